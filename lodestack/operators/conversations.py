"""Conversations, activity and provenance lookups (W03, W08, P15, P19 to P22, T-10, J09, J11, J12, K05, K06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY, TITLE_EVERY, SHORT_WORDS = 20, 6, 8


def last_messages(messages: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last n messages of each conversation, with their place from the end."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= n)


def follow_up_queries(messages: DataFrame) -> DataFrame:
    """User messages with the query to search: a short one takes the user message before it along."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    u = messages.withColumn("_prev", prev).withColumn("_n", words).where("role = 'user'")
    q = F.when((F.col("_n") <= SHORT_WORDS) & F.col("_prev").isNotNull(), F.concat("_prev", F.lit(" "), "text")).otherwise(F.col("text"))
    return u.withColumn("query", q).drop("_prev", "_n")


def title_refresh(messages: DataFrame) -> DataFrame:
    """Messages after which the title is made anew: the count, capped at the history's length, is 2 or a multiple of 6."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    n = F.least(F.count(F.lit(1)).over(w), F.lit(HISTORY))
    return messages.withColumn("n", n).where((F.col("n") == 2) | (F.col("n") % TITLE_EVERY == 0))


def context_sources(documents: Column, memory: Column, attachment: Column, web: Column) -> Column:
    return F.array_compact(F.array(F.when(documents, "documents"), F.when(memory, "memory"), F.when(attachment, "attachment"), F.when(web, "web")))


def newest(df: DataFrame, order: str, ident: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(order), ident).limit(n)


def source_label(member: Column, root: Column, title: Column) -> Column:
    """Last part of the first occurrence's path, else the title."""
    return F.coalesce(F.element_at(F.split(F.replace(F.coalesce(member, root), F.lit("\\"), F.lit("/")), "/"), -1), title)


def citing_messages(messages: DataFrame) -> DataFrame:
    """document_id, message_id of all citations: null and repeated ones count once."""
    return messages.select("message_id", F.explode("citations").alias("c")).select(F.col("c.document_id").alias("document_id"), "message_id").where("document_id is not null").distinct()


def provenance_trace(documents: DataFrame, jobs: DataFrame, chunks: DataFrame, citations: DataFrame) -> DataFrame:
    """A row a document: its import job, how many chunks it has and how many messages cite it."""
    n = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    c = citations.groupBy("document_id").agg(F.count(F.lit(1)).alias("citing"))
    j = documents.join(jobs, "job_id", "left").join(n, "document_id", "left").join(c, "document_id", "left")
    return j.withColumn("chunks", F.coalesce("chunks", F.lit(0))).withColumn("citing", F.coalesce("citing", F.lit(0)))


#: Version of the snapshot's format.
SNAPSHOT = 1
_TURNS = "conv_id long, messages array<struct<turn:long,role:string,text:string>>"
_MEMORIES = "memory_id long, content string"


def export_snapshot(messages: DataFrame, path: str, memories: DataFrame | None = None) -> None:
    """``path``/conversations (one JSON object a conversation) and ``path``/memories; the manifest, with version and counts, is written last."""
    spark = messages.sparkSession
    g = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    g.write.mode("errorifexists").json(f"{path}/conversations")
    kept = memories.select("memory_id", "content") if memories is not None else spark.createDataFrame([], _MEMORIES)
    kept.write.mode("errorifexists").json(f"{path}/memories")
    counts = [spark.read.schema(kind).json(f"{path}/{name}").count() for name, kind in (("conversations", _TURNS), ("memories", _MEMORIES))]
    spark.createDataFrame([(SNAPSHOT, *counts)], "version int, conversations long, memories long").coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def restore_snapshot(spark, path: str, into: DataFrame) -> DataFrame:
    """Messages of a snapshot, only where ``into`` is empty; a snapshot without a manifest, of another version or not whole is refused."""
    if not into.isEmpty():
        raise ValueError("restore needs empty tables")
    m = spark.read.schema("version int, conversations long, memories long").json(f"{path}/manifest").first()
    if m is None or m.version != SNAPSHOT:
        raise ValueError("a snapshot of another version")
    rows = spark.read.schema(_TURNS).json(f"{path}/conversations")
    if rows.count() != m.conversations or restore_memories(spark, path).count() != m.memories:
        raise ValueError("the snapshot is not whole")
    return rows.select("conv_id", F.explode("messages").alias("m")).select("conv_id", "m.*")


def restore_memories(spark, path: str) -> DataFrame:
    return spark.read.schema(_MEMORIES).json(f"{path}/memories")
