"""Ingest: chunks, upserts and the cache of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as T


#: Chunk ids for each document: texts of up to some 800 million characters.
WIDE = 1_000_000


def chunk_documents(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """document_id, text -> chunk_id, document_id, chunk_index, content.

    A chunk's id follows from its document's: WIDE ids are set aside for each document. A text with
    more chunks, or a document_id too large for this, is refused, so that no two chunks share an id.
    """
    c = docs.select("document_id", F.posexplode(T.chunks(F.col("text"), size, overlap)).alias("chunk_index", "content"))
    fits = (F.col("chunk_index") < WIDE) & F.col("document_id").between(-(2**63) // WIDE + 1, 2**63 // WIDE - 1)
    ident = F.when(fits, F.col("document_id") * WIDE + F.col("chunk_index")).otherwise(F.raise_error(F.lit("too many chunks, or too large a document_id, for a chunk_id")))
    return c.select(ident.alias("chunk_id"), "document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content")


def chunk_signature(docs: DataFrame, size: int = 1000, overlap: int = 200) -> tuple[int, int | None]:
    """(number of chunks, greatest chunk_id) that ``chunk_documents`` would give, from lengths alone: nothing is cut."""
    n = F.length(T.strip(F.col("text")))
    last = F.greatest(F.ceil((n - size) / F.lit(size - overlap)), F.lit(0)).cast("long")
    some = docs.select("document_id", n.alias("n"), last.alias("last")).where("n > 0")
    r = some.agg(F.coalesce(F.sum(F.col("last") + 1), F.lit(0)).alias("n"), F.max(F.col("document_id") * WIDE + F.col("last")).alias("last")).first()
    return int(r.n), r["last"]


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Existing rows, and of the new ones the first of each key that is not there yet (least by ``order``, then by all columns)."""
    rest = [c for c in existing.columns if c not in keys and c not in order]
    first = new.groupBy(*keys).agg(F.min(F.struct(*[c for c in order if c not in keys], *rest)).alias("_r")).select(*keys, "_r.*")
    return existing.unionByName(first.join(existing.select(*keys).distinct(), keys, "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the greatest version of each key; a new row wins a tie. An aggregate, so that a hot key combines before the shuffle."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in keys and c != version]
    top = both.groupBy(*keys).agg(F.max(F.struct(version, "_new", *rest)).alias("_r"))
    return top.select(*keys, "_r.*").select(*existing.columns)


def replace_groups(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete-then-insert: all existing rows of a key that has new rows go."""
    return existing.join(new.select(key).distinct(), key, "left_anti").select(*existing.columns).unionByName(new)


def write_once(rows: DataFrame, column: str, updates: DataFrame, key: str) -> DataFrame:
    """Set a column where it is null; ``conflict`` marks updates of a row that holds another value."""
    u = updates.select(key, F.col(column).alias("_new"))
    j = rows.join(u, key, "left")
    return j.withColumn("conflict", F.col(column).isNotNull() & F.col("_new").isNotNull() & (F.col(column) != F.col("_new"))).withColumn(column, F.coalesce(column, "_new")).drop("_new")


def cache_key(model: str, text) -> F.Column:
    return F.sha2(F.concat_ws(":", F.lit(model), text), 256)


def cached_embeddings(texts: DataFrame, cache: DataFrame, model: str, dimension: int, embed) -> DataFrame:
    """Read-through: id, text -> id, embedding. Only distinct texts without a vector of the right size reach ``embed`` (key, text -> key, embedding)."""
    keyed = texts.withColumn("key", cache_key(model, F.col("text")))
    good = cache.where(F.size("embedding") == dimension).select("key", "embedding")
    missing = keyed.select("key", "text").dropDuplicates(["key"]).join(good, "key", "left_anti")
    return keyed.join(good.unionByName(embed(missing).select("key", "embedding")), "key", "left").select("id", "embedding")
