"""A search index for BM25: postings in segments with their maxima, written once, added to, and searched by pruned top-k (T-2, T-3, A22).

A folder holds three tables:

``postings``  batch, bucket of the term; term, seg, n, max_tf, min_dl, and the postings (ids, tfs, dls). A segment is
              a set of about SEGMENT chunks of a batch, so a row is bounded; a frequent term has many rows.
              The empty term is in every chunk, once: it gives the number of chunks and their lengths.
``terms``     batch, bucket; term, df.
``commits``   version, the batches that it has, their signature (chunks, last id), tokens, and the mean raw idf.

A commit is written last and names its batches, so a build that was lost leaves nothing that a reader sees.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lodestack.functions.text import tokens
from lodestack.operators.retrieval import EPSILON, K1, B, _blocks, _ranked, _union

BUCKETS, SEGMENT = 64, 4096
#: Segments whose postings of a bucket go to one task together, and how many such sets a task has on average.
FILE_SEGMENTS, FILE_BUCKETS = 128, 4
#: Segments of a query that are scored first, to learn how good a k-th hit is.
PROBED = 2
_COMMIT = "version long, batches array<string>, buckets int, n long, last long, tokens long, mean_idf double"
_POSTINGS = "term string, seg int, n long, max_tf long, min_dl long, ids array<bigint>, tfs array<bigint>, dls array<bigint>, batch string, bucket int"
_TERMS = "term string, df long, batch string, bucket int"


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str
    version: int
    batches: tuple[str, ...]
    buckets: int
    n: int
    last: int | None
    tokens: int
    mean_idf: float

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}").where(F.col("batch").isin(*self.batches))

    def postings(self) -> DataFrame:
        return self._read("postings", _POSTINGS)

    def terms(self) -> DataFrame:
        return self._read("terms", _TERMS)

    @property
    def signature(self) -> tuple[int, int | None]:
        return self.n, self.last


def signature(chunks: DataFrame) -> tuple[int, int | None]:
    """(chunks, last id): chunks are never edited in place, so any change alters one of them."""
    return tuple(chunks.agg(F.count(F.lit(1)), F.max("chunk_id")).first())


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def segment_rows(chunks: DataFrame, segments: int) -> DataFrame:
    """term, seg, n, max_tf, min_dl, p (its postings in order of ids): a row a term and segment.

    Chunks meet in their segments first, as texts: both aggregates then stay in tasks of bounded size, and no token is shuffled.
    """
    seg = F.pmod(F.xxhash64(F.col("chunk_id").cast("long")), F.lit(segments)).cast("int")
    met = chunks.select("chunk_id", "content").withColumn("seg", seg).repartition(segments, "seg")
    w = met.select(F.col("chunk_id").cast("long").alias("chunk_id"), "seg", tokens(F.coalesce("content", F.lit(""))).alias("w"))
    each = w.select("chunk_id", "seg", F.size("w").cast("long").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "w")).alias("term"))
    posts = each.groupBy("term", "seg", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return posts.groupBy("term", "seg").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.sort_array(F.collect_list(F.struct("chunk_id", "tf", "dl"))).alias("p"))


def _write_batch(chunks: DataFrame, path: str, buckets: int, n: int) -> str:
    """Postings and terms of a batch; its name."""
    batch, segments = uuid.uuid4().hex, max(1, -(-n // SEGMENT))
    groups = -(-segments // FILE_SEGMENTS)
    tasks = groups * -(-buckets // FILE_BUCKETS)
    rows = segment_rows(chunks, segments)
    rows = rows.select("term", "seg", "n", "max_tf", "min_dl", F.col("p.chunk_id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"), F.lit(batch).alias("batch"), _bucket("term", buckets).alias("bucket"))
    # A bucket's rows are dealt out by groups of segments, so no frequent term makes one file large; a term's rows lie together in each.
    rows.repartition(tasks, "bucket", F.floor(F.col("seg") / FILE_SEGMENTS)).sortWithinPartitions("bucket", "term", "seg").write.partitionBy("batch", "bucket").mode("append").parquet(f"{path}/postings")
    written = chunks.sparkSession.read.schema(_POSTINGS).parquet(f"{path}/postings").where(F.col("batch") == batch)
    df = written.groupBy("batch", "bucket", "term").agg(F.sum("n").alias("df")).select("term", "df", "batch", "bucket")
    df.repartition(tasks, "bucket", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(groups))).sortWithinPartitions("bucket", "term").write.partitionBy("batch", "bucket").mode("append").parquet(f"{path}/terms")
    return batch


def _raw(n, df):
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _commit(spark: SparkSession, path: str, batches: list[str], buckets: int, version: int) -> SearchIndex:
    whole = SearchIndex(spark, path, version, tuple(batches), buckets, 0, None, 0, 0.0)
    own = whole.postings().where((F.col("bucket") == _bucket(F.lit(""), buckets)) & (F.col("term") == ""))
    sums = own.agg(F.sum("n"), F.max(F.array_max("ids")), F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n, last, total = sums[0] or 0, sums[1], sums[2] or 0
    df = whole.terms().where("term <> ''").groupBy("bucket", "term").agg(F.sum("df").alias("df"))
    mean = df.agg(F.avg(_raw(F.lit(n), F.col("df")))).first()[0] or 0.0
    spark.createDataFrame([(version, batches, buckets, n, last, total, mean)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return SearchIndex(spark, path, version, tuple(batches), buckets, n, last, total, mean)


def build_index(chunks: DataFrame, path: str, buckets: int = BUCKETS, n: int | None = None) -> SearchIndex:
    """chunks (chunk_id: integer, unique; content) -> a new version of the index at ``path`` that has these chunks alone. Null content is empty. ``n``: their number, if known."""
    old = open_index(chunks.sparkSession, path)
    batch = _write_batch(chunks, path, buckets, chunks.count() if n is None else n)
    return _commit(chunks.sparkSession, path, [batch], buckets, 1 + (old.version if old else 0))


def add_to_index(index: SearchIndex, chunks: DataFrame) -> SearchIndex:
    """A new version that also has ``chunks`` (of ids that the index has not): only they are read."""
    batch = _write_batch(chunks, index.path, index.buckets, chunks.count())
    return _commit(index.spark, index.path, [*index.batches, batch], index.buckets, index.version + 1)


def open_index(spark: SparkSession, path: str, version: int | None = None) -> SearchIndex | None:
    """The last version (or that one) of the index at ``path``; None if there is none."""
    try:
        rows = spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    r = (rows if version is None else rows.where(F.col("version") == version)).orderBy(F.desc("version")).first()
    return SearchIndex(spark, path, r.version, tuple(r.batches), r.buckets, r.n, r.last, r.tokens, r.mean_idf) if r else None


def current_index(chunks: DataFrame, path: str, buckets: int = BUCKETS, known: tuple[int, int | None] | None = None) -> SearchIndex:
    """The index at ``path`` if its signature is that of ``chunks``, else a new one. ``known``: the signature, where the caller has it for less than a count of ``chunks``."""
    index = open_index(chunks.sparkSession, path)
    known = known or signature(chunks)
    return index if index and index.signature == known else build_index(chunks, path, buckets, known[0])


def _asked(index: SearchIndex, queries: DataFrame) -> tuple[DataFrame, list[int]]:
    """query_id, term, bucket, w (times asked x idf) of the terms that the index has; the buckets to read."""
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = asked.withColumn("bucket", _bucket("term", index.buckets))
    buckets = sorted(r.bucket for r in asked.select("bucket").distinct().collect())  # index.buckets at most
    some = index.terms().where(F.col("bucket").isin(*buckets)).join(F.broadcast(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
    raw = _raw(F.lit(index.n), F.sum("df"))
    idf = some.groupBy("bucket", "term").agg(F.when(raw < 0, EPSILON * F.lit(index.mean_idf)).otherwise(raw).alias("idf"))
    return asked.join(F.broadcast(idf), ["bucket", "term"]).select("query_id", "term", "bucket", (F.col("times") * F.col("idf")).alias("w")), buckets


def _gain(tf, dl, index: SearchIndex):
    """What a posting's frequency and length make of its term's weight: grows with tf, falls with dl."""
    average = index.tokens / index.n if index.tokens else 1.0
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(average)))


def _scores(index: SearchIndex, rows: DataFrame, asked: DataFrame, segments: DataFrame | None) -> DataFrame:
    """query_id, chunk_id, score of the postings of the terms asked for, in the ``segments`` (query_id, batch, seg) given."""
    hits = rows.join(F.broadcast(asked), ["bucket", "term"])
    if segments is not None:
        hits = hits.join(segments, ["query_id", "batch", "seg"], "left_semi")
    p = hits.select("query_id", "w", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
    return p.groupBy("query_id", F.col("p.ids").alias("chunk_id")).agg(F.sum(F.col("w") * _gain(F.col("p.tfs"), F.col("p.dls"), index)).alias("score"))


def segment_bounds(index: SearchIndex, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, batch, seg, bound: no chunk of the segment scores higher for the query. Reads maxima alone, no postings."""
    best = F.greatest(F.lit(0.0), F.col("w") * _gain(F.col("max_tf"), F.col("min_dl"), index))
    return rows.join(F.broadcast(asked), ["bucket", "term"]).groupBy("query_id", "batch", "seg").agg(F.sum(best).alias("bound"))


def surviving_segments(index: SearchIndex, rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, batch, seg of all segments that may hold one of a query's first k chunks: the k-th score of the few segments of highest bound is a bound from below."""
    bounds = segment_bounds(index, rows, asked)
    first = bounds.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "batch", "seg"))).where(F.col("nth") <= PROBED)
    probe = _ranked(_scores(index, rows, asked, first.select("query_id", "batch", "seg")), k, F.desc("score"), "chunk_id")
    least = probe.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    # Scores are ranked after rounding to six places.
    return bounds.join(F.broadcast(least), "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-5)).select("query_id", "batch", "seg")


def search(index: SearchIndex, queries: DataFrame, k: int, positive: bool = False) -> DataFrame:
    """queries (query_id, query) -> query_id, chunk_id, score, rank: the rows that ``retrieval.bm25_topk`` gives over all chunks.

    Only the buckets of the terms asked for are read: their maxima first, then the postings of the
    segments that survive. Queries go in blocks of a counted size. ``positive``: scores above zero only.
    """
    parts = []
    for block in _blocks(queries.select("query_id", "query"), "query_id", 1000):
        asked, buckets = _asked(index, block)
        rows = index.postings().where(F.col("bucket").isin(*buckets))
        parts.append(_scores(index, rows, asked, surviving_segments(index, rows, asked, max(1, k))))
    s = _union(parts).withColumn("score", F.round("score", 6))
    return _ranked(s.where("score > 0") if positive else s, k, F.desc("score"), "chunk_id")
