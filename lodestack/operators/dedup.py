"""Exact and near duplicates of documents (A01, A02, J03, J04, W04, T-9, F18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.vectors import near_pairs


def exact_groups(docs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Values of ``key`` found more than once: key, n, first (least by ``order``); nulls are no group.

    One partial aggregate and a shuffle of the keys; members are not gathered.
    """
    g = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    return g.where("n > 1")


def keep_oldest_plan(docs: DataFrame, key: str, order: list[str], ident: str) -> DataFrame:
    """A row for each document of an exact group: keep_id, action KEEP or DELETE, n.

    The aggregate's groups are joined back (AQE splits a hot key), so no group is sorted in one task.
    """
    g = exact_groups(docs, key, [*order, ident]).select(F.col(key).alias("_k"), "n", F.col(f"first.{ident}").alias("keep_id"))
    j = docs.join(g, F.col(key) == F.col("_k"))
    return j.withColumn("action", F.when(F.col(ident) == F.col("keep_id"), "KEEP").otherwise("DELETE")).drop("_k")


def reason(n: Column, keep: Column) -> Column:
    return F.format_string("exact duplicate of %s (%d copies)", keep.cast("string"), n)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: str, b: str) -> Column:
    """1 - cosine; null where a vector is zero."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def near_duplicate_documents(chunks: DataFrame, similarity: float = 0.95, limit: int = 50) -> DataFrame:
    """chunks (document_id, chunk_index, embedding) -> a, b, distance: the nearest ``limit`` pairs of documents by their first chunks (the limit is the feature)."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    first = chunks.where("chunk_index = 0").select("document_id", "embedding")
    return near_pairs(first, "document_id", "embedding", 1 - similarity).orderBy("distance", "a", "b").limit(limit)
