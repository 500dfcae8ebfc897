"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import written


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``links`` (columns ``a``, ``b``: longs, undirected) -> node, component (the least node reachable).

    Only nodes with a link to another node are listed. Loops and repeated links do no harm; rows
    with a null end are ignored. A step takes the least neighbour by an aggregate, which combines
    before the shuffle; no neighbourhood is gathered. The number of steps grows with the logarithm
    of the longest path, and each step's links are written, so that lineage stays short.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    e = written(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi.alias("u"), lo.alias("v")).distinct(), "links")
    state = None
    while True:
        # Large star: each greater neighbour of u is linked to u's least neighbour (or u).
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e1 = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # Small star: u and its smaller neighbours are linked to the least of them.
        least = e1.groupBy("u").agg(F.min("v").alias("m"))
        e = written(e1.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct(), "small")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
