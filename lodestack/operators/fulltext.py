"""Ranked full text: positions of plain words, minimal covers and their density (T-6).

A document's words are numbered from 1. A cover of a query is a shortest stretch of words that satisfies
it: for any of its terms (``any``) each place of a term, for all of them (``all``) each stretch that holds
every term and has no shorter one inside. A cover counts the less the more other words it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.retrieval import _blocks, _ranked, _union

# The weight of a place, the last place that is told apart, and the places kept of a term in a document.
WEIGHT, LAST_PLACE, PLACES = 0.1, 16383, 255


def words(c) -> F.Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def positions(docs: DataFrame, ident: str, text: str, some: DataFrame | None = None) -> DataFrame:
    """ident, term, pos: places of all words, or of those in ``some`` (term; few); beyond LAST_PLACE they are one place, and a term has PLACES of them at most in a document.

    The number of a term's places before is counted in its own document and term, so no document is sorted whole.
    Places are dealt out by document once, and all that follows stays there.
    """
    p = docs.select(ident, F.posexplode(words(F.coalesce(text, F.lit("")))).alias("i", "term"))
    p = p if some is None else p.join(F.broadcast(some), "term", "left_semi")
    p = p.select(ident, "term", F.least(F.col("i") + 1, F.lit(LAST_PLACE)).alias("pos")).repartition(ident).distinct()
    nth = F.row_number().over(Window.partitionBy(ident, "term").orderBy("pos"))
    return p.withColumn("_n", nth).where(F.col("_n") <= PLACES).drop("_n")


def asked_terms(queries: DataFrame) -> DataFrame:
    """queries (query_id, query) -> query_id, term, m: their different terms and how many."""
    q = queries.select("query_id", F.array_distinct(words(F.coalesce("query", F.lit("")))).alias("t"))
    return q.select("query_id", F.size("t").alias("m"), F.explode("t").alias("term"))


def covers(hits: DataFrame, ident: str, need: str = "any") -> DataFrame:
    """hits (query_id, m, ident, term, pos) -> query_id, ident, start, end, inside: minimal covers and the query's places in each.

    For ``all``: the cover that ends at a place starts where the term that was met longest ago was last met;
    it is minimal if no earlier end has the same start. Only documents that have every term are looked at.
    """
    if need == "any":
        return hits.select("query_id", ident, F.col("pos").alias("start"), F.col("pos").alias("end"), F.lit(1).cast("long").alias("inside")).distinct()
    if need != "all":
        raise ValueError("need is any or all")
    whole = Window.partitionBy("query_id", ident)
    order = whole.orderBy("pos")
    full = hits.withColumn("terms", F.collect_set("term").over(whole)).where(F.size("terms") == F.col("m"))
    places = full.groupBy("query_id", ident, "pos").agg(F.max("m").alias("m"), F.first("terms").alias("terms"), F.collect_set("term").alias("own"))
    # Each place with each of the query's terms, and where that term was last met.
    wide = places.withColumn("nth", F.row_number().over(order)).withColumn("term", F.explode("terms"))
    at = F.when(F.array_contains("own", F.col("term")), F.struct("pos", "nth"))
    wide = wide.withColumn("last", F.last(at, ignorenulls=True).over(Window.partitionBy("query_id", ident, "term").orderBy("pos")))
    ends = wide.groupBy("query_id", ident, "pos", "m", "nth").agg(F.count("last").alias("met"), F.min("last").alias("first")).where("met = m")
    ends = ends.select("query_id", ident, "pos", "nth", F.col("first.pos").alias("start"), F.col("first.nth").alias("first"))
    ends = ends.withColumn("before", F.lag("start").over(order)).where("before is null or start > before")
    return ends.select("query_id", ident, "start", F.col("pos").alias("end"), (F.col("nth") - F.col("first") + 1).cast("long").alias("inside"))


def cover_density(found: DataFrame, ident: str) -> DataFrame:
    """query_id, ident, score: the sum over covers of WEIGHT / (1 + words inside that are not the query's)."""
    noise = F.col("end") - F.col("start") - (F.col("inside") - 1)
    # Beyond the last place several words share one: half of the cover stands for what is not known.
    noise = F.when(noise < 0, F.floor((F.col("inside") - 1) / 2)).otherwise(noise)
    return found.groupBy("query_id", ident).agg(F.sum(F.lit(WEIGHT) / (1 + noise)).alias("score"))


def fulltext_topk(docs: DataFrame, queries: DataFrame, k: int, ident: str = "chunk_id", text: str = "content", need: str = "any") -> DataFrame:
    """docs (ident, text), queries (query_id, query) -> query_id, ident, score, rank: the first k by cover density, ties by id.

    ``any``: documents with a term of the query; ``all``: those with every term. Nulls are empty.
    """
    # Only places of terms that are asked for are dealt out.
    hits = _union([positions(docs, ident, text, b.select("term").distinct()).join(b, "term") for b in _blocks(asked_terms(queries), "term")])
    s = cover_density(covers(hits, ident, need), ident).withColumn("score", F.round("score", 6))
    return _ranked(s, k, F.desc("score"), ident)
