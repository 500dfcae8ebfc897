"""Retrieval: dense and BM25 top-k, reciprocal-rank fusion, hybrid search (T-1 to T-5, T-7, W11, F06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import tokens
from lodestack.operators import vectors
from lodestack.operators.dedup import cosine_distance
from lodestack.operators.shared import shared_dir

#: The parameters of Okapi BM25 and of reciprocal-rank fusion.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
POOL = 50
#: Queries (or their terms) are broadcast only up to so many rows; more are taken in blocks of that size.
QUERIES = 20_000


def _blocks(queries: DataFrame, key: str, most: int = QUERIES) -> list[DataFrame]:
    """The queries as blocks that may be broadcast: their number was counted."""
    n = -(-queries.count() // most)
    return [F.broadcast(queries)] if n <= 1 else [F.broadcast(queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)) for i in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ranked(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each query with their rank (the limit prunes within tasks first)."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(0, k))


def dense_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """chunks (chunk_id, embedding), queries (query_id, q) -> query_id, chunk_id, distance, rank.

    An exact scan by products of blocks (``vectors.nearest``): a task gives k rows a query, which are
    ranked after. Chunks without a vector, or with one of another size than the query's, are left out;
    k <= 0 gives nothing; the distance to or of a zero vector is null and comes last.
    """
    hits = vectors.nearest(chunks if k > 0 else chunks.limit(0), queries, max(1, k))
    return _ranked(hits, k, F.asc_nulls_last("distance"), "chunk_id")


def term_stats(chunks: DataFrame) -> DataFrame:
    """chunk_id, content -> term, df, and in the row of the empty term: df the number of chunks, tokens their number of tokens.

    One pass over the chunks: each gives its distinct terms and a row of its own, which combine
    before the shuffle.
    """
    w = chunks.select(tokens(F.coalesce("content", F.lit(""))).alias("w"))
    rows = F.concat(F.array(F.struct(F.lit("").alias("term"), F.size("w").cast("long").alias("n"))), F.transform(F.array_distinct("w"), lambda x: F.struct(x.alias("term"), F.lit(0).cast("long").alias("n"))))
    return w.select(F.explode_outer(rows).alias("r")).groupBy("r.term").agg(F.count(F.lit(1)).alias("df"), F.sum("r.n").alias("tokens"))


def _weights(stats: DataFrame, asked: DataFrame) -> DataFrame:
    """term, idf, avgdl of the terms asked for. A negative idf becomes EPSILON times the mean idf over all terms."""
    whole = stats.where("term = ''").select(F.col("df").alias("n"), (F.col("tokens") / F.col("df")).alias("avgdl"))  # one row
    raw = stats.where("term <> ''").join(F.broadcast(whole), F.lit(True)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    some = raw.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    return some.join(F.broadcast(mean), F.lit(True)).select("term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (query_id, query) -> query_id, chunk_id, score of every chunk with a query term; a repeated term counts again.

    Two passes over the chunks: document frequencies of all terms, then the terms asked for, met
    before anything is aggregated. Queries go in blocks of a counted size.
    """
    shared_dir(chunks.sparkSession)
    stats = term_stats(chunks).checkpoint()  # three of its uses would each read the chunks
    words = chunks.select("chunk_id", tokens(F.col("content")).alias("w"))
    posts = words.select("chunk_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    tf, parts = F.col("tf"), []
    for block in _blocks(queries.select("query_id", "query"), "query_id", QUERIES // 20):
        asked = block.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
        hits = posts.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
        weighed = asked.join(F.broadcast(_weights(stats, asked)), "term")
        s = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        parts.append(hits.join(F.broadcast(weighed), "term").groupBy("query_id", "chunk_id").agg(F.sum(s).alias("score")))
    return _union(parts)


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int, positive: bool = False) -> DataFrame:
    """``positive``: only scores above zero (the experiment's variant)."""
    s = bm25_scores(chunks, queries)
    # Rounded before ranking, so that the order of a sum's terms cannot swap equal scores.
    s = s.where("score > 0") if positive else s
    return _ranked(s.withColumn("score", F.round("score", 6)), k, F.desc("score"), "chunk_id")


def rrf(ranked: list[DataFrame], k: int, item: str = "chunk_id") -> DataFrame:
    """Ranked lists (query_id, item, rank) -> query_id, item, score, best, rank; ties: best rank, then the id as a string."""
    both = ranked[0].select("query_id", item, "rank")
    for x in ranked[1:]:
        both = both.unionByName(x.select("query_id", item, "rank"))
    f = both.groupBy("query_id", item).agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best"))
    return _ranked(f, k, F.desc("score"), "best", F.col(item).cast("string"))


def hybrid_topk(chunks: DataFrame, queries: DataFrame, k: int, lexical=None) -> DataFrame:
    """queries (query_id, query, q): each arm gives max(POOL, k) candidates, fused; every hit has its real distance.

    ``lexical`` (queries, k) -> ranked hits takes the place of the scan by BM25, as ``search_index.search`` does.
    """
    pool = max(POOL, k)
    asked = queries.select("query_id", "query")
    fused = rrf([dense_topk(chunks, queries.select("query_id", "q"), pool), lexical(asked, pool) if lexical else bm25_topk(chunks, asked, pool)], k)
    back = fused.join(queries.select("query_id", "q"), "query_id").join(chunks.select("chunk_id", "embedding"), "chunk_id")
    return back.select("query_id", "chunk_id", "rank", "score", cosine_distance("embedding", "q").alias("distance"))


def or_match(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """terms (term, ...) x asked (query_id, term): rows of every query that asks for their term."""
    return _union([terms.join(b, "term") for b in _blocks(asked, "term")])


def rank_documents(ranked: DataFrame, chunk_docs: DataFrame) -> DataFrame:
    """Collapse a chunk ranking to documents: each document's best chunk, ranked anew."""
    d = ranked.join(chunk_docs, "chunk_id").groupBy("query_id", "document_id").agg(F.min("rank").alias("best"))
    w = Window.partitionBy("query_id").orderBy("best", "document_id")
    return d.withColumn("rank", F.row_number().over(w))


def rerank(ranked: DataFrame, score) -> DataFrame:
    """Order a pool anew by ``score``, a column expression or pandas UDF column of a model that the caller has."""
    w = Window.partitionBy("query_id").orderBy(F.desc("model_score"), "rank")
    return ranked.withColumn("model_score", score).withColumn("rank", F.row_number().over(w))
