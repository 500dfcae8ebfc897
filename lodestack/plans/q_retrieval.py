"""Queries: duplicates of documents, chunks, tokens, retrieval and its evaluation."""

from __future__ import annotations

import zlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import dedup, evaluate, fulltext, ingest, retrieval, search_index
from lodestack.operators.shared import shared_dir
from lodestack.plans.testdata import CHUNKS_SQL, chunks, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicate_groups(s, d):
    return dedup.exact_groups(_docs(s, d), "content_hash", ["doc_id"]).select("content_hash", "n", F.col("first.doc_id").alias("first_id"))


@query("""
WITH g AS (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS n, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents)
SELECT sha256(text) AS content_hash, doc_id, keep_id, n, CASE WHEN doc_id = keep_id THEN 'KEEP' ELSE 'DELETE' END AS action,
  'exact duplicate of ' || CAST(keep_id AS VARCHAR) || ' (' || CAST(n AS VARCHAR) || ' copies)' AS reason FROM g WHERE n > 1""")
def exact_duplicate_plan(s, d):
    p = dedup.keep_oldest_plan(_docs(s, d), "content_hash", [], "doc_id")
    return p.select("content_hash", "doc_id", "keep_id", "n", "action", dedup.reason(F.col("n"), F.col("keep_id")).alias("reason"))


# Every vector, and a copy of it that is a little off.
_TWICE = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE WHEN i = 1 + vec_id % 64 THEN x + 0.25 ELSE x END) FROM embeddings)"


def _twice(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return e.unionByName(e.select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.transform("embedding", lambda x, i: F.when(i == F.col("vec_id") % 64, x + 0.25).otherwise(x)).alias("embedding")))


@query(f"WITH {_TWICE} SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_cosine_similarity(a.e, b.e), 6) AS distance FROM v a JOIN v b ON a.vec_id < b.vec_id AND 1 - list_cosine_similarity(a.e, b.e) < 0.05")
def near_duplicate_pairs(s, d):
    return dedup.near_pairs(_twice(s, d), "vec_id", "embedding", 0.05).select("a", "b", F.round("distance", 6).alias("distance"))


@query(f"WITH {_TWICE} SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_cosine_similarity(a.e, b.e), 6) AS distance FROM v a JOIN v b ON a.vec_id < b.vec_id AND 1 - list_cosine_similarity(a.e, b.e) < 0.05 ORDER BY 1 - list_cosine_similarity(a.e, b.e), a, b LIMIT 50")
def near_duplicate_documents(s, d):
    c = _twice(s, d).select(F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding")
    return dedup.near_duplicate_documents(c).select("a", "b", F.round("distance", 6).alias("distance"))


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, document_id, chunk_index, sha256(content) AS content_sha, length(content) AS chars FROM chunks")
def chunk_documents(s, d):
    return chunks(s, d).select("chunk_id", "document_id", "chunk_index", F.sha2("content", 256).alias("content_sha"), F.length("content").cast("long").alias("chars"))


@query(f"WITH {CHUNKS_SQL} SELECT d.doc_id AS document_id, count(c.chunk_id) AS n FROM documents d LEFT JOIN chunks c ON d.doc_id = c.document_id GROUP BY d.doc_id")
def chunk_counts(s, d):
    n = chunks(s, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    docs = table(s, d, "documents").select(F.col("doc_id").alias("document_id"))
    return docs.join(n, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_terms FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents)")
def token_stats(s, d):
    t = table(s, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_terms"))


@query("SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents) GROUP BY term HAVING count(*) >= 2")
def vocabulary(s, d):
    w = table(s, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("term"))
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("""
SELECT item_id, coalesce(string_agg(t, ' | ' ORDER BY p), '') AS q FROM (
  SELECT item_id, t, min(p) AS p FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t, unnest(range(len(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS p FROM benchmark) GROUP BY ALL) GROUP BY item_id""")
def or_tsquery(s, d):
    return table(s, d, "benchmark").select("item_id", T.or_query(F.col("text")).alias("q"))


_BM25 = CHUNKS_SQL + r""",
toks AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS term FROM chunks),
dl AS (SELECT c.chunk_id, len(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS dl FROM chunks c),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
post AS (SELECT chunk_id, term, count(*) AS tf FROM toks GROUP BY ALL),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, tot GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark WHERE item_id % 100 = 0) GROUP BY ALL),
score AS (SELECT query_id, p.chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN post p USING (term) JOIN idf USING (term) JOIN dl USING (chunk_id), tot GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM score)"""


def _asked(s, d):
    return table(s, d, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _index(s, d, c, name="chunks"):
    """The application's index of these chunks: written by the first query that asks, used while its signature holds."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    docs = docs.join(table(s, d, "embeddings").select(F.col("vec_id").alias("document_id")), "document_id") if name == "paired" else docs
    return search_index.current_index(c, known=ingest.chunk_signature(docs), path=f"{shared_dir(s)}/search-{name}-{s.sparkContext.applicationId}-{zlib.crc32(d.encode()):08x}")


@query(f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 20")
def bm25_topk(s, d):
    return search_index.search(_index(s, d, chunks(s, d)), _asked(s, d), 20)


@query(f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 20")
def bm25_scan_topk(s, d):
    """Without an index: two passes over the chunks."""
    return retrieval.bm25_topk(chunks(s, d), _asked(s, d), 20)


@query(f"WITH {_BM25} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM score WHERE score > 0 QUALIFY rank <= 10")
def bm25_positive_topk(s, d):
    return search_index.search(_index(s, d, chunks(s, d)), _asked(s, d), 10, positive=True)


_DENSE = """vec AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
qs AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0),
dense AS (SELECT query_id, chunk_id, 1 - list_cosine_similarity(e, q) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_cosine_similarity(e, q), chunk_id) AS rank FROM vec, qs)"""


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _asked_vectors(s, d):
    return table(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(f"WITH {_DENSE} SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM dense WHERE rank <= 20")
def dense_topk(s, d):
    return retrieval.dense_topk(_vectors(s, d), _asked_vectors(s, d), 20).withColumn("distance", F.round("distance", 6))


# A document's chunks take the vector of its number: the tables pair no text with a vector otherwise.
_PAIRED = CHUNKS_SQL.replace("chunks AS", "allchunks AS") + ", chunks AS (SELECT chunk_id, document_id, content, embedding FROM allchunks JOIN embeddings ON document_id = vec_id)"
_HYBRID = _PAIRED + "," + _BM25.split(CHUNKS_SQL + ",", 1)[1] + "," + _DENSE + """,
fused AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) AS best FROM (
  SELECT query_id, chunk_id, rank FROM dense WHERE rank <= 50 UNION ALL SELECT query_id, chunk_id, rank FROM bm WHERE rank <= 50) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, CAST(chunk_id AS VARCHAR)) AS rank FROM fused)"""
_HYBRID = _HYBRID.replace("vec AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)", "vec AS (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM chunks)")


def _paired(s, d):
    return chunks(s, d).join(table(s, d, "embeddings"), F.col("vec_id") == F.col("document_id")).select("chunk_id", "document_id", "content", "embedding")


@query(f"WITH {_HYBRID} SELECT query_id, chunk_id, score, best, rank FROM top WHERE rank <= 20")
def rrf_fusion(s, d):
    c = _paired(s, d)
    return retrieval.rrf([retrieval.dense_topk(c, _asked_vectors(s, d), 50), search_index.search(_index(s, d, c, "paired"), _asked(s, d), 50)], 20)


@query(f"WITH {_HYBRID} SELECT t.query_id, t.chunk_id, t.rank, t.score, round(1 - list_cosine_similarity(e, q), 6) AS distance FROM top t JOIN vec USING (chunk_id) JOIN qs USING (query_id) WHERE t.rank <= 10 AND t.query_id IN (SELECT item_id FROM benchmark)")
def hybrid_topk(s, d):
    asked = _asked(s, d).join(_asked_vectors(s, d), "query_id")
    c = _paired(s, d)
    index = _index(s, d, c, "paired")
    return retrieval.hybrid_topk(c, asked, 10, lambda q, k: search_index.search(index, q, k)).withColumn("distance", F.round("distance", 6))


@query(f"WITH {CHUNKS_SQL} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS n FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS term FROM chunks) GROUP BY term")
def index_terms(s, d):
    """The index's dictionary: chunks and occurrences of each term."""
    p = _index(s, d, chunks(s, d)).postings().where("term <> ''")
    return p.groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))


@query("""
WITH q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark WHERE item_id % 100 = 0),
d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents)
SELECT item_id AS query_id, doc_id, count(*) AS n_terms FROM q JOIN d USING (term) GROUP BY ALL""")
def fulltext_or_match(s, d):
    terms = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))))
    q = _asked(s, d).select("query_id", terms("query").alias("term"))
    t = table(s, d, "documents").select("doc_id", terms("text").alias("term"))
    return retrieval.or_match(t, q).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n_terms"))


_PLACES = """
q AS (SELECT item_id AS query_id, {words} AS t FROM benchmark WHERE item_id % 100 = 0),
d AS (SELECT chunk_id, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM chunks),
pos AS (SELECT DISTINCT chunk_id, w AS term, least(i, 16383) AS pos FROM (SELECT chunk_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM d)),
p AS (SELECT chunk_id, term, pos FROM pos QUALIFY row_number() OVER (PARTITION BY chunk_id, term ORDER BY pos) <= 255),
hit AS (SELECT query_id, len(t) AS m, chunk_id, term, pos FROM (SELECT query_id, t, unnest(t) AS term FROM q) JOIN p USING (term))"""
_ANY = _PLACES.format(words="list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))")
_ALL = _PLACES.format(words="list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')[1:3])")


@query(f"WITH {CHUNKS_SQL}, {_ANY}, s AS (SELECT query_id, chunk_id, round(count(DISTINCT pos) * CAST(0.1 AS DOUBLE), 6) AS score FROM hit GROUP BY ALL) SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 50")
def fulltext_rank(s, d):
    """Chunks with any term of a query, by cover density."""
    return fulltext.fulltext_topk(chunks(s, d), _asked(s, d), 50)


# Of each place, the least of the last places of all terms so far starts its cover; a start counts once.
@query(f"""WITH {CHUNKS_SQL}, {_ALL},
e AS (SELECT a.query_id, a.chunk_id, a.pos, a.m, b.term, max(b.pos) AS last FROM (SELECT DISTINCT query_id, chunk_id, pos, m FROM hit) a JOIN hit b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.pos <= a.pos GROUP BY ALL),
c AS (SELECT query_id, chunk_id, min(pos) AS stop, start FROM (SELECT query_id, chunk_id, pos, min(last) AS start FROM e GROUP BY query_id, chunk_id, pos, m HAVING count(*) = m) GROUP BY query_id, chunk_id, start),
n AS (SELECT c.query_id, c.chunk_id, start, stop, count(DISTINCT pos) AS inside FROM c JOIN hit h ON h.query_id = c.query_id AND h.chunk_id = c.chunk_id AND pos BETWEEN start AND stop GROUP BY ALL)
SELECT query_id, chunk_id, round(sum(0.1 / (1 + (stop - start) - (inside - 1))), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(0.1 / (1 + (stop - start) - (inside - 1))), 6) DESC, chunk_id) AS rank FROM n GROUP BY query_id, chunk_id QUALIFY rank <= 50""")
def fulltext_cover_rank(s, d):
    """Chunks with all of a query's first three words, by the density of their minimal covers."""
    q = _asked(s, d).select("query_id", F.array_join(F.slice(fulltext.words(F.col("query")), 1, 3), " ").alias("query"))
    return fulltext.fulltext_topk(chunks(s, d), q, 50, need="all")


_METRICS = """
rel AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON doc_id % 200 = item_id),
q AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'lexical' ELSE 'semantic' END AS type FROM benchmark),
arms AS (SELECT unnest(['a', 'b']) AS arm),
ranked AS (
  SELECT arm, query_id, doc_id, row_number() OVER (PARTITION BY arm, query_id ORDER BY CASE WHEN arm = 'a' THEN gap ELSE -gap END, doc_id) AS rank
  FROM (SELECT arm, query_id, r.doc_id + k AS doc_id, abs(k) AS gap FROM rel r, arms, (SELECT unnest([-2, 0, 3]) AS k))),
hits AS (SELECT arm, query_id, count(*) AS hits, max(1.0 / rank) AS mrr, sum(1 / log2(rank + 1)) AS dcg FROM ranked JOIN rel USING (query_id, doc_id) WHERE rank <= 10 GROUP BY ALL),
n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
m AS (SELECT arm, q.query_id, type, coalesce(hits / n, 0) AS recall, coalesce(mrr, 0) AS mrr,
  coalesce(dcg / list_sum([1 / log2(i + 1) for i in range(1, CAST(least(n, 10) AS INTEGER) + 1)]), 0) AS ndcg
  FROM q CROSS JOIN arms LEFT JOIN n USING (query_id) LEFT JOIN hits USING (arm, query_id))"""


def _metrics(s, d):
    b, docs = table(s, d, "benchmark"), table(s, d, "documents")
    rel = docs.select((F.col("doc_id") % 200).alias("query_id"), "doc_id").join(b.select(F.col("item_id").alias("query_id")), "query_id")
    q = b.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "lexical").otherwise("semantic").alias("type"))
    wide = rel.select("query_id", F.explode(F.array(F.lit(-2), F.lit(0), F.lit(3))).alias("k"), "doc_id").select("query_id", (F.col("doc_id") + F.col("k")).alias("document_id"), F.abs("k").alias("gap"))
    out = None
    for arm, sign in (("a", 1), ("b", -1)):
        w = Window.partitionBy("query_id").orderBy(sign * F.col("gap"), "document_id")
        r = wide.withColumn("rank", F.row_number().over(w))
        m = evaluate.ir_metrics(r, rel.withColumnRenamed("doc_id", "document_id"), q, 10).join(q, "query_id").withColumn("arm", F.lit(arm))
        out = m if out is None else out.unionByName(m)
    return out


@query(f"WITH {_METRICS} SELECT arm, query_id, type, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM m")
def ir_metrics(s, d):
    return _metrics(s, d).select("arm", "query_id", "type", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query(f"WITH {_METRICS} SELECT arm, type, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY GROUPING SETS ((arm), (arm, type))")
def ir_metrics_summary(s, d):
    m = evaluate.summary(_metrics(s, d), ["recall", "mrr", "ndcg"])
    return m.select("arm", "type", "n", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query(f"WITH {_METRICS} SELECT query_id, a.type, round(a.ndcg - b.ndcg, 6) AS difference FROM m a JOIN m b USING (query_id) WHERE a.arm = 'a' AND b.arm = 'b'")
def paired_difference(s, d):
    return evaluate.paired_difference(_metrics(s, d), "a", "b", "ndcg").withColumn("difference", F.round("difference", 6))


@query()
def bootstrap_decision(s, d):
    diff = evaluate.paired_difference(_metrics(s, d), "a", "b", "ndcg")
    return evaluate.decision(evaluate.bootstrap(diff, ["type"], "difference", "query_id"), 0.02)


_DRAWN = f"""
dif AS (SELECT query_id, a.type, a.ndcg - b.ndcg AS v FROM m a JOIN m b USING (query_id) WHERE a.arm = 'a' AND b.arm = 'b'),
w AS (SELECT type, r, v, CASE {" ".join(f"WHEN u < {x!r} THEN {k}" for k, x in enumerate(evaluate.poisson_steps()))} ELSE 12 END AS w FROM (
  SELECT type, r, v, CAST(('0x' || substr(md5('0|' || r || '|' || query_id), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM dif, range(2000) t(r))),
mean AS (SELECT type, r, sum(w * v) / sum(w) AS m FROM w GROUP BY type, r HAVING sum(w) > 0),
ends AS (SELECT type, list(m ORDER BY m) AS ms FROM mean GROUP BY type),
iv AS (SELECT type, n, mean, ms[CAST(floor(0.025 * len(ms)) AS INTEGER) + 1] AS low, ms[CAST(floor(0.975 * len(ms)) AS INTEGER)] AS high FROM ends JOIN (SELECT type, count(*) AS n, avg(v) AS mean FROM dif GROUP BY type) USING (type))"""


def _intervals(s, d):
    diff = evaluate.paired_difference(_metrics(s, d), "a", "b", "ndcg")
    return evaluate.drawn_intervals(diff, ["type"], "difference", "query_id")


@query(f"WITH {_METRICS}, {_DRAWN} SELECT type, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM iv")
def drawn_intervals(s, d):
    return _intervals(s, d).select("type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query(f"WITH {_METRICS}, {_DRAWN} SELECT coalesce(max(CASE WHEN type = 'lexical' THEN low END) > 0.02, FALSE) AS lexical_gain, coalesce(max(CASE WHEN type = 'semantic' THEN high END) >= 0, FALSE) AS no_semantic_loss, coalesce(max(CASE WHEN type = 'lexical' THEN low END) > 0.02, FALSE) AND coalesce(max(CASE WHEN type = 'semantic' THEN high END) >= 0, FALSE) AS adopt FROM iv")
def drawn_decision(s, d):
    return evaluate.decision(_intervals(s, d), 0.02)


@query("SELECT event_type, percentile_disc(0.05) WITHIN GROUP (ORDER BY value) AS p5, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(s, d):
    return evaluate.nearest_rank(table(s, d, "events"), ["event_type"], "value", [5, 50, 95])


@query(f"WITH {_BM25}, best AS (SELECT query_id, document_id, min(rank) AS best FROM bm JOIN chunks USING (chunk_id) WHERE rank <= 50 GROUP BY ALL) SELECT query_id, document_id, best, row_number() OVER (PARTITION BY query_id ORDER BY best, document_id) AS rank FROM best")
def document_ranking(s, d):
    c = chunks(s, d)
    return retrieval.rank_documents(search_index.search(_index(s, d, c), _asked(s, d), 50), c.select("chunk_id", "document_id"))


@query(r"""
WITH l AS (SELECT doc_id, p, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents)),
w AS (SELECT doc_id, p, unnest(regexp_extract_all(line, '[A-Za-z]{3,}')) AS word FROM l),
voc AS (SELECT lower(word) AS v FROM w GROUP BY 1 HAVING count(*) >= 2),
r AS (SELECT doc_id, p, count(*) AS n, avg(CASE WHEN v IS NOT NULL THEN 1.0 ELSE 0 END) AS share FROM w LEFT JOIN voc ON lower(word) = v GROUP BY ALL)
SELECT doc_id, CAST(p AS BIGINT) AS line_no, n, round(share, 6) AS share FROM r JOIN l USING (doc_id, p)
WHERE n >= CASE WHEN regexp_matches(line, '[0-9=()+\-/*<>^]') THEN 1 ELSE 2 END AND share >= 0.6""")
def line_quality_filter(s, d):
    from lodestack.operators.lines import keep_good_lines

    return keep_good_lines(table(s, d, "documents").select("doc_id", "text")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "n", F.round("share", 6).alias("share"))
