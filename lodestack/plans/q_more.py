"""Queries of operators that had none: totals, junk, listed members, recovery, replaced groups, cached vectors, frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import ingest, inventory, lines, lookups, manifest
from lodestack.plans.q_files import _MERKLE
from lodestack.plans.testdata import FILES_SQL, files, table, trees
from lodestack.sources import reports

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {_MERKLE}, m AS (SELECT *, count(*) OVER (PARTITION BY sig) AS n FROM sigs), r AS (SELECT dir FROM m WHERE n > 1),
w AS (SELECT regexp_replace(path, '/[^/]*$', '') AS d3, size FROM trees),
b AS (SELECT s.dir, CAST(sum(size) AS BIGINT) AS bytes FROM sigs s JOIN w ON d3 = s.dir OR starts_with(d3, s.dir || '/') GROUP BY 1),
dg AS (SELECT sig, n, min(m.dir) AS first_dir FROM m WHERE n > 1 GROUP BY sig, n HAVING NOT bool_and(regexp_replace(m.dir, '/[^/]*$', '') IN (SELECT dir FROM r))),
fg AS (SELECT size, sha, count(*) AS n FROM trees WHERE size > 0 GROUP BY size, sha HAVING count(*) > 1)
SELECT (SELECT coalesce(CAST(sum(size * (n - 1)) AS BIGINT), 0) FROM fg) AS exact_duplicate_reclaimable, (SELECT coalesce(CAST(sum((n - 1) * bytes) AS BIGINT), 0) FROM dg JOIN b ON b.dir = first_dir) AS directory_duplicate_reclaimable""")
def reclaimable_totals(s, d):
    t = trees(s, d)
    groups = inventory.duplicate_directories(inventory.merkle_signatures(t)).join(inventory.subtree_sizes(t).select(F.col("dir").alias("first_dir"), "bytes"), "first_dir")
    return reports.reclaimable_totals(inventory.exact_file_groups(t), groups)


_JUNK = ", ".join(f"'{x}'" for x in manifest.JUNK)


@query(f"""WITH {FILES_SQL} SELECT doc_id, lower(regexp_extract(p, '[^/]*$')) IN ({_JUNK}) AS junk FROM (
  SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN path || '/.DS_Store' WHEN 1 THEN path || '/Thumbs.db' WHEN 2 THEN 'desktop.INI' ELSE path END AS p FROM files)""")
def junk_names(s, d):
    i = F.col("doc_id") % 7
    p = F.when(i == 0, F.concat("path", F.lit("/.DS_Store"))).when(i == 1, F.concat("path", F.lit("/Thumbs.db"))).when(i == 2, "desktop.INI").otherwise(F.col("path"))
    return files(s, d).select("doc_id", manifest.is_junk(p).alias("junk"))


@query(f"WITH {FILES_SQL} SELECT f.path, f.doc_id AS document_id FROM files f JOIN labels l ON l.doc_id = f.doc_id")
def listed_members(s, d):
    m = files(s, d).select("path", F.col("doc_id").alias("document_id"))
    return lookups.listed_members(m, table(s, d, "labels").select(F.col("doc_id").alias("document_id")))


@query("""SELECT o_orderkey AS action, CASE WHEN e AND u THEN 'NOT_ATTEMPTED' ELSE 'UNKNOWN' END AS result, CASE WHEN NOT e THEN 'source is missing' WHEN NOT u THEN 'source has changed' END AS message,
  CASE WHEN o_orderstatus <> 'P' THEN 'only unknown audits are reconciled' WHEN o_orderkey % 11 = 0 THEN 'already reconciled' WHEN o_orderkey % 2 = 0 AND e THEN 'the source is still there' WHEN o_orderkey % 2 = 1 AND NOT (e AND u) THEN 'the source is gone or changed' END AS problem
FROM (SELECT *, o_custkey % 3 > 0 AS e, o_custkey % 5 > 1 AS u FROM orders)""")
def recovery_and_reconciliation(s, d):
    o = table(s, d, "orders")
    e, u, k = F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 5 > 1, F.col("o_orderkey")
    r = lookups.recovery_outcome(e, u)
    result, outcome = F.when(F.col("o_orderstatus") == "P", "UNKNOWN").otherwise("SUCCESS"), F.when(k % 2 == 0, "SUCCESS").otherwise("FAILED")
    return o.select(k.alias("action"), r["result"].alias("result"), r["message"].alias("message"), lookups.reconciliation_problem(result, outcome, k % 11 == 0, e, u).alias("problem"))


@query("""WITH new AS (SELECT o_orderkey AS k, 'order' AS what, CAST(o_custkey AS BIGINT) AS n FROM orders WHERE o_orderkey % 3 = 0)
SELECT l_orderkey AS k, 'line' AS what, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM new) UNION ALL SELECT * FROM new""")
def replaced_groups(s, d):
    old = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit("line").alias("what"), F.col("l_linenumber").cast("long").alias("n"))
    new = table(s, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.lit("order").alias("what"), F.col("o_custkey").cast("long").alias("n"))
    return ingest.replace_groups(old, new, "k")


# A stand-in for a model: lengths. The cache holds every third text, some of another size, which do not count.
@query("""WITH c AS (SELECT DISTINCT text, CASE WHEN length(text) % 2 = 0 THEN [-1.0, -1.0] ELSE [-1.0] END AS e FROM documents WHERE length(text) % 3 = 0)
SELECT doc_id, CASE WHEN len(c.e) = 2 THEN -1.0 ELSE CAST(length(d.text) AS DOUBLE) END AS first FROM documents d LEFT JOIN c ON c.text = d.text""")
def cached_vectors(s, d):
    t = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    some = t.select("text").distinct().where(F.length("text") % 3 == 0)
    cache = some.select(ingest.cache_key("m", F.col("text")).alias("key"), F.when(F.length("text") % 2 == 0, F.array(F.lit(-1.0), F.lit(-1.0))).otherwise(F.array(F.lit(-1.0))).alias("embedding"))
    got = ingest.cached_embeddings(t, cache, "m", 2, lambda x: x.select("key", F.array(F.length("text").cast("double"), F.lit(0.0)).alias("embedding")))
    return got.select(F.col("id").alias("doc_id"), F.get("embedding", F.lit(0)).alias("first"))


# Vectors as thumbnails of frames, ten frames of each, which drift a little.
@query("""
WITH RECURSIVE f AS (SELECT v.vec_id // 500 AS recording, v.vec_id AS frame, list_transform(b.embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100) AS BIGINT) + v.vec_id % 10 // 4) AS pixels FROM embeddings v JOIN embeddings b ON b.vec_id = v.vec_id // 10 * 10),
o AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY frame) AS k FROM f),
r AS (SELECT recording, k, frame, pixels AS last, TRUE AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.recording, o.k, o.frame, CASE WHEN list_avg(list_transform(list_zip(o.pixels, r.last), lambda z: abs(z[1] - z[2]))) >= 1.5 THEN o.pixels ELSE r.last END, list_avg(list_transform(list_zip(o.pixels, r.last), lambda z: abs(z[1] - z[2]))) >= 1.5
  FROM r JOIN o ON o.recording = r.recording AND o.k = r.k + 1)
SELECT recording, frame FROM r WHERE kept""")
def changed_frames(s, d):
    e, i = table(s, d, "embeddings"), F.col("vec_id")
    base = e.select(i.alias("base"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 100)).alias("p"))
    f = e.select(F.floor(i / 500).alias("recording"), i.alias("frame"), (F.floor(i / 10) * 10).alias("base"), F.floor(i % 10 / 4).alias("more")).join(base, "base")
    f = f.select("recording", "frame", F.zip_with("p", F.array_repeat("more", F.size("p")), lambda x, y: x + y).alias("pixels"))
    return lines.skip_unchanged_frames(f, 1.5, 100).select("recording", "frame")


@query()
def new_screen_lines(s, d):
    """Lines of a document as a recording's frames of three lines: what says something new (difflib has no SQL)."""
    n = F.floor(F.col("line_no") / 3)
    f = table(s, d, "documents").select(F.col("doc_id").alias("recording"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("recording", n.alias("frame"), "line_no", "line")
    return lines.drop_repeated_lines(f, step=200).select("recording", "frame", "line_no", F.sha2("line", 256).alias("line_sha"))
