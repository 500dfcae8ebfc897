"""Queries: lookups, filters and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import inventory, lookups
from lodestack.operators.manifest import DIRTY
from lodestack.plans.testdata import CHUNKS_SQL, FILES_SQL, chunks, files, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {FILES_SQL}, o AS (SELECT sha, list(path) AS p FROM files GROUP BY sha) SELECT sha FROM o WHERE NOT list_bool_or(list_transform(p, lambda x: contains(lower(regexp_extract(x, '[^/]*$')), 'f1') OR contains(lower(regexp_extract(x, '[^/]*$')), '.mp4')))")
def name_exclusions(s, d):
    g = files(s, d).groupBy("sha").agg(F.collect_set("path").alias("occurrences"))
    return lookups.without_names(g, ["f1", ".mp4"]).select("sha")


@query("""WITH h AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
SELECT query_id, chunk_id, round(1 - distance, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM h) WHERE rank <= 30 AND distance <= 0.8""")
def relevance_cutoff(s, d):
    from lodestack.operators.retrieval import dense_topk

    e = table(s, d, "embeddings")
    h = dense_topk(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 30)
    return lookups.scored(lookups.within(h, 0.8)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE starts_with(path, 'src1/en/') OR starts_with(path, 'src2/') OR path = 'src4'")
def readable_paths(s, d):
    jobs = s.createDataFrame([("src1/en", "COMPLETED", "filesystem"), ("src2", "COMPLETED", "filesystem"), ("src3", "FAILED", "filesystem"), ("src5", "COMPLETED", "upload"), ("src4", "COMPLETED", "filesystem")], "source_path string, status string, source_type string").where("source_path <> 'src4'")
    return lookups.readable(files(s, d).select("path"), jobs)


@query("SELECT event_id, event_type FROM events WHERE event_type = 'purchase' AND user_id = 7 AND ts < TIMESTAMP '2024-06-01'")
def filtered_events(s, d):
    e = table(s, d, "events").withColumn("started_at", F.col("ts"))
    return lookups.filtered(e, {"event_type": "purchase", "user_id": 7, "value": None}, "2024-06-01").select("event_id", "event_type")


@query("""WITH c AS (SELECT l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY 1)
SELECT c_custkey AS hit, CASE WHEN c_custkey % 3 <> 0 THEN coalesce((SELECT string_agg(CAST(o_orderkey AS VARCHAR) || ':' || CASE WHEN coalesce(n, 0) > 2 THEN CAST(n AS VARCHAR) ELSE '-' END, ',' ORDER BY o_orderkey) FROM orders LEFT JOIN c ON o = o_orderkey WHERE o_custkey = c_custkey), '') END AS occurrences FROM customer""")
def hit_occurrences(s, d):
    hits = table(s, d, "customer").select(F.col("c_custkey").alias("hit"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("group_id"))
    inst = table(s, d, "orders").select(F.col("o_orderkey").alias("instance_id"), F.col("o_custkey").alias("group_id"), F.col("o_orderstatus").alias("root"))
    links = table(s, d, "lineitem").select(F.col("l_orderkey").alias("instance_id"), F.col("l_linenumber").alias("seq"), F.lit("x").alias("kind"), F.col("l_partkey").cast("string").alias("path"))
    o = lookups.enrich(hits, inst, links)
    say = F.transform("occurrences", lambda x: F.concat(x["instance_id"].cast("string"), F.lit(":"), F.when(x["ancestry"].isNotNull(), F.size(x["ancestry"]).cast("string")).otherwise("-")))
    return o.select("hit", F.array_join(say, ",").alias("occurrences"))


@query("SELECT o_custkey % 300 AS group_id, min(o_orderkey % 50) AS batch_id FROM orders WHERE o_orderkey % 50 % 3 = 1 GROUP BY 1")
def owning_batch(s, d):
    i = table(s, d, "orders").select((F.col("o_custkey") % 300).alias("group_id"), (F.col("o_orderkey") % 50).alias("batch_id"))
    b = s.range(50).select(F.col("id").alias("batch_id"), F.when(F.col("id") % 3 == 1, "RUNNING").otherwise("PAUSED").alias("status"))
    return lookups.owning_batch(i, b)


@query(f"""WITH {FILES_SQL}, f AS (SELECT *, lower(regexp_extract(path, '[^/]*$')) AS name FROM files), m AS (SELECT size, name FROM f WHERE doc_id % 9 = 0)
SELECT size, name, arg_min(path, length(path) * 1000000 + doc_id) AS path, count(*) AS n FROM f WHERE (size, name) IN (SELECT (size, name) FROM m) OR mtime > 50000 GROUP BY size, name""")
def hash_candidates(s, d):
    f = files(s, d)
    return lookups.hash_candidates(f, f.where("doc_id % 9 = 0").select("size", F.concat(F.lit("in/"), F.upper(F.element_at(F.split("path", "/"), -1))).alias("name")), 50000)


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE size IN (SELECT size FROM files WHERE doc_id % 13 = 0)")
def same_size_files(s, d):
    f = files(s, d)
    return lookups.same_size(f, f.where("doc_id % 13 = 0")).select("path")


@query(f"""WITH {FILES_SQL}, i AS (SELECT doc_id % 60 AS group_id, CASE WHEN doc_id % 60 % 2 = 0 THEN 'p' || CAST(doc_id % 60 AS VARCHAR) ELSE path END AS path FROM files), a AS (SELECT user_id % 70 AS group_id, count(*) AS n FROM events GROUP BY 1)
SELECT group_id, min(path) AS path, coalesce(min(n), 0) AS attempts FROM i LEFT JOIN a USING (group_id) GROUP BY group_id HAVING count(DISTINCT path) = 1""")
def retry_report(s, d):
    g = F.col("doc_id") % 60
    i = files(s, d).select(g.alias("group_id"), F.when(g % 2 == 0, F.concat(F.lit("p"), g.cast("string"))).otherwise(F.col("path")).alias("path"))
    return lookups.retry_report(i.select("group_id").distinct(), i, table(s, d, "events").select((F.col("user_id") % 70).alias("group_id")))


@query(f"WITH {FILES_SQL} SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(size % 7), 0) AS BIGINT) AS chunks FROM files WHERE doc_id % 3 <> 0")
def new_paths_envelope(s, d):
    f = files(s, d).withColumn("chunks", F.col("size") % 7)
    return lookups.new_paths_envelope(f, f.where("doc_id % 3 = 0"))


@query(f"""WITH {FILES_SQL}, o AS (SELECT doc_id AS id, doc_id % 80 AS group_id, path, CASE WHEN doc_id % 4 = 0 OR doc_id % 80 < 20 AND doc_id % 3 = 0 THEN 'missing' WHEN doc_id % 4 < 3 OR doc_id % 80 < 20 THEN 'changed' END AS why FROM files)
SELECT group_id, arg_min(path, id) FILTER (WHERE why IS NULL) AS path, CASE WHEN count(*) FILTER (WHERE why IS NULL) = 0 THEN string_agg(DISTINCT why, '; ' ORDER BY why) END AS reasons FROM o GROUP BY group_id""")
def first_verified(s, d):
    i, f = F.col("doc_id"), files(s, d)
    gone = (i % 4 == 0) | ((i % 80 < 20) & (i % 3 == 0))
    fresh = f.where(~gone).select("path", F.when((i % 4 < 3) | (i % 80 < 20), F.lit("x")).otherwise(F.col("sha")).alias("sha"))
    return lookups.first_verified(f.select(i.alias("id"), (i % 80).alias("group_id"), "path", "sha"), fresh)


@query("""WITH i AS (SELECT o_orderkey AS instance_id, o_custkey % 10 AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 700 END AS group_id FROM orders),
a AS (SELECT event_id AS attempt_id, CASE WHEN event_id % 2 = 0 THEN event_id END AS instance_id, CASE WHEN event_id % 2 = 1 THEN event_id % 900 END AS group_id FROM events)
SELECT attempt_id, 'instance' AS level FROM a WHERE instance_id IN (SELECT instance_id FROM i WHERE run_id = 3) UNION ALL SELECT attempt_id, 'group' FROM a WHERE instance_id IS NULL AND group_id IN (SELECT group_id FROM i WHERE run_id = 3 AND group_id IS NOT NULL)""")
def attempts_of_run(s, d):
    o, e = F.col("o_orderkey"), F.col("event_id")
    i = table(s, d, "orders").select(o.alias("instance_id"), (F.col("o_custkey") % 10).alias("run_id"), F.when(o % 2 == 0, o % 700).alias("group_id"))
    a = table(s, d, "events").select(e.alias("attempt_id"), F.when(e % 2 == 0, e).alias("instance_id"), F.when(e % 2 == 1, e % 900).alias("group_id"))
    return lookups.attempts_of_run(i, a, 3)


@query(f"WITH {CHUNKS_SQL} SELECT doc_id AS document_id FROM documents WHERE doc_id NOT IN (SELECT document_id FROM chunks WHERE chunk_index = 1)")
def documents_without_chunks(s, d):
    return lookups.without_chunks(table(s, d, "documents").select(F.col("doc_id").alias("document_id")), chunks(s, d).where("chunk_index = 1"))


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE doc_id % 3 = 2 AND size IN (SELECT size FROM files WHERE mtime > 40000)")
def size_doubts(s, d):
    f = files(s, d)
    return lookups.doubtful(f.where("doc_id % 3 = 2"), f, 40000).select("path")


@query(f"WITH {FILES_SQL} SELECT DISTINCT sha FROM files WHERE doc_id % 10 = 2 AND doc_id % 4 <> 0")
def verified_archives(s, d):
    f = files(s, d)
    a = f.where("doc_id % 10 = 2").select("doc_id", F.col("path").alias("archive"))
    return lookups.verified_archives(a, a.where("doc_id % 4 = 0"), f)


@query("SELECT sha256(text) AS sha, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY text HAVING count(*) > 1")
def group_members(s, d):
    m = lookups.members_in_order(files(s, d), "sha", ["doc_id", "path"])
    return m.select("sha", F.transform("members", lambda x: x["doc_id"]).alias("ids"))


@query(f"WITH {CHUNKS_SQL} SELECT count(*) AS n, max(chunk_id) AS last FROM chunks")
def index_signature(s, d):
    return lookups.index_signature(chunks(s, d))


@query("SELECT item_id, CASE WHEN item_id % 3 <> 0 THEN item_id % 2 = 0 END AS path_hit, CASE WHEN item_id % 4 <> 1 THEN contains(lower(text), 'the') END AS term_hit FROM benchmark")
def evaluation_hits(s, d):
    i = F.col("item_id")
    empty = F.array().cast("array<string>")
    b = table(s, d, "benchmark").select("item_id", F.when(i % 3 != 0, F.array(F.lit("Docs/A"))).otherwise(empty).alias("want_paths"), F.when(i % 2 == 0, F.array(F.lit("x/docs/a.md"))).otherwise(empty).alias("paths"), F.when(i % 4 != 1, F.array(F.lit("THE"))).otherwise(empty).alias("want_terms"), F.array("text").alias("terms"))
    return lookups.hit_flags(b).select("item_id", "path_hit", "term_hit")


@query(f"WITH {FILES_SQL} SELECT CASE WHEN doc_id % 5 = 0 THEN 'unique' WHEN doc_id % 7 = 0 THEN 'repeat' ELSE 'duplicate' END AS status, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1")
def status_counters(s, d):
    i = F.col("doc_id")
    return lookups.status_counters(files(s, d).withColumn("status", F.when(i % 5 == 0, "unique").when(i % 7 == 0, "repeat").otherwise("duplicate")))


@query(f"""WITH {FILES_SQL}, g AS (SELECT size, min(path) AS first_path FROM files WHERE size > 0 GROUP BY size, sha HAVING count(*) > 1), x AS (SELECT *, lower(regexp_extract(first_path, '[^/]+(\\.[^./]+)$', 1)) AS suffix FROM g)
SELECT suffix, first(first_path ORDER BY size, first_path) AS path FROM x WHERE suffix IN ('.txt', '.pdf', '.zip') AND size < 5000 GROUP BY suffix""")
def smallest_group(s, d):
    return lookups.smallest_group(inventory.exact_file_groups(files(s, d)), [".txt", ".pdf", ".zip"], 5000)


@query("""SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'only unknown audits are reconciled' WHEN event_id % 5 = 0 THEN 'already reconciled' WHEN event_id % 2 = 0 AND event_id % 7 < 4 THEN 'the source is still there' WHEN event_id % 2 = 1 AND NOT (event_id % 7 < 4 AND event_id % 11 < 6) THEN 'the source is gone or changed' END AS problem,
CASE WHEN event_id % 7 < 4 AND event_id % 11 < 6 THEN 'NOT_ATTEMPTED' ELSE 'UNKNOWN' END AS recovered FROM events""")
def reconciliation(s, d):
    e = F.col("event_id")
    there, unchanged = e % 7 < 4, e % 11 < 6
    res = F.when(e % 3 == 0, "UNKNOWN").otherwise("SUCCESS")
    return table(s, d, "events").select("event_id", lookups.reconciliation_problem(res, F.when(e % 2 == 0, "SUCCESS").otherwise("FAILED"), e % 5 == 0, there, unchanged).alias("problem"), lookups.recovery_outcome(there, unchanged)["result"].alias("recovered"))


@query(f"""WITH {CHUNKS_SQL} SELECT chunk_id, 'c' || CAST(chunk_id AS VARCHAR) || '-lex' AS lexical_id, 'c' || CAST(chunk_id AS VARCHAR) || '-sem' AS semantic_id FROM chunks
WHERE length(content) >= 300 AND chunk_index > 0 ORDER BY sha256('7:' || CAST(chunk_id AS VARCHAR)), chunk_id LIMIT 20""")
def drafting_sample(s, d):
    c = chunks(s, d)
    return lookups.drafting_sample(c, c.where("chunk_index = 0"), 20, 7)


@query("""WITH h AS (SELECT a.vec_id AS q, b.vec_id AS c, 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, c) AS rank FROM h QUALIFY rank <= 5)
SELECT q AS query_id, string_agg(CAST(rank AS VARCHAR) || ':' || CAST(c AS VARCHAR) || ':' || CAST(c % 100 AS VARCHAR), ',' ORDER BY rank) AS citations FROM r GROUP BY q""")
def citations_projection(s, d):
    from lodestack.operators.retrieval import dense_topk

    e = table(s, d, "embeddings")
    h = dense_topk(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 5)
    c = lookups.citations(lookups.scored(h.withColumn("document_id", F.col("chunk_id") % 100)))
    return c.select("query_id", F.array_join(F.transform("citations", lambda x: F.concat_ws(":", x["rank"], x["chunk_id"], x["document_id"])), ",").alias("citations"))


@query(f"""WITH {FILES_SQL} SELECT path, CASE WHEN row_number() OVER (PARTITION BY size % 40 ORDER BY CAST(contains(path, 'src1') AS INTEGER), regexp_matches(regexp_extract(path, '[^/]*$'), '{DIRTY}'), len(string_split(path, '/')), length(path), path) = 1 THEN 'KEEP' ELSE 'REDUNDANT' END AS action FROM files""")
def folder_plan(s, d):
    from lodestack.operators.manifest import ranked_folders

    return ranked_folders(files(s, d).select(F.col("path").alias("dir"), (F.col("size") % 40).alias("sig")), ["src1"]).select(F.col("dir").alias("path"), "action")


_COPIES = FILES_SQL + ", a AS (SELECT path, size % 90 AS group_id, doc_id % 3 = 0 AS processed, doc_id % 9 = 0 AND doc_id % 90 < 45 AS there, doc_id % 12 = 0 AS error FROM files)"


@query(f"WITH {_COPIES} SELECT path FROM a WHERE group_id IN (SELECT group_id FROM a GROUP BY 1 HAVING bool_or(processed) AND NOT coalesce(bool_or(there OR error) FILTER (WHERE processed), false))")
def copies_plan(s, d):
    from lodestack.operators.manifest import copies_plan as plan

    i = F.col("doc_id")
    a = files(s, d).select("path", (F.col("size") % 90).alias("group_id"), (i % 3 == 0).alias("processed"), ((i % 9 == 0) & (i % 90 < 45)).alias("exists"), (i % 12 == 0).alias("error"))
    return plan(a).select("path")


@query("SELECT s_suppkey AS plan_id, s_suppkey % 3 = 0 AND s_suppkey % 4 = 1 AS actionable FROM supplier")
def actionable_plans(s, d):
    from lodestack.operators.audit import actionable

    k = F.col("s_suppkey")
    sup = table(s, d, "supplier")
    auth = sup.select(k.alias("plan_id"), F.when(k % 3 == 0, "AUTHORIZED").otherwise("REVOKED").alias("status"))
    return actionable(auth, sup.where(k % 4 < 3).select(k.alias("plan_id"), (k % 4 == 1).alias("valid"))).select("plan_id", "actionable")


@query(f"WITH {FILES_SQL} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'm' || CAST(doc_id AS VARCHAR) WHEN doc_id % 4 = 1 THEN regexp_extract(path, '[^/]*$') ELSE 'untitled' END AS label FROM files")
def source_labels(s, d):
    from lodestack.operators.conversations import source_label

    i = F.col("doc_id")
    member = F.when(i % 4 == 0, F.concat(F.lit("in\\x/m"), i.cast("string")))
    return files(s, d).select("doc_id", source_label(member, F.when(i % 4 < 2, F.replace("path", F.lit("/"), F.lit("\\"))), F.lit("untitled")).alias("label"))


@query("SELECT doc_id, sha256(substring(text, 1, 4000)) AS head_sha, length(text) > 4000 AS truncated FROM documents")
def truncated_texts(s, d):
    from lodestack.functions.text import truncated

    t = table(s, d, "documents").select("doc_id", truncated(F.col("text"), 4000).alias("t"))
    return t.select("doc_id", F.sha2("t.text", 256).alias("head_sha"), F.col("t.truncated").alias("truncated"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(x, '!\[\[[^\]]*\]\]', '', 'g'), '\[\[(?:[^\]|]*\|)?\s*([^\]|]*?)\s*\]\]', '\1', 'g') AS cleaned FROM (SELECT conv_id, turn, '[[p|' || substring(text, 1, 8) || ']] ![[img]] [[ ' || substring(text, 9, 5) || ' ]]' AS x FROM conversations)""")
def wikilink_cleanup(s, d):
    from lodestack.functions.text import clean_wikilinks

    x = F.concat(F.lit("[[p|"), F.substring("text", 1, 8), F.lit("]] ![[img]] [[ "), F.substring("text", 9, 5), F.lit(" ]]"))
    return table(s, d, "conversations").select("conv_id", "turn", clean_wikilinks(x).alias("cleaned"))
