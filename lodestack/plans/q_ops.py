"""Queries: classification, selection, batches, audits, conversations, upserts, event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.functions import paths as P
from lodestack.operators import audit, batches, classify, conversations, ingest
from lodestack.plans.testdata import FILES_SQL, files, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Sizes are blown up so that every risk tier occurs.
_SRC = FILES_SQL + r""", src AS (SELECT doc_id, path, path AS root, CASE WHEN doc_id % 6 = 0 THEN 'in/m' || CAST(doc_id AS VARCHAR) || '.csv' END AS member, size * (1 + (doc_id % 13) * 40000) AS size, sha FROM files),
sfx AS (SELECT *, regexp_replace(lower(regexp_extract(coalesce(member, root), '[^/]+(\.[^./]+)$', 1)), '^(\.[a-z0-9]+)_[0-9]+$', '\1') AS s, lower(regexp_extract(coalesce(member, root), '[^/]+(\.[^./]+)$', 1)) AS s0 FROM src),
cat AS (SELECT *, CASE WHEN s IN ('.zip', '.7z', '.gz', '.rar') THEN 'ARCHIVE' ELSE 'LOOSE_FILE' END AS source_category FROM sfx),
cls AS (SELECT *, CASE WHEN source_category = 'ARCHIVE' THEN 'CONTAINER' WHEN s = '.c9r' THEN 'ENCRYPTED' WHEN s IN ('.txt', '.md', '.pdf', '.docx', '.pptx') THEN 'TEXT_DOCUMENT' WHEN s IN ('.csv', '.json') THEN 'STRUCTURED_DATA'
    WHEN s IN ('.mp4', '.jpg', '.jpeg', '.png', '.gif', '.mp3', '.mov', '.wav', '.m4a') THEN 'MEDIA' WHEN s IN ('.exe', '.dll', '.msi', '.apk', '.bin') THEN 'SOFTWARE' ELSE 'UNKNOWN' END AS workload_category,
  CASE WHEN source_category = 'ARCHIVE' THEN CASE WHEN size < 10000000 THEN 'LOW' WHEN size < 1000000000 THEN 'MEDIUM' WHEN size < 5000000000 THEN 'HIGH' ELSE 'EXTREME' END
    ELSE CASE WHEN size >= 500000000 THEN 'EXTREME' WHEN size >= 50000000 THEN 'HIGH' WHEN size >= 1000000 THEN 'MEDIUM' ELSE 'LOW' END END AS risk_tier,
  s IN ('.zip', '.7z') AS extractable,
  CASE WHEN s0 = '.c9r' THEN 'EXCLUDED' WHEN s0 IN ('.bin', '.exe', '.dll', '.jpg', '.jpeg', '.png', '.gif', '.mp3', '.mp4', '.mov') THEN 'UNSUPPORTED' ELSE 'ELIGIBLE' END AS eligibility FROM cat)"""


def _classified(s, d):
    f, i = files(s, d), F.col("doc_id")
    src = f.select("doc_id", "path", F.col("path").alias("root"), F.when(i % 6 == 0, F.concat(F.lit("in/m"), i.cast("string"), F.lit(".csv"))).alias("member"), (F.col("size") * (1 + (i % 13) * 40000)).alias("size"), "sha")
    return classify.classify(src)


@query(f"WITH {_SRC} SELECT root, member, source_category, workload_category, risk_tier, extractable, eligibility, CASE WHEN eligibility = 'ELIGIBLE' THEN 'EXTRACTED' ELSE eligibility END AS pipeline_state FROM cls")
def source_classification(s, d):
    return _classified(s, d).select("root", "member", "source_category", "workload_category", "risk_tier", "extractable", "eligibility", "pipeline_state")


@query(f"WITH {_SRC} SELECT root, size FROM cls WHERE source_category IN ('ARCHIVE', 'LOOSE_FILE') AND workload_category IN ('CONTAINER', 'TEXT_DOCUMENT') AND risk_tier IN ('LOW', 'MEDIUM') AND (source_category <> 'ARCHIVE' OR extractable)")
def policy_filter(s, d):
    return classify.policy_filter(_classified(s, d), ["ARCHIVE", "LOOSE_FILE"], ["CONTAINER", "TEXT_DOCUMENT"], ["LOW", "MEDIUM"], True).select("root", "size")


@query(f"WITH {_SRC} SELECT risk_tier, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT CASE WHEN doc_id % 9 <> 0 THEN risk_tier END AS risk_tier, size FROM cls) GROUP BY risk_tier")
def risk_distribution(s, d):
    c = _classified(s, d).withColumn("risk_tier", F.when(F.col("doc_id") % 9 != 0, F.col("risk_tier")))
    return c.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(f"WITH {FILES_SQL}, r AS (SELECT path, size, sum(size) OVER w AS b, row_number() OVER w AS n FROM files WINDOW w AS (ORDER BY path ROWS UNBOUNDED PRECEDING)) SELECT path, size, CAST(b AS BIGINT) AS running_bytes, n AS running_files FROM r WHERE b <= 500000 AND n <= 300")
def stop_never_skip(s, d):
    return classify.stop_never_skip(files(s, d).select("path", "size"), 500_000, 300)


_DEF = FILES_SQL + """, a AS (SELECT path, CASE WHEN doc_id % 10 IN (2, 3) THEN 'ARCHIVE' ELSE 'LOOSE_FILE' END AS source_category, CASE WHEN doc_id % 4 <> 0 THEN CAST(size % 20 AS VARCHAR) END AS dup_group FROM files)"""


@query(f"WITH {_DEF} SELECT path, source_category = 'ARCHIVE' AND dup_group IS NOT NULL AND path <> min(path) OVER (PARTITION BY source_category, dup_group) AS deferred FROM a")
def archive_deferrals(s, d):
    f, i = files(s, d), F.col("doc_id")
    a = f.select("path", F.when((i % 10).isin(2, 3), "ARCHIVE").otherwise("LOOSE_FILE").alias("source_category"), F.when(i % 4 != 0, (F.col("size") % 20).cast("string")).alias("dup_group"))
    return classify.archive_deferrals(a).select("path", "deferred")


@query(f"""WITH {FILES_SQL}, f AS (SELECT path, sha, CAST(doc_id % 10 AS VARCHAR) AS ext, string_split(path, '/')[1] AS top FROM files),
t AS (SELECT *, row_number() OVER (PARTITION BY ext, top ORDER BY sha, path) AS turn FROM f), p AS (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY turn, top) AS pick FROM t) SELECT path, ext, top, turn, pick FROM p WHERE pick <= 12""")
def pilot_round_robin(s, d):
    f = files(s, d).select("path", "sha", (F.col("doc_id") % 10).cast("string").alias("ext"), F.split_part("path", F.lit("/"), F.lit(1)).alias("top"))
    return classify.pilot_round_robin(f, 12).select("path", "ext", "top", "turn", "pick")


_EXCL = FILES_SQL + """, x AS (SELECT path, size, string_split(path, '/')[1] AS top, CASE WHEN path LIKE '%.c9r' THEN 'type' WHEN size > 6000 THEN 'tier' WHEN path LIKE 'src3/%' THEN 'top_folder'
  WHEN path LIKE '%/f1%' THEN 'sensitive_name' WHEN doc_id % 17 = 0 THEN 'no_checksum' END AS reason FROM files)"""


def _excluded(s, d):
    f = files(s, d)
    rules = [("type", F.endswith("path", F.lit(".c9r"))), ("tier", F.col("size") > 6000), ("top_folder", F.startswith("path", F.lit("src3/"))), ("sensitive_name", F.contains("path", F.lit("/f1"))), ("no_checksum", F.col("doc_id") % 17 == 0)]
    return classify.first_exclusion(f, rules)


@query(f"WITH {_EXCL} SELECT reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY reason")
def first_match_exclusions(s, d):
    return _excluded(s, d).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EXCL} SELECT top, CASE WHEN size > 5000 THEN 'large' WHEN size > 2000 AND regexp_matches(path, '\\.(txt|md)$') THEN 'chunk_heavy' ELSE 'normal' END AS class, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM x WHERE reason IS NULL GROUP BY ALL")
def selection_groups(s, d):
    f = _excluded(s, d).where("reason is null").withColumn("class", classify.size_class(P.suffix(F.col("path")), F.col("size"), 5000, 2000))
    return f.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("top"), "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


_ENVELOPE = '"envelope":{"max_embeddings":9,"max_extracted_bytes":null,"max_runtime_seconds":60,"max_source_bytes":1000,"max_source_instances":5},'


@query(f"""WITH {FILES_SQL}, f AS (SELECT doc_id % 7 AS batch_id, path, CASE WHEN doc_id % 3 = 0 THEN 'm' || CAST(doc_id AS VARCHAR) END AS m FROM files)
SELECT batch_id, count(*) AS n, sha256('{{"d0_report_sha256":"r",{_ENVELOPE}"ordering_version":"o1","selected_paths":[' ||
  string_agg('{{"member_path":' || coalesce('"' || m || '"', 'null') || ',"root_t7_path":"' || path || '"}}', ',' ORDER BY path, coalesce(m, '')) || '],"selection_policy_version":"p1"}}') AS fingerprint FROM f GROUP BY 1""")
def selection_fingerprint(s, d):
    i = F.col("doc_id")
    f = files(s, d).select((i % 7).alias("batch_id"), F.col("path").alias("root"), F.when(i % 3 == 0, F.concat(F.lit("m"), i.cast("string"))).alias("member"))
    envelope = {"max_source_instances": 5, "max_source_bytes": 1000, "max_embeddings": 9, "max_runtime_seconds": 60}
    return classify.fingerprint(f, ["batch_id"], "r", "p1", "o1", envelope)


@query(f"""WITH {FILES_SQL}, f AS (SELECT doc_id, size * 20000 AS size, CASE doc_id % 11 WHEN 0 THEN 'other/' WHEN 1 THEN 'master/node_modules/' WHEN 2 THEN 'master/My Passwords/' ELSE 'master/' END || CASE doc_id % 13 WHEN 0 THEN replace(path, '/f', '/~$f') WHEN 1 THEN replace(path, '/f', '/Secret f') ELSE path END AS path, sha FROM files),
e AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '[^/]+(\\.[^./]+)$', 1)) AS ext FROM f),
x AS (SELECT *, CASE WHEN NOT starts_with(path, 'master/') THEN 'outside the master root' WHEN starts_with(path, 'master/src4/') THEN 'top-level folder excluded' WHEN starts_with(name, '~$') THEN 'office lock file'
  WHEN contains(lower(name), 'secret') THEN 'sensitive-looking name' WHEN contains(path, '/node_modules/') THEN 'vendor or cache folder' WHEN doc_id % 23 = 0 THEN 'no recorded checksum'
  WHEN size >= 50000000 THEN 'risk tier too high for the policy' END AS reason FROM e WHERE ext IN ('.txt', '.pdf', '.md', '.docx'))
SELECT reason, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM x GROUP BY reason""")
def master_selection(s, d):
    i, p = F.col("doc_id"), F.col("path")
    top = F.when(i % 11 == 0, "other/").when(i % 11 == 1, "master/node_modules/").when(i % 11 == 2, "master/My Passwords/").otherwise("master/")
    name = F.when(i % 13 == 0, F.replace(p, F.lit("/f"), F.lit("/~$f"))).when(i % 13 == 1, F.replace(p, F.lit("/f"), F.lit("/Secret f"))).otherwise(p)
    f = files(s, d).select(F.concat(top, name).alias("path"), (F.col("size") * 20000).alias("size"), F.when(i % 23 != 0, F.col("sha")).alias("sha"))
    f = f.where(classify.selected_workload(P.suffix(p)).isNotNull())
    x = classify.first_exclusion(f, classify.selection_rules("master", folders=("src4",)))
    return x.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(f"""WITH {FILES_SQL}, c AS (SELECT doc_id, path AS root, CASE WHEN doc_id % 3 = 0 THEN 'm' END AS member FROM files) SELECT root, member FROM c WHERE NOT (doc_id % 4 = 0 AND doc_id % 5 <> 0 AND (doc_id % 2 = 0))""")
def anti_join_eligible(s, d):
    c = files(s, d).select("doc_id", F.col("path").alias("root"), F.when(F.col("doc_id") % 3 == 0, "m").alias("member"))
    i = F.col("doc_id")
    inst = c.where(i % 4 == 0).select("root", "member", F.when(i % 5 != 0, "r1").alias("d0"), F.lit(None).cast("string").alias("d1"), F.when(i % 5 == 0, "r2").alias("d2"))
    return classify.not_yet_materialised(c.select("root", "member"), inst, "r1")


_BATCH = """i AS (SELECT o_orderkey AS id, o_custkey % 20 AS batch_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 500 END AS group_id, CASE WHEN o_orderkey % 5 = 0 THEN 'ARCHIVE' WHEN o_orderkey % 7 <> 0 THEN 'LOOSE_FILE' END AS source_category FROM orders),
g AS (SELECT k AS group_id, ['INGESTED', 'FAILED', 'CHUNKED', 'UNSUPPORTED'][CAST(k % 4 AS INTEGER) + 1] AS state FROM range(500) t(k)),
a AS (SELECT CASE WHEN event_id % 2 = 0 THEN event_id % 20000 END AS instance_id, CASE WHEN event_id % 2 = 1 THEN event_id % 490 END AS group_id, CASE WHEN event_id % 3 = 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS outcome, CASE WHEN event_id % 5 <> 0 THEN event_id % 4 = 0 END AS retryable FROM events)"""


def _batch(s, d):
    k, e, o = F.col("o_orderkey"), F.col("event_id"), table(s, d, "orders")
    i = o.select(k.alias("id"), (F.col("o_custkey") % 20).alias("batch_id"), F.when(k % 3 != 0, k % 500).alias("group_id"), F.when(k % 5 == 0, "ARCHIVE").when(k % 7 != 0, "LOOSE_FILE").alias("source_category"))
    g = s.range(500).select(F.col("id").alias("group_id"), F.get(F.array(*[F.lit(x) for x in ("INGESTED", "FAILED", "CHUNKED", "UNSUPPORTED")]), (F.col("id") % 4).cast("int")).alias("state"))
    a = table(s, d, "events").select(F.when(e % 2 == 0, e % 20000).alias("instance_id"), F.when(e % 2 == 1, e % 490).alias("group_id"), F.when(e % 3 == 0, "FAILURE").otherwise("SUCCESS").alias("outcome"), F.when(e % 5 != 0, e % 4 == 0).alias("retryable"))
    return i, g, a


_REPORT = _BATCH + """,
j AS (SELECT i.*, g.state, EXISTS (SELECT 1 FROM a WHERE a.instance_id = i.id) OR (i.group_id IS NOT NULL AND EXISTS (SELECT 1 FROM a WHERE a.group_id = i.group_id)) AS tried,
  EXISTS (SELECT 1 FROM a WHERE a.instance_id = i.id AND outcome = 'SUCCESS') AS won, EXISTS (SELECT 1 FROM a WHERE a.instance_id = i.id AND outcome = 'FAILURE' AND NOT coalesce(retryable, true)) AS lost FROM i LEFT JOIN g USING (group_id)),
rep AS (SELECT batch_id, count(*) AS selected, count(*) FILTER (WHERE tried) AS attempted,
  count(*) FILTER (WHERE tried AND ((source_category = 'ARCHIVE' AND (won OR lost)) OR (source_category <> 'ARCHIVE' AND state IN ('INGESTED', 'FAILED', 'EXCLUDED', 'UNSUPPORTED')))) AS terminal,
  count(*) FILTER (WHERE tried AND ((source_category = 'ARCHIVE' AND won) OR (source_category <> 'ARCHIVE' AND state = 'INGESTED'))) AS successful FROM j GROUP BY batch_id)"""


@query(f"WITH {_REPORT} SELECT *, attempted > selected OR terminal > attempted OR successful > terminal AS violated FROM rep")
def batch_report(s, d):
    return audit.batch_report(*_batch(s, d))


@query(f"WITH {_REPORT} SELECT batch_id, batch_id % 2 = 0 AND selected = attempted AND terminal = attempted AS complete FROM rep")
def batch_completion(s, d):
    r = audit.batch_report(*_batch(s, d)).withColumn("status", F.when(F.col("batch_id") % 2 == 0, "RUNNING").otherwise("PAUSED"))
    return r.select("batch_id", audit.is_complete(r).alias("complete"))


_AUD = """act AS (SELECT l_orderkey AS execution_id, l_linenumber AS action_id FROM lineitem),
aud AS (SELECT l_orderkey AS execution_id, l_linenumber AS action_id, l_orderkey * 10 + l_linenumber AS audit_id, CASE WHEN l_orderkey % 13 = 0 AND l_linenumber = 2 THEN 'UNKNOWN' WHEN (l_partkey + l_linenumber) % 5 = 0 OR l_orderkey % 9 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS result, l_partkey FROM lineitem WHERE NOT (l_orderkey % 11 = 0 AND l_linenumber = 1))"""


def _audits(s, d):
    o, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    li = table(s, d, "lineitem")
    act = li.select(o.alias("execution_id"), n.alias("action_id"))
    res = F.when((o % 13 == 0) & (n == 2), "UNKNOWN").when(((p + n) % 5 == 0) | (o % 9 == 0), "FAILED").otherwise("SUCCESS")
    return act, li.where(~((o % 11 == 0) & (n == 1))).select(o.alias("execution_id"), n.alias("action_id"), (o * 10 + n).alias("audit_id"), res.alias("result"), p)


@query(f"""WITH {_AUD}, n AS (SELECT execution_id, count(*) AS actions FROM act GROUP BY 1),
g AS (SELECT execution_id, count(DISTINCT action_id) AS audited, bool_or(result = 'UNKNOWN') AS u, bool_and(result = 'SUCCESS') AS al, bool_or(result = 'SUCCESS') AS an, min(audit_id) FILTER (WHERE result <> 'SUCCESS') AS first_failure FROM aud GROUP BY 1)
SELECT execution_id, CASE WHEN coalesce(audited, 0) < actions THEN 'PENDING' WHEN u THEN 'NEEDS_REVIEW' WHEN al THEN 'COMPLETED' WHEN NOT an THEN 'FAILED' ELSE 'PARTIALLY_COMPLETED' END AS status, first_failure FROM n LEFT JOIN g USING (execution_id)""")
def execution_status(s, d):
    act, aud = _audits(s, d)
    return audit.execution_status(aud, act)


@query(f"""WITH {_AUD}, x AS (SELECT audit_id, result, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 3 = 1 END AS m, l_partkey % 4 = 0 AS open FROM aud)
SELECT audit_id, list_filter([CASE WHEN open THEN 'ended' END, CASE WHEN result = 'FAILED' AND m IS DISTINCT FROM false THEN 'failed_not_mutated' END, CASE WHEN result = 'SUCCESS' AND m IS DISTINCT FROM true THEN 'success_mutated' END, CASE WHEN result = 'UNKNOWN' AND m IS NOT NULL THEN 'unknown_mutation' END], lambda v: v IS NOT NULL) AS violations
FROM x WHERE len(violations) > 0""")
def audit_violations(s, d):
    _, aud = _audits(s, d)
    p = F.col("l_partkey")
    x = aud.withColumn("mutated", F.when(p % 3 != 0, p % 3 == 1)).withColumn("ended_at", F.when(p % 4 != 0, F.lit(1)))
    return audit.violations(x, audit.audit_rules()).select("audit_id", "violations")


@query(f"""WITH {FILES_SQL}, p AS (SELECT DISTINCT doc_id % 40 AS plan_id FROM files), c AS (SELECT doc_id % 40 AS plan_id, doc_id < 36 AS canonical, doc_id % 101 <> 0 AND doc_id % 103 <> 0 AND doc_id % 107 <> 0 AND doc_id % 109 <> 0 AND doc_id % 113 <> 0 AND doc_id % 127 <> 0 AND regexp_matches(path, '[^/.]\\.[^./]+$') AS ok FROM files),
g AS (SELECT plan_id, bool_and(ok) AND bool_or(canonical) AS valid, count(*) FILTER (WHERE NOT ok) AS bad FROM c GROUP BY 1)
SELECT plan_id, valid, bad FROM p JOIN g USING (plan_id)""")
def plan_validity(s, d):
    i = F.col("doc_id")
    f = files(s, d).withColumn("plan_id", i % 40)
    scan = f.where("doc_id % 101 <> 0").select("path", F.when(i % 127 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(i % 103 == 0, F.lit("x")).otherwise(F.col("sha")).alias("sha"))
    now = f.where("doc_id % 107 <> 0").select(i.alias("document_id"), F.when(i % 109 == 0, F.lit("moved")).otherwise(F.col("path")).alias("source"), F.when(i % 113 == 0, F.lit("odd")).otherwise(F.upper(F.element_at(F.split("path", r"\."), -1))).alias("source_type"))
    seen = f.select("plan_id", i.alias("document_id"), (i < 36).alias("canonical"), "path", "size", "sha")
    return audit.plan_validity(f.select("plan_id").distinct(), seen, scan, now)


@query("""SELECT s_suppkey AS plan_id, CASE WHEN s_suppkey % 11 = 0 THEN 'review not found' WHEN s_suppkey % 3 = 1 THEN 'review not approved' WHEN s_suppkey % 5 = 2 THEN 'already authorized' WHEN s_suppkey % 4 <> 1 THEN 'no longer valid' END AS problem FROM supplier""")
def authorization_problems(s, d):
    k = F.col("s_suppkey")
    sup = table(s, d, "supplier")
    reviews = sup.where(k % 11 != 0).select(k.alias("review_id"), F.when(k % 3 == 1, "PENDING").otherwise("APPROVED").alias("status"))
    auth = sup.where(k % 5 >= 2).select(k.alias("plan_id"), F.when(k % 5 == 2, "AUTHORIZED").otherwise("REVOKED").alias("status"))
    valid = sup.where(k % 4 < 3).select(k.alias("plan_id"), (k % 4 == 1).alias("valid"))
    return audit.authorization_problem(sup.select(k.alias("plan_id"), k.alias("review_id")), reviews, auth, valid)


@query("""WITH e AS (SELECT event_id // 4 AS group_id, CAST(event_id % (1 + (event_id // 4) % 4) AS INTEGER) + 1 AS no, CASE WHEN event_id % 29 = 0 THEN 'FAILURE' WHEN event_id % 3 = 0 THEN 'SKIPPED' ELSE 'SUCCESS' END AS outcome, event_id % 5 < 3 AS done FROM events)
SELECT group_id, CASE WHEN bool_or(outcome = 'FAILURE') THEN 'FAILED' ELSE ['EXTRACTED', 'NORMALIZED', 'CHUNKED', 'EMBEDDED', 'INGESTED'][coalesce(max(CASE WHEN outcome = 'SUCCESS' THEN no + CAST(no = 4 AND done AS INTEGER) END), 1)] END AS state FROM e GROUP BY group_id""")
def state_from_attempts(s, d):
    e = F.col("event_id")
    g = F.floor(e / 4)
    at = (e % (1 + g % 4)).cast("int")
    a = table(s, d, "events").select(g.alias("group_id"), F.get(F.array(*[F.lit(x) for x in audit.STAGES]), at).alias("stage"), F.when(e % 29 == 0, "FAILURE").when(e % 3 == 0, "SKIPPED").otherwise("SUCCESS").alias("outcome"), F.when(e % 5 < 3, 0).otherwise(7).alias("chunks_left"))
    return audit.state_from_attempts(a)


@query("""WITH e AS (SELECT user_id % 50 AS batch_id, ['reserve', 'consume', 'release', 'recover'][CAST(event_id % 4 AS INTEGER) + 1] AS kind, event_id % 7 AS amount FROM events)
SELECT batch_id, CAST(sum(CASE kind WHEN 'reserve' THEN amount WHEN 'release' THEN -amount WHEN 'recover' THEN -amount ELSE 0 END) AS BIGINT) AS reserved, CAST(sum(CASE WHEN kind = 'consume' THEN amount ELSE 0 END) AS BIGINT) AS consumed FROM e GROUP BY 1""")
def embedding_ledger(s, d):
    e = F.col("event_id")
    kind = F.get(F.array(*[F.lit(x) for x in ("reserve", "consume", "release", "recover")]), (e % 4).cast("int"))
    return audit.ledger(table(s, d, "events").select((F.col("user_id") % 50).alias("batch_id"), kind.alias("kind"), (e % 7).alias("amount")))


_CH = "['PLANNED', 'RUNNING', 'PAUSED', 'COMPLETED', 'ABORTED']"


@query(f"""WITH c AS (SELECT event_id, {_CH}[CAST(event_id % 5 AS INTEGER) + 1] AS old, {_CH}[CAST((event_id // 5) % 5 AS INTEGER) + 1] AS new, CASE WHEN event_id % 3 = 0 THEN 'MANUAL_ABORT' ELSE 'POLICY' END AS reason FROM events)
SELECT * FROM c WHERE old || '>' || new NOT IN ('PLANNED>RUNNING', 'RUNNING>PAUSED', 'RUNNING>COMPLETED', 'RUNNING>ABORTED', 'PAUSED>RUNNING', 'PAUSED>ABORTED') OR (reason = 'MANUAL_ABORT' AND old <> 'PAUSED')""")
def illegal_transitions(s, d):
    names, e = F.array(*[F.lit(x) for x in ("PLANNED", "RUNNING", "PAUSED", "COMPLETED", "ABORTED")]), F.col("event_id")
    c = table(s, d, "events").select("event_id", F.get(names, (e % 5).cast("int")).alias("old"), F.get(names, (F.floor(e / 5) % 5).cast("int")).alias("new"), F.when(e % 3 == 0, "MANUAL_ABORT").otherwise("POLICY").alias("reason"))
    return audit.illegal_transitions(c)


@query("SELECT p_partkey AS id, CASE WHEN p_size < 10 OR p_partkey % 100 < 5 THEN 'HARD_STOP' WHEN p_size < 15 OR p_partkey % 100 < 20 THEN 'SOFT_STOP' ELSE 'NORMAL' END AS tier FROM part")
def resource_tiers(s, d):
    disk, memory = audit.guard_tier(F.col("p_size"), 15, 10), audit.guard_tier(F.col("p_partkey") % 100, 20, 5)
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), audit.worse_tier(disk, memory).alias("tier"))


@query("SELECT l_orderkey AS archive, CAST(sum(CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey ELSE l_partkey END) AS BIGINT) AS charged FROM lineitem GROUP BY 1")
def extracted_bytes(s, d):
    m = table(s, d, "lineitem").select(F.col("l_orderkey").alias("archive"), F.col("l_partkey").alias("estimate"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_suppkey")).alias("actual"))
    return audit.corrected_bytes(m)


@query("SELECT s_suppkey AS run_id FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey % 40 FROM customer WHERE c_custkey % 3 = 0 UNION SELECT c_custkey % 60 FROM customer WHERE c_custkey % 5 = 0 UNION SELECT 77)")
def orphan_runs(s, d):
    c = F.col("c_custkey")
    uses = table(s, d, "customer").select(F.when(c % 3 == 0, c % 40).alias("d0"), F.when(c % 5 == 0, c % 60).alias("d1"), F.lit(77).cast("long").alias("d2"))
    return audit.orphan_runs(table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("run_id")), uses)


@query("SELECT o_orderkey AS owner FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 6 = 0 OR (o_orderkey % 8 = 0 AND n > 1)")
def bad_chains(s, d):
    o, n = F.col("l_orderkey"), F.col("n")
    li = table(s, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    kind = F.when((n == 1) & (o % 6 != 0), "FILE").otherwise("ARCHIVE_MEMBER")
    links = li.select(o.alias("owner"), n.alias("seq"), kind.alias("kind"), n.alias("id"), F.when(n > 1, F.when(o % 8 == 0, n + 7).otherwise(n - 1)).alias("parent"))
    return audit.bad_chains(links)


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM conversations QUALIFY from_end <= 3")
def recent_history(s, d):
    return conversations.last_messages(table(s, d, "conversations"), 3).select("conv_id", "turn", "role", "from_end")


@query(r"""WITH p AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM conversations)
SELECT conv_id, turn, sha256(CASE WHEN n <= 8 AND prev IS NOT NULL THEN prev || ' ' || text ELSE text END) AS query_sha FROM p WHERE role = 'user'""")
def followup_query(s, d):
    return conversations.follow_up_queries(table(s, d, "conversations")).select("conv_id", "turn", F.sha2("query", 256).alias("query_sha"))


@query("WITH n AS (SELECT conv_id, turn, least(count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 20) AS n FROM conversations) SELECT * FROM n WHERE n = 2 OR n % 6 = 0")
def title_refresh(s, d):
    return conversations.title_refresh(table(s, d, "conversations")).select("conv_id", "turn", "n")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 100")
def recent_activity(s, d):
    return conversations.newest(table(s, d, "events"), "ts", "event_id", 100).select("event_id", "event_type")


@query("""WITH cit AS (SELECT DISTINCT event_id AS message_id, unnest([user_id % 1000, value % 1, event_id % 700]) AS document_id FROM (SELECT event_id, user_id, 5 AS value FROM events)),
n AS (SELECT document_id, count(*) AS citing FROM cit GROUP BY 1)
SELECT d.doc_id AS document_id, 'job' || CAST(d.doc_id % 12 AS VARCHAR) AS job, CAST(1 + greatest(ceil((length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) - 1000) / 800.0), 0) AS BIGINT) * CAST(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0 AS BIGINT) AS chunks, coalesce(citing, 0) AS citing FROM documents d LEFT JOIN n ON n.document_id = d.doc_id""")
def provenance_trace(s, d):
    from lodestack.plans.testdata import chunks

    docs = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 12).alias("job_id"))
    jobs = s.range(12).select(F.col("id").alias("job_id"), F.concat(F.lit("job"), F.col("id").cast("string")).alias("job"))
    e = table(s, d, "events")
    ref = lambda c: F.struct(c.cast("long").alias("document_id"))
    msgs = e.select(F.col("event_id").alias("message_id"), F.array(ref(F.col("user_id") % 1000), ref(F.lit(0)), ref(F.col("event_id") % 700)).alias("citations"))
    return conversations.provenance_trace(docs, jobs, chunks(s, d), conversations.citing_messages(msgs)).select("document_id", "job", "chunks", "citing")


@query("SELECT doc_id, list_filter([CASE WHEN doc_id % 2 = 0 THEN 'documents' END, CASE WHEN doc_id % 3 = 0 THEN 'memory' END, CASE WHEN doc_id % 5 = 0 THEN 'attachment' END, CASE WHEN doc_id % 7 = 0 THEN 'web' END], lambda x: x IS NOT NULL) AS sources FROM documents")
def context_sources(s, d):
    i = F.col("doc_id")
    return table(s, d, "documents").select("doc_id", conversations.context_sources(i % 2 == 0, i % 3 == 0, i % 5 == 0, i % 7 == 0).alias("sources"))


@query("""WITH u AS (SELECT user_id AS k, max(event_id) FILTER (WHERE event_id % 2 = 0) AS old, max(event_id) FILTER (WHERE event_id % 2 = 1) AS new FROM events GROUP BY 1) SELECT k, greatest(old, new) AS version FROM u""")
def upsert_latest(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("version"))
    return ingest.upsert(e.where("version % 2 = 0"), e.where("version % 2 = 1"), ["k"], "version")


@query("WITH o AS (SELECT DISTINCT user_id AS k FROM events WHERE event_id < 300) SELECT k, 0 AS version FROM o UNION ALL SELECT user_id AS k, min(event_id) AS version FROM events WHERE event_id >= 300 AND user_id NOT IN (SELECT k FROM o) GROUP BY 1")
def insert_if_absent(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("version"))
    old = e.where("version < 300").select("k", F.lit(0).cast("long").alias("version")).distinct()
    return ingest.insert_if_absent(old, e.where("version >= 300"), ["k"], ["version"])


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def events_tumbling(s, d):
    from lodestack.streaming.windows import tumbling

    return tumbling(table(s, d, "events"), "1 hour").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def events_session(s, d):
    from lodestack.streaming.windows import sessions

    return sessions(table(s, d, "events"), "30 minutes").select("user_id", "start", "n")


# Events as probes of a user's service: amounts as free disk, errors as calls that did not reach it.
@query("""
WITH p AS (SELECT user_id AS key, event_id AS seq, CAST(floor(value * 100) AS BIGINT) * 20000000 AS workspace, CAST(floor(value * 100) AS BIGINT) * 9000000 AS dbfree, CASE WHEN event_type IN ('error', 'view') THEN FALSE WHEN event_type = 'signup' THEN TRUE END AS reachable FROM events),
i AS (SELECT *, sum(CASE WHEN reachable THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS isle FROM p),
f AS (SELECT *, sum(CASE WHEN NOT reachable THEN 1 ELSE 0 END) OVER (PARTITION BY key, isle ORDER BY seq) AS failures,
  CASE WHEN workspace < 10737418240 THEN 2 WHEN workspace < 16106127360 THEN 1 ELSE 0 END AS w, CASE WHEN dbfree < 5368709120 THEN 2 WHEN dbfree < 8589934592 THEN 1 ELSE 0 END AS d FROM i),
g AS (SELECT *, greatest(w, d) AS n, NOT coalesce(reachable, TRUE) AND failures >= 3 AS lost FROM f)
SELECT key, seq, CAST(failures AS BIGINT) AS failures, CASE WHEN n = 2 OR (n = 0 AND lost) THEN 'HARD_STOP' WHEN n = 1 THEN 'SOFT_STOP' ELSE 'NORMAL' END AS tier,
  CASE WHEN n > 0 THEN (CASE WHEN d > w THEN 'postgres' ELSE 'workspace' END) || (CASE WHEN n = 2 THEN '_hard_stop' ELSE '_soft_stop' END) WHEN lost THEN 'ollama_persistently_unreachable' END AS stop_reason FROM g""")
def guard_probes(s, d):
    e, cents = table(s, d, "events"), F.floor(F.col("value") * 100).cast("long")
    reachable = F.when(F.col("event_type").isin("error", "view"), False).when(F.col("event_type") == "signup", True)
    p = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (cents * 20_000_000).alias("workspace"), (cents * 9_000_000).alias("database"), reachable.alias("reachable"))
    return batches.guard_probes(p).select("key", "seq", "failures", "tier", "stop_reason")


# Events as commands; a user's events of one stretch of numbers are a batch.
_REASONS = [*batches.PAUSE_REASONS, *batches.ABORT_REASONS, batches.MANUAL_ABORT, *batches.COMPLETE_REASONS]


@query(f"""
WITH RECURSIVE c AS (SELECT user_id * 1000000 + event_id // 1000 AS batch_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'pause' WHEN 'view' THEN 'resume' WHEN 'error' THEN 'abort' ELSE 'complete' END AS action,
  {_REASONS}[CAST(event_id % {len(_REASONS)} AS INTEGER) + 1] AS reason, ['NORMAL', 'NORMAL', 'SOFT_STOP', 'HARD_STOP'][CAST(event_id % 4 AS INTEGER) + 1] AS tier FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY seq) AS k,
  CASE WHEN action = 'pause' THEN reason IN {batches.PAUSE_REASONS} WHEN action = 'abort' THEN reason IN {(*batches.ABORT_REASONS, batches.MANUAL_ABORT)} WHEN action = 'complete' THEN reason IN {batches.COMPLETE_REASONS} ELSE TRUE END AS fits FROM c),
r AS (SELECT DISTINCT batch_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, '' AS old, 'PLANNED' AS new, TRUE AS fits, '' AS reason FROM c
  UNION ALL SELECT o.batch_id, o.k, o.seq, r.new, CASE WHEN NOT o.fits THEN r.new WHEN action = 'start' AND r.new = 'PLANNED' THEN 'RUNNING' WHEN action = 'pause' AND r.new = 'RUNNING' THEN 'PAUSED'
    WHEN action = 'resume' AND r.new = 'PAUSED' THEN CASE tier WHEN 'HARD_STOP' THEN 'ABORTED' WHEN 'SOFT_STOP' THEN 'PAUSED' ELSE 'RUNNING' END
    WHEN action = 'abort' AND (r.new = 'PAUSED' OR (r.new = 'RUNNING' AND o.reason <> '{batches.MANUAL_ABORT}')) THEN 'ABORTED' WHEN action = 'complete' AND r.new = 'RUNNING' THEN 'COMPLETED' ELSE r.new END, o.fits, o.reason
  FROM r JOIN o ON o.batch_id = r.batch_id AND o.k = r.k + 1)
SELECT batch_id, seq, old, new, old <> new AS applied, CASE WHEN NOT fits THEN 'reason' END AS problem, CASE WHEN old <> new AND new <> 'RUNNING' THEN reason END AS stop_reason FROM r WHERE k > 0""")
def batch_machine(s, d):
    e, i = table(s, d, "events"), F.col("event_id")
    action = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "click", "pause").when(F.col("event_type") == "view", "resume").when(F.col("event_type") == "error", "abort").otherwise("complete")
    pick = lambda values, n: F.element_at(F.lit(values), (n + 1).cast("int"))
    c = e.select((F.col("user_id") * 1_000_000 + F.floor(i / 1000)).alias("batch_id"), i.alias("seq"), action.alias("action"), pick(_REASONS, i % len(_REASONS)).alias("reason"), pick(["NORMAL", "NORMAL", "SOFT_STOP", "HARD_STOP"], i % 4).alias("tier"))
    return batches.fold_commands(c)
