"""Queries: file inventory, duplicates of files and directories, provenance, manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import paths as P
from lodestack.functions.text import date_tokens
from lodestack.operators import inventory, lookups, manifest
from lodestack.plans.testdata import FILES_SQL, TREES_SQL, files, trees

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


DIRTY_SQL = manifest.DIRTY
_EXT = "CASE WHEN lower(path) LIKE '%.tar.gz' THEN '.tar.gz' WHEN regexp_extract(path, '[^/]+(\\.[^./]+)$', 1) = '' THEN '(no extension)' ELSE lower(regexp_extract(path, '[^/]+(\\.[^./]+)$', 1)) END"
_ANC = "unnest([array_to_string(string_split(path, '/')[1:n], '/') for n in range(1, len(string_split(path, '/')))]) AS dir"


@query(f"WITH {FILES_SQL}, e AS (SELECT {_EXT} AS ext, size FROM files) SELECT ext, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, ext IN ('.zip', '.7z', '.rar', '.tar', '.gz', '.tgz', '.tar.gz', '.bz2', '.tbz2', '.tar.bz2', '.xz', '.txz', '.tar.xz', '.iso', '.cab', '.arj', '.lz', '.lzma', '.z', '.zst', '.tzst') AS is_archive, ext IN ('.zip', '.7z') AS is_known FROM e GROUP BY ext")
def ext_inventory(s, d):
    return inventory.by_extension(files(s, d))


@query(f"WITH {FILES_SQL}, a AS (SELECT size, {_ANC} FROM files) SELECT dir, CAST(len(string_split(dir, '/')) AS INTEGER) AS dir_depth, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM a GROUP BY dir")
def subtree_sizes(s, d):
    return inventory.subtree_sizes(files(s, d))


@query(f"WITH {FILES_SQL} SELECT path, size FROM files ORDER BY size DESC, path LIMIT 20")
def largest_files(s, d):
    return inventory.largest(files(s, d).select("path", "size"), 20)


@query(f"WITH {FILES_SQL} SELECT path, size FROM files WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1)")
def d1_size_candidates(s, d):
    return inventory.size_candidates(files(s, d)).select("path", "size")


@query(f"WITH {FILES_SQL} SELECT size, sha, count(*) AS n, min(path) AS first_path, CASE WHEN bool_and(lower(path) LIKE '%.c9r') THEN 'cryptomator_chunk_duplicate' ELSE 'exact_duplicate' END AS category, size * (count(*) - 1) AS reclaimable FROM files WHERE size > 0 GROUP BY size, sha HAVING count(*) > 1")
def d1_exact_groups(s, d):
    return inventory.exact_file_groups(files(s, d))


@query(f"""WITH {FILES_SQL}, c AS (SELECT * FROM files WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1)),
g AS (SELECT size * (count(*) - 1) AS r FROM files WHERE size > 0 GROUP BY size, sha HAVING count(*) > 1)
SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM c) AS candidates, (SELECT count(*) FROM c WHERE size > 0) AS hashed, (SELECT count(*) FROM g) AS groups, (SELECT CAST(coalesce(sum(r), 0) AS BIGINT) FROM g) AS reclaimable""")
def d1_counters(s, d):
    return inventory.counters(files(s, d))


_MERKLE = TREES_SQL + """,
l3 AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, sha256(string_agg('F:' || regexp_extract(path, '[^/]*$') || ':' || CAST(size AS VARCHAR) || chr(10), '' ORDER BY 'F:' || regexp_extract(path, '[^/]*$') || ':' || CAST(size AS VARCHAR) || chr(10))) AS sig, count(*) AS files FROM trees GROUP BY 1),
l2 AS (SELECT regexp_replace(dir, '/[^/]*$', '') AS dir, sha256(string_agg('D:' || regexp_extract(dir, '[^/]*$') || ':' || sig || chr(10), '' ORDER BY dir)) AS sig, CAST(sum(files) AS BIGINT) AS files FROM l3 GROUP BY 1),
l1 AS (SELECT 'root' AS dir, sha256(string_agg('D:' || regexp_extract(dir, '[^/]*$') || ':' || sig || chr(10), '' ORDER BY 'D:' || regexp_extract(dir, '[^/]*$') || ':' || sig)) AS sig, CAST(sum(files) AS BIGINT) AS files FROM l2),
sigs AS (SELECT dir, 3 AS dir_depth, sig, files FROM l3 UNION ALL SELECT dir, 2, sig, files FROM l2 UNION ALL SELECT dir, 1, sig, files FROM l1)"""


@query(f"WITH {_MERKLE} SELECT * FROM sigs")
def dir_merkle(s, d):
    return inventory.merkle_signatures(trees(s, d))


@query(f"""WITH {_MERKLE}, m AS (SELECT *, count(*) OVER (PARTITION BY sig) AS n FROM sigs), r AS (SELECT dir FROM m WHERE n > 1)
SELECT sig, n, min(dir) AS first_dir FROM m WHERE n > 1 GROUP BY sig, n HAVING NOT bool_and(regexp_replace(dir, '/[^/]*$', '') IN (SELECT dir FROM r))""")
def dir_merkle_groups(s, d):
    return inventory.duplicate_directories(inventory.merkle_signatures(trees(s, d)))


_FOLDERS = TREES_SQL + """,
f3 AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, sha1(string_agg('f' || chr(0) || regexp_extract(path, '[^/]*$') || chr(0) || sha || chr(0), '' ORDER BY regexp_extract(path, '[^/]*$'))) AS sig, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM trees GROUP BY 1),
f2 AS (SELECT regexp_replace(dir, '/[^/]*$', '') AS dir, sha1(string_agg('d' || chr(0) || regexp_extract(dir, '[^/]*$') || chr(0) || sig || chr(0), '' ORDER BY dir)) AS sig, CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM f3 GROUP BY 1),
f1 AS (SELECT 'root' AS dir, sha1(string_agg('d' || chr(0) || regexp_extract(dir, '[^/]*$') || chr(0) || sig || chr(0), '' ORDER BY 'd' || chr(0) || regexp_extract(dir, '[^/]*$') || chr(0) || sig)) AS sig, CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM f2),
folders AS (SELECT * FROM f3 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f1)"""


@query(f"WITH {_FOLDERS} SELECT dir, sig AS fingerprint, files, bytes FROM folders")
def folder_fingerprints(s, d):
    return lookups.folder_fingerprints(trees(s, d))


@query(f"""WITH {_FOLDERS} SELECT a.sig, count(*) AS n, count(DISTINCT b.sig) <> 1 OR bool_or(b.sig IS NULL) AS maximal
FROM folders a LEFT JOIN folders b ON b.dir = regexp_replace(a.dir, '/[^/]*$', '') AND a.dir LIKE '%/%' GROUP BY a.sig HAVING count(*) > 1""")
def folder_groups(s, d):
    return inventory.folder_groups(lookups.folder_fingerprints(trees(s, d)).select("dir", F.col("fingerprint").alias("sig")))


@query(f"""WITH {_MERKLE}, m AS (SELECT *, count(*) OVER (PARTITION BY sig) AS n FROM sigs), r AS (SELECT dir FROM m WHERE n > 1),
w AS (SELECT regexp_replace(path, '/[^/]*$', '') AS d3, size FROM trees),
b AS (SELECT s.dir, CAST(sum(size) AS BIGINT) AS bytes FROM sigs s JOIN w ON d3 = s.dir OR starts_with(d3, s.dir || '/') GROUP BY 1),
dg AS (SELECT sig, n, min(m.dir) AS first_dir FROM m WHERE n > 1 GROUP BY sig, n HAVING NOT bool_and(regexp_replace(m.dir, '/[^/]*$', '') IN (SELECT dir FROM r))),
fg AS (SELECT size, sha, count(*) AS n, min(path) AS first_path FROM trees WHERE size > 0 GROUP BY size, sha HAVING count(*) > 1),
x AS (SELECT 'exact_duplicate' AS section, first_path AS path, n, size * (n - 1) AS reclaimable FROM fg UNION ALL SELECT 'directory_duplicate', first_dir, n, (n - 1) * bytes FROM dg JOIN b ON b.dir = first_dir)
SELECT section, path, n, reclaimable, row_number() OVER (PARTITION BY section ORDER BY reclaimable DESC, path) AS rank FROM x QUALIFY rank <= 10""")
def d1_report(s, d):
    t = trees(s, d)
    groups = inventory.duplicate_directories(inventory.merkle_signatures(t)).join(inventory.subtree_sizes(t).select(F.col("dir").alias("first_dir"), "bytes"), "first_dir")
    return inventory.report_sections(inventory.exact_file_groups(t), groups, 10).select("section", "path", "n", "reclaimable", "rank")


@query(f"""WITH {_MERKLE}, m AS (SELECT *, count(*) OVER (PARTITION BY sig) AS n FROM sigs),
p AS (SELECT sha AS group_id, path FROM trees),
a AS (SELECT group_id, path, arg_max(m.sig, dir_depth) AS sig FROM p JOIN m ON n > 1 AND starts_with(path, dir || '/') GROUP BY ALL)
SELECT p.group_id, CASE WHEN count(DISTINCT a.sig) = 1 AND NOT bool_or(a.sig IS NULL) THEN min(a.sig) END AS sig FROM p LEFT JOIN a USING (group_id, path) GROUP BY p.group_id""")
def nearest_dup_ancestor(s, d):
    sigs = inventory.merkle_signatures(trees(s, d))
    dup = sigs.join(sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sig", "left_semi")
    return inventory.nearest_duplicate_ancestor(trees(s, d).select(F.col("sha").alias("group_id"), "path"), dup)


_DATES = """[strftime(x, '%Y-%m-%d') for x in list_filter(
  list_transform(list_filter(regexp_extract_all(path, '[0-9]+'), lambda t: length(t) = 8), lambda t: CASE
    WHEN year(try_strptime(t, '%d%m%Y')) BETWEEN 2000 AND 2035 THEN try_strptime(t, '%d%m%Y')
    WHEN year(try_strptime(t, '%Y%m%d')) BETWEEN 2000 AND 2035 THEN try_strptime(t, '%Y%m%d') END), lambda x: x IS NOT NULL)]"""


@query(f"WITH {FILES_SQL} SELECT path, {_DATES} AS dates FROM files")
def path_date_tokens(s, d):
    return files(s, d).select("path", date_tokens(F.col("path")).alias("dates"))


@query(f"WITH {FILES_SQL} SELECT path, list_sort(list_filter(['d1', 'en', 'src1', '.PDF', 'f9'], lambda k: contains(lower(path), lower(k)))) AS words FROM files")
def path_keywords(s, d):
    return files(s, d).select("path", F.transform(manifest.keywords(F.col("path"), ["d1", "en", "src1", ".pdf", "f9"]), lambda w: F.when(w == ".pdf", ".PDF").otherwise(w)).alias("words"))


# Groups of equal texts, under folders that do or do not sound historical; some paths are gone, some carry no date.
_FACTS = FILES_SQL + f""", named AS (SELECT sha AS group_id, doc_id % 7 <> 3 AS present,
  (['', 'Archive/', 'work/', 'Current/x/', '', 'Takeout-1/', 'work/', ''])[CAST(doc_id % 8 AS INTEGER) + 1] || CASE WHEN doc_id % 3 = 0 THEN path ELSE regexp_replace(path, '_[0-9]+', '_n', 'g') END AS path FROM files),
mem AS (SELECT *, len(string_split(path, '/')) AS depth, {_DATES} AS d,
  len(list_filter(['archive', 'backup', 'as a copy of', 'copy of', 'old', '_duplicates_quarantine', '.trash', 'sync-conflict', 'takeout-'], lambda k: contains(lower(path), k))) > 0 AS h,
  len(list_filter(['current', 'latest', 'working'], lambda k: contains(lower(path), k))) > 0 AS c FROM named),
grp AS (SELECT group_id FROM mem GROUP BY 1 HAVING count(*) > 1),
facts AS (SELECT group_id, count(*) FILTER (WHERE present) AS existing, count(*) FILTER (WHERE NOT present) AS missing,
  coalesce(list_sort(list_distinct(flatten(list(d) FILTER (WHERE present)))), []) AS dates,
  count(*) FILTER (WHERE present AND len(d) > 0) AS with_dates, count(*) FILTER (WHERE present AND len(d) = 0) AS without_dates,
  count(*) FILTER (WHERE present AND h) AS with_historical, count(*) FILTER (WHERE present AND c) AS with_current,
  CAST(min(depth) FILTER (WHERE present) AS INTEGER) AS min_depth, CAST(max(depth) FILTER (WHERE present) AS INTEGER) AS max_depth,
  first(path ORDER BY depth, path) FILTER (WHERE present) AS shallowest, first(h ORDER BY depth, path) FILTER (WHERE present) AS shallowest_historical
  FROM mem SEMI JOIN grp USING (group_id) GROUP BY group_id),
inf AS (SELECT *, CASE WHEN existing < 2 THEN 'STALE_REFERENCE_UNVERIFIABLE' WHEN len(dates) >= 2 THEN 'DIVERGENT_DATE_SIGNAL' WHEN len(dates) = 1 AND without_dates > 0 THEN 'PARTIAL_DATE_OR_KEYWORD_SIGNAL'
  WHEN with_historical > 0 AND max_depth > min_depth AND NOT shallowest_historical THEN 'PARTIAL_DATE_OR_KEYWORD_SIGNAL' WHEN with_historical > 0 THEN 'UNIFORM_KEYWORD_NO_FURTHER_SIGNAL' ELSE 'NO_PROVENANCE_SIGNAL' END AS inference FROM facts)"""


def _facts(s, d):
    i = F.col("doc_id")
    top = F.element_at(F.array(*[F.lit(x) for x in ("", "Archive/", "work/", "Current/x/", "", "Takeout-1/", "work/", "")]), (i % 8 + 1).cast("int"))
    path = F.concat(top, F.when(i % 3 == 0, F.col("path")).otherwise(F.regexp_replace("path", "_[0-9]+", "_n")))
    m = files(s, d).select(F.col("sha").alias("group_id"), path.alias("path"), (i % 7 != 3).alias("present"))
    g = m.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return manifest.group_facts(m.join(g, "group_id", "left_semi"))


@query(f"WITH {_FACTS} SELECT * FROM facts")
def d2_facts(s, d):
    return _facts(s, d)


@query(f"""WITH {_FACTS} SELECT group_id, inference, CASE WHEN inference = 'DIVERGENT_DATE_SIGNAL' THEN 'medium' ELSE 'low' END AS confidence, inference <> 'DIVERGENT_DATE_SIGNAL' AS review,
CASE WHEN existing < 2 THEN 'PATHS_MISSING_IN_D2' WHEN len(dates) >= 2 THEN 'MULTIPLE_DISTINCT_DATE_TOKENS' WHEN len(dates) = 1 AND without_dates > 0 THEN 'SINGLE_DATE_TOKEN_PARTIAL_COVERAGE' WHEN inference = 'PARTIAL_DATE_OR_KEYWORD_SIGNAL' THEN 'HISTORICAL_KEYWORD_PRESENT,DEPTH_ASYMMETRY_WITH_KEYWORD' WHEN with_historical > 0 THEN 'HISTORICAL_KEYWORD_PRESENT' ELSE 'NO_DATE_OR_KEYWORD_SIGNAL' END AS evidence, shallowest FROM inf""")
def d2_inference(s, d):
    return manifest.infer(_facts(s, d)).select("group_id", "inference", "confidence", "review", F.array_join("evidence", ",").alias("evidence"), "shallowest")


@query(f"WITH {_FACTS} SELECT inference, count(*) AS n FROM inf GROUP BY inference")
def d2_inference_counts(s, d):
    return manifest.infer(_facts(s, d)).groupBy("inference").agg(F.count(F.lit(1)).alias("n"))


_IDENT = FILES_SQL + """, ident AS (SELECT path, size, mtime, CASE WHEN size = 0 THEN 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855'
  WHEN doc_id % 3 = 0 THEN sha WHEN doc_id % 3 = 1 AND doc_id % 4 <> 0 AND mtime <= 30000 THEN sha ELSE 'unique:' || path END AS sha, doc_id % 5 = 0 AS in_archive, 'z' || CAST(doc_id % 15 AS VARCHAR) || '.zip' AS archive FROM files), boxes AS (SELECT DISTINCT sha FROM files WHERE doc_id % 10 = 2)"""


def _boxes(s, d):
    """Archives that were opened."""
    return files(s, d).where("doc_id % 10 = 2")


def _ident(s, d):
    f = files(s, d)
    report = f.where("doc_id % 3 = 1").withColumn("size", F.when(F.col("doc_id") % 4 == 0, F.col("size") + 1).otherwise(F.col("size")))
    i = manifest.identify(f.select("path", "size", "mtime", "doc_id"), f.where("doc_id % 3 = 0"), report, 30000)
    return i.select("path", "size", "mtime", "sha", (F.col("doc_id") % 5 == 0).alias("in_archive"), F.concat(F.lit("z"), (F.col("doc_id") % 15).cast("string"), F.lit(".zip")).alias("archive"))


@query(f"""WITH {_IDENT}, c AS (SELECT sha, min(size) AS size, arg_min({_EXT}, [CAST(in_archive AS VARCHAR), path]) AS ext, count(*) FILTER (WHERE NOT in_archive) AS n_loose, count(*) FILTER (WHERE in_archive) AS n_archive FROM ident GROUP BY sha)
SELECT *, CASE WHEN n_archive = 0 THEN 'loose_only' WHEN n_loose = 0 THEN 'archive_only' ELSE 'both' END AS presence, sha IN (SELECT sha FROM boxes) AS is_container, NOT starts_with(sha, 'unique:') AS known FROM c""")
def content_manifest(s, d):
    return manifest.contents(_ident(s, d), _boxes(s, d))


@query(f"WITH {_IDENT}, c AS (SELECT sha, min(size) AS size, arg_min({_EXT}, [CAST(in_archive AS VARCHAR), path]) AS ext FROM ident GROUP BY sha) SELECT ext, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM c GROUP BY ext ORDER BY bytes DESC, ext LIMIT 15")
def bytes_by_type(s, d):
    g = manifest.contents(_ident(s, d), _boxes(s, d)).groupBy("ext").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("bytes"), "ext").limit(15)


@query(f"""WITH {_IDENT}, r AS (SELECT sha, path, row_number() OVER (PARTITION BY sha ORDER BY in_archive, CAST(contains(lower(path), 'src1') AS INTEGER) + CAST(contains(lower(path), 'fr/') AS INTEGER),
  regexp_matches(regexp_extract(path, '[^/]*$'), '{DIRTY_SQL}'), len(string_split(path, '/')), length(path), path) AS k, count(*) OVER (PARTITION BY sha) AS n FROM ident WHERE sha NOT IN (SELECT sha FROM boxes)) SELECT sha, path AS keep_path, n, false AS junk FROM r WHERE k = 1""")
def keep_location(s, d):
    return manifest.best_location(_ident(s, d), _boxes(s, d), ["src1", "fr/"])


@query(f"""WITH {_IDENT}, l AS (SELECT DISTINCT sha FROM ident WHERE NOT in_archive), e AS (SELECT archive, i.sha, count(*) AS n, min(size) AS size, bool_or(l.sha IS NULL) AS need FROM ident i LEFT JOIN l ON l.sha = i.sha WHERE in_archive AND size > 0 AND i.sha NOT IN (SELECT sha FROM boxes) GROUP BY ALL)
SELECT archive, CAST(sum(n) AS BIGINT) AS files, count(*) FILTER (WHERE need) AS needed, CAST(coalesce(sum(size) FILTER (WHERE need), 0) AS BIGINT) AS needed_bytes FROM e GROUP BY archive""")
def archive_verdict(s, d):
    return manifest.archive_verdict(_ident(s, d), _boxes(s, d))


_KEPT = FILES_SQL + f""", kept AS (SELECT path, size, (doc_id * 7919) % 97 < 12 AND source <> 'src3' AS kept FROM files JOIN (SELECT doc_id, source FROM documents) USING (doc_id)),
anc AS (SELECT size, kept, {_ANC} FROM kept), rem AS (SELECT dir, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM anc GROUP BY dir HAVING NOT bool_or(kept)),
top AS (SELECT * FROM rem WHERE regexp_replace(dir, '/[^/]*$', '') NOT IN (SELECT dir FROM rem) OR dir NOT LIKE '%/%')"""


def _kept(s, d):
    f = files(s, d)
    return f.select("path", "size", (((F.col("doc_id") * 7919) % 97 < 12) & ~F.startswith("path", F.lit("src3/"))).alias("kept"))


@query(f"WITH {_KEPT} SELECT * FROM top")
def removable_dirs(s, d):
    return manifest.removable_dirs(_kept(s, d))


@query(f"WITH {_KEPT} SELECT path FROM kept WHERE NOT kept AND NOT EXISTS (SELECT 1 FROM top WHERE starts_with(path, dir || '/'))")
def removable_files(s, d):
    k = _kept(s, d)
    return manifest.not_under(k.where("not kept").select("path"), manifest.removable_dirs(k))


@query(f"""WITH {FILES_SQL}, n AS (SELECT path, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE sha END AS sha FROM files WHERE doc_id % 2 = 0), live AS (SELECT DISTINCT sha FROM files WHERE doc_id % 4 = 1)
SELECT path, sha, CASE WHEN sha IS NULL THEN 'error' WHEN sha IN (SELECT sha FROM live) THEN 'duplicate' WHEN path = min(path) OVER (PARTITION BY sha) THEN 'unique' ELSE 'repeat' END AS status FROM n""")
def first_seen_repeat(s, d):
    f = files(s, d)
    new = f.where("doc_id % 2 = 0").select("path", F.when(F.col("doc_id") % 11 != 0, F.col("sha")).alias("sha"))
    return manifest.first_seen(new, f.where("doc_id % 4 = 1"))


@query(f"WITH {FILES_SQL} SELECT path, sha, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'ok' END AS status FROM files")
def verify_status(s, d):
    f = files(s, d)
    scan = f.select("path", F.when(F.col("doc_id") % 5 != 0, F.when(F.col("doc_id") % 7 == 0, F.reverse("sha")).otherwise(F.col("sha"))).alias("sha"))
    return manifest.verify(f.select("path", "sha"), scan)


@query(f"""WITH {FILES_SQL}, m AS (SELECT 'z' || CAST(doc_id % 15 AS VARCHAR) || '.zip' AS archive, path AS name, sha, size FROM files WHERE doc_id % 5 = 0 AND size > 0 AND doc_id % 35 <> 0)
SELECT archive, name, sha FROM m WHERE sha NOT IN (SELECT sha FROM files WHERE doc_id % 5 <> 0)""")
def archive_needed(s, d):
    f = files(s, d)
    m = f.where("doc_id % 5 = 0").select(F.concat(F.lit("z"), (F.col("doc_id") % 15).cast("string"), F.lit(".zip")).alias("archive"), F.col("path").alias("name"), "sha", "size", (F.col("doc_id") % 35 == 0).alias("opened"))
    return manifest.archive_needed(m, f.where("doc_id % 5 <> 0")).select("archive", "name", "sha")


@query(f"WITH {FILES_SQL} SELECT path, regexp_extract_all(path || '!a/b.7z!c', '(?i).*?(?:\\.zip!|\\.7z!|\\.rar!)|.+$') AS levels FROM files WHERE path LIKE '%.zip'")
def archive_levels(s, d):
    f = files(s, d).where(F.endswith("path", F.lit(".zip")))
    return f.select("path", P.archive_levels(F.concat("path", F.lit("!a/b.7z!c"))).alias("levels"))
