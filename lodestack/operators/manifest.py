"""Provenance facts and the content manifest (D2, D3: A10 to A20, J13, J16 to J20, J27, J30, P12, P13, P16, W07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import paths as P
from lodestack.functions.text import date_tokens

# Names that are never kept, words that mark a path as historical or as current, and the
# pattern of names that copying programs make.
JUNK = ("thumbs.db", "desktop.ini", ".ds_store")
HISTORICAL = ("archive", "backup", "as a copy of", "copy of", "old", "_duplicates_quarantine", ".trash", "sync-conflict", "takeout-")
CURRENT = ("current", "latest", "working")
DIRTY = r"(?i)(_\d{10}(\.[^./]+)?$)|(\.duplicate-\d+)|( \(\d+\)(\.[^./]+)?$)|( - copy)| copy(\.[^./]+)?$"
#: Evidence patterns of a group with their confidence and whether a human has to look.
INFERENCES = {
    "STALE_REFERENCE_UNVERIFIABLE": ("low", True),
    "DIVERGENT_DATE_SIGNAL": ("medium", False),
    "PARTIAL_DATE_OR_KEYWORD_SIGNAL": ("low", True),
    "UNIFORM_KEYWORD_NO_FURTHER_SIGNAL": ("low", True),
    "NO_PROVENANCE_SIGNAL": ("low", True),
}


def is_junk(path: Column) -> Column:
    return F.lower(P.basename(path)).isin(*JUNK)


def keywords(path: Column, words=HISTORICAL) -> Column:
    """Sorted words found in a path, whatever the case."""
    return F.array_sort(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(path), w)))


def rank(path: Column, in_archive: Column, avoid: list[str]) -> Column:
    """Struct to take the least of: not in an archive, fewest words to avoid, clean name, shallow, short, then the path."""
    low = F.lower(path)
    hits = sum((F.contains(low, F.lit(a)).cast("int") for a in avoid), F.lit(0))
    dirty = P.basename(path).rlike(DIRTY)
    return F.struct(in_archive.alias("in_archive"), hits.alias("hits"), dirty.alias("dirty"), P.depth(path).alias("depth"), F.length(path).alias("chars"), path.alias("path"))


def group_facts(members: DataFrame) -> DataFrame:
    """group_id, path, present -> facts of each group; all but ``missing`` are of paths that are present.

    existing, missing, dates (sorted, distinct), with_dates, without_dates, with_historical,
    with_current, min_depth, max_depth, shallowest (its path; the least of equally deep ones) and
    shallowest_historical.
    """
    p, here = F.col("path"), F.col("present")
    d, old, new = date_tokens(p), F.size(keywords(p)) > 0, F.size(keywords(p, CURRENT)) > 0
    m = members.select("group_id", "path", "present", F.when(here, d).alias("d"), old.alias("old"), new.alias("new"), P.depth(p).alias("depth"))
    dated = F.size("d") > 0
    g = m.groupBy("group_id").agg(
        F.count_if(here).alias("existing"),
        F.count_if(~here).alias("missing"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("d")))).alias("dates"),
        F.count_if(here & dated).alias("with_dates"),
        F.count_if(here & ~dated).alias("without_dates"),
        F.count_if(here & F.col("old")).alias("with_historical"),
        F.count_if(here & F.col("new")).alias("with_current"),
        F.min(F.when(here, F.col("depth"))).alias("min_depth"),
        F.max(F.when(here, F.col("depth"))).alias("max_depth"),
        F.min(F.when(here, F.struct("depth", "path", "old"))).alias("_s"),
    )
    return g.withColumn("shallowest", F.col("_s.path")).withColumn("shallowest_historical", F.col("_s.old")).drop("_s")


def infer(facts: DataFrame) -> DataFrame:
    """Adds inference, evidence, confidence and review (whether a human has to look) by the first pattern that holds."""
    dates, old = F.size("dates"), F.col("with_historical") > 0
    asymmetric = old & (F.col("max_depth") > F.col("min_depth")) & ~F.col("shallowest_historical")
    patterns = [
        (F.col("existing") < 2, "STALE_REFERENCE_UNVERIFIABLE", ["PATHS_MISSING_IN_D2"]),
        (dates >= 2, "DIVERGENT_DATE_SIGNAL", ["MULTIPLE_DISTINCT_DATE_TOKENS"]),
        ((dates == 1) & (F.col("without_dates") > 0), "PARTIAL_DATE_OR_KEYWORD_SIGNAL", ["SINGLE_DATE_TOKEN_PARTIAL_COVERAGE"]),
        (asymmetric, "PARTIAL_DATE_OR_KEYWORD_SIGNAL", ["HISTORICAL_KEYWORD_PRESENT", "DEPTH_ASYMMETRY_WITH_KEYWORD"]),
        (old, "UNIFORM_KEYWORD_NO_FURTHER_SIGNAL", ["HISTORICAL_KEYWORD_PRESENT"]),
        (F.lit(True), "NO_PROVENANCE_SIGNAL", ["NO_DATE_OR_KEYWORD_SIGNAL"]),
    ]
    row = lambda code, evidence: F.struct(F.lit(code).alias("code"), F.array(*[F.lit(e) for e in evidence]).alias("evidence"), F.lit(INFERENCES[code][0]).alias("confidence"), F.lit(INFERENCES[code][1]).alias("review"))
    got = F.coalesce(*[F.when(cond, row(code, evidence)) for cond, code, evidence in patterns])
    f = facts.withColumn("_i", got)
    return f.select("*", F.col("_i.code").alias("inference"), F.col("_i.evidence").alias("evidence"), F.col("_i.confidence").alias("confidence"), F.col("_i.review").alias("review")).drop("_i")


EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def identify(scan: DataFrame, hashes: DataFrame, report: DataFrame, analyzed_at: int) -> DataFrame:
    """scan (path, size, mtime) + sha: the empty hash, the file's own, the report's if unchanged since, else ``unique:path``."""
    j = scan.join(hashes.select("path", F.col("sha").alias("_own")), "path", "left").join(report.select("path", F.col("size").alias("_size"), F.col("sha").alias("_old")), "path", "left")
    sha = F.when(F.col("size") == 0, EMPTY_SHA).otherwise(F.coalesce("_own", F.when((F.col("size") == F.col("_size")) & (F.col("mtime") <= analyzed_at), F.col("_old")), F.concat(F.lit("unique:"), "path")))
    return j.withColumn("sha", sha).drop("_own", "_size", "_old")


def contents(locations: DataFrame, containers: DataFrame) -> DataFrame:
    """sha, path, size, in_archive x containers (sha of archives that were opened) -> a row for each content.

    size, ext of its first place, loose and archive counts, presence, is_container, and known (false
    where the content was never hashed).
    """
    g = locations.groupBy("sha").agg(F.min("size").alias("size"), F.min_by(P.extension(F.col("path")), F.struct("in_archive", "path")).alias("ext"), F.count_if(~F.col("in_archive")).alias("n_loose"), F.count_if("in_archive").alias("n_archive"))
    g = g.withColumn("presence", F.when(F.col("n_archive") == 0, "loose_only").when(F.col("n_loose") == 0, "archive_only").otherwise("both"))
    g = g.join(containers.select("sha").distinct().withColumn("_c", F.lit(True)), "sha", "left")
    return g.withColumn("is_container", F.col("_c").isNotNull()).withColumn("known", ~F.startswith("sha", F.lit("unique:"))).drop("_c")


def best_location(locations: DataFrame, containers: DataFrame, avoid: list[str]) -> DataFrame:
    """sha, keep_path, n, junk: where each content is kept; containers count through their members and are left out."""
    kept = locations.join(containers.select("sha").distinct(), "sha", "left_anti")
    g = kept.groupBy("sha").agg(F.min(rank(F.col("path"), F.col("in_archive"), avoid)).alias("r"), F.count(F.lit(1)).alias("n"))
    return g.select("sha", F.col("r.path").alias("keep_path"), "n", is_junk(F.col("r.path")).alias("junk"))


def archive_verdict(locations: DataFrame, containers: DataFrame) -> DataFrame:
    """archive, files: its members of some size that are no containers; needed, needed_bytes: distinct contents that no loose file has."""
    loose = locations.where("not in_archive").select("sha").distinct().withColumn("loose", F.lit(True))
    inside = locations.where("in_archive and size > 0").join(containers.select("sha").distinct(), "sha", "left_anti").join(loose, "sha", "left")
    each = inside.groupBy("archive", "sha").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.bool_or(F.col("loose").isNull()).alias("only"))
    return each.groupBy("archive").agg(F.sum("n").alias("files"), F.count_if("only").alias("needed"), F.coalesce(F.sum(F.when(F.col("only"), F.col("size"))), F.lit(0)).alias("needed_bytes"))


def removable_dirs(files: DataFrame) -> DataFrame:
    """files (path, size, kept) -> topmost directories without a kept file below: dir, files, bytes."""
    g = P.with_ancestors(files).groupBy("dir").agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).where("kept = 0")
    up = g.select(F.col("dir").alias("up"))
    return g.withColumn("up", P.parent(F.col("dir"))).join(up, "up", "left_anti").select("dir", "files", "bytes")


def not_under(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """Files with none of the directories above them: ancestors are exploded and met by an equi-join."""
    hit = P.with_ancestors(files.select("path")).join(dirs.select("dir"), "dir", "left_semi").select("path").distinct()
    return files.join(hit, "path", "left_anti")


def first_seen(new: DataFrame, live: DataFrame) -> DataFrame:
    """path, sha -> status: error without a hash, duplicate of a live copy, unique at the first path, else repeat."""
    known = live.select(F.col("sha").alias("_s")).where("_s is not null").distinct().withColumn("_live", F.lit(True))
    first = new.where("sha is not null").groupBy(F.col("sha").alias("_f")).agg(F.min("path").alias("_first"))
    j = new.join(known, F.col("sha") == F.col("_s"), "left").join(first, F.col("sha") == F.col("_f"), "left")
    status = F.when(F.col("sha").isNull(), "error").when(F.col("_live"), "duplicate").when(F.col("path") == F.col("_first"), "unique").otherwise("repeat")
    return j.withColumn("status", status).select(*new.columns, "status")


def verify(kept: DataFrame, scan: DataFrame) -> DataFrame:
    """kept (path, sha) against a fresh scan (path, sha): ok, missing or changed."""
    j = kept.join(scan.select("path", F.col("sha").alias("_now")), "path", "left")
    return j.withColumn("status", F.when(F.col("_now") == F.col("sha"), "ok").when(F.col("_now").isNull(), "missing").otherwise("changed")).drop("_now")


def archive_needed(members: DataFrame, loose: DataFrame) -> DataFrame:
    """members (archive, name, sha, size, opened) that no live loose copy has: leaves of some size, copies that are not the archive itself."""
    m = members.where("size > 0 and not opened")
    c = loose.select(F.col("sha").alias("_s"), F.col("path").alias("_p"))
    return m.join(c, (F.col("sha") == F.col("_s")) & (F.col("archive") != F.col("_p")), "left_anti")


def copies_plan(archives: DataFrame) -> DataFrame:
    """group_id, path, processed, exists, error: groups of copies with some member processed, and no processed one there or in error."""
    g = archives.groupBy("group_id").agg(F.bool_or("processed").alias("any"), F.coalesce(F.bool_or(F.when(F.col("processed"), F.col("exists") | F.col("error"))), F.lit(False)).alias("live"))
    return archives.join(g.where("any and not live").select("group_id"), "group_id", "left_semi")


def ranked_folders(folders: DataFrame, avoid: list[str]) -> DataFrame:
    """sig, dir -> action KEEP for each group's best folder, REDUNDANT for the others."""
    w = Window.partitionBy("sig").orderBy(rank(F.col("dir"), F.lit(False), avoid))
    return folders.withColumn("action", F.when(F.row_number().over(w) == 1, "KEEP").otherwise("REDUNDANT"))
