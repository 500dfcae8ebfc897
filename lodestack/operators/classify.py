"""Classification of sources (P02 to P08, P10, P11, P25, W01, W02, W05, F11, J08, J23, A32, T-13)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import paths as P
from lodestack.functions.text import json_string

# Suffix families and size bounds (decimal bytes) of the policy.
ARCHIVE = (".zip", ".7z", ".gz", ".rar")
EXTRACTABLE = (".zip", ".7z")
ENCRYPTED = (".c9r",)
TEXT = (".txt", ".md", ".pdf", ".docx", ".pptx")
STRUCTURED = (".json", ".csv")
MEDIA = (".mp4", ".jpg", ".jpeg", ".png", ".gif", ".mp3", ".mov", ".wav", ".m4a")
SOFTWARE = (".exe", ".dll", ".msi", ".apk", ".bin")
UNSUPPORTED = (".bin", ".exe", ".dll", ".jpg", ".jpeg", ".png", ".gif", ".mp3", ".mp4", ".mov")
# Document types of the master selection, names that may hold a secret, folders of programs.
SELECTED_TEXT = (".md", ".txt", ".html", ".htm", ".pdf", ".docx", ".doc", ".rtf", ".pptx", ".xlsx", ".mbox", ".epub")
SELECTED_STRUCTURED = (".json", ".csv", ".xml", ".ipynb")
HEAVY = (".txt", ".md", ".json", ".csv")
SENSITIVE = ("recovery key", "recovery-key", "recovery_key", "recovery kit", "recovery-kit", "recovery_kit", "password", "passwd", "credential", "secret", "private key", "private_key", "seed phrase", "backup code")
VENDOR = r"(?i)/(node_modules|site-packages|\.venv|venv|\.git|__pycache__|\.cache|Cache|Code Cache|\.stversions|\.stfolder|dist-info|egg-info)/"
MB, GB = 1_000_000, 1_000_000_000
#: Rows of a range of paths that one task sums.
RANGE = 1_000_000


def source_category(suffix: Column) -> Column:
    return F.when(suffix.isin(*ARCHIVE), "ARCHIVE").otherwise("LOOSE_FILE")


def workload_category(category: Column, suffix: Column) -> Column:
    return (
        F.when(category == "ARCHIVE", "CONTAINER")
        .when(suffix.isin(*ENCRYPTED), "ENCRYPTED")
        .when(suffix.isin(*TEXT), "TEXT_DOCUMENT")
        .when(suffix.isin(*STRUCTURED), "STRUCTURED_DATA")
        .when(suffix.isin(*MEDIA), "MEDIA")
        .when(suffix.isin(*SOFTWARE), "SOFTWARE")
        .otherwise("UNKNOWN")
    )


def risk_tier(category: Column, size: Column) -> Column:
    archive = F.when(size < 10 * MB, "LOW").when(size < GB, "MEDIUM").when(size < 5 * GB, "HIGH").otherwise("EXTREME")
    loose = F.when(size >= 500 * MB, "EXTREME").when(size >= 50 * MB, "HIGH").when(size >= MB, "MEDIUM").otherwise("LOW")
    return F.when(category == "ARCHIVE", archive).otherwise(loose)


def eligibility(path: Column) -> Column:
    """By the plain suffix: conflict numbers are not taken off here."""
    s = P.suffix(path)
    return F.when(s == ".c9r", "EXCLUDED").when(s.isin(*UNSUPPORTED), "UNSUPPORTED").otherwise("ELIGIBLE")


def initial_state(eligible: Column) -> Column:
    return F.when(eligible == "EXCLUDED", "EXCLUDED").when(eligible == "UNSUPPORTED", "UNSUPPORTED").otherwise("EXTRACTED")


def classify(sources: DataFrame) -> DataFrame:
    """root, member, size -> category, workload, tier, eligibility and first state. A member's path wins over its root's."""
    path = F.coalesce("member", "root")
    s = sources.withColumn("_s", P.source_suffix(path)).withColumn("source_category", source_category(F.col("_s")))
    s = s.withColumn("workload_category", workload_category(F.col("source_category"), F.col("_s"))).withColumn("risk_tier", risk_tier(F.col("source_category"), F.col("size")))
    s = s.withColumn("extractable", F.col("_s").isin(*EXTRACTABLE)).withColumn("eligibility", eligibility(path))
    return s.withColumn("pipeline_state", initial_state(F.col("eligibility"))).drop("_s")


def policy_filter(classified: DataFrame, sources: list[str], workloads: list[str], tiers: list[str], need_extractable: bool) -> DataFrame:
    keep = F.col("source_category").isin(*sources) & F.col("workload_category").isin(*workloads) & F.col("risk_tier").isin(*tiers)
    if need_extractable:
        keep = keep & ((F.col("source_category") != "ARCHIVE") | F.col("extractable"))
    return classified.where(keep)


def stop_never_skip(candidates: DataFrame, most_bytes: int, most_files: int) -> DataFrame:
    """Path order; take rows up to the first one that would break a limit, none after it.

    Sizes are not negative, so running sums only grow. They are taken in two steps: within ranges
    of paths, and over one row a range, so no task sorts everything. Ranges hold about RANGE rows.
    """
    n = max(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-candidates.count() // RANGE))
    c = candidates.repartitionByRange(n, "path").withColumn("_r", F.spark_partition_id())
    w = Window.partitionBy("_r").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    inner = c.withColumn("_b", F.sum("size").over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    tops = inner.groupBy("_r").agg(F.max("_b").alias("b"), F.max("_n").alias("n"), F.min("path").alias("first"))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    tops = tops.select(F.col("_r").alias("_q"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n0"))
    j = inner.join(F.broadcast(tops), F.col("_r") == F.col("_q"))
    j = j.withColumn("running_bytes", F.col("_b") + F.col("_b0")).withColumn("running_files", F.col("_n") + F.col("_n0"))
    return j.where((F.col("running_bytes") <= most_bytes) & (F.col("running_files") <= most_files)).select(*candidates.columns, "running_bytes", "running_files")


def archive_deferrals(classified: DataFrame) -> DataFrame:
    """Adds deferred: of archives with one duplicate group all but the first path; a null group is never deferred."""
    first = classified.where("source_category = 'ARCHIVE' and dup_group is not null").groupBy(F.col("dup_group").alias("_g")).agg(F.min("path").alias("_first"))
    j = classified.join(first, F.col("dup_group") == F.col("_g"), "left")
    return j.withColumn("deferred", (F.col("source_category") == "ARCHIVE") & F.coalesce(F.col("path") != F.col("_first"), F.lit(False))).drop("_g", "_first")


def pilot_round_robin(files: DataFrame, k: int) -> DataFrame:
    """ext, top, sha -> k files of each ext, taken round the top folders in order of checksum."""
    w1 = Window.partitionBy("ext", "top").orderBy("sha", "path")
    w2 = Window.partitionBy("ext").orderBy("turn", "top")
    # A folder cannot give more than k, so the second window sees at most k rows of each.
    first = files.withColumn("turn", F.row_number().over(w1)).where(F.col("turn") <= k)
    return first.withColumn("pick", F.row_number().over(w2)).where(F.col("pick") <= k)


def first_exclusion(files: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds reason: the name of the first rule that holds, null for a file that stays."""
    return files.withColumn("reason", F.coalesce(*[F.when(cond, name) for name, cond in rules]))


def selected_workload(suffix: Column) -> Column:
    """text_document or structured_data; null for what is no document."""
    return F.when(suffix.isin(*SELECTED_TEXT), "text_document").when(suffix.isin(*SELECTED_STRUCTURED), "structured_data")


def selection_rules(root: str, only_types=(), folders=(), name_parts=(), sensitive: bool = True, policy: bool = True) -> list[tuple[str, Column]]:
    """Rules for first_exclusion over path, size, sha (null where none is recorded): why a document is not selected."""
    path = F.col("path")
    ext, name, top = P.suffix(path), P.basename(path), F.split_part(F.substring(path, len(root) + 2, 2147483647), F.lit("/"), F.lit(1))
    holds = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(name), w)) if words else F.lit(False)
    s = P.source_suffix(path)
    category = source_category(s)
    admitted = workload_category(category, s).isin("TEXT_DOCUMENT", "STRUCTURED_DATA")
    return [
        ("type not in this tier", ~ext.isin(*only_types) if only_types else F.lit(False)),
        ("outside the master root", ~F.startswith(path, F.lit(f"{root}/"))),
        ("top-level folder excluded", top.isin(*folders) if folders else F.lit(False)),
        ("office lock file", F.startswith(name, F.lit("~$"))),
        ("sensitive-looking name", holds(SENSITIVE) if sensitive else F.lit(False)),
        ("name excluded", holds(name_parts)),
        ("vendor or cache folder", path.rlike(VENDOR)),
        ("no recorded checksum", F.col("sha").isNull()),
        ("type not admitted by the policy", ~admitted if policy else F.lit(False)),
        ("risk tier too high for the policy", ~risk_tier(category, F.col("size")).isin("LOW", "MEDIUM") if policy else F.lit(False)),
    ]


def size_class(suffix: Column, size: Column, large: int = 50 * MB, heavy: int = MB) -> Column:
    """Plain texts above ``heavy`` bytes give many chunks; anything above ``large`` is a class of its own."""
    return F.when(size > large, "large").when(suffix.isin(*HEAVY) & (size > heavy), "chunk_heavy").otherwise("normal")


def not_yet_materialised(candidates: DataFrame, instances: DataFrame, run: str) -> DataFrame:
    """Candidates (root, member) without an instance in ``run``, whichever of the three run columns names it; null members match."""
    here = instances.where((F.col("d0") == run) | (F.col("d1") == run) | (F.col("d2") == run)).select(F.col("root").alias("_root"), F.col("member").alias("_member"))
    return candidates.join(here, (F.col("root") == F.col("_root")) & F.col("member").eqNullSafe(F.col("_member")), "left_anti")


def fingerprint(selection: DataFrame, by: list[str], report: str, policy: str, ordering: str, envelope: dict[str, int | None]) -> DataFrame:
    """SHA-256 of what each batch selects (root, member) and under which report, policy, ordering and envelope.

    The canonical form is JSON with sorted keys, no blanks and ASCII only, paths sorted by root and
    member (null as empty). A batch's paths, which its envelope bounds, are gathered in one row.
    """
    names = ("max_embeddings", "max_extracted_bytes", "max_runtime_seconds", "max_source_bytes", "max_source_instances")
    text = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    head = f'{{"d0_report_sha256":{text(report)},"envelope":{text({k: envelope.get(k) for k in names})},"ordering_version":{text(ordering)},"selected_paths":['
    member = F.when(F.col("member").isNull(), "null").otherwise(json_string(F.col("member")))
    entry = F.concat(F.lit('{"member_path":'), member, F.lit(',"root_t7_path":'), json_string(F.col("root")), F.lit("}"))
    g = selection.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("root", F.coalesce("member", F.lit("")).alias("m"), entry.alias("e")))).alias("_p"))
    whole = F.concat(F.lit(head), F.array_join(F.transform("_p", lambda x: x["e"]), ","), F.lit(f'],"selection_policy_version":{text(policy)}}}'))
    return g.select(*by, F.size("_p").cast("long").alias("n"), F.sha2(whole, 256).alias("fingerprint"))
