"""Smaller joins, filters and reports (P14, P15, P17, P18, P23, P24, J09, J10, J14, J15, J21 to J24, J26, J28 to J30, A02, A14, A22, A34 to A36, T-13, F23, F24, F26, F28, K01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import paths as P


def without_names(groups: DataFrame, needles: list[str]) -> DataFrame:
    """Rows none of whose ``occurrences`` (array of paths) has a needle in its lower-cased base name."""
    names = F.transform("occurrences", lambda p: F.lower(P.basename(p)))
    hit = F.exists(names, lambda n: F.exists(F.array(*[F.lit(x) for x in needles]), lambda x: F.contains(n, x)))
    return groups.where(~hit)


def within(hits: DataFrame, limit: float | None) -> DataFrame:
    return hits if limit is None else hits.where(F.col("distance") <= limit)


def scored(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", 1 - F.col("distance"))


def citations(hits: DataFrame) -> DataFrame:
    """query_id, citations: hits in rank order as structs."""
    c = F.struct("rank", "chunk_id", "document_id", "score")
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_list(c)).alias("citations"))


def readable(paths: DataFrame, jobs: DataFrame) -> DataFrame:
    """Paths at or under the root of a completed file-system job, met on their ancestors."""
    roots = jobs.where("status = 'COMPLETED' and source_type = 'filesystem'").select(F.col("source_path").alias("dir")).distinct()
    up = paths.select("path", F.explode(F.concat(P.ancestors(F.col("path")), F.array("path"))).alias("dir"))
    return paths.join(up.join(roots, "dir", "left_semi").select("path").distinct(), "path", "left_semi")


def filtered(df: DataFrame, equal: dict[str, object], started_before=None) -> DataFrame:
    """Optional equality filters; ``started_before`` is strict."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df if started_before is None else df.where(F.col("started_at") < F.lit(started_before))


def enrich(hits: DataFrame, instances: DataFrame, links: DataFrame) -> DataFrame:
    """Adds occurrences: the instances of a hit's group, each with its chain of links where that has more than two; null without a group."""
    c = links.groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "path"))).alias("chain"))
    i = instances.join(c, "instance_id", "left").withColumn("ancestry", F.when(F.size("chain") > 2, F.col("chain")))
    o = i.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("instance_id", "root", "ancestry"))).alias("occurrences"))
    return hits.join(o, "group_id", "left").withColumn("occurrences", F.when(F.col("group_id").isNotNull(), F.coalesce("occurrences", F.array().cast(o.schema["occurrences"].dataType))))


def owning_batch(instances: DataFrame, batches: DataFrame) -> DataFrame:
    """group_id, batch_id: the least running batch that holds an instance of the group."""
    return instances.join(batches.where("status = 'RUNNING'"), "batch_id").groupBy("group_id").agg(F.min("batch_id").alias("batch_id"))


def hash_candidates(files: DataFrame, members: DataFrame, after: int) -> DataFrame:
    """Files whose size and name an archive member has, or changed after ``after``; of equal (size, name) the shortest path."""
    m = members.select(F.col("size").alias("_s"), F.lower(P.basename(F.col("name"))).alias("_n")).distinct().withColumn("_hit", F.lit(True))
    f = files.withColumn("name", F.lower(P.basename(F.col("path")))).join(m, (F.col("size") == F.col("_s")) & (F.col("name") == F.col("_n")), "left")
    f = f.where(F.coalesce("_hit", F.lit(False)) | (F.col("mtime") > after))
    return f.groupBy("size", "name").agg(F.min(F.struct(F.length("path").alias("n"), "path")).alias("r"), F.count(F.lit(1)).alias("n")).select("size", "name", F.col("r.path").alias("path"), "n")


def same_size(files: DataFrame, members: DataFrame) -> DataFrame:
    return files.join(members.select("size").distinct(), "size", "left_semi")


def listed_members(members: DataFrame, documents: DataFrame) -> DataFrame:
    """Members whose document is still there."""
    return members.join(documents, "document_id")


def retry_report(groups: DataFrame, instances: DataFrame, attempts: DataFrame) -> DataFrame:
    """group_id, path, attempts of groups with exactly one distinct path."""
    i = instances.groupBy("group_id").agg(F.count_distinct("path").alias("_n"), F.min("path").alias("path")).where("_n = 1").drop("_n")
    a = attempts.groupBy("group_id").agg(F.count(F.lit(1)).alias("attempts"))
    return groups.join(i, "group_id").join(a, "group_id", "left").select("group_id", "path", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def new_paths_envelope(candidates: DataFrame, instances: DataFrame) -> DataFrame:
    """One row for candidates whose path no run has observed: files, bytes, chunks."""
    c = candidates.join(instances.select("path").distinct(), "path", "left_anti")
    return c.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def first_verified(occurrences: DataFrame, fresh: DataFrame) -> DataFrame:
    """group_id, path of the first occurrence (by id) whose fresh hash is the group's; else the distinct reasons, sorted."""
    j = occurrences.join(fresh.select("path", F.col("sha").alias("_now")), "path", "left")
    ok = F.col("_now") == F.col("sha")
    why = F.when(F.col("_now").isNull(), "missing").when(~ok, "changed")
    g = j.groupBy("group_id").agg(F.min_by(F.when(ok, F.col("path")), F.when(ok, F.col("id"))).alias("path"), F.array_join(F.array_sort(F.collect_set(why)), "; ").alias("_why"))
    return g.select("group_id", "path", F.when(F.col("path").isNull(), F.col("_why")).alias("reasons"))


def attempts_of_run(instances: DataFrame, attempts: DataFrame, run: int) -> DataFrame:
    """Attempts of a run's instances and of their groups."""
    i = instances.where(F.col("run_id") == run)
    a = attempts.join(i.select("instance_id"), "instance_id", "left_semi").withColumn("level", F.lit("instance"))
    g = attempts.where("instance_id is null").join(i.select("group_id").where("group_id is not null").distinct(), "group_id", "left_semi").withColumn("level", F.lit("group"))
    return a.select("attempt_id", "level").unionByName(g.select("attempt_id", "level"))


def without_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    return documents.join(chunks.select("document_id").distinct(), "document_id", "left_anti")


def doubtful(unhashed: DataFrame, files: DataFrame, after: int) -> DataFrame:
    """Unhashed files that share their size with a file changed after ``after``."""
    return unhashed.join(files.where(F.col("mtime") > after).select("size").distinct(), "size", "left_semi")


def verified_archives(done: DataFrame, errors: DataFrame, locations: DataFrame) -> DataFrame:
    """Contents of archives that were opened without an error."""
    good = done.join(errors.select("archive").distinct(), "archive", "left_anti")
    return locations.join(good.select(F.col("archive").alias("path")), "path", "left_semi").select("sha").distinct()


def members_in_order(docs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, members: structs in order, of groups with more than one (a report: one row holds a group)."""
    g = docs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("members"))
    return g.where(F.size("members") > 1)


def index_signature(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.max("chunk_id").alias("last"))


def hit_flags(answers: DataFrame) -> DataFrame:
    """Adds path_hit and term_hit: an expected path or term is cited; null without an expectation."""
    cited = lambda want, have: F.when(F.size(want) > 0, F.exists(want, lambda w: F.exists(have, lambda h: F.contains(F.lower(h), F.lower(w)))))
    return answers.withColumn("path_hit", cited("want_paths", "paths")).withColumn("term_hit", cited("want_terms", "terms"))


def status_counters(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def smallest_group(groups: DataFrame, suffixes: list[str], cap: int) -> DataFrame:
    """suffix, path: the first path of the smallest group under ``cap`` bytes, for each suffix."""
    s = groups.withColumn("suffix", P.suffix(F.col("first_path"))).where(F.col("suffix").isin(*suffixes) & (F.col("size") < cap))
    return s.groupBy("suffix").agg(F.min(F.struct("size", "first_path")).alias("r")).select("suffix", F.col("r.first_path").alias("path"))


def reconciliation_problem(result: Column, outcome: Column, before: Column, exists: Column, unchanged: Column) -> Column:
    """Why an audit cannot be reconciled so; null if it can."""
    return (
        F.when(result != "UNKNOWN", "only unknown audits are reconciled")
        .when(before, "already reconciled")
        .when((outcome == "SUCCESS") & exists, "the source is still there")
        .when((outcome == "FAILED") & ~(exists & unchanged), "the source is gone or changed")
    )


def recovery_outcome(exists: Column, unchanged: Column) -> Column:
    """struct(result, message) of an action that was under way when its execution stopped."""
    result = F.when(exists & unchanged, "NOT_ATTEMPTED").otherwise("UNKNOWN")
    return F.struct(result.alias("result"), F.when(~exists, "source is missing").when(~unchanged, "source has changed").alias("message"))


def canonical_rules() -> dict[str, Column]:
    decided = F.col("canonical_status") != "UNRESOLVED"
    return {"decider": ~decided | F.col("decided_by").isNotNull(), "reason": ~decided | (F.length(F.trim("reason")) > 0)}


def drafting_sample(chunks: DataFrame, used: DataFrame, n: int, seed: int, least: int = 300) -> DataFrame:
    """n chunks of ``least`` characters or more that were not used yet, by a seeded hash (the feature is a sample)."""
    c = chunks.where(F.length("content") >= least).join(used.select("chunk_id"), "chunk_id", "left_anti")
    s = c.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("chunk_id").cast("string")), 256), "chunk_id").limit(n)
    return s.select("chunk_id", F.concat(F.lit("c"), F.col("chunk_id").cast("string"), F.lit("-lex")).alias("lexical_id"), F.concat(F.lit("c"), F.col("chunk_id").cast("string"), F.lit("-sem")).alias("semantic_id"))


def folder_fingerprints(files: DataFrame, checkpoint=lambda df: df) -> DataFrame:
    """files (path, sha, size) -> dir, fingerprint, files, bytes of everything below each folder, deepest folders first.

    SHA-1 over a folder's sorted entries, each ended by NUL: ``f`` NUL name NUL sha for its files and
    ``d`` NUL name NUL fingerprint for its folders. One aggregate for each level (a folder's own entries
    are what it gathers). Pass a ``checkpoint`` that writes a DataFrame for deep trees.
    """
    entry = lambda kind, name, value: F.concat(F.lit(f"{kind}\0"), name, F.lit("\0"), value)
    own = files.select(P.parent(F.col("path")).alias("dir"), entry("f", P.basename(F.col("path")), F.col("sha")).alias("e"), F.lit(1).alias("files"), F.col("size").alias("bytes"))
    own = checkpoint(own.withColumn("d", F.when(F.col("dir") == "", 0).otherwise(P.depth(F.col("dir")))))
    out, below = None, None
    for d in range(own.agg(F.max("d")).first()[0] or 0, 0, -1):
        rows = own.where(F.col("d") == d).select("dir", "e", "files", "bytes")
        if below is not None:
            rows = rows.unionByName(below.select(P.parent(F.col("dir")).alias("dir"), entry("d", P.basename(F.col("dir")), F.col("fingerprint")).alias("e"), "files", "bytes"))
        g = rows.groupBy("dir").agg(F.sort_array(F.collect_list("e")).alias("l"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
        below = checkpoint(g.select("dir", F.sha1(F.concat(F.array_join("l", "\0"), F.lit("\0"))).alias("fingerprint"), "files", "bytes"))
        out = below if out is None else out.unionByName(below)
    return out if out is not None else own.select("dir", F.lit("").alias("fingerprint"), "files", "bytes").limit(0)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
