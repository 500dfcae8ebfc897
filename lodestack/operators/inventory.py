"""Corpus inventory and duplicate discovery over file tables (D0, D1: A03 to A09, T-8, T-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import paths as P

# Archive suffixes that can be opened, and all others of the inventory.
KNOWN = (".zip", ".7z")
OTHER = (".rar", ".tar", ".gz", ".tgz", ".tar.gz", ".bz2", ".tbz2", ".tar.bz2", ".xz", ".txz", ".tar.xz", ".iso", ".cab", ".arj", ".lz", ".lzma", ".z", ".zst", ".tzst")
ARCHIVES = (*KNOWN, *OTHER)


def by_extension(files: DataFrame) -> DataFrame:
    """ext, files, bytes, is_archive, is_known (an archive that can be opened)"""
    e = files.withColumn("ext", P.extension(F.col("path")))
    g = e.groupBy("ext").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return g.withColumn("is_archive", F.col("ext").isin(*ARCHIVES)).withColumn("is_known", F.col("ext").isin(*KNOWN))


def subtree_sizes(files: DataFrame) -> DataFrame:
    """dir, dir_depth, files, bytes of everything below each directory: one aggregate over (file, ancestor) rows."""
    return P.with_ancestors(files.select("path", "size")).groupBy("dir", "dir_depth").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def largest(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy(F.desc("size"), "path").limit(max(0, n))


def size_candidates(files: DataFrame) -> DataFrame:
    """Files that share their size with another one: only these need their content read."""
    sizes = files.groupBy("size").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("size")
    return files.join(sizes, "size", "left_semi")


def exact_file_groups(files: DataFrame) -> DataFrame:
    """size, sha, n, first path, category, reclaimable bytes of non-empty files with equal size and hash."""
    g = files.where("size > 0 and sha is not null").groupBy("size", "sha").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), F.bool_and(F.endswith(F.lower("path"), F.lit(".c9r"))).alias("c9r"))
    return g.where("n > 1").select("size", "sha", "n", "first_path", F.when(F.col("c9r"), "cryptomator_chunk_duplicate").otherwise("exact_duplicate").alias("category"), (F.col("size") * (F.col("n") - 1)).alias("reclaimable"))


def counters(files: DataFrame) -> DataFrame:
    """One row: files, candidates (zero-byte files too), hashed, groups, reclaimable."""
    c = size_candidates(files).agg(F.count(F.lit(1)).alias("candidates"), F.coalesce(F.sum((F.col("size") > 0).cast("long")), F.lit(0)).alias("hashed"))
    g = exact_file_groups(files).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"))
    return files.agg(F.count(F.lit(1)).alias("files")).join(c, F.lit(True)).join(g, F.lit(True))  # three single rows


def merkle_signatures(files: DataFrame, checkpoint=lambda df: df) -> DataFrame:
    """dir, dir_depth, sig, files: SHA-256 over the sorted lines ``F:name:size`` then ``D:name:sig``, deepest directories first.

    Lines are sorted as they are, so ``a.b`` may come before ``a``: equal trees have equal signatures, which are not
    those of a sort by names alone. One aggregate for each level of depth (a directory's own entries are what it gathers). Pass a
    ``checkpoint`` that writes a DataFrame for deep trees.
    """
    own = files.select(P.parent(F.col("path")).alias("dir"), P.basename(F.col("path")).alias("name"), "size")
    own = own.select("dir", F.when(F.col("dir") == "", 0).otherwise(P.depth(F.col("dir"))).alias("d"), F.concat(F.lit("F:"), "name", F.lit(":"), F.col("size").cast("string"), F.lit("\n")).alias("line"), F.lit(1).alias("files"))
    own = checkpoint(own)
    deepest = own.agg(F.max("d")).first()[0]
    out, below = None, None
    for d in range(deepest or 0, 0, -1):
        rows = own.where(F.col("d") == d).select("dir", F.lit(0).alias("kind"), "line", "files")
        if below is not None:
            rows = rows.unionByName(below.select(P.parent(F.col("dir")).alias("dir"), F.lit(1).alias("kind"), F.concat(F.lit("D:"), P.basename(F.col("dir")), F.lit(":"), "sig", F.lit("\n")).alias("line"), "files"))
        g = rows.groupBy("dir").agg(F.sort_array(F.collect_list(F.struct("kind", "line"))).alias("l"), F.sum("files").alias("files"))
        below = checkpoint(g.select("dir", F.lit(d).alias("dir_depth"), F.sha2(F.array_join(F.transform("l", lambda x: x["line"]), ""), 256).alias("sig"), "files"))
        out = below if out is None else out.unionByName(below)
    return out


def duplicate_directories(sigs: DataFrame) -> DataFrame:
    """sig, n, first_dir of equal non-empty trees; a group goes whose members all lie in directories that repeat themselves (topmost only)."""
    g = sigs.where("files > 0").groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = sigs.join(g, "sig")
    repeated = member.select(F.col("dir").alias("up")).distinct()
    m = member.withColumn("up", P.parent(F.col("dir"))).join(repeated.withColumn("inner", F.lit(True)), "up", "left")
    return m.groupBy("sig", "n").agg(F.min("dir").alias("first_dir"), F.bool_and(F.coalesce("inner", F.lit(False))).alias("nested")).where("not nested").drop("nested")


def folder_groups(folders: DataFrame) -> DataFrame:
    """dir, sig -> sig, n, maximal: false where all members share one known parent fingerprint."""
    p = folders.select(F.col("dir").alias("up"), F.col("sig").alias("up_sig"))
    m = folders.withColumn("up", P.parent(F.col("dir"))).join(p, "up", "left")
    g = m.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("up_sig").alias("ups"), F.bool_or(F.col("up_sig").isNull()).alias("rootless"))
    return g.where("n > 1").select("sig", "n", ((F.col("ups") != 1) | F.col("rootless")).alias("maximal"))


def nearest_duplicate_ancestor(files: DataFrame, dup_dirs: DataFrame) -> DataFrame:
    """group_id, path x dup_dirs (dir, sig) -> group_id, sig: the deepest repeated directory above all paths of a group; null if a path has none or they differ."""
    a = P.with_ancestors(files.select("group_id", "path")).join(dup_dirs.select("dir", "sig"), "dir").groupBy("group_id", "path").agg(F.max_by("sig", "dir_depth").alias("sig"))
    j = files.select("group_id", "path").join(a, ["group_id", "path"], "left").groupBy("group_id").agg(F.count_distinct("sig").alias("sigs"), F.bool_or(F.col("sig").isNull()).alias("miss"), F.min("sig").alias("sig"))
    return j.select("group_id", F.when((F.col("sigs") == 1) & ~F.col("miss"), F.col("sig")).alias("sig"))


def report_sections(groups: DataFrame, directories: DataFrame, top: int) -> DataFrame:
    """Exact groups (category, reclaimable, n, first_path) and directory groups (sig, n, first_dir, bytes) -> section, rank, path, n, reclaimable.

    The ``top`` of each section by reclaimable bytes, most first: files of each category, and
    directories, where a group of n equal trees of ``bytes`` gives (n - 1) * bytes back.
    """
    f = groups.select(F.col("category").alias("section"), F.col("first_path").alias("path"), "n", "reclaimable")
    d = directories.select(F.lit("directory_duplicate").alias("section"), F.col("first_dir").alias("path"), "n", ((F.col("n") - 1) * F.col("bytes")).alias("reclaimable"))
    w = Window.partitionBy("section").orderBy(F.desc("reclaimable"), "path")
    return f.unionByName(d).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(0, top))
