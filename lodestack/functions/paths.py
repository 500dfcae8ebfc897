"""Path functions as column expressions, and the ancestor table of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Compound archive suffixes that count as one.
COMPOUND = (".tar.gz", ".tar.bz2", ".tar.xz", ".tar.zst")


def basename(c: Column) -> Column:
    return F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)


def suffix(c: Column) -> Column:
    """Lower-cased suffix of the last component, or '': dot files and names that end in a dot have none."""
    return F.lower(F.regexp_extract(basename(c), r"^.+(\.[^.]+)$", 1))


def extension(c: Column) -> Column:
    """Extension class: a compound suffix, else the suffix, else ``(no extension)``."""
    low, out = F.lower(c), F.when(suffix(c) == "", "(no extension)").otherwise(suffix(c))
    for x in COMPOUND:
        out = F.when(F.endswith(low, F.lit(x)), x).otherwise(out)
    return out


def source_suffix(c: Column) -> Column:
    """Suffix without a conflict number: ``.pdf_12`` counts as ``.pdf``."""
    return F.regexp_replace(suffix(c), r"^(\.[a-z0-9]+)_\d+$", "$1")


def parent(c: Column) -> Column:
    """Path of the directory, '' at the top."""
    return F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise("")


def depth(c: Column) -> Column:
    """Components of a relative path."""
    return F.size(F.split(c, "/"))


def ancestors(c: Column) -> Column:
    """All directories above a path, topmost first."""
    parts = F.split(c, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def with_ancestors(files: DataFrame, path: str = "path") -> DataFrame:
    """One row for each file and directory above it: adds dir and dir_depth."""
    return files.select("*", F.posexplode(ancestors(F.col(path))).alias("_d", "dir")).withColumn("dir_depth", F.col("_d") + 1).drop("_d")


def archive_levels(c: Column) -> Column:
    """``a.zip!b.7z!c`` -> its levels, cut after each archive's ``!``."""
    return F.split(c, r"(?i)(?<=\.zip!)|(?<=\.7z!)|(?<=\.rar!)")


def under(c: Column, root: Column) -> Column:
    """Equal to root or below it, at a path border."""
    return (c == root) | F.startswith(c, F.concat(root, F.lit("/")))
