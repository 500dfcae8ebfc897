"""File scans and readers."""

from __future__ import annotations

import hashlib
import os
import re
import stat
import zlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCAN = "path string, dir string, name string, ext string, size long, mtime double, nlink int, depth int, kind string, error string"


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, size of all files below ``root``, on any store Spark reads; contents are never read (the column is pruned)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    return df.select(F.element_at(F.split("path", F.lit(base), 2), -1).alias("relative_path"), F.col("length").alias("size"))


class FileTree(DataSource):
    """``spark.read.format("filetree").load(root)``: metadata of a mounted tree; a large folder is dealt out by its entries.

    Symbolic links are listed and not followed; what cannot be read is a row with an error, never a failure.
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCAN

    def reader(self, schema) -> DataSourceReader:
        return FileTreeReader(self.options["path"])


class FileTreeReader(DataSourceReader):
    #: The driver opens folders, level by level, until it has so many entries; these make at most PARTS partitions.
    ENTRIES, PARTS = 256, 1024

    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        """Lists of (entry, whether everything below it belongs to the partition)."""
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)
        found, level = [], sorted(os.listdir(self.root))
        while level and len(found) + len(level) < self.ENTRIES:
            below = []
            for rel in level:
                full = os.path.join(self.root, rel)
                names = self._names(full) if os.path.isdir(full) and not os.path.islink(full) else None
                found.append((rel, names is None))
                below += [f"{rel}/{n}" for n in names or ()]
            level = below
        found += [(rel, True) for rel in level]
        return [InputPartition(found[i :: self.PARTS]) for i in range(min(self.PARTS, len(found)))] or [InputPartition([])]

    @staticmethod
    def _names(full: str) -> list[str] | None:
        try:
            return sorted(os.listdir(full))
        except OSError:  # its partition will say so
            return None

    def read(self, partition):
        for entry, whole in partition.value:
            todo = [entry]
            while todo:
                rel = todo.pop()
                full = os.path.join(self.root, rel)
                base, depth = os.path.basename(rel), rel.count("/") + 1
                row = [rel, os.path.dirname(rel), base, os.path.splitext(base)[1].lower()]
                try:
                    s = os.lstat(full)
                    kind = "symlink" if stat.S_ISLNK(s.st_mode) else "dir" if stat.S_ISDIR(s.st_mode) else "file"
                    yield (*row, s.st_size, s.st_mtime, s.st_nlink, depth, kind, None)
                    if kind == "dir" and whole:
                        todo += [f"{rel}/{n}" for n in sorted(os.listdir(full), reverse=True)]
                except OSError as e:
                    yield (*row, None, None, None, depth, "error", type(e).__name__)


HASHES = "path string, size long, sha string, crc32 long, changed boolean, error string"
#: Bytes of a file in memory at once.
PIECE = 8 << 20


def open_file(path: str):
    """A file of any store that Arrow knows, to be read in pieces: (file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def content_hashes(spark: SparkSession, root: str, done: DataFrame | None = None) -> DataFrame:
    """path, size, sha, crc32, changed, error of every file that is not empty, without those in ``done`` (path).

    Spark lists the files; executors read each in pieces, so files may have any size. ``changed``
    marks files whose size or time differ before and after reading; a file that cannot be read has
    an error and no hash, and fails nothing; one that is gone before its turn gives no row.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root).where("length > 0").select("path", F.col("length").alias("size"))
    if done is not None:
        df = df.join(done.select("path"), "path", "left_anti")

    def run(batches):
        for b in batches:
            rows = []
            for path, size in zip(b["path"].to_pylist(), b["size"].to_pylist(), strict=True):
                sha, crc = hashlib.sha256(), 0
                try:
                    store, at = open_file(path)
                    before = store.get_file_info(at)
                    with store.open_input_stream(at, compression=None) as f:
                        while piece := f.read(PIECE):
                            sha.update(piece)
                            crc = zlib.crc32(piece, crc)
                    after = store.get_file_info(at)
                    rows.append((path, after.size, sha.hexdigest(), crc, (before.size, before.mtime_ns) != (after.size, after.mtime_ns) or after.size != size, None))
                except OSError as e:
                    rows.append((path, size, None, None, None, type(e).__name__))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()), strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string())], names=[c.split()[0] for c in HASHES.split(", ")])

    return df.mapInArrow(run, HASHES)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Approved queries of a JSON Lines set; a line without its fields, type or labels is an error."""
    df = spark.read.schema("query_id string, query string, type string, relevant array<string>, approved boolean").json(path)
    bad = F.col("query_id").isNull() | F.col("query").isNull() | ~F.coalesce(F.col("type").isin("lexical", "semantic"), F.lit(False)) | (F.coalesce(F.size("relevant"), F.lit(0)) < 1)
    checked = df.withColumn("query_id", F.when(bad, F.raise_error(F.lit("a query lacks its id, text, type or labels"))).otherwise(F.col("query_id")))
    return checked.where("approved")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON report; list fields that are missing are empty."""
    df = spark.read.schema(schema).option("multiLine", "true").json(path)
    return df.select(*[F.coalesce(c, F.array().cast(t)).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def check_output(output: str, root: str) -> None:
    """Refuse an output that is or lies in the scanned tree, links resolved."""
    o, r = Path(output).resolve(), Path(root).resolve()
    if o == r or r in o.parents:
        raise ValueError(f"{output} lies in the scanned tree")


def write_plan(df: DataFrame, path: str) -> None:
    """A CSV plan; what is there is never overwritten."""
    df.write.mode("errorifexists").csv(path, header=True)
