"""Scans as tables, discovery reports in sections, and the hash of a report."""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources.files import PIECE, FileTree, check_output, open_file

RUN = "run string, root string, started timestamp, completed timestamp, files long, dirs long, symlinks long, errors long, bytes long"


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc)


def record_scan(spark: SparkSession, root: str, target: str) -> str:
    """Scan the tree at ``root`` into ``target``: rows of files, dirs, symlinks and errors by run and kind, then one row of the run. Its id.

    ``target`` may not lie in the tree. The run's row is written last: readers take runs that have one.
    """
    check_output(target.removeprefix("file://"), root)
    spark.dataSource.register(FileTree)
    run, started = uuid.uuid4().hex, _now()
    rows = spark.read.format("filetree").load(root).withColumn("run", F.lit(run))
    rows.write.partitionBy("run", "kind").mode("append").parquet(f"{target}/entries")
    got = spark.read.parquet(f"{target}/entries").where(F.col("run") == run).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()  # four kinds
    n, size = {r.kind: r.n for r in got}, sum(r.bytes or 0 for r in got if r.kind == "file")
    meta = [(run, root, started, _now(), n.get("file", 0), n.get("dir", 0), n.get("symlink", 0), n.get("error", 0), size)]
    spark.createDataFrame(meta, RUN).coalesce(1).write.mode("append").parquet(f"{target}/runs")
    return run


def scan_runs(spark: SparkSession, target: str) -> DataFrame:
    """The runs that ended, with their root, times and totals."""
    return spark.read.schema(RUN).parquet(f"{target}/runs")


def scan_entries(spark: SparkSession, target: str, run: str | None = None) -> DataFrame:
    """The rows of a run, or of the one that ended last."""
    if run is None:
        last = scan_runs(spark, target).orderBy(F.desc("completed"), "run").first()
        run = last.run if last else ""
    return spark.read.parquet(f"{target}/entries").where(F.col("run") == run)


def reclaimable_totals(groups: DataFrame, directories: DataFrame) -> DataFrame:
    """Exact groups (reclaimable) and directory groups (n, bytes) -> one row: exact_duplicate_reclaimable, directory_duplicate_reclaimable.

    They are two views of the same bytes, so they are never added.
    """
    one = groups.agg(F.coalesce(F.sum("reclaimable"), F.lit(0)).cast("long").alias("exact_duplicate_reclaimable"))
    two = directories.agg(F.coalesce(F.sum((F.col("n") - 1) * F.col("bytes")), F.lit(0)).cast("long").alias("directory_duplicate_reclaimable"))
    return one.join(F.broadcast(two), F.lit(True))  # a row each


def write_sections(sections: dict[str, DataFrame], path: str, root: str, kind: str) -> None:
    """A report (kind D0, D1 or D2) of ``root``: a JSON Lines folder for each section and ``report.json``, which names them with their rows and columns.

    Sections have any size: tasks write them. ``report.json`` is written last. What is there is never
    overwritten, and a report may not lie in the tree that it is about.
    """
    check_output(path.removeprefix("file://"), root)
    spark = next(iter(sections.values())).sparkSession
    said = {}
    for name, df in sections.items():
        df.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/{name}")
        said[name] = {"rows": spark.read.schema(df.schema).json(f"{path}/{name}").count(), "columns": df.columns}
    text = json.dumps({"kind": kind, "root": root, "sections": said}, indent=2)
    store, at = open_file(path)
    with store.open_output_stream(f"{at}/report.json") as f:
        f.write(text.encode())


def read_section(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/{name}")


def report_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a report: of a file's bytes, or for a folder of its files' names and hashes in order.

    Executors read the files in pieces. Only names and hashes come to the driver: a report's files are as many as its tasks.
    """

    def run(batches):
        for b in batches:
            out = []
            for p in b["path"].to_pylist():
                store, at = open_file(p)
                sha = hashlib.sha256()
                with store.open_input_stream(at, compression=None) as f:
                    while piece := f.read(PIECE):
                        sha.update(piece)
                out.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([b["path"], pa.array(out, pa.string())], names=["path", "sha"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    # Files that Spark writes beside a report's (of success, and checksums) are not part of it.
    files = files.where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[._]"))
    rows = sorted((r.path, r.sha) for r in files.mapInArrow(run, "path string, sha string").collect())
    if len(rows) == 1 and Path(rows[0][0]).name == Path(path).name:
        return rows[0][1]
    # Names of parts have the id of the job that wrote them; their order and contents count.
    base = len(path.removeprefix("file://").rstrip("/"))
    lines = [f"{p.split('://')[-1].removeprefix('file:')[base:].rsplit('/', 1)[0]}\0{sha}\n" for p, sha in rows]
    return hashlib.sha256("".join(lines).encode()).hexdigest()


DISCOVERY = "kind string, root string, report_sha256 string, started timestamp, completed timestamp"


def record_run(spark: SparkSession, target: str, kind: str, root: str, report: str, started: datetime.datetime, completed: datetime.datetime) -> str:
    """Append a discovery run with the hash of its report to the table at ``target``; the hash. The scanned tree is not touched."""
    if kind not in ("D0", "D1", "D2"):
        raise ValueError("kind is D0, D1 or D2")
    sha = report_hash(spark, report)
    spark.createDataFrame([(kind, root, sha, started, completed)], DISCOVERY).coalesce(1).write.mode("append").parquet(target)
    return sha
