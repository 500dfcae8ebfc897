"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the cluster.

    Only where it is unset and the master is one process (as in tests) a temporary folder is made and
    set; on a cluster, executors would each write to their own disk, so there it is refused.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir() if spark.sparkContext.getCheckpointDir() else None
    if not at:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodestack-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already written) with a broadcast hint if it has at most ``limit`` rows; else it is joined by shuffle."""
    return F.broadcast(df) if df.count() <= limit else by_shuffle(df)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` with a hint that its join runs by shuffle. Spark sizes a table by its files and the widths of its columns: rows that
    Python or an explode makes of it count once, an array as one element, repeats as they are compressed. It would broadcast such a table at any true size."""
    return df.hint("merge")


def slices(batches, rows: int = 500, most: int = 8 << 20):
    """Arrow batches in slices of a few rows and of about ``most`` bytes: texts and what is made of them are in Python's memory for one slice at a time."""
    for b in batches:
        step = max(1, min(rows, int(most * b.num_rows / max(1, b.nbytes))))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def apart(docs: DataFrame, make) -> DataFrame | None:
    """``make`` of ``docs`` with columns that begin with an underscore out of its way (operators use such names); None if there are none."""
    away = {c: f"own{i}{c}" for i, c in enumerate(docs.columns) if c.startswith("_")}
    return make(docs.withColumnsRenamed(away)).withColumnsRenamed({v: k for k, v in away.items()}) if away else None


def ascii_lower(col):
    """A-Z to a-z; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
