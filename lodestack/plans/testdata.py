"""The test tables seen as the engine's entities, for Spark and (as common table expressions) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_EXT = [".txt", ".pdf", ".zip", ".tar.gz", ".md", ".docx", ".MP4", ".c9r", ".pdf_12", ""]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: path, size, sha, mtime; names carry eight digits that are sometimes a date."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in _EXT]), (i % 10 + 1).cast("int"))
    digits = F.concat(F.lpad((i % 35).cast("string"), 2, "0"), F.lpad((i % 14).cast("string"), 2, "0"), (1998 + i % 40).cast("string"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/d"), (i % 5).cast("string"), F.lit("/f"), i.cast("string"), F.lit("_"), digits, F.when(i % 17 == 0, " (2)").when(i % 19 == 0, " - Copy").otherwise(""), ext)
    return d.select("doc_id", path.alias("path"), F.col("n_chars").cast("long").alias("size"), F.sha2("text", 256).alias("sha"), (i * 60).alias("mtime"))


FILES_SQL = """files AS (
  SELECT doc_id, source || '/' || lang || '/d' || CAST(doc_id % 5 AS VARCHAR) || '/f' || CAST(doc_id AS VARCHAR) || '_'
    || lpad(CAST(doc_id % 35 AS VARCHAR), 2, '0') || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || CAST(1998 + doc_id % 40 AS VARCHAR)
    || CASE WHEN doc_id % 17 = 0 THEN ' (2)' WHEN doc_id % 19 = 0 THEN ' - Copy' ELSE '' END
    || (['.txt', '.pdf', '.zip', '.tar.gz', '.md', '.docx', '.MP4', '.c9r', '.pdf_12', ''])[CAST(doc_id % 10 AS INTEGER) + 1] AS path,
    CAST(n_chars AS BIGINT) AS size, sha256(text) AS sha, doc_id * 60 AS mtime
  FROM documents)"""


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as directory trees of which many are equal: path, size, sha."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    box, sub, n = i % 50, F.floor(i / 50) % 4, F.floor(i / 200)
    path = F.concat(F.lit("root/b"), box.cast("string"), F.lit("/c"), sub.cast("string"), F.lit("/f"), n.cast("string"))
    return d.select(path.alias("path"), (10 + box % 10 + sub + n).cast("long").alias("size"), F.sha2(F.concat((box % 10).cast("string"), F.lit("-"), sub.cast("string"), F.lit("-"), n.cast("string")), 256).alias("sha"))


TREES_SQL = """trees AS (
  SELECT 'root/b' || CAST(doc_id % 50 AS VARCHAR) || '/c' || CAST((doc_id // 50) % 4 AS VARCHAR) || '/f' || CAST(doc_id // 200 AS VARCHAR) AS path,
    CAST(10 + (doc_id % 50) % 10 + (doc_id // 50) % 4 + doc_id // 200 AS BIGINT) AS size,
    sha256(CAST((doc_id % 50) % 10 AS VARCHAR) || '-' || CAST((doc_id // 50) % 4 AS VARCHAR) || '-' || CAST(doc_id // 200 AS VARCHAR)) AS sha
  FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents cut into chunks: chunk_id, document_id, chunk_index, content."""
    from lodestack.operators.ingest import chunk_documents

    return chunk_documents(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"))


CHUNKS_SQL = """chunks AS (
  SELECT doc_id * 1000000 + i AS chunk_id, doc_id AS document_id, i AS chunk_index, substring(t, CAST(i * 800 + 1 AS INTEGER), 1000) AS content
  FROM (SELECT doc_id, t, unnest(range(0, 1 + CAST(greatest(ceil((length(t) - 1000) / 800.0), 0) AS BIGINT))) AS i
        FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents) WHERE length(t) > 0))"""
