"""Incremental ingest: a file stream in available-now runs; checkpoints take the place of claims and leases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.ingest import chunk_documents


def ingest_available(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Chunk all new Parquet files of documents (doc_id, text) under ``source`` into ``target``, each content once.

    Chunks of contents that ``target`` holds are left out, so a run that is repeated adds nothing;
    within a run the least doc_id of a content counts.
    """

    def add(batch: DataFrame, number: int) -> None:
        docs = batch.select(F.col("doc_id").alias("document_id"), "text", F.sha2("text", 256).alias("content"))
        first = docs.groupBy("content").agg(F.min("document_id").alias("document_id"))
        docs = docs.join(first, ["content", "document_id"], "left_semi").dropDuplicates(["content"])
        if spark.catalog.tableExists(target):
            spark.catalog.refreshTable(target)
            docs = docs.join(spark.table(target).select("content").distinct(), "content", "left_anti")
        out = chunk_documents(docs).join(docs.select("document_id", F.col("content").alias("c")), "document_id")
        out.select("chunk_id", "document_id", "chunk_index", F.col("content").alias("chunk"), F.col("c").alias("content")).write.mode("append").saveAsTable(target)

    q = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if spark.catalog.tableExists(target):
        spark.catalog.refreshTable(target)  # batches wrote from a session of their own
