from lodestack.streaming.ingest import ingest_available
from lodestack.streaming.windows import tumbling


def test_incremental_ingest(spark, tmp_path):
    src, ck = tmp_path / "src", str(tmp_path / "ck")
    spark.createDataFrame([(1, "one"), (2, "one"), (3, "two")], "doc_id long, text string").write.parquet(str(src / "a"))
    run = lambda: ingest_available(spark, str(src / "*"), "doc_id long, text string", "chunked", ck)
    spark.sql("DROP TABLE IF EXISTS chunked")
    run()
    assert spark.table("chunked").count() == 2
    spark.createDataFrame([(4, "two"), (5, "three")], "doc_id long, text string").write.parquet(str(src / "b"))
    run()
    run()
    assert sorted(r.document_id for r in spark.table("chunked").collect()) == [1, 3, 5]


def test_windows_over_a_stream(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.write.parquet(str(tmp_path / "e"))
    stream = tumbling(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "e")), "1 hour", "1 hour")
    q = stream.writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("wins").count() == tumbling(batch, "1 hour").count()
