"""The search index against the two-pass scan: same rows, fewer bytes, appends, staleness."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import retrieval, search_index
from tests.test_plans import plan


def rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 5)) for r in df.collect())


def corpus(spark, n=400, seed=1, first=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    text = lambda: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=rng.randrange(0, 60)))
    made = [(first + i, text()) for i in range(n)] + [(first + n, None), (first + n + 1, ""), (first + n + 2, "common é common_word w0")]
    return spark.createDataFrame(made, "chunk_id long, content string")


@pytest.fixture
def asked(spark):
    q = [(1, "w0 w0 w7"), (2, "w250 w3"), (3, "absent"), (4, ""), (5, "W1 w2, w2; common_word"), (6, None), (7, "w299")]
    return spark.createDataFrame(q, "query_id long, query string")


@pytest.mark.parametrize("segment", [7, 4096])
def test_equals_scan_also_after_appends(spark, tmp_path, monkeypatch, asked, segment):
    monkeypatch.setattr(search_index, "SEGMENT", segment)
    one, two = corpus(spark), corpus(spark, 90, 2, 5000)
    index = search_index.build_index(one, f"file://{tmp_path}/i", 8)
    for k in (1, 5, 1000):
        assert rows(search_index.search(index, asked, k)) == rows(retrieval.bm25_topk(one, asked, k))
    more = search_index.add_to_index(index, two)
    both = one.unionByName(two)
    assert more.signature == search_index.signature(both) and more.version == 2
    assert rows(search_index.search(more, asked, 5)) == rows(retrieval.bm25_topk(both, asked, 5))
    assert rows(search_index.search(more, asked, 5, positive=True)) == rows(retrieval.bm25_topk(both, asked, 5, positive=True))
    # An older version can still be read.
    old = search_index.open_index(spark, f"file://{tmp_path}/i", 1)
    assert rows(search_index.search(old, asked, 5)) == rows(retrieval.bm25_topk(one, asked, 5))


def test_staleness(spark, tmp_path, asked):
    at = f"file://{tmp_path}/i"
    one = corpus(spark, 50)
    assert search_index.open_index(spark, at) is None
    a = search_index.current_index(one, at)
    assert search_index.current_index(one, at).version == a.version == 1
    b = search_index.current_index(one.where("chunk_id < 40"), at)
    assert (b.version, b.n) == (2, 40) and search_index.open_index(spark, at) == b


def test_signature_from_lengths(spark, sf_dir):
    from lodestack.operators import ingest

    odd = [(i, " " * 3 + "x" * n + "\n") for i, n in enumerate((0, 1, 999, 1000, 1001, 1800, 1801, 5000))] + [(90, None), (91, " \u00a0\n")]
    made = spark.createDataFrame(odd, "document_id long, text string")
    for docs in (made, made.limit(0), spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", "document_id")):
        assert ingest.chunk_signature(docs) == search_index.signature(ingest.chunk_documents(docs))


def test_a_query_reads_its_buckets_and_prunes(spark, tmp_path, monkeypatch):
    """Only the terms' buckets are read, bounds read no postings, and segments without a chance are left out."""
    monkeypatch.setattr(search_index, "SEGMENT", 20)
    c = corpus(spark, 600, 3)
    c = c.unionByName(spark.createDataFrame([(9000 + i, "rare rare rare w1") for i in range(3)], "chunk_id long, content string"))
    index = search_index.build_index(c, f"file://{tmp_path}/i", 32)
    q = spark.createDataFrame([(1, "rare w0")], "query_id long, query string")
    asked, buckets = search_index._asked(index, q)
    assert 1 <= len(buckets) <= 2
    p = plan(search_index.search(index, q, 2))
    assert "PartitionFilters: [" in p and f"bucket#" in p and "IN (" in p.replace("isin", "IN")
    scan = plan(search_index.segment_bounds(index, index.postings(), asked))
    assert "ids:array" not in scan and "max_tf:bigint" in scan
    rows_ = index.postings().where(F.col("bucket").isin(*buckets))
    every = search_index.segment_bounds(index, rows_, asked).count()
    left = search_index.surviving_segments(index, rows_, asked, 2).count()
    assert every >= 25 and left <= 6
    assert rows(search_index.search(index, q, 2)) == rows(retrieval.bm25_topk(c, q, 2))


def test_empty(spark, tmp_path, asked):
    index = search_index.build_index(corpus(spark).limit(0), f"file://{tmp_path}/i")
    assert index.n == 0 and search_index.search(index, asked, 3).count() == 0
    assert search_index.search(search_index.build_index(corpus(spark, 5), f"file://{tmp_path}/j"), asked.limit(0), 3).count() == 0


def test_postings_are_dealt_by_groups_of_segments(spark, tmp_path, monkeypatch):
    """Tokens were shuffled twice, and the chunks counted although their number was known. A term's rows are dealt out by groups of segments."""
    monkeypatch.setattr(search_index, "SEGMENT", 8)
    monkeypatch.setattr(search_index, "FILE_SEGMENTS", 2)
    c = spark.range(90).select(F.col("id").alias("chunk_id"), F.concat(F.lit("common w"), (F.col("id") % 7).cast("string"), F.lit(" common x"), F.col("id").cast("string")).alias("content"))
    monkeypatch.setattr(type(c), "count", lambda _: 1 / 0)
    index = search_index.build_index(c, str(tmp_path / "i"), 4, 90)
    monkeypatch.undo()
    p = index.postings().withColumn("file", F.input_file_name())
    assert p.where("term = 'common'").select("file").distinct().count() > 1
    assert p.where("term <> ''").agg(F.sum("n")).first()[0] == 270 and index.n == 90
    asked = spark.createDataFrame([(1, "common w3 x10"), (2, "x5 x5 w6")], "query_id long, query string")
    assert sorted(map(tuple, search_index.search(index, asked, 6).collect())) == sorted(map(tuple, retrieval.bm25_topk(c, asked, 6).collect()))


def test_tokens_are_counted_within_their_segment(spark):
    """Postings were counted before a shuffle that they did not get smaller by: a task held all those of its texts."""
    c = spark.range(500).select(F.col("id").alias("chunk_id"), F.concat(F.lit("w x y "), F.col("id").cast("string")).alias("content"))
    r = search_index.segment_rows(c, 7)
    text = r._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and text.index("Exchange") > text.rindex("Aggregate")
    assert r.agg(F.sum("n"), F.countDistinct("seg")).first() == (2500, 7)
