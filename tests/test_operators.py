import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import conversations, dedup, evaluate, ingest, inventory, lines, manifest, retrieval


def test_near_pairs_brute(spark, sf_dir):
    import numpy as np

    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(200)
    v = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    unit = {k: x / np.linalg.norm(x) for k, x in v.items()}
    for t in (0.3, 0.6, 0.9):
        want = {(a, b) for a in unit for b in unit if a < b and 1 - unit[a] @ unit[b] < t}
        assert {(r.a, r.b) for r in dedup.near_pairs(df, "vec_id", "embedding", t).collect()} == want


def test_zero_vector_and_nulls(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "id long, e array<double>")
    assert dedup.near_pairs(df, "id", "e", 0.5).count() == 0
    g = dedup.exact_groups(spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "id long, h string"), "h", ["id"])
    assert [(r.h, r.n) for r in g.collect()] == [("a", 2)]


def test_negative_idf_floor(spark):
    rows = [(i, "common " + ("rare" if i == 0 else "other" + str(i))) for i in range(6)]
    got = retrieval.bm25_topk(spark.createDataFrame(rows, "chunk_id long, content string"), spark.createDataFrame([(1, "common common rare")], "query_id long, query string"), 10).collect()
    assert len(got) == 6 and got[0].chunk_id == 0 and all(r.score != 0 for r in got)


def test_rrf_ties_by_string(spark):
    r = spark.createDataFrame([(1, 9, 1), (1, 10, 2)], "query_id long, chunk_id long, rank int")
    s = spark.createDataFrame([(1, 10, 1), (1, 9, 2)], "query_id long, chunk_id long, rank int")
    assert [x.chunk_id for x in retrieval.rrf([r, s], 5).orderBy("rank").collect()] == [10, 9]


def test_metrics_without_relevant(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    rel = spark.createDataFrame([(1, 5)], "query_id long, document_id long")
    ranked = spark.createDataFrame([(1, 4, 1), (1, 5, 2)], "query_id long, document_id long, rank int")
    m = {r.query_id: r for r in evaluate.ir_metrics(ranked, rel, q, 10).collect()}
    assert m[2].ndcg == 0 and m[1].recall == 1 and m[1].mrr == 0.5


def test_bootstrap_is_that_of_the_random_module(spark):
    values = [float(i * 7 % 5) for i in range(50)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(values)], "arm string, q long, x double").repartition(3)
    got = evaluate.bootstrap(df, ["arm"], "x", "q", 200).first()
    rng = random.Random(0)
    means = sorted(sum(rng.choices(values, k=50)) / 50 for _ in range(200))
    assert (got.mean, got.low, got.high) == (sum(values) / 50, means[5], means[194])


def test_cache_reaches_embed_once(spark):
    texts = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, text string")
    cache = spark.createDataFrame([("y", [1.0])], "t string, embedding array<double>").select(ingest.cache_key("m", F.col("t")).alias("key"), "embedding")
    got = {r.id: r.embedding for r in ingest.cached_embeddings(texts, cache, "m", 1, lambda d: d.select("key", F.array(F.lit(2.0)).alias("embedding"))).collect()}
    assert got == {1: [2.0], 2: [2.0], 3: [1.0]}


def test_write_once_and_replace(spark):
    rows = spark.createDataFrame([(1, None), (2, "a")], "k long, g string")
    got = {r.k: (r.g, r.conflict) for r in ingest.write_once(rows, "g", spark.createDataFrame([(1, "x"), (2, "b")], "k long, g string"), "k").collect()}
    assert got == {1: ("x", False), 2: ("a", True)}
    assert ingest.replace_groups(rows, spark.createDataFrame([(2, "z")], "k long, g string"), "k").count() == 2


def test_lines_and_frames(spark):
    df = spark.createDataFrame([("r", 1, 0, "hello world"), ("r", 2, 0, "hello worlds"), ("r", 3, 0, "other")], "recording string, frame int, line_no int, line string")
    assert {r.line for r in lines.drop_repeated_lines(df).collect()} == {"hello world", "other"}
    f = spark.createDataFrame([("r", 1, [0, 0]), ("r", 2, [1, 1]), ("r", 3, [5, 5])], "recording string, frame int, pixels array<int>")
    assert sorted(r.frame for r in lines.skip_unchanged_frames(f).collect()) == [1, 3]


def test_export_and_restore(spark, tmp_path):
    m = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    conversations.export_snapshot(m, str(tmp_path / "s"), spark.createDataFrame([(5, "likes tea")], "memory_id long, content string"))
    assert [tuple(r) for r in conversations.restore_memories(spark, str(tmp_path / "s")).collect()] == [(5, "likes tea")]
    assert conversations.restore_snapshot(spark, str(tmp_path / "s"), m.limit(0)).count() == 2
    with pytest.raises(ValueError):
        conversations.restore_snapshot(spark, str(tmp_path / "s"), m)
    manifest_file = next((tmp_path / "s/manifest").glob("part-*"))
    for bad in ('{"version":2,"conversations":1,"memories":1}', '{"version":1,"conversations":3,"memories":1}'):
        (tmp_path / "s/manifest" / f".{manifest_file.name}.crc").unlink(missing_ok=True)
        manifest_file.write_text(bad)
        with pytest.raises(ValueError):
            conversations.restore_snapshot(spark, str(tmp_path / "s"), m.limit(0))


def test_empty_files(spark):
    f = spark.createDataFrame([], "path string, size long, sha string, in_archive boolean, archive string")
    assert inventory.exact_file_groups(f).count() == 0 and manifest.contents(f, f).count() == 0 and inventory.largest(f, 0).count() == 0


def test_bm25_scan_counts_terms_once(spark):
    """Counts of terms were three parts of one plan, each with its own pass over the chunks."""
    c = spark.createDataFrame([(1, "common rare"), (2, "common")], "chunk_id long, content string")
    q = spark.createDataFrame([(1, "common rare")], "query_id long, query string")
    assert "coalesce(content" not in retrieval.bm25_scores(c, q)._jdf.queryExecution().analyzed().toString()
