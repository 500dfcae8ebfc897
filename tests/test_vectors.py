"""Vectors: near pairs and nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.operators import retrieval, vectors


def frame(spark, x, first=0):
    return spark.createDataFrame([(i + first, r.tolist()) for i, r in enumerate(x)], "id long, e array<double>")


def brute(x, below):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    d = 1 - u @ u.T
    return {(i, j) for i, j in zip(*np.nonzero(d < below), strict=True) if i < j}


def planted(rng, n, size, off=0.25):
    x = rng.standard_normal((n, size)) / np.sqrt(size)
    return np.concatenate((x, x + rng.standard_normal((n, size)) * off * rng.random((n, 1)) / np.sqrt(size)))


@pytest.mark.parametrize("size", [8, 64, 384])
def test_bands_miss_nothing_and_meet_few(spark, size):
    """All near pairs at 0.05 are found (0.99 is asked for), and under a twentieth of all pairs meet at all."""
    x = planted(np.random.default_rng(size), 600, size)
    want = brute(x, 0.05)
    df = frame(spark, x)
    got = {(r.a, r.b) for r in vectors.near_pairs(df, "id", "e", 0.05).collect()}
    assert got == want and len(want) > 300
    bits, bands, _ = vectors.band_plan(0.05, len(x))
    reps = df.select("id", F.col("e").alias("u"))
    met = vectors.met_pairs(reps, size, 0.05, bits, bands).select("a", "b").distinct().count()
    # In few dimensions many pairs are truly close; of the others few meet.
    assert met < 0.05 * len(x) ** 2 / 2 + (0 if size > 8 else 12 * len(want) + 0.05 * len(x) ** 2)


@pytest.mark.parametrize("below", [1e-6, 0.05, 0.4, 1.0, 1.7])
def test_any_threshold(spark, monkeypatch, below):
    """Wide thresholds, and ``exact``, go by blocks."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 37)
    x = planted(np.random.default_rng(1), 90, 16)
    assert (vectors.band_plan(below, 180) is None) == (below >= 0.4)
    for exact in (False, True):
        got = [(r.a, r.b) for r in vectors.near_pairs(frame(spark, x), "id", "e", below, exact=exact).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(x, below)


def test_copies_meet_once(spark):
    """A third of all rows is one vector: it is one representative, and its pairs are written out after the join."""
    rng = np.random.default_rng(3)
    x = np.concatenate((np.tile(rng.standard_normal(24), (60, 1)), rng.standard_normal((120, 24))))
    df = frame(spark, x)
    classes = vectors.vector_classes(df, "id", "e")
    assert classes.where("id = rep").count() == 121
    got = vectors.near_pairs(df, "id", "e", 0.05).collect()
    assert {(r.a, r.b) for r in got} == {(i, j) for j in range(60) for i in range(j)} and all(abs(r.distance) < 1e-9 for r in got)


def test_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [2.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    assert {(r.a, r.b) for r in vectors.near_pairs(df, "id", "e", 0.05).collect()} == {(2, 4), (2, 5), (4, 5)}
    assert vectors.near_pairs(df.limit(0), "id", "e", 0.05).count() == 0
    with pytest.raises(ValueError):
        vectors.near_pairs(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, e array<double>"), "id", "e", 0.1)


def test_nearest_equals_brute(spark, monkeypatch):
    """Ties by id, several sizes, null and zero vectors, and queries in blocks."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 12)).astype("f4")
    x[50:90] = x[7]
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(900, [0.0] * 12), (901, None), (902, [1.0, 2.0]), (903, [2.0, 1.0])]
    c = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 7, 50)] + [(77, [1.0, 2.0]), (78, None)], "query_id long, q array<float>")
    want = {}
    for i in (0, 7, 50):
        u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1)[:, None]
        d = 1 - (u * u[i]).sum(axis=1)
        want[i] = [j for _, j in sorted((round(e, 9), j) for j, e in enumerate(d.tolist()))][:45]
    want[77] = [902, 903]
    for most in (vectors.QUERY_BYTES, 100):
        monkeypatch.setattr(vectors, "QUERY_BYTES", most)
        got = {}
        for r in retrieval.dense_topk(c, q, 45).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == want
    last = retrieval.dense_topk(c, q.where("query_id = 0"), 400).orderBy("rank").collect()
    assert len(last) == 301 and last[-1].chunk_id == 900 and last[-1].distance is None
    assert retrieval.dense_topk(c, q, 0).count() == 0 and retrieval.dense_topk(c.limit(0), q, 3).count() == 0


def test_a_task_gives_k_rows_a_query(spark):
    x = np.random.default_rng(6).standard_normal((2000, 8))
    c = frame(spark, x).withColumnsRenamed({"id": "chunk_id", "e": "embedding"}).repartition(4)
    q = c.where("chunk_id < 6").withColumnsRenamed({"chunk_id": "query_id", "embedding": "q"})
    hits = vectors.nearest(c, q, 10)
    assert hits.count() == 4 * 6 * 10
