import pytest

from lodestack.queries import ORACLE_SQL, QUERIES
from tests.compare import connect, same


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def test_bootstrap_decision(spark, sf_dir, duck):
    """The one query without SQL, against the random module over the differences that SQL gives."""
    import random

    assert set(QUERIES) - set(ORACLE_SQL) == {"bootstrap_decision", "new_screen_lines"}
    rows = duck.execute(f"SELECT type, difference FROM ({ORACLE_SQL['paired_difference']}) ORDER BY query_id").fetchall()
    bounds = {}
    for kind in ("lexical", "semantic"):
        values, rng = [x for t, x in rows if t == kind], random.Random(0)
        means = sorted(sum(rng.choices(values, k=len(values))) / len(values) for _ in range(2000))
        bounds[kind] = means[50], means[1949]
    gain, loss = bounds["lexical"][0] > 0.02, bounds["semantic"][1] >= 0
    r = QUERIES["bootstrap_decision"](spark, sf_dir).first()
    assert (r.lexical_gain, r.no_semantic_loss, r.adopt) == (gain, loss, gain and loss)


def test_new_screen_lines(spark, sf_dir):
    """The other one, against one pass over each document's lines."""
    import hashlib

    from tests.test_lines import one_pass

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "text").collect()
    want = []
    for r in docs:
        frames = [(r.doc_id, i // 3, i, x) for i, x in enumerate(r.text.split("\n"))]
        want += [(a, b, c, hashlib.sha256(x.encode()).hexdigest()) for a, b, c, x in one_pass(frames)]
    assert sorted(map(tuple, QUERIES["new_screen_lines"](spark, sf_dir).collect())) == sorted(want)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "keep_id" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
