"""Fill-in-the-middle against a plain regex version, with chunks so small that every text is dealt out."""

import hashlib
import random
import re

import numpy as np
import pytest

from lodestack.llm import fim
from tests.llm.test_ops import ODD, table

NEW = ("n", "form", "prefix_chars", "middle_chars", "output")


def plainly(doc_id, text, seed="1"):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    p, q = sorted((a % (len(u) + 1), b % (len(u) + 1)))
    one, two, three = "".join(u[:p]), "".join(u[p:q]), "".join(u[q:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return len(u), "plain", None, None, text
    out = f"<S>{three}<P>{one}<M>{two}" if d % 100 < 20 else f"<P>{one}<S>{three}<M>{two}"
    return len(u), "spm" if d % 100 < 20 else "psm", len(one), len(two), out


def cases():
    rng = random.Random(3)
    made = ["".join(rng.choice(["a", "Zq", "é", "日", "🙂", " ", "\n", "<", "P", ">", "S", "M", "7", "\0", "word"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    tricky = ["<P", "a<", ">S<", "<<S", "x<P>y", "<M>", "ab", "日本", "abc" * 4000 + "é" + "-" * 4000, "no marks < S > but <S", "É" * 70000, "w" * 200000]
    return ODD + [(100 + i, t) for i, t in enumerate(made + tricky)] + [(-5, "minus one"), (None, None), (None, "no id"), (None, "w" * 100000), (None, "w" * 100000)]


@pytest.mark.parametrize("chunk", [1, 7, fim.CHUNK])
def test_equals_regex(spark, chunk):
    rows = [r for r in cases() if chunk > 1 or len(r[1] or "") < 500]
    got = fim.fill_in_middle(table(spark, rows).withColumnRenamed("key", "form").withColumnRenamed("w", "output"), chunk=chunk).withColumn("back", fim.restored())
    assert [c for c in got.columns if c in ("n_words", "form", "line", "output")] == ["n_words", "line", "form", "output"]
    out = sorted([(r.doc_id, r.text, *(r[c] for c in NEW), r.back) for r in got.collect()], key=repr)
    assert out == sorted([(d, t or "", *plainly(d, t), t or "") for d, t in rows], key=repr)


def test_empty_and_string_ids(spark):
    assert fim.fill_in_middle(table(spark, [])).count() == 0
    rows = [("a", "one two three"), (None, "x" * 50), ("b", "long " * 40)]
    got = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id string, text string"), chunk=16)
    assert sorted(((r.doc_id, *(r[c] for c in NEW)) for r in got.collect()), key=repr) == sorted(((d, *plainly(d, t)) for d, t in rows), key=repr)


def test_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "one two three", 7, "x", "y"), (2, "w" * 50, 8, "x", "y")], "doc_id long, text string, _n int, _th string, _id string")
    got = fim.fill_in_middle(d, chunk=16)
    assert got.columns == [*d.columns, *NEW] and sorted((r.doc_id, r._n, r._th, r.n) for r in got.collect()) == [(1, 7, "x", 5), (2, 8, "x", 1)]


def test_functions_compose(spark):
    """However a text is cut, composing the chunks' functions gives the units of the whole, and each chunk's entry state."""
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "é", " ", "日", "Q"]) for _ in range(40)).encode()
        cuts = [0, *sorted(i for i in rng.sample(range(1, len(text)), 9) if text[i] & 0xC0 != 0x80), len(text)]
        s = fim.Scan(np.frombuffer(text, "u1"), np.array(cuts))
        state = units = 0
        for i in range(len(cuts) - 1):
            assert state == (text[: cuts[i]][-1:].isalpha() and text[cuts[i] - 1] < 128)
            units += s.units[i] - (s.opens[i] and state)
            state = int(s.closes[i])
        assert units == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text.decode()))


def test_giant_document_is_many_tasks(spark):
    """Chunks of one text are dealt to several partitions."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "word, " * 100000)], "_id long, text string").withColumn("_th", F.xxhash64("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = fim.text_chunks(rows, 4096).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 4 and sum(r["count"] for r in got) == -(-600000 // 4096)
