"""Suffix arrays and the removal of repeated strings against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from lodestack.llm import suffix_array, suffix_dedup
from tests.llm.test_ops import ODD, table


def plain_order(t):
    def key(i):
        end = next(j for j in range(i, len(t)) if t[j] == 0)
        return [*((int(x), 0) for x in t[i:end]), (0, end)]

    return sorted(range(len(t)), key=key)


def test_suffix_array_and_prefixes():
    rng = random.Random(0)
    for n in range(1500):
        letters = rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        strings = [bytes(rng.choice(letters) for _ in range(rng.randrange(0 if n % 3 else 1, 16))) for _ in range(rng.randrange(1, 6))]
        t, starts = suffix_array.joined(strings)
        sa = suffix_array.suffix_array(t)
        assert sa.tolist() == plain_order(t)
        common = suffix_array.common_prefixes(t, sa)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
            k = 0
            while t[a + k] == t[b + k] != 0:
                k += 1
            assert common[b] == k
        length = rng.randrange(1, 5)
        where = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        got = suffix_array.repeated_starts(strings, length)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == [(j, i) for j, s in enumerate(strings) for i in range(len(s) - length + 1) if where[s[i : i + length]] > 1]


def test_long_runs_and_deep_names():
    strings = [b"x" * 5000, b"x" * 4999 + b"y", b"ab" * 3000, b"ba" * 3000]
    which, at = suffix_array.repeated_starts(strings, 200)
    assert Counter(which.tolist()) == {0: 4801, 1: 4800, 2: 5801, 3: 5801}


@pytest.mark.parametrize("size", [1, 2, 3, 5, 6, 7, 12, 64])
def test_run_hashes_follow_content(size):
    data = np.frombuffer(bytes(random.Random(size).choice(b"ab") for _ in range(400)), "u1")
    h = suffix_dedup.run_hashes(data, size)
    names = {}
    assert len(h) == 400 - size + 1
    for i, x in enumerate(h.tolist()):
        assert names.setdefault(data[i : i + size].tobytes(), x) == x
    assert len(set(names.values())) == len(names)


def test_pieces_share_no_window_and_miss_none():
    rng = random.Random(2)
    for _ in range(100):
        strings = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(40))) for _ in range(6)]
        starts = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        got = suffix_dedup.pieces_of(np.frombuffer(b"".join(strings), "u1"), starts, 8, 3)
        windows = [(w, i) for w, a, n, _ in zip(*(x.tolist() for x in got), strict=True) for i in range(a, a + n - 7)]
        assert windows == [(w, i) for w, s in enumerate(strings) for i in range(len(s) - 7)]


def plainly(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        edge = np.diff(gone.astype(int))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        out.append((d, len(t), int(gone.sum()), spans, bytes(x for x, g in zip(t, gone[1:-1], strict=True) if not g)))
    return sorted(out, key=repr)


def cases(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé日") for _ in range(rng.randrange(1, 5)))
    texts = ["".join(word() for _ in range(rng.randrange(30))) for _ in range(60)]
    shared = ["".join(word() for _ in range(12)) for _ in range(4)]
    texts += [texts[rng.randrange(60)][:20] + rng.choice(shared) + word() for _ in range(80)] + texts[:5]
    return ODD[:5] + list(enumerate(texts, 50)) + [(None, shared[0]), (None, shared[0]), (3, "ab" * 40), (3, "xyz"), (8, "q" * 70)]


@pytest.mark.parametrize(("length", "anchor", "hot", "part"), [(6, 2, 500, 1 << 20), (8, 8, 1, 64), (10, 4, 2, 100), (5, 1, 0, 1 << 20), (1, 1, 500, 50)])
def test_equals_plain(spark, monkeypatch, length, anchor, hot, part):
    """Also with anchors so hot that all are counted, with texts in parts and with shards of one anchor."""
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", part)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", part)
    rows = cases(length)
    got = suffix_dedup.drop_repeats(table(spark, rows).withColumnRenamed("key", "kept").withColumnRenamed("n", "spans"), length, anchor, hot)
    assert "fp" in got.columns and got.columns[-2:] == ["spans", "kept"]
    out = sorted([(r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got.collect()], key=repr)
    assert out == plainly(rows, length)


def test_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "abcabc", 7, "x"), (2, "abd", 8, "y")], "doc_id long, text string, _id int, _spans string")
    got = suffix_dedup.drop_repeats(d, 3, 2)
    assert got.columns == [*d.columns, "n_bytes", "n_removed", "spans", "kept"] and sorted((r.doc_id, r._id, r._spans, r.n_removed) for r in got.collect()) == [(1, 7, "x", 6), (2, 8, "y", 0)]


def test_long_texts_and_empty(spark):
    assert suffix_dedup.drop_repeats(table(spark, [])).count() == 0
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(60000)]
    rows = [*ODD, (70, " ".join(words)), (71, " ".join(words[40000:40100])), (72, "other " * 10 + " ".join(words[5:40])), (None, None)]
    got = suffix_dedup.drop_repeats(table(spark, rows))
    out = sorted([(r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got.collect()], key=repr)
    assert out == plainly(rows, 200)
    assert {r[0]: r[2] for r in out}[70] == len(" ".join(words[5:40])) + len(" ".join(words[40000:40100])) + 1
