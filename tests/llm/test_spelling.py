"""Spelling variants against plain Python: all pairs by edit distance, with groups so small that the trie goes down level by level."""

import random
import re
import zlib
from collections import Counter

import pytest

from lodestack.llm import spelling
from tests.llm.test_ops import ODD, table


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plainly(rows, min_chars=5, min_count=3):
    n = Counter()
    for d, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}
    out = {}
    for w in n:
        close = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        form = close[0] if close and n[close[0]] >= 2 * n[w] else None
        out[w] = (n[w], len(close), form, form and n[form])
    rows = []
    for w, (c, k, form, m) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.append((w, c, k, form, m, root))
    return sorted(rows)


def mixed(seed=2):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abéÿ") for _ in range(rng.randrange(5, 8))) for _ in range(60)] + ["aaaaaa", "aaaaa", "aaaaaaa", "Straße", "ÀÉÏõ×÷", "naïve", "naïves"]
    texts = [" ".join(rng.choice(base) for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    return ODD + list(enumerate(texts, 100)) + [(None, texts[0]), (7, texts[1].upper()), (7, texts[1].upper()), (900, ("q" * 3000 + " ") * 4 + ("q" * 2999 + " ") * 3)]


@pytest.mark.parametrize("group", [1, 3, 40, spelling.GROUP_WORDS])
def test_equals_all_pairs(spark, group):
    rows = [r for r in mixed() if group > 3 or r[0] != 900]
    got = spelling.spelling_variants(table(spark, rows), group_words=group)
    assert sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()) == plainly(rows)


def test_every_slip_is_planted(spark):
    """Some of the runs have h divisible by 97, so the slip is met."""
    rows = [(i, "wording") for i in range(2000)]
    got = {r.word: r for r in spelling.spelling_variants(table(spark, rows)).collect()}
    assert sum(r.n for r in got.values()) <= 2000 and len(got) > 3 and all(r.root == "wording" for r in got.values())
    assert sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.values()) == plainly(rows)


def test_branch_pairs_are_met_once():
    rng = random.Random(4)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 60))})
        got = list(spelling.near_in_branch("", words, []))
        assert len(got) == len({frozenset(p) for p in got})
        assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_empty(spark):
    for rows in ([], [(1, None), (2, "")], [(1, "one two six")]):
        assert spelling.spelling_variants(table(spark, rows)).collect() == []


def test_words_travel_to_their_neighbours_only(spark):
    """Rows dealt to branches stay near the vocabulary's size: active pairs, not all pairs of prefixes."""
    rng = random.Random(9)
    words = {"".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(3000)}
    vocab = spelling.written(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), "vocabulary")
    seen = []
    keep = spelling._in_branches

    def noted(groups, *rest):
        seen.append(groups.count())
        return keep(groups, *rest)

    spelling._in_branches = noted
    try:
        spelling.near_words(vocab, 500).collect()
    finally:
        spelling._in_branches = keep
    assert sum(seen) < 2 * len(words)
