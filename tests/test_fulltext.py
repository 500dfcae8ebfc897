"""Cover density against a plain version of the rank."""

import random
import re

import pytest

from lodestack.operators import fulltext


def plain_rank(text, query, need):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    terms = list(dict.fromkeys(re.findall("[a-z0-9]+", (query or "").lower())))
    seen, places = {}, []
    for i, x in enumerate(w):
        p = min(i + 1, fulltext.LAST_PLACE)
        if x in terms and len(seen.setdefault(x, [])) < fulltext.PLACES and p not in seen[x]:
            seen[x].append(p)
            places.append((p, x))
    places.sort()
    at = sorted({p for p, _ in places})
    if need == "any":
        return round(sum(0.1 for _ in at), 6) or None
    found, total = set(), 0.0
    for i, start in enumerate(at):
        for j in range(i, len(at)):
            inside = {x for p, x in places if start <= p <= at[j]}
            if inside == set(terms):
                shorter = i < j and ({x for p, x in places if at[i + 1] <= p <= at[j]} == set(terms))
                if not shorter:
                    found.add((start, at[j], j - i + 1))
                break
    for a, b, n in found:
        total += 0.1 / (1 + (b - a) - (n - 1))
    return round(total, 6) if found else None


@pytest.mark.parametrize("need", ["any", "all"])
def test_equals_plain(spark, need):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("ab cd ef gh x y z".split()) for _ in range(rng.randrange(40)))) for i in range(60)] + [(900, None), (901, ""), (902, "AB, cd; ef! ab")]
    queries = [(1, "ab"), (2, "ab cd"), (3, "ef ab gh ab"), (4, "nothing ab"), (5, ""), (6, None)]
    d = spark.createDataFrame(docs, "chunk_id long, content string")
    q = spark.createDataFrame(queries, "query_id long, query string")
    want = []
    for i, text in queries:
        s = sorted((-r, c) for c, t in docs if text and (r := plain_rank(t, text, need)))
        want += [(i, c, -r, n + 1) for n, (r, c) in enumerate(s[:7])]
    got = [(r.query_id, r.chunk_id, r.score, r["rank"]) for r in fulltext.fulltext_topk(d, q, 7, need=need).orderBy("query_id", "rank").collect()]
    assert got == want


def test_places_are_bounded(spark):
    d = spark.createDataFrame([(1, "x " * 400), (2, "y " * 20000 + "x")], "chunk_id long, content string")
    q = spark.createDataFrame([(1, "x")], "query_id long, query string")
    assert {r.chunk_id: r.score for r in fulltext.fulltext_topk(d, q, 9).collect()} == {1: 25.5, 2: 0.1}
    with pytest.raises(ValueError):
        fulltext.fulltext_topk(d, q, 9, need="some")


def test_only_asked_places_are_dealt_out(spark):
    """Places of all words were shuffled, and covers joined by the query alone, so that a query was one task."""
    d = spark.createDataFrame([(1, "ab cd xy ab"), (2, "xy xy")], "chunk_id long, content string")
    some = spark.createDataFrame([("ab",)], "term string")
    assert sorted(map(tuple, fulltext.positions(d, "chunk_id", "content", some).collect())) == [(1, "ab", 1), (1, "ab", 4)]
    hits = spark.createDataFrame([(1, 2, 1, "ab", 1), (1, 2, 1, "cd", 2), (1, 2, 2, "ab", 5)], "query_id long, m int, chunk_id long, term string, pos int")
    c = fulltext.covers(hits, "chunk_id", "all")
    assert "Join" not in c._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in c.collect()] == [(1, 1, 1, 2, 2)]
