"""Frames of recordings: any cut into ranges gives what one pass over a recording gives."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from lodestack.operators import lines


def one_pass(frames, window=4, ratio=0.8):
    near = lambda a, b: a in b or b in a or SequenceMatcher(None, a, b).ratio() >= ratio
    out = []
    for rec in sorted({f[0] for f in frames}):
        recent = []
        for n in sorted({f[1] for f in frames if f[0] == rec}):
            own = [(no, x, lines.normalise(x or "")) for r, k, no, x in sorted(frames, key=lambda f: f[2]) if (r, k) == (rec, n)]
            seen, fresh = set().union(*recent) if recent else set(), []
            for no, x, key in own:
                if key and not any(near(key, y) for y in seen) and not any(near(key, y) for y in fresh):
                    fresh.append(key)
                    out.append((rec, n, no, x))
            recent = [*recent, {k for _, _, k in own if k}][-window:]
    return sorted(out)


@pytest.mark.parametrize("step", [1, 3, 7.5, 1000])
def test_repeated_lines_for_any_cut(spark, step):
    rng = random.Random(3)
    pool = ["The first line", "the FIRST line!", "Something else", "something  else here", "x = 1", "x = 2", "", " -- ", None, "Slide 12", "Slide 13 of the talk"]
    frames = [(r, n, no, rng.choice(pool)) for r in "ab" for n in sorted(rng.sample(range(-10, 60), 30)) for no in range(rng.randrange(1, 4))]
    df = spark.createDataFrame(frames, "recording string, frame int, line_no int, line string")
    got = sorted(tuple(r) for r in lines.drop_repeated_lines(df, step=step).collect())
    assert got == one_pass(frames) and len(got) > 20


def test_rules_of_lines(spark):
    """A blank line drops nothing, letters and digits alone are compared, a line goes if its own frame has it, the fifth frame back is forgotten."""
    f = [("r", 0, 0, "Alpha beta"), ("r", 0, 1, ""), ("r", 1, 0, "gamma delta"), ("r", 1, 1, "GAMMA-delta"), ("r", 2, 0, "alpha, BETA."), ("r", 3, 0, "w"), ("r", 4, 0, "zzz"), ("r", 5, 0, "qqq"), ("r", 6, 0, "kkk"), ("r", 7, 0, "alpha beta"), ("s", 8, 0, "qqq")]
    df = spark.createDataFrame(f, "recording string, frame int, line_no int, line string")
    got = sorted((r.recording, r.frame, r.line_no) for r in lines.drop_repeated_lines(df).collect())
    assert got == [("r", 0, 0), ("r", 1, 0), ("r", 3, 0), ("r", 4, 0), ("r", 5, 0), ("r", 6, 0), ("r", 7, 0), ("s", 8, 0)]
    assert lines.drop_repeated_lines(df.limit(0)).count() == 0


def kept_in_one_pass(frames, least):
    out, last = [], {}
    for r, n, px in sorted(frames, key=lambda f: f[:2]):
        x = np.asarray(px, float)
        if r not in last or len(last[r]) != len(x) or np.abs(x - last[r]).mean() >= least:
            out.append((r, n))
            last[r] = x
    return out


@pytest.mark.parametrize("step", [4, 9, 1000])
def test_unchanged_frames_for_any_cut(spark, step):
    """Slow drifts, long still parts and jumps: what a range keeps depends on frames far before it."""
    rng = random.Random(step)
    frames = []
    for r in "abc":
        level = 0.0
        for n in range(60):
            level += {"a": 0.4, "b": 0.0, "c": rng.choice([0, 0, 0.7, 3])}[r]
            frames.append((r, n, [round(level), round(level + 0.5), 0]))
    df = spark.createDataFrame(frames, "recording string, frame int, pixels array<int>")
    got = sorted((r.recording, r.frame) for r in lines.skip_unchanged_frames(df, step=step).collect())
    assert got == kept_in_one_pass(frames, 1.5)
    assert lines.skip_unchanged_frames(df.limit(0)).count() == 0


def test_long_lines_are_told_apart_quickly():
    """Unlike lines of one length were left to difflib."""
    import time

    rng = random.Random(5)
    a, b = ("".join(rng.choice("abcdefghij") for _ in range(190)) for _ in range(2))
    for x, y in [(a, b), ("", a), (a, a), ("abcbdab", "bdcaba"), ("xay", "zaz")]:
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, c in enumerate(x):
            for j, d in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if c == d else max(table[i][j + 1], table[i + 1][j])
        assert lines.common_length(x, lines.letter_places(y), len(y)) == table[-1][-1]
        assert sum(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks()) <= table[-1][-1]
    at = time.process_time()
    for _ in range(20):
        lines.common_length(a, lines.letter_places(b), len(b))
    ours, at = time.process_time() - at, time.process_time()
    for _ in range(20):
        SequenceMatcher(None, a, b).ratio()
    assert ours < (time.process_time() - at) / 3


def test_similar_lines_of_any_length(spark):
    """Copies with a few changed letters, of lines below and above difflib's limit of 200: what one pass over all says."""
    rng = random.Random(6)
    pool = []
    for n in (5, 40, 180, 260, 900):
        x = [rng.choice("abcdefghijklmnop") for _ in range(n)]
        for part in (0, 0.05, 0.15, 0.25, 0.5):
            pool.append("".join(rng.choice("qrstuvw") if rng.random() < part else c for c in x))
    frames = [(r, n, no, rng.choice(pool)) for r in "ab" for n in range(25) for no in range(2)]
    df = spark.createDataFrame(frames, "recording string, frame int, line_no int, line string")
    assert sorted(tuple(r) for r in lines.drop_repeated_lines(df, step=7).collect()) == one_pass(frames)


@pytest.mark.parametrize("floor", [1, 2, 4])
def test_good_lines_equal_plain(spark, floor):
    """Every word was shuffled to its vocabulary entry, and whole lines to their shares."""
    import re
    from collections import Counter

    rng = random.Random(floor)
    pool = ["the", "The", "word", "alpha", "beta", "of", "x=1", "rare"] + [f"{a}{b}{c}" for a in "uvw" for b in "xyz" for c in "klm"]
    docs = [(i, "\n".join(" ".join(rng.choice(pool) for _ in range(rng.randrange(7))) for _ in range(rng.randrange(6)))) for i in range(25)] + [(90, None), (91, ""), (92, "only once1"), (93, "gone = (lost)")]
    words = lambda x: re.findall("[A-Za-z]{3,}", x)
    seen = Counter(w.lower() for _, t in docs for w in words(t or ""))
    want = []
    for i, t in docs:
        for p, x in enumerate((t or "").split("\n")):
            w = words(x)
            good = sum(seen[y.lower()] >= floor for y in w)
            if len(w) >= (1 if re.search(r"[0-9=()+\-/*<>^]", x) else 2) and good / len(w) >= 0.6:
                want.append((i, p, x, len(w), round(good / len(w), 6)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = lines.keep_good_lines(df, floor=floor)
    assert sorted((r.doc_id, r.line_no, r.line, r.n, round(r.share, 6)) for r in out.collect()) == sorted(want)
    if floor == 2:
        plan = out.select("doc_id", "line_no", "n", "share")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1
