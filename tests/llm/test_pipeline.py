"""The pipeline: each stage on planted cases and odd rows, and the whole run against its parts."""

import random

import corpus_pipeline as cp
from lodestack.llm import near_copies, quality
from tests.llm.test_ops import ODD, hits_brute, lines_brute


def docs(spark, rows):
    full = [(d, t, "en", f"src{i % 3}", len(t or "")) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_take_odd_rows(spark, sf_dir):
    for rows in (ODD, []):
        d = docs(spark, rows)
        for _, f in cp.STAGES[:-1]:
            out = f(spark, d, sf_dir)
            assert out.columns == d.columns and out.dtypes == d.dtypes
            out.count()
        assert cp.STAGES[-1][1](spark, d, sf_dir).count() == len(rows)


def test_near_dup_stage(spark, sf_dir):
    rng = random.Random(1)
    base = [" ".join(f"w{rng.randint(0, 4000)}" for _ in range(150)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(20):
        w = base[i].split()
        w[rng.randrange(150)] = "changed"
        rows.append((100 + i, " ".join(w)))  # 5 of 146 shingles: Jaccard 0.93
        half = base[i].split()[:75] + base[39 - i].split()[75:]
        rows.append((200 + i, " ".join(half)))  # a third
    rows += [(300, base[0]), (301, base[0].upper() + "  ")]
    kept = {r.doc_id for r in cp.near_dup_stage(spark, docs(spark, rows), sf_dir).collect()}
    assert kept == set(range(40)) | set(range(200, 220))


def shingles5(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    a, b = shingles5(a), shingles5(b)
    return len(a & b) / len(a | b)


def test_near_dup_stage_beyond_the_bit_bound(spark, sf_dir):
    """Appended passages and replaced blocks at Jaccard 0.8 to 0.85, of which most lie beyond 7 bits of word pairs."""
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randint(0, 4000)}" for _ in range(n)]
    rows = []
    for i in range(40):
        base = words(200)
        rows += [(i, " ".join(base)), (100 + i, " ".join(base + words(46))), (200 + i, " ".join(base[:80] + words(14) + base[94:]))]
        assert 0.8 <= jaccard(rows[-3][1], rows[-2][1]) <= 0.85 and 0.8 <= jaccard(rows[-3][1], rows[-1][1]) <= 0.85
    assert {r.doc_id for r in cp.near_dup_stage(spark, docs(spark, rows), sf_dir).collect()} == set(range(40))


def test_near_dup_stage_keeps_form_letters(spark, sf_dir):
    """Letters that differ in one word have a Jaccard index of 0.783, and many the same word-pair fingerprint."""
    rng = random.Random(3)
    form = [f"f{rng.randint(0, 4000)}" for _ in range(45)]
    rows = [(i, " ".join(form[:20] + [f"name{i}"] + form[21:])) for i in range(600)]
    assert jaccard(rows[0][1], rows[1][1]) < 0.8
    assert cp.near_dup_stage(spark, docs(spark, rows), sf_dir).count() == 600


def test_near_dup_stage_by_rows(spark, sf_dir):
    """Rows that repeat, rows without a doc_id, and two texts of one doc_id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, b), (None, a), (None, c), (None, c + " more"), (3, None), (4, ""), (None, " ")]
    kept = sorted(((r.doc_id, r.text) for r in cp.near_dup_stage(spark, docs(spark, rows), sf_dir).collect()), key=repr)
    assert kept[:-1] == [(1, a), (1, b), (3, None)] and kept[-1][0] is None and kept[-1][1] in (c, c + " more")
    # Of equal texts the least doc_id stays, and a text like them goes with them.
    rows = [(i, a) for i in range(300)] + [(1000 + i, a + f" tail {i}") for i in range(200)]
    assert [r.doc_id for r in cp.near_dup_stage(spark, docs(spark, rows).repartition(7), sf_dir).collect()] == [0]


def edited(rng, words, kind, share):
    n = len(words)
    new = [f"n{rng.randint(0, 9999)}" for _ in range(max(1, int(share * n)))]
    if kind == "appended":
        return words + new
    if kind == "block":
        at = rng.randrange(n - len(new))
        return words[:at] + new + words[at + len(new) :]
    out = list(words)
    for w in new[: max(1, len(new) // 5)]:
        out[rng.randrange(n)] = w
    return out


def test_near_dup_recall_by_band(spark, sf_dir, monkeypatch):
    """Every planted pair of Jaccard 0.8 or more is found, whatever the kind of edit, also where shared shingles meet by a shuffle; none below is."""
    rng = random.Random(11)
    rows, planted = [], {}
    for i in range(240):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([12, 40, 120, 400]))]
        copy = edited(rng, base, ("appended", "block", "scattered")[i % 3], rng.uniform(0.01, 0.3))
        rows += [(i, " ".join(base)), (1000 + i, " ".join(copy))]
        planted[i] = jaccard(rows[-2][1], rows[-1][1])
    bands = [sum(lo <= x < lo + 0.1 for x in planted.values()) for lo in (0.6, 0.7, 0.8, 0.9)]
    assert min(bands) >= 10
    want = set(range(240)) | {1000 + i for i, x in planted.items() if x < 0.8}
    for shared in (near_copies.SHARED, 0):
        monkeypatch.setattr(near_copies, "SHARED", shared)
        assert {r.doc_id for r in cp.near_dup_stage(spark, docs(spark, rows), sf_dir).collect()} == want


def test_decontaminate_stage_by_rows(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    rows = [(None, item), (None, "clean words"), (7, item), (7, "other clean words"), (8, None)]
    got = sorted(((r.doc_id, r.text) for r in cp.decontaminate_stage(spark, docs(spark, rows), sf_dir).collect()), key=repr)
    assert got == sorted([(None, "clean words"), (7, "other clean words"), (8, None)], key=repr)


def test_quality_stage(spark):
    """Toxic and poor documents go and good ones stay, as labelled in a table of some thousand labels."""
    d = "/root/testdata/sf0.1"
    every = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r.doc_id for r in cp.quality_stage(spark, every, d).select("doc_id").collect()}
    grades = {r.doc_id: r.g for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", quality.grade().alias("g")).collect()}
    share = [sum(i in kept for i, g in grades.items() if g == k) / max(1, sum(g == k for g in grades.values())) for k in range(3)]
    assert share[0] < 0.1 and share[1] < 0.2 and share[2] > 0.97


def test_line_stage(spark, sf_dir):
    rows = [(i, f"own {i}\nA passage that repeats\nend {i}") for i in range(12)]
    out = cp.line_stage(spark, docs(spark, rows), sf_dir).collect()
    assert all(r.text == f"own {r.doc_id}\nend {r.doc_id}" and r.n_chars == len(r.text) for r in out)


def test_decontaminate_stage(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(10**6, items[0][1]), (10**6 + 1, items[1][1] + " word" * 2000)]
    want = {d for d, n, hit, _ in hits_brute(rows, items) if not (hit and 20 * hit >= n)}
    assert {r.doc_id for r in cp.decontaminate_stage(spark, docs(spark, rows), sf_dir).collect()} == want and 10**6 + 1 in want


def pipeline_brute(spark, sf_dir):
    """The whole pipeline in plain Python: scores from features, lines by counts, all pairs for near copies, all windows, the tokenizers library."""
    import hashlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in table.collect()]
    score = lambda t: float(model.weights[quality.features(t)].astype("f8").sum())
    rows = [(d, t) for d, t in rows if model.tails(np.array([score(t)]))[0, -1] >= quality.KEEP]
    rows = [(d, t) for d, t, _, _ in lines_brute(rows, 10)]
    sets = {d: shingles_of(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if (not x and not y) or (x and y and len(x & y) >= 0.8 * len(x | y)):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    rows = [(d, t) for d, t in rows if find(d) == d]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {d for d, n, hit, _ in hits_brute(rows, items) if hit and 20 * hit >= n}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for d, t in rows:
        if d not in bad:
            x = lib.encode(t, add_special_tokens=False).ids
            out.append((d, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(x, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out)


def shingles_of(t):
    """Distinct runs of five words; all words where there are fewer."""
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_run(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in out.collect()) == pipeline_brute(spark, sf_dir)


def test_columns_of_any_name_go_through(spark, sf_dir):
    """Extra columns that are named like what operators add or join by keep their values."""
    names = ["n_lines", "n_dropped", "p_good", "p_not_toxic", "expected_grade", "_id0", "_th0", "_h", "th", "_id", "_th", "unit", "n", "prefix", "token", "spans"]
    menu = "\n".join(["Menu of all", "a line of our own {0} words and more words here"])
    rows = [(i, menu.format(i)) for i in range(12)] + [(50, "same text of ten words that is found twice here"), (51, "same text of ten words that is found twice here")]
    d = docs(spark, rows).selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    for _, f in cp.STAGES[:-1]:
        out = f(spark, d, sf_dir)
        assert out.columns == d.columns and out.dtypes == d.dtypes
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)
    assert {r.n_chars for r in cp.line_stage(spark, d, sf_dir).where("doc_id < 12").collect()} <= {len(menu.format(i)) - 12 for i in range(12)}


def test_letters_of_one_form_do_not_meet_in_pairs(spark, monkeypatch):
    """600 letters of 60 words with two of their own, no two of Jaccard 0.8: candidates are as many as the letters, not their pairs; and copies of such a size are one component."""
    rng = random.Random(7)
    form = [f"w{rng.randint(0, 4000)}" for _ in range(60)]
    letters = [(i, " ".join([*form[:15], f"name{i}", *form[16:40], f"sum{i}", *form[41:]])) for i in range(600)]
    assert jaccard(letters[0][1], letters[1][1]) < 0.8
    copies = [f"v{rng.randint(0, 4000)}" for _ in range(120)]
    near = [(1000 + i, " ".join([*copies[:60], f"name{i}", *copies[61:]])) for i in range(300)]
    assert jaccard(near[0][1], near[1][1]) >= 0.8
    sizes = {}
    keep = near_copies.written

    def noted(df, name):
        out = keep(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_copies, "written", noted)
    got = near_copies.near_copies(docs(spark, letters + near), cp.SHINGLE, cp.SIMILARITY, cp.PAIR_WORDS, cp.NEAR_BITS, cp.WIDE_BITS).collect()
    assert sum(r.first for r in got) == 601 and {r.component_id for r in got if r.doc_id >= 1000} == {1000}
    assert sizes["candidates"] < 40 * 900  # of 224,550 pairs of letters and of copies


def test_what_spark_sizes_too_low_is_joined_by_shuffle(spark):
    """Small files become many rows in Python, or hold arrays: such sides are not broadcast at any size of their files."""
    from pyspark.sql import functions as F

    from lodestack.llm.common import small, written
    from lodestack.llm.simhash import fingerprint_links

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    ids = spark.range(3000)
    fps = written(ids.select(F.xxhash64("id").alias("fp"), F.xxhash64("id", F.lit(1)).alias("s0"), F.xxhash64("id", F.lit(2)).alias("s1")), "fps")
    for links in (fingerprint_links(fps, 4), fingerprint_links(fps, 7, 32, 8)):
        assert plan(links).count("SortMergeJoin") == 1
    assert "Broadcast" not in plan(fingerprint_links(fps, 4))

    rows = docs(spark, [(i, f"one {i} two {i} three {i} four") for i in range(20)])
    units = written(near_copies.unit_rows(rows, 5, 2, 0.8, near_copies.common_shingles(rows, 5, 20)), "units")
    named = units.select("unit", F.struct("doc_id", "th").alias("rep"))
    pairs = written(units.select(F.col("unit").alias("a"), F.col("unit").alias("b")), "pairs")
    for got in (near_copies.likely(pairs, units, 0.8), near_copies.verified(pairs, rows, named, 5, 0.8, False)):
        assert "Broadcast" not in plan(got) and plan(got).count("SortMergeJoin") == 2
        assert got.count() == 20

    assert "Broadcast" in plan(ids.join(small(ids, 3000), "id"))
    assert "Broadcast" not in plan(ids.join(small(ids, 2999), "id"))
