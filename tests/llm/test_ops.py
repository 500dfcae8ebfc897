"""Every operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import bpe, chat, decontaminate, html_extract, line_dedup, quality, simhash, syncmers, token_store, warc
from lodestack.llm.components import connected_components
from lodestack.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import connect, same

ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (5, "Ünï cödé 日本語 🙂 ÉÉ"), (6, "w " * 30000), (7, "a\nb\n\nA \nc\r"), (None, "no id"), (8, "the <|endoftext|> end"), (9, "x" * 5000)]


def table(spark, rows=None, extra=True):
    df = spark.createDataFrame(ODD if rows is None else rows, "doc_id long, text string")
    for c in ("n_words", "pos", "fp", "key", "h", "w", "n_lines", "line", "rid", "host", "n", "keep") if extra else ():
        df = df.selectExpr("*", f"'clash' AS {c}")
    return df


def words13(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name])


# ---------------------------------------------------------------- 1


def hits_brute(rows, items):
    out = []
    for d, t in rows:
        w, hit, found = words13(t), set(), set()
        for i, it in items:
            v = words13(it)
            n = min(13, len(v))
            wins = {tuple(v[s : s + n]) for s in range(max(1, len(v) - 12))} if v else set()
            for s in range(len(w) - n + 1):
                if v and tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found.add(str(i))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_decontamination_brute(spark, monkeypatch):
    rng = random.Random(5)
    vocab = "a b c d e f g É σς ΑΣ'Α ΟΣ.".split()
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, text(20)), (2, text(13)), (3, text(3)), (4, ""), (5, None), (6, text(14).upper()), (2, text(13)), (7, "one")]
    rows = ODD + [(100 + i, f"{text(40)} {rng.choice(items)[1] or ''}!" if i % 2 else text(60)) for i in range(30)]
    rows += [(200, items[0][1] + ", " + items[1][1]), (201, items[0][1].title()), (202, items[5][1].lower())]
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS wtext", "2 AS doc_id")
    for block in (decontaminate.BLOCK, 7):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_benchmark_hits(table(spark, rows), b).collect()), key=repr)
        assert got == hits_brute(rows, items)


def test_decontamination_prefix_thins_the_join(spark, monkeypatch):
    """A phrase that every document holds, in a window that also has a rare shingle, writes no row a document; the scan stays in generated code."""
    phrase = "the cat sat on the mat and looked"
    items = [(1, f"{phrase} rare1 rare2 rare3 rare4 rare5 rare6")]
    rows = [(i, f"{phrase} {i} and {phrase}") for i in range(200)] + [(500, items[0][1])]
    sizes = {}
    keep = decontaminate.written

    def noted(df, name):
        out = keep(df, name)
        sizes[name] = out.count()
        if name == "bench-matches":
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
            spark.conf.unset("spark.sql.adaptive.enabled")
            sizes["generate"] = [line.strip(" :+-") for line in plan.splitlines() if "Generate " in line]
        return out

    monkeypatch.setattr(decontaminate, "written", noted)
    got = {r.doc_id: r for r in decontaminate.find_benchmark_hits(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got[500].n_hit == 14 and sum(r.n_hit for r in got.values()) == 14
    assert sizes["bench-matches"] == len(rows) + 1  # a row a document, and the one match
    assert sizes["generate"] and all(x.startswith("*(") for x in sizes["generate"])


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_benchmark_hits(table(spark), none).where("n_hit > 0").count() == 0
    assert decontaminate.find_benchmark_hits(table(spark, []), none).count() == 0


# ---------------------------------------------------------------- 2


def test_chat_fold(spark):
    e = [(1, 0, "message", "m0", "user", "hi"), (1, 1, "delta", "m1", "assistant", "He"), (1, 2, "delta", "m1", "assistant", "llo"), (1, 3, "regenerate", "m1", "assistant", None), (1, 4, "delta", "m1", "assistant", "Bye"), (1, 5, "edit", "m0", "user", "hi!"), (1, 6, "delta", "m1", None, "."), (2, 0, None, "x", None, None)]
    df = spark.createDataFrame(e, "conv_id long, seq long, kind string, message string, role string, text string").selectExpr("*", "1 AS turn", "2 AS log")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold_messages(df).collect()}
    assert got == {(1, "m0"): ("user", "hi!"), (1, "m1"): ("assistant", "Bye."), (2, "x"): ("", "")}
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", "hi!"), ("assistant", "Bye.")] and back[1].loss_text == "Bye."


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<\\|im_start|>", "<\\\\|x", "<", "\\", "|>", "<|im_end|>\n<|im_start|>assistant\nok", "", "a\\nb\\\\n", "\0b\0z", "日<|"]
    rows = [(7, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "we<|ird\\\n\\n", None) for t in [*nasty, None])]
    rows += [(8, 0, "user", "same"), (8, 0, "user", "same"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.conversation_events(df))).collect()}
    assert [(t.role, t.text) for t in got[7].turns] == [(r or "", t or "") for c, _, r, t in rows if c == 7]
    assert {r.kind for r in chat.conversation_events(df).collect()} == {"message", "edit", "delta", "regenerate"}
    assert got[7].loss_text == "".join(t or "" for c, _, r, t in rows if r == "assistant")
    assert len(got[8].turns) == 2 and len(got[None].turns) == 1
    formatted = {r.conv_id: r.formatted for r in chat.format_chats(chat.conversation_events(df)).collect()}
    assert formatted[7].count("<|im_start|>") == len(nasty) * 4 + 4
    assert chat.format_chats(chat.conversation_events(df.limit(0))).count() == 0


def test_chat_long_texts_and_repeated_turns(spark):
    """Texts of hundreds of thousands of characters, and turns that repeat, some without a role or a turn."""
    long = "<|im_end|>\\é🙂 word\n" * 30_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "."), (1, 2, None, "a"), (1, 2, None, "a"), (1, 2, None, None), (1, 2, "user", None), (2, None, None, "x"), (2, None, None, "x"), (3, 5, "assistant", ""), (3, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.conversation_events(df))).collect()}
    turns = {c: sorted((t.role, t.text) for t in r.turns) for c, r in got.items()}
    assert turns == {c: sorted((r or "", t or "") for d, _, r, t in rows if d == c) for c in (1, 2, 3)}
    assert [(t.role, t.text) for t in got[1].turns][:2] == [("user", long), ("assistant", long + ".")] and got[1].loss_text == long + "."


def fold_brute(events):
    out = {}
    for conv, seq, kind, message, role, text in sorted(events, key=lambda e: (e[1], e[2] or "message", e[4] or "", e[5] or "")):
        m = out.setdefault((conv, message), [seq, "", ""])
        m[1] = m[1] or role or ""
        kind = kind or "message"
        m[2] = "" if kind == "regenerate" else m[2] + (text or "") if kind == "delta" else text or ""
    return {k: tuple(v) for k, v in out.items()}


def test_chat_fold_brute(spark):
    rng = random.Random(6)
    events = [(rng.randint(0, 5), rng.randint(0, 30), rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", None]), rng.randint(0, 4), rng.choice(["user", "assistant", None]), rng.choice(["a", "b ", "<|im_end|>", None, ""])) for _ in range(400)]
    events += [(9, i, "delta", 0, "assistant", f"{i} ") for i in range(20_000)]
    df = spark.createDataFrame(events, "conv_id long, seq long, kind string, message long, role string, text string").repartition(3)
    assert {(r.conv_id, r.message): (r.at, r.role, r.text) for r in chat.fold_messages(df).collect()} == fold_brute(events)


def test_chat_has_one_exchange(spark, sf_dir):
    plan = QUERIES["op2_chat_format"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


# ---------------------------------------------------------------- 3


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, fit_docs=2500, skip_share=0.3)
    assert np.all(np.diff(model.thresholds) > 0)
    from pyspark.sql import functions as F

    out = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1000)) < 300).withColumn("grade", quality.grade())
    rows = quality.score_quality(docs.join(out, "doc_id"), model).select("grade", "p_good", "expected_grade").collect()
    kept = [sum(r.p_good >= quality.KEEP for r in rows if r.grade == g) / sum(r.grade == g for r in rows) for g in range(3)]
    assert kept[0] < 0.05 and kept[1] < 0.12 and kept[2] > 0.98


def test_quality_edges(spark):
    m = quality.fit([], np.array([]))
    assert quality.score_quality(table(spark), m).count() == len(ODD)
    assert quality.score_quality(table(spark, []), m).count() == 0
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, None, None), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(quality.train(table(spark), labels).weights) == quality.DIM
    one = quality.score_quality(table(spark), m).first()
    assert one.keep == "clash" and 0 <= one.p_good <= 1


# ---------------------------------------------------------------- 4


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path(name), Tokenizer.from_file(public_tokenizers.path(name))


def test_token_store(spark, docs, tmp_path, monkeypatch):
    path, lib = tokenizer("byte_bpe_50k.json")
    monkeypatch.setattr(token_store, "BLOCK_BYTES", 3000)
    rows = [(d, t) for d, t in ODD if d is not None] + [(1000 + d, t) for d, t in docs]
    at = f"file://{tmp_path}/s"
    token_store.write_store(table(spark, rows), at, path)
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in token_store.read_store(spark, at).collect())
    ids = sorted((d, lib.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows)
    start, want = 0, []
    for d, x in ids:
        want.append((d, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert got == want
    assert token_store.fetch(spark, at, 1005) == dict(ids)[1005] and token_store.fetch(spark, at, 10**9) is None
    with pytest.raises(Exception, match="null"):
        token_store.write_store(table(spark), f"file://{tmp_path}/n", path)
    token_store.write_store(table(spark, []), f"file://{tmp_path}/e", path)
    assert token_store.read_store(spark, f"file://{tmp_path}/e").count() == 0


def test_block_refuses_another_dictionary():
    data = token_store.write_block([], hashlib.sha256(b"a").digest(), 2)
    with pytest.raises(ValueError):
        token_store.Block(data, b"b")


ODD_TEXTS = ["it's we'll", "a\x1cb \x1d c\x85d ​ e", " lead", "tail ", "a \nb", "x\n\n\ny z\n", "\n\n a", "  double  blank ", "é ﬁ ẛ̣ K Å", "ΑΣ ΣΑΣ İ ǅ ß ẞ", "ⅷ ½ ²३", "<|startoftext|><|endoftext|>  x<|endoftext|>", "", "\t", "日本 🙂🙂"]


def test_piece_encoder_equals_library(docs):
    path, lib = tokenizer("byte_bpe_50k.json")
    import pyarrow as pa

    e = token_store.PieceEncoder(path, 4)
    texts = ODD_TEXTS + [t for _, t in docs] + ODD_TEXTS + [f"a{chr(c)}b {chr(c)}1 {chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    want = [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [e.encode(t) for t in texts] == want
    for n in (1, 7, len(texts)):
        got = [x for at in range(0, len(texts), n) for x in e.encode_all(pa.array(texts).slice(at, n))]
        assert got == want


# ---------------------------------------------------------------- 5


@pytest.mark.parametrize("top", [4096, 2])
def test_next_document(spark, docs, monkeypatch, top):
    monkeypatch.setattr(syncmers, "TOP", top)
    rows = ODD + [(1000 + 700 * d, t) for d, t in docs[:120]] + [(10**15, "far away id"), (-5, "negative")]
    df = syncmers.with_next(table(spark, rows), ["text"])
    order = sorted(((-(1 << 63) if d is None else d, t) for d, t in rows), key=lambda x: (-x[0], (x[1] is not None, (x[1] or "").encode())))
    want = sorted(((a, order[(i + 1) % len(order)][1]) for i, a in enumerate(order)), key=repr)
    got = sorted((((-(1 << 63) if r.doc_id is None else r.doc_id, r.text), r.next_text) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("bits", [1, 9])
def test_next_of_crowded_ids(spark, monkeypatch, bits):
    """Thousands of rows without a doc_id, or of one doc_id, many of them equal: next rows are one round over all rows, ids in order, and no task has them all."""
    from collections import Counter

    monkeypatch.setattr(syncmers, "BITS", bits)
    rng = random.Random(bits)
    rows = [(None, f"none {i}") for i in range(5000)] + [(None, None)] * 400 + [(None, "none same")] * 600 + [(77, "77 all the same")] * 900
    rows += [(78, f"78 {rng.randrange(500)}") for _ in range(1200)] + [(d, f"{d} x") for d in range(70, 90) if d not in (77, 78)] + [(10**14, "100000000000000 far")] * 2 + [(-3, "-3 a"), (-3, "-3 b")]
    df = table(spark, rows).withColumn("seen", F.lit(1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = syncmers.with_next(df, ["text"]).withColumn("p", F.spark_partition_id()).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows) and Counter(r.next_text for r in got) == Counter(t for _, t in rows)
    name = lambda t: -(1 << 63) if t is None or t.startswith("none") else int(t.split()[0])
    leave = Counter((name(r.text), name(r.next_text)) for r in got if name(r.text) != name(r.next_text))
    ids = sorted({name(t) for _, t in rows}, reverse=True)
    assert leave == Counter(zip(ids, [*ids[1:], ids[0]], strict=True))
    # Copies have their like as next, but for one.
    assert sum(r.text != r.next_text for r in got if r.text == "none same") == sum(r.next_text is not None for r in got if r.text is None) == 1
    tasks = Counter(r.p for r in got if r.doc_id is None)
    assert len(tasks) >= 4 and max(tasks.values()) < 3500


def test_syncmer_anchors(spark, docs):
    df = spark.createDataFrame([(1, docs[0][1]), (2, docs[0][1]), (3, "pre fix words " + docs[0][1]), (4, "a b"), (5, None)], "doc_id long, text string")
    a = {r.doc_id: {(x.pos, x.hash) for x in r.a} for r in syncmers.with_anchors(df, "text", "a").collect()}
    assert a[1] == a[2] and len(a[4]) == 1 and a[5] == set()
    # Context-free: the same anchors three words on.
    assert {(p + 3, h) for p, h in a[1]} <= a[3] and len(a[3]) <= len(a[1]) + 3
    n = len(docs[0][1].split())
    assert 0.3 * n < len(a[1]) < 0.75 * n


def test_syncmers_of_short_and_unspaced_texts(spark):
    short = [(i, " ".join(f"s{i}x{j}" for j in range(5 + i % 2))) for i in range(60)]
    rng = random.Random(4)
    prose = "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(300))
    df = spark.createDataFrame([*short, (100, prose), (101, prose[:150] + "X" + prose[150:]), (102, " ")], "doc_id long, text string")
    df = syncmers.with_sketch(df, "text", "fp")
    fp = {r.doc_id: r.fp for r in df.collect()}
    assert all(fp[i] for i, _ in short) and len({tuple(fp[i]) for i, _ in short}) == 60 and fp[102] == []
    a, b = (df.where(f"doc_id = {i}").select(F.col("fp").alias(n)) for i, n in ((100, "a"), (101, "b")))
    assert 0.7 < syncmers.with_likeness(a.crossJoin(b), "a", "b", "x").first().x < 1
    # Sentences of Han characters between blanks: half of the text is kept, and so is about half of the likeness to itself.
    rows = [(1, " ".join(prose[i : i + 20] for i in range(0, 300, 20)), ""), (2, None, ""), (3, "w " * 50_000, "")]
    rows = [*rows, (4, " ".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(300)), "")]
    got = {r.doc_id: r for r in syncmers.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    assert 0.2 < got[1].near_edited < 0.6 and got[2].fp == [] and got[2].n == 0 and got[3].n == 100_000
    assert syncmers.fingerprint_documents(df.limit(0)).count() == 0
    assert syncmers.fingerprint_documents(table(spark)).count() == len(ODD)


def letters_brute(t):
    import regex

    scripts = "[" + "".join(rf"\p{{{x}}}" for x in "Han Hiragana Katakana Thai Lao Khmer Myanmar".split()) + "]"
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", regex.sub(f"({scripts})", r" \1 ", t)) if w]
    return [x for w in words for x in (w if len(w) > syncmers.LONG else [w])]


def sketch_brute(t):
    import struct

    import xxhash

    def h(*parts):
        x = 42
        for p in parts:
            x = xxhash.xxh64_intdigest(struct.pack("<Q", p) if isinstance(p, int) else p.encode(), x)
        return x

    k, s = syncmers.K, syncmers.S
    w = [h(x) for x in letters_brute(t)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    anchors = []
    for i in range(len(w) - k + 1):
        inner = [signed(h(*w[i + j : i + j + s])) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            anchors.append(h(*w[i : i + k]))
    if w and not anchors:
        anchors = [h(*w)]
    distinct = list(dict.fromkeys(a & 0xFFFFFFFF for a in anchors))
    least = set(sorted(distinct)[: syncmers.SKETCH])
    return [a for a in distinct if a in least]


def likeness_brute(a, b):
    u = sorted({*a, *b})[: syncmers.SKETCH]
    if not u:
        return 1.0
    x, y = [v for v in a if v in set(b) & set(u)], [v for v in b if v in set(a) & set(u)]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]  # longest common subsequence
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            best[i + 1][j + 1] = best[i][j] + 1 if p == q else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1] / len(u)


def test_fingerprints_brute(spark, docs):
    """Every column against the rule written out, also with passages in another order and scripts without blanks."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    moved = words[60:] + words[:60]
    mixed = [" ".join(x) for x in (words, moved, words[:40] + moved[20:], rng.sample(words, 120))]
    rows = [(i, t) for i, t in docs[:60]] + [(1000 + i, t) for i, t in enumerate([*mixed, "日本語の文章です。 これは test です", "x" * 200 + " y", "", "one two three four five six", "a b c d e"])]
    got = {r.doc_id: r for r in syncmers.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True)
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = sketch_brute(t), sketch_brute(nxt), sketch_brute(edited)
        r = got[d]
        assert (r.n, r.fp, r.efp, r.edited) == (len(t), a, c, edited), d
        assert abs(r.near_edited - likeness_brute(a, c)) < 1e-9 and abs(r.near_next - likeness_brute(a, b)) < 1e-9, d
    assert 0.3 < got[1001].near_next < 0.7  # two halves that changed places


def test_fingerprint_query(spark, sf_dir, docs):
    rows = {r.doc_id: r for r in QUERIES["op5_fingerprints"](spark, sf_dir).collect()}
    order = sorted(docs, reverse=True)
    by_text = {}
    for i, (d, t) in enumerate(order):
        n, nxt = len(t), order[(i + 1) % len(order)][1]
        edited = t[: n - n // 2] + nxt[: n // 2]
        assert rows[d].n_chars == n and rows[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text.setdefault(t, set()).add(rows[d].fingerprint)
        by_text.setdefault(edited, set()).add(rows[d].edited_fingerprint)
        assert 0 <= rows[d].near_edited <= 1 and 0 <= rows[d].near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    long = [rows[d] for d, t in docs if len(t) > 1500]
    assert np.mean([r.near_edited for r in long]) > 0.25 and np.median([r.near_next for r in long]) < 0.1


# ---------------------------------------------------------------- 6


def test_bpe_equals_library(spark, docs):
    path, lib = tokenizer("word_bpe_49k.json")
    rows = ODD + [(2000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(1000 + d, t) for d, t in docs]
    got = sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.encode_decode(table(spark, rows), path).collect()), key=repr)
    want = []
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    assert bpe.encode_decode(table(spark, []), path).count() == 0


def test_bpe_of_every_character():
    path, lib = tokenizer("word_bpe_49k.json")
    t = bpe.tokenizer(path)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for n in range(0, len(chars), 20_000):
        texts = [f"a{c}b x{c} {c}1" for c in chars[n : n + 20_000]]
        ids, decoded = t.encode_decode_all(texts)
        want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == want
        assert decoded[:50] == [lib.decode(x, skip_special_tokens=False) for x in want[:50]]


def test_bpe_of_mixed_texts():
    """Random mixtures of scripts, signs, white space, combining characters, added and unassigned ones, also in slices of one text."""
    path, lib = tokenizer("word_bpe_49k.json")
    rng, t = random.Random(8), bpe.tokenizer(path)
    pool = [*"abzE'.,!12 \n\t \x1c\x85\u3000éßΣσİǅ日本🙂\u0301\u0307\u1100\u1161\ua7dc\u0378\U000105d2", "<|endoftext|>", "  ", "'s", "the "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    want = [lib.encode(x, add_special_tokens=False).ids for x in texts]
    for got in (t.encode_decode_all(texts), tuple(zip(*(t.encode_decode(x) for x in texts), strict=True))):
        assert [np.frombuffer(x, "<u4").tolist() for x in got[0]] == want
        assert list(got[1]) == [lib.decode(x, skip_special_tokens=False) for x in want]
    assert t.encode_decode_all([]) == ([], [])


def test_bpe_random_words():
    path, lib = tokenizer("word_bpe_49k.json")
    t, rng = bpe.tokenizer(path), random.Random(3)
    for _ in range(3000):
        w = "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 25)))
        assert np.frombuffer(t.encode_decode(w)[0], "<u4").tolist() == lib.encode(w, add_special_tokens=False).ids


# ---------------------------------------------------------------- 7


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    same = "<p>" + "é" * 60
    rows = [(1, "http://a.b.org/x?q=1", same), (2, "http://a.b.org/y", same), (3, None, None), (4, "not a url [", "short"), (5, "http://c.org/\r\nX: y", "short"), (2, "http://a.b.org/y", same), (6, "http://a.b.org/x?q=1", "<p>" + "z" * 200 + "\r\n\r\n" * 5), (None, "http://n.org", same)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS offset").repartition(3)
    at = f"file://{tmp_path}/w"
    warc.write_archive(df, at)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_records(warc.index_entries(spark, at), at).collect()), key=repr)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        rev = h == same and p != 1
        want.append((p, "revisit" if rev else "response", 1 if rev else None, len(b), hashlib.sha256(b).hexdigest()))
    assert got == sorted(want, key=repr)
    assert sorted(r.page_id for r in warc.look_up(spark, at, ["http://A.B.org/x?q=1", "http://none.org/"]).collect()) == [1, 6]
    found = warc.find_captures(warc.url_keys(df), at)
    assert sorted(found.select("file", "offset", "length").collect()) == sorted(warc.index_entries(spark, at).select("file", "offset", "length").collect())
    heads = [r.record_id for r in warc.read_records(found, at, headers=True).collect()]
    assert len(set(heads)) == len(rows)
    assert warc.url_key("https://www.Example.com:8080/A?b") == "com,example,www:8080)/a?b"
    warc.write_archive(df.limit(0), f"file://{tmp_path}/e")
    assert warc.index_entries(spark, f"file://{tmp_path}/e").count() == 0
    assert warc.look_up(spark, f"file://{tmp_path}/e", ["http://c.org/"]).count() == 0
    big = spark.createDataFrame([(1, "http://big.org/", "é" * 3_000_000), (2, "http://big.org/", "é" * 3_000_000)], "page_id long, url string, html string")
    warc.write_archive(big, f"file://{tmp_path}/b")
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc.look_up(spark, f"file://{tmp_path}/b", ["http://big.org/"]).collect()) == [(1, 6_000_000, "response"), (2, 6_000_000, "revisit")]


def test_warc_hot_url_is_spread(spark, tmp_path, monkeypatch):
    """A URL captured many times fills many blocks; each is searched on its own, and only blocks that hold a key are read."""
    monkeypatch.setattr(warc, "BLOCK", 10)
    rows = [(i, "http://hot.org/" if i % 3 else f"http://h{i}.org/", f"{i} " * 60) for i in range(600)]
    at = f"file://{tmp_path}/h"
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), at)
    got = warc.look_up(spark, at, ["http://hot.org/", "http://h3.org/", "http://h4.org/"])
    assert sorted(r.page_id for r in got.collect()) == sorted([i for i in range(600) if i % 3] + [3])
    keys = warc.url_keys(spark.createDataFrame([("http://h3.org/",)], "url string"))
    assert warc.blocks_of(keys, at).count() == 1 and warc.blocks_of(warc.url_keys(spark.createDataFrame([("http://hot.org/",)], "url string")), at).count() >= 40


# ---------------------------------------------------------------- 8


def simhash_brute(t, k):
    import xxhash

    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, tau):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= tau:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("tau,n", [(4, 300), (7, 250), (2, 40)])
def test_links_of_random_fingerprints(spark, tau, n):
    rng = random.Random(tau)
    centres = [rng.getrandbits(64) for _ in range(n // 10)]
    fps = {}
    for i in range(n):
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, tau + 2)):
            x ^= 1 << b
        fps[i] = x
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in fps.values()})
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {(r.a, r.b) for r in simhash.fingerprint_links(df, tau).collect()}
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= tau}
    assert got == want and len(want) > n / 4


def test_simhash_edges(spark, docs):
    rows = [r for r in ODD if r[0] is not None] + [(1000 + d, t) for d, t in docs]
    got = {}
    for r in simhash.near_duplicates(table(spark, rows)).collect():
        got[r.doc_id] = (r.fp & ((1 << 64) - 1), r.component_id)
    fps = {d: simhash_brute(t, 4) for d, t in rows}
    assert got == {d: (fps[d], c) for d, c in classes(fps, 4).items()}
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    assert simhash.near_duplicates(table(spark, [(None, "x"), (3, "x")])).where("component_id = 3").count() == 2


def test_allocation_covers():
    rng = np.random.default_rng(1)
    for tau, m, held in ((4, 3, 0), (7, 3, 1), (4, 2, 0), (10, 4, 1)):
        t = simhash.allocate(np.sort(rng.random((50, m, tau + 1)) * 1000, 2), [64 // m] * m, tau, held)
        assert (t.sum(1) == tau - m + 1).all() and t.min() >= -1


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(100):
        for a, b in edges:
            if a is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


# ---------------------------------------------------------------- 9


def lines_brute(rows, least, keep_first=False):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x).strip(" \t\n\x0b\x0c\r")
    seen, first = {}, {}
    for d, t in rows:
        at = {}
        for i, x in enumerate((t or "").split("\n")):
            at.setdefault(key(x), i)
        for k, i in at.items():
            seen[k] = seen.get(k, 0) + 1
            first[k] = min(first.get(k, (float("inf"), 0)), (d, i)) if d is not None else first.get(k, (float("inf"), 0))
    out = []
    for d, t in rows:
        raw = (t or "").split("\n")
        kept = [x for i, x in enumerate(raw) if not key(x) or seen[key(x)] < least or (keep_first and first[key(x)] == (d, i))]
        out.append((d, "\n".join(kept), len(raw), len(raw) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast,flush", [(10**6, 10**6), (0, 10**6), (10**6, 1), (0, 20)])
@pytest.mark.parametrize("first", [False, True])
def test_line_dedup_brute(spark, monkeypatch, broadcast, flush, first):
    monkeypatch.setattr(line_dedup, "FLUSH", flush)
    rng = random.Random(4)
    pool = ["Menu ", " menu", "É", "é", "x\t", "", "long " * 20]
    rows = ODD[:4] + ODD[5:8] + [(20 + i, "\n".join(rng.choice([*pool, f"own {i} {j}"]) for j in range(8))) for i in range(40)]
    got = line_dedup.dedup_lines(table(spark, rows), 5, first, broadcast).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=repr) == lines_brute(rows, 5, first)
    assert got[0].key == "clash"


def test_line_filters_grow_by_ranges():
    """The arrays of a range have the same size for any number of lines; their load, and so the share of false suspects, stays as it is."""
    a, b = line_dedup.Ranges(1 << 28), line_dedup.Ranges(1 << 40)
    assert a.log_bits == b.log_bits == 24 and b.n == a.n << 12
    r = line_dedup.Ranges(200_000)
    h = np.random.default_rng(1).integers(0, 1 << 64, 200_000, dtype="u8")
    h = h[r.of(h) == 3]
    array = np.zeros((1 << r.log_bits) // 8, "u1")
    r.add(array, h[::2])
    assert r.has(array, h[::2]).all() and r.has(array, h[1::2]).mean() < 0.03


def test_only_suspected_lines_go_on(spark, monkeypatch):
    """Of 64 ranges' lines, those that go on to be counted are the repeats and few others, each repeat of a task as one row; filters do not leave their tasks."""
    monkeypatch.setattr(line_dedup, "FLUSH", 1000)
    rows = [(i, "\n".join(["hot line", f"pair {i // 2}", *(f"own {i} {j}" for j in range(40))])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    ranges = line_dedup.Ranges(400 * 42)
    dealt = line_dedup.line_rows(docs, ranges).collect()
    assert len({r.range for r in dealt}) == ranges.n == 64
    assert sum(len(r.ids) for r in dealt if r.n == 0) < 400 * 41 and max(r.n for r in dealt) >= 20
    got = line_dedup.suspects(spark.createDataFrame(dealt, line_dedup._LINE_DDL), ranges).groupBy("h").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert {(r.n) for r in got if r.n > 2} == {400} and sum(r.n == 2 for r in got) == 200
    assert sum(r.rows for r in got) < 200 * 2 + 30 + 0.03 * 400 * 40


def test_line_dedup_edges(spark):
    odd = table(spark, [(i, f"same\nown {i}") for i in range(4)]).selectExpr("*", "doc_id AS _id", "text AS _drop")
    got = line_dedup.dedup_lines(odd, 2, False, 0)
    assert got.columns == [*(c for c in odd.columns if c != "n_lines"), "n_lines", "n_dropped"] and all(r._drop == f"same\n{r.text}" and r._id == r.doc_id for r in got.collect())
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0
    got = line_dedup.dedup_lines(table(spark, [(None, "same")] * 3 + [(1, None)]), 2, False, 0).collect()
    assert sorted((r.text, r.n_dropped) for r in got) == [("", 0), ("", 1), ("", 1), ("", 1)]


# ---------------------------------------------------------------- 10


def article_texts(rows):
    import html

    want = {}
    for r in rows:
        body = re.search("<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", body))
        want[r.page_id] = "\n".join(x for x in parts if x)
    return want


def test_main_text_of_the_table(spark, sf_dir):
    want = article_texts(spark.read.parquet(f"{sf_dir}/pages.parquet").collect())
    got = {r.page_id: r for r in QUERIES["op10_main_text"](spark, sf_dir).collect()}
    assert {k: v.text for k, v in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize("names", [True, False])
def test_main_text_by_the_template_alone(spark, monkeypatch, names):
    """No article or main elements, and classes and ids without meaning: the template gives the contract's text, and without it the adverts stay."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = pages.collect()
    want = article_texts(rows)
    if not names:
        monkeypatch.setattr(html_extract, "NOISE", frozenset())  # the template is deduced from tokens; words are not asked
    plain, host = {}, html_extract.host_of("url")
    hosts = {r.page_id: r.h for r in pages.select("page_id", host.alias("h")).collect()}
    for r in rows:
        mean = lambda m, h=hosts[r.page_id]: f'{m[1]}="k{zlib.crc32((h + m[2]).encode()) % 997}"'
        x = re.sub(r"(</?)(?:article|main)\b", r"\1div", r.html)
        # What was an article is a div of a class of its own, of no meaning either.
        plain[r.page_id] = re.sub(r'\b(class|id)="([^"]*)"', mean, x)
    df = spark.createDataFrame([(r.page_id, r.url, plain[r.page_id] if names else r.html) for r in rows], "page_id long, url string, html string").repartition(8)
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()} if names else None
    if names:
        assert got == want
        assert all(html_extract.extract(x, html_extract.Template(())) != want[i] for i, x in plain.items())
    else:
        found = html_extract.occurrence_classes(df).collect()
        held = {}
        for r in found:
            held.setdefault(r.host, []).append((r.token, r["class"], r.support, r.pages, r.place, r.chars))
        templates = {h: html_extract.Template(x) for h, x in held.items()}
        assert {r.page_id: html_extract.extract(r.html, templates[hosts[r.page_id]]) for r in rows} == want


def page(body):
    return f"<html><head><title>T</title></head><body>{body}</body></html>"


def test_template_without_article(spark, monkeypatch):
    chrome = '<div class="top"><a href="/">Home</a> <a href="/b">Blog</a></div>{}<div class="low">Follow us everywhere</div>'
    rows = [(i, f"http://h.org/{i}", page(chrome.format(f'<div class="c17"><h2>Story {i}</h2><p>Body &amp; soul of number {i}, {"more " * i}told<br>here.</p></div>'))) for i in range(12)]
    rows += [(50, "http://h.org/odd", "<p>bare"), (51, None, None), (None, "::", "<article>x<aside>no</aside><section id=comments>no</section> y</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS token", "3 AS t")
    want = {i: f"Story {i}\nBody & soul of number {i}, {'more ' * i}told here." for i in range(12)} | {50: "bare", 51: "", None: "x\ny"}
    for limit in (10**6, -1):
        monkeypatch.setattr(html_extract, "TEMPLATE_ROWS", limit)
        assert {r.page_id: r.text for r in html_extract.main_text(df).collect()} == want
    assert html_extract.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "body,want",
    [
        ("<article><header><h1>A</h1></header><p>b<form>f</form><p>c</article><footer>z</footer>", "A\nb\nc"),
        ('<main><div class="ad-box">buy</div><p>a<script>if (a<b) "</p>"</script>b</p></main>', "ab"),
        ("<article><p>one<!-- x <p> --> two</p><p hidden>h</p><ul><li>l1<li>l2</ul></article>", "one two\nl1\nl2"),
        ('<article>a &lt;b&gt; &copy; &#233;&nbsp;c<div class="comments"><p>me too</p></div></article><section class="comment-list">c</section>', "a <b> © é c"),
        ("<article><p>cut off<scr", "cut off"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
    ],
)
def test_extraction(body, want):
    assert html_extract.extract(page(body), html_extract.Template(())) == want


@pytest.mark.parametrize(
    "body,want",
    [
        ('<div><p>The story itself.</p></div><ol class="comments"><li><article>me too</article></ol>', "The story itself."),
        ("<div><p>A story that is a good deal longer than the teaser is.</p></div><div><article>Teaser</article></div>", "A story that is a good deal longer than the teaser is.\nTeaser"),
        ("<article hidden>old</article><div>a</div><div>b</div>", "a\nb"),
        ("<div>" + "long " * 50_000 + "</div>", ("long " * 50_000).strip()),
    ],
)
def test_articles_that_are_not_the_main_text(body, want):
    assert html_extract.extract(page(body), html_extract.Template(())) == want


def test_names_do_not_overrule_the_template(spark):
    """A host whose whole text lies in a 'widget' keeps it; reader comments longer than the story go by their name."""
    words = lambda k, i: " ".join(f"{k}{i}x{j}" for j in range(100 if k == "s" else 300))
    a = '<div class="widget-box"><div class="title"><h1>Title {0}</h1></div><div class="x1"><p>{1}</p></div></div><div class="x2">Buy {0} now</div>'
    b = '<div class="x1"><p>{1}</p></div><div class="comments"><p>{2}</p></div>'
    rows = [(100 * j + i, f"http://h{j}.org/{i}", page(x.format(i, words("s", i), words("c", i)))) for j, x in enumerate((a, b)) for i in range(12)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\n{words('s', i)}" for i in range(12)} | {100 + i: words("s", i) for i in range(12)}
    # A second large box beside an article is not part of it.
    c = '<article><div class="x1"><p>{1}</p></div><div class="x3"><p>By {0}</p></div></article><div class="x2"><p>{2}</p></div>'
    rows = [(i, f"http://h.org/{i}", page(c.format(i, words("c", i), words("s", i)))) for i in range(12)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{words('c', i)}\nBy {i}" for i in range(12)}


def test_boilerplate_inside_articles_and_split_bodies(spark):
    body = "<article><div class=c1><p>First {0} part {0}</p></div><div class=b><p>Read more of us</p><p>Rate this story</p></div><div class=c2><p>Second {0} of {0}</p></div></article>"
    split = '<div class="k1"><p>Start {0} with more {0} words</p></div><div class="k2"><p>End {0}</p></div><div class="k3">Follow us</div><div class="k4">All rights</div>'
    rows = [(100 * j + i, f"http://h{j}.org/{i}", page(b.format(i))) for j, b in enumerate((body, split)) for i in range(12)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"First {i} part {i}\nSecond {i} of {i}" for i in range(12)} | {100 + i: f"Start {i} with more {i} words\nEnd {i}" for i in range(12)}


def hosts(spark, *layouts, pages=12):
    """Main texts of hosts of so many pages each, by (host, page); a layout gives a page's body."""
    rows = [(1000 * j + i, f"http://h{j}.org/{i}", page(f(i))) for j, f in enumerate(layouts) for i in range(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {divmod(r.page_id, 1000): r.text for r in html_extract.main_text(df).collect()}


def many(k, i, n):
    return " ".join(f"{k}{i}w{j}" for j in range(n))


def test_slots_before_names(spark):
    """A story in a slot with a noise word stays, with its lead; the same words on hosts of fewer than five pages go by their names."""
    story = lambda i: f'<div class="lead"><p>{many("l", i, 20)}</p></div><div class="story share"><p>{many("s", i, 100)}</p></div><div class="x1">Follow {i} us</div>'
    assert hosts(spark, story) == {(0, i): f"{many('l', i, 20)}\n{many('s', i, 100)}" for i in range(12)}
    assert hosts(spark, story, pages=4) == {(0, i): f"{many('l', i, 20)}\nFollow {i} us" for i in range(4)}
    # A slot that is known stays by its share; an element that the template does not know is asked for its name.
    odd = lambda i: story(i) + ('<div class="newsletter">Sign up</div>' if i == 3 else "")
    assert hosts(spark, odd) == hosts(spark, story)


def test_comments_without_a_name(spark):
    """Records of two slots that come again on a page are comments where a slot stands alone; sections and a host of nothing but records stay."""
    record = lambda i, j: f'<div class="r"><div class="who">reader {i} {j}</div><div class="what"><p>{many(f"c{j}x", i, 60)}</p></div></div>'
    story = lambda i: f'<div class="x1"><p>{many("s", i, 100)}</p></div>'
    commented = lambda i: story(i) + f'<div class="x2">{"".join(record(i, j) for j in range(2 + i % 4))}</div>'
    inside = lambda i: f'<div class="x1"><p>{many("s", i, 100)}</p>{"".join(record(i, j) for j in range(2 + i % 4))}</div>'
    sections = lambda i: f'<div class="x1"><p>{many("s", i, 40)}</p>{"".join(f"<section><h2>H{i}{j}</h2><p>{many(f"t{j}x", i, 50)}</p></section>" for j in range(2 + i % 4))}</div>'
    only = lambda i: f'<div class="x2">{"".join(record(i, j) for j in range(2 + i % 4))}</div>'
    got = hosts(spark, commented, inside, sections, only)
    for i in range(12):
        assert got[0, i] == got[1, i] == many("s", i, 100)
        assert got[2, i] == "\n".join([many("s", i, 40), *(x for j in range(2 + i % 4) for x in (f"H{i}{j}", many(f"t{j}x", i, 50)))])
        assert got[3, i] == "\n".join(many(f"c{j}x", i, 60) for j in range(2 + i % 4))  # names of writers go by their share


def test_same_text_on_all_pages_is_not_main(spark):
    """A notice as long as the story, in a slot of its own without a name, cut in pieces that are too long to be tokens; and a host whose pages are all copies."""
    notice = "All of this is offered as it is and as it stands. " * 12
    body = lambda i: f'<div class="x3"><p>{notice}</p></div><div class="x1"><p>{many("s", i, 80)}</p></div>'
    copies = lambda i: '<div class="x1"><p>' + many("same", 1, 90) + "</p></div>"
    got = hosts(spark, body, copies)
    assert got == {(0, i): many("s", i, 80) for i in range(12)} | {(1, i): many("same", 1, 90) for i in range(12)}


def test_the_template_decides_on_a_planted_table(spark):
    """Without a template, notices, teasers and comments of unnamed boxes stay on every page of hosts like these."""
    body = lambda i: f'<div class="a1">Read {i % 3} next</div><div class="b2"><p>{many("s", i, 50)}</p></div><div class="c3">Sold by {i % 2} of us</div>'
    got = hosts(spark, body)
    assert got == {(0, i): many("s", i, 50) for i in range(12)}
    assert all(html_extract.extract(page(body(i)), html_extract.Template(())) != got[0, i] for i in range(12))


def test_no_local_folder_on_a_cluster(monkeypatch):
    """Without spark.checkpoint.dir a cluster is refused; one process gets a temporary folder."""
    from types import SimpleNamespace

    from lodestack.llm.common import shared_dir

    held = {}
    conf = SimpleNamespace(get=lambda k, d=None: held.get(k, d), set=held.__setitem__)
    for master in ("local-cluster[3,2,5000]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master)))
    made = shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None, master="local[4]")))
    assert made.startswith("file://") and held["spark.checkpoint.dir"] == made


def ordinal_loss(model_x, at, row, grades, n, used):
    """Mean negative log-likelihood of the cumulative-link model with its ridge, written out."""
    w, theta = model_x[:used], model_x[used:]
    s = np.zeros(n)
    np.add.at(s, row, w[at])
    tail = lambda k: 1 / (1 + np.exp(-(s - theta[k])))
    above = np.stack([np.ones(n), *(tail(k) for k in range(len(theta))), np.zeros(n)])
    p = above[grades, np.arange(n)] - above[grades + 1, np.arange(n)]
    return -np.log(np.maximum(p, 1e-300)).mean() + quality.RIDGE / 2 * (w**2).sum()


def test_ordinal_fit_is_near_the_optimum(spark):
    """By finite differences of a loss written out anew: the gradient at the fit is a small part of that at the start, and steps off it cost."""
    rng = np.random.default_rng(4)
    grades = rng.integers(0, 3, 400)
    rows = []
    for g in grades:
        rows.append(np.unique(np.concatenate([rng.choice(6, 2) + 6 * g, rng.choice(18, 1)])).astype("i4"))
    m = quality.fit(rows, grades)
    used = np.flatnonzero(m.weights)
    place = {b: i for i, b in enumerate(used)}
    at = np.array([place[b] for r in rows for b in r if b in place])
    row = np.array([i for i, r in enumerate(rows) for b in r if b in place])
    loss = lambda x: ordinal_loss(x, at, row, grades, len(rows), len(used))

    def gradient(x):
        e = np.eye(len(x)) * 1e-5
        return np.array([(loss(x + d) - loss(x - d)) / 2e-5 for d in e])

    x = np.concatenate([m.weights[used].astype("f8"), m.thresholds])
    start = np.concatenate([np.zeros(len(used)), [-3.0, -2.0]])
    assert len(used) > 5 and np.linalg.norm(gradient(x)) < 0.02 * np.linalg.norm(gradient(start))
    assert all(loss(x + d) > loss(x) for d in rng.normal(0, 0.3, (50, len(x))))
    # Scores and tail probabilities are sums and sigmoids of what was fitted.
    texts = [(1, "alpha beta"), (2, None), (3, "GAMMA!! gamma ## gamma gamma")]
    full = quality.OrdinalModel(rng.normal(0, 1, quality.DIM).astype("f4"), np.array([-1.0, 0.5]))
    for r in quality.score_quality(spark.createDataFrame(texts, "doc_id long, text string"), full).collect():
        s = full.weights[quality.features(r.text)].astype("f8").sum()
        p = [1 / (1 + np.exp(-(s - t))) for t in full.thresholds]
        assert abs(r.p_not_toxic - p[0]) < 1e-6 and abs(r.p_good - p[1]) < 1e-6 and abs(r.expected_grade - sum(p)) < 1e-6
