"""Literal cases of inventory, provenance, classification, evaluation and audit."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestack.functions.text import date_tokens, json_string
from lodestack.operators import audit, classify, dedup, evaluate, ingest, inventory, lookups, manifest, retrieval


def files(spark, rows):
    return spark.createDataFrame([(p, n, hashlib.sha256(str(c).encode()).hexdigest()) for p, n, c in rows], "path string, size long, sha string")


def test_inventory(spark):
    f = files(spark, [(x, n, x) for x, n in [("photo.JPG", 10), ("notes.txt", 5), ("no_extension_file", 3), ("backup.tar.gz", 20), ("plain.gz", 8), ("known.zip", 10), ("known.7z", 10), ("other.rar", 10), ("other.iso", 10)]])
    got = {r.ext: (r.files, r.bytes, r.is_archive, r.is_known) for r in inventory.by_extension(f).collect()}
    assert got == {".jpg": (1, 10, False, False), ".txt": (1, 5, False, False), "(no extension)": (1, 3, False, False), ".tar.gz": (1, 20, True, False), ".gz": (1, 8, True, False), ".zip": (1, 10, True, True), ".7z": (1, 10, True, True), ".rar": (1, 10, True, False), ".iso": (1, 10, True, False)}


def test_exact_file_groups(spark):
    f = files(spark, [("a.c9r", 5, 1), ("b.c9r", 5, 1), ("a.txt", 6, 2), ("b.txt", 6, 2), ("x.c9r", 7, 3), ("x.bin", 7, 3), ("e1", 0, 4), ("e2", 0, 4)])
    got = {r.first_path: (r.category, r.n, r.reclaimable) for r in inventory.exact_file_groups(f).collect()}
    assert got == {"a.c9r": ("cryptomator_chunk_duplicate", 2, 5), "a.txt": ("exact_duplicate", 2, 6), "x.bin": ("exact_duplicate", 2, 7)}


@pytest.mark.parametrize(
    "path,want",
    [
        ("/corpus/27082026/file.txt", ["2026-08-27"]),
        ("/corpus/backup-19-02-2026/file.txt", ["2026-02-19"]),
        ("/corpus/99999999/01011826/f", []),
        ("/corpus/takeout-20260604T054024Z/f", ["2026-06-04"]),
    ],
)
def test_date_tokens(spark, path, want):
    assert spark.range(1).select(date_tokens(F.lit(path)).alias("d")).first().d == want


@pytest.mark.parametrize(
    "paths,code,confidence,review",
    [
        (["c/27082026/f", "c/21082026/f"], "DIVERGENT_DATE_SIGNAL", "medium", False),
        (["c/27082026/f", "c/current/f"], "PARTIAL_DATE_OR_KEYWORD_SIGNAL", "low", True),
        (["c/Archive/b.txt", "c/b.txt"], "PARTIAL_DATE_OR_KEYWORD_SIGNAL", "low", True),
        (["c/Backup1/a", "c/Backup2/a"], "UNIFORM_KEYWORD_NO_FURTHER_SIGNAL", "low", True),
        (["c/project_a/t", "c/project_b/t"], "NO_PROVENANCE_SIGNAL", "low", True),
        (["c/27082026/f", "!c/21082026/f"], "STALE_REFERENCE_UNVERIFIABLE", "low", True),
    ],
)
def test_inference(spark, paths, code, confidence, review):
    m = spark.createDataFrame([(1, p.lstrip("!"), not p.startswith("!")) for p in paths], "group_id long, path string, present boolean")
    r = manifest.infer(manifest.group_facts(m)).first()
    assert (r.inference, r.confidence, r.review) == (code, confidence, review) and r.dates == sorted(r.dates)


def test_keep_list(spark):
    rows = [("s1", "deep/er/report.txt", False), ("s1", "report (2).txt", False), ("s1", "a.zip :: report.txt", True), ("s2", "box.zip", False), ("s3", "x/notes - copy.txt", False), ("s3", "x/y/notes.txt", False), ("s4", "a/Thumbs.db", False)]
    loc = spark.createDataFrame(rows, "sha string, path string, in_archive boolean")
    got = {r.sha: (r.keep_path, r.junk) for r in manifest.best_location(loc, spark.createDataFrame([("s2",)], "sha string"), []).collect()}
    assert got == {"s1": ("deep/er/report.txt", False), "s3": ("x/y/notes.txt", False), "s4": ("a/Thumbs.db", True)}


def test_folder_fingerprints(spark):
    def h(*entries):
        return hashlib.sha1(b"".join(e.encode() + b"\0" for e in sorted(entries))).hexdigest()

    rows = [("t1/top.txt", 3, "a"), ("t1/sub/in.txt", 4, "b"), ("t2/top.txt", 3, "a"), ("t2/sub/in.txt", 4, "b"), ("t3/top.txt", 3, "c")]
    f = files(spark, rows)
    sha = {c: hashlib.sha256(c.encode()).hexdigest() for c in "abc"}
    got = {r.dir: (r.fingerprint, r.files, r.bytes) for r in lookups.folder_fingerprints(f).collect()}
    sub = h(f"f\0in.txt\0{sha['b']}")
    top = h(f"f\0top.txt\0{sha['a']}", f"d\0sub\0{sub}")
    assert got == {"t1/sub": (sub, 1, 4), "t2/sub": (sub, 1, 4), "t1": (top, 2, 7), "t2": (top, 2, 7), "t3": (h(f"f\0top.txt\0{sha['c']}"), 1, 3)}
    assert lookups.folder_fingerprints(f.limit(0)).count() == 0


def test_families_do_not_overlap_and_classify(spark):
    kinds = [classify.ARCHIVE, classify.ENCRYPTED, classify.TEXT, classify.STRUCTURED, classify.MEDIA, classify.SOFTWARE]
    assert sum(map(len, kinds)) == len({x for k in kinds for x in k})
    rows = [("a.c9r", "LOOSE_FILE", "ENCRYPTED", False, "EXCLUDED"), ("a.zip", "ARCHIVE", "CONTAINER", True, "ELIGIBLE"), ("a.rar", "ARCHIVE", "CONTAINER", False, "ELIGIBLE"), ("a.gif", "LOOSE_FILE", "MEDIA", False, "UNSUPPORTED"), ("a.wav", "LOOSE_FILE", "MEDIA", False, "ELIGIBLE"), ("a.msi", "LOOSE_FILE", "SOFTWARE", False, "ELIGIBLE"), ("a.bin", "LOOSE_FILE", "SOFTWARE", False, "UNSUPPORTED"), ("a.xml", "LOOSE_FILE", "UNKNOWN", False, "ELIGIBLE"), ("a.pdf_1768918262", "LOOSE_FILE", "TEXT_DOCUMENT", False, "ELIGIBLE")]
    s = spark.createDataFrame([(p, None, 5) for p, *_ in rows], "root string, member string, size long")
    got = {r.root: (r.source_category, r.workload_category, r.extractable, r.eligibility) for r in classify.classify(s).collect()}
    assert got == {p: tuple(x) for p, *x in rows}


def test_selection_rules(spark):
    rows = [("m/a/ok.md", 5, "s"), ("x/a/ok.md", 5, "s"), ("m/private/a.md", 5, "s"), ("m/a/~$b.docx", 5, "s"), ("m/a/My Password list.txt", 5, "s"), ("m/.git/a.txt", 5, "s"), ("m/a/no.md", 5, None), ("m/a/page.html", 5, "s"), ("m/a/big.pdf", 60_000_000, "s")]
    f = spark.createDataFrame(rows, "path string, size long, sha string")
    got = [r.reason for r in classify.first_exclusion(f, classify.selection_rules("m", folders=("private",))).orderBy("path").collect()]
    want = {"m/a/ok.md": None, "x/a/ok.md": "outside the master root", "m/private/a.md": "top-level folder excluded", "m/a/~$b.docx": "office lock file", "m/a/My Password list.txt": "sensitive-looking name", "m/.git/a.txt": "vendor or cache folder", "m/a/no.md": "no recorded checksum", "m/a/page.html": "type not admitted by the policy", "m/a/big.pdf": "risk tier too high for the policy"}
    assert got == [want[p] for p in sorted(want)]
    c = spark.createDataFrame([(".txt", 2_000_000), (".pdf", 2_000_000), (".pdf", 50_000_001), (".txt", 1_000_000)], "ext string, size long")
    assert [r.c for r in c.select(classify.size_class(F.col("ext"), F.col("size")).alias("c")).collect()] == ["chunk_heavy", "normal", "large", "normal"]


def test_selection_fingerprint(spark):
    paths = [("b/é 日.txt", None), ('a/"q"\\\n\x01\x7f🙂.zip', "in/ü"), ("b/é 日.txt", "m")]
    envelope = {"max_source_instances": 3, "max_source_bytes": 10, "max_extracted_bytes": None, "max_embeddings": 4, "max_runtime_seconds": 5}
    canonical = {"d0_report_sha256": "r", "selection_policy_version": "p", "ordering_version": "o", "envelope": envelope, "selected_paths": [{"root_t7_path": r, "member_path": m} for r, m in sorted(paths, key=lambda x: (x[0], x[1] or ""))]}
    want = hashlib.sha256(json.dumps(canonical, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    df = spark.createDataFrame([(1, r, m) for r, m in paths], "batch_id long, root string, member string")
    assert classify.fingerprint(df, ["batch_id"], "r", "p", "o", envelope).first().fingerprint == want
    odd = "".join(map(chr, range(0x300))) + "\uffff\U0010ffff"
    assert spark.createDataFrame([(odd,)], "t string").select(json_string(F.col("t")).alias("j")).first().j == json.dumps(odd)


def test_decision(spark):
    for lexical, semantic, adopt in (((0.1, 0.3), (-0.05, 0.05), True), ((0.01, 0.3), (-0.05, 0.05), False), ((0.1, 0.3), (-0.3, -0.1), False)):
        df = spark.createDataFrame([("lexical", 0.2, *lexical), ("semantic", 0.0, *semantic)], "type string, mean double, low double, high double")
        assert evaluate.decision(df, 0.05).first().adopt is adopt
    assert evaluate.decision(df.limit(0), 0.05).first().adopt is False


def test_bm25_cases(spark):
    def top(chunks, query, k=10):
        c = spark.createDataFrame(chunks, "chunk_id long, content string")
        return [r.chunk_id for r in retrieval.bm25_topk(c, spark.createDataFrame([(1, query)], "query_id long, query string"), k).orderBy("rank").collect()]

    assert top([(1, "alpha beta"), (2, "gamma delta")], "alpha") == [1]
    assert top([(7, "match"), (3, "match"), (5, "match")], "match", 2) == [3, 5]
    assert top([(1, "a")], " ") == [] and top([], "a") == []


def test_queries_go_in_blocks(spark, monkeypatch, sf_dir):
    """Beyond the counted bound the same hits come out, block by block."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = e.where("chunk_id < 20").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    one = sorted(map(str, retrieval.dense_topk(e, q, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERIES", 7)
    monkeypatch.setattr(retrieval._blocks, "__defaults__", (7,))
    assert sorted(map(str, retrieval.dense_topk(e, q, 3).collect())) == one


def test_near_duplicate_documents(spark):
    c = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.01]), (3, 0, [0.0, 1.0]), (4, 1, [1.0, 0.0]), (5, 0, [1.0, 0.05])], "document_id long, chunk_index int, embedding array<double>")
    got = [(r.a, r.b) for r in dedup.near_duplicate_documents(c, 0.95, 2).collect()]
    assert got == [(1, 2), (2, 5)]
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            dedup.near_duplicate_documents(c, bad)


def test_chunk_ids_never_collide(spark):
    d = spark.createDataFrame([(2**60, "x")], "document_id long, text string")
    with pytest.raises(Exception, match="chunk_id"):
        ingest.chunk_documents(d).collect()
    assert ingest.chunk_documents(spark.createDataFrame([(-3, "x" * 2000)], "document_id long, text string")).count() == 3


def test_file_checks(spark):
    seen = [("ok", "d1", "a.txt", 3, "h"), ("gone", "d2", "b.txt", 3, "h"), ("odd", "d3", "c.pdf", 3, "h"), ("new", "d4", "d.txt", 3, "h"), ("nodoc", "d9", "e.txt", 3, "h"), ("blind", "d5", "f.txt", None, None)]
    f = spark.createDataFrame(seen, "k string, document_id string, path string, size long, sha string")
    scan = spark.createDataFrame([("a.txt", 3, "h"), ("c.pdf", 3, "h"), ("d.txt", 4, "x"), ("e.txt", 3, "h"), ("f.txt", 1, "y")], "path string, size long, sha string")
    docs = spark.createDataFrame([("d1", "a.txt", "TXT"), ("d2", "b.txt", "txt"), ("d3", "c.pdf", "txt"), ("d4", "moved.txt", "txt"), ("d5", "f.txt", "txt")], "document_id string, source string, source_type string")
    got = {r.k: (r.document_exists, r.path_changed, r.exists_now, r.type_matches, r.hash_matches, r.size_matches, r.valid) for r in audit.file_checks(f, scan, docs).collect()}
    assert got == {"ok": (True, False, True, True, True, True, True), "gone": (True, False, False, True, False, False, False), "odd": (True, False, True, False, True, True, False), "new": (True, True, True, True, False, False, False), "nodoc": (False, True, True, False, True, True, False), "blind": (True, False, True, True, False, False, False)}


def test_ledger_and_junk(spark):
    led = spark.createDataFrame([(1, -1), (2, 5), (3, 11)], "batch_id long, reserved long")
    assert {r.batch_id for r in audit.ledger_breaks(led, F.lit(10)).collect()} == {1, 3}
    names = spark.createDataFrame([("a/.DS_Store",), ("b/x.db",)], "p string")
    assert [r.j for r in names.select(manifest.is_junk(F.col("p")).alias("j")).collect()] == [True, False]
    rules = spark.createDataFrame([("UNRESOLVED", None, None), ("DECIDED", None, "x"), ("DECIDED", "me", " ")], "canonical_status string, decided_by string, reason string")
    assert sorted(tuple(r.violations) for r in audit.violations(rules, lookups.canonical_rules()).collect()) == [("decider",), ("reason",)]
    m = spark.createDataFrame([("m1", 1), ("m2", 2)], "member string, document_id long")
    assert [r.member for r in lookups.listed_members(m, spark.createDataFrame([(2,)], "document_id long")).collect()] == ["m2"]
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_id long, rank int")
    assert {r.chunk_id: r.rank for r in retrieval.rerank(ranked, F.col("chunk_id").cast("double")).collect()} == {11: 1, 10: 2}
