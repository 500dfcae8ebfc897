import hashlib
import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lodestack.sources import archives, files


def zipped(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for n, d in members.items():
            z.writestr(n, d)
    return b.getvalue()


def test_scan_and_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_text("hello")
    (tmp_path / "y.md").write_text("")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    got = {r.relative_path: r["size"] for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got["a/x.txt"] == 5
    spark.dataSource.register(files.FileTree)
    rows = {r.path: r for r in spark.read.format("filetree").load(str(tmp_path)).collect()}
    assert rows["a/x.txt"].kind == "file" and rows["a/x.txt"].depth == 2 and rows["link"].kind == "symlink" and "link/x.txt" not in rows
    (tmp_path / "link").unlink()  # Spark's own reader follows links
    h = files.content_hashes(spark, str(tmp_path)).collect()
    assert [(r["size"], r.changed, r.error) for r in h] == [(5, False, None)] and h[0].sha == hashlib.sha256(b"hello").hexdigest() and h[0].crc32 == zlib.crc32(b"hello")
    assert files.content_hashes(spark, str(tmp_path), spark.createDataFrame([(h[0].path,)], "path string")).count() == 0


def test_hashes_read_in_pieces(spark, tmp_path, monkeypatch):
    """A file of many pieces, and one that goes between listing and reading."""
    data = bytes(range(256)) * 4000
    (tmp_path / "big.bin").write_bytes(data)
    (tmp_path / "gone.bin").write_bytes(b"x")
    monkeypatch.setattr(files, "PIECE", 1000)
    df = files.content_hashes(spark, str(tmp_path))
    df.explain()  # the listing is made here
    (tmp_path / "gone.bin").unlink()
    got = {r.path.rsplit("/", 1)[1]: r for r in df.collect()}
    assert set(got) == {"big.bin"} and got["big.bin"].sha == hashlib.sha256(data).hexdigest()


def test_plan_and_report_files(spark, tmp_path):
    plan = spark.createDataFrame([("a,b", 1)], "path string, n int")
    files.write_plan(plan, str(tmp_path / "p"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "p"), "path string, n int").collect()] == [("a,b", 1)]
    with pytest.raises(Exception, match="exist"):
        files.write_plan(plan, str(tmp_path / "p"))
    (tmp_path / "r.json").write_text('{"root": "/x", "groups": null}')
    r = files.read_report(spark, str(tmp_path / "r.json"), "root string, groups array<string>, missing array<int>").first()
    assert (r.root, r.groups, r.missing) == ("/x", [], [])


def test_failure_codes(spark):
    """The codes as they are fixed; only the depth limit is final."""
    want = {
        "ok": None,
        "denied": ("PERMISSION_DENIED", True),
        "missing": ("T7_UNAVAILABLE", True),
        "no_space": ("INSUFFICIENT_DISK_SPACE", True),
        "expansion": ("OVERSIZED_OR_EXPANSION_LIMIT", True),
        "max_depth": ("OVERSIZED_OR_EXPANSION_LIMIT", False),
        "error": ("MALFORMED_ARCHIVE", True),
        "unsafe_path": ("MALFORMED_ARCHIVE", True),
        "encrypted": ("EXTRACTION_ERROR_OTHER", True),
        "odd": ("EXTRACTION_ERROR_OTHER", True),
    }
    got = spark.createDataFrame([(k,) for k in want], "s string").select("s", archives.failure_code(F.col("s")).alias("c")).collect()
    assert {r.s: r.c and tuple(r.c) for r in got} == want


def test_no_space_for_nested_archives(spark, tmp_path, monkeypatch):
    import io
    import shutil
    import types
    import zipfile

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x.txt", "x")
    with zipfile.ZipFile(tmp_path / "o.zip", "w") as z:
        z.writestr("in.zip", inner.getvalue())
    monkeypatch.setattr(archives, "KEPT", 0)
    monkeypatch.setattr(shutil, "disk_usage", lambda _: types.SimpleNamespace(free=archives.RESERVE))
    assert not archives.fits(10) and archives.fits(0)
    with open(tmp_path / "o.zip", "rb") as f:
        assert [r[-1] for r in archives._members("o", f, "o!", 1, True, 3)] == ["no_space"]


HEADS = {
    "---\ncreated_at: 2020\n---\nb": "Created at: 2020\n\nb",
    "---\ntags: [a, 'b c', 3]\n---\n b \n": "Tags: a, b c, 3\n\nb",
    "---\nby:\n  - Ann\n  - \"Bo: b\"\ntags:\n- x\n---\n": "By: Ann, Bo: b\nTags: x\n\n",
    "---\na:\nb: ~\nc: []\nd: {}\ne: ''\n---\nbody ": "body ",
    "---\ndone: yes\nn: 0\nd: 2023-01-05\nt: 2023-01-05 10:00:00\nf: 1.50\nx: 0x10\n---\nb": "Done: True\nN: 0\nD: 2023-01-05\nT: 2023-01-05 10:00:00\nF: 1.5\nX: 16\n\nb",
    "---\ntext: |-\n  one\n  two\nlong: some\n  more # c\n---\nb": "Text: one\ntwo\nLong: some more\n\nb",
    "---\nurl: https://x.org/a?b#c\n# c\nmap: {a: 1}\n---\nb": "Url: https://x.org/a?b#c\nMap: {'a': 1}\n\nb",
    "---\nno mapping\n---\nb [[l]]": "---\nno mapping\n---\nb l",
    "---\na: [1\n---\nb": "---\na: [1\n---\nb",
    "---\na: b: c\n---\nb": "---\na: b: c\n---\nb",
    "---\na: &x 1\n---\nb": "---\na: &x 1\n---\nb",
    " ---\na: 1\n---\nb": " ---\na: 1\n---\nb",
    "---\r\na: 1\r\n---\r\nb": "A: 1\n\nb",
    "[[a|b]] [[ c ]] ![[d]] [[]] [[e|]] [[f|g|h]] [[a|b": "b c  [[]] [[e|]] g|h [[a|b",
}


@pytest.mark.parametrize("text", HEADS)
def test_heads_and_links(text):
    from lodestack.sources.frontmatter import readable

    assert readable(text) == HEADS[text]


def test_links_as_columns_equal_links_in_files(spark):
    from lodestack.functions.text import clean_wikilinks
    from lodestack.sources.frontmatter import plain_links

    texts = [*HEADS, "[[ ]] [[|x]] [[a| ]] ![[a|b]] [[\u00a0a\u00a0]] [[a\nb]]"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", clean_wikilinks(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == {t: plain_links(t) for t in texts}


def test_large_folders_are_dealt_out(spark, tmp_path, monkeypatch):
    for i in range(6):
        (tmp_path / f"root/top/d{i}/e").mkdir(parents=True)
        for j in range(8):
            (tmp_path / f"root/top/d{i}/e/f{j}").write_text("x")
    want = {str(p.relative_to(tmp_path / "root")) for p in (tmp_path / "root").rglob("*")}
    for entries in (1, 4, 20, 10_000):
        monkeypatch.setattr(files.FileTreeReader, "ENTRIES", entries)
        r = files.FileTreeReader(str(tmp_path / "root"))
        parts = r.partitions()
        got = [row[0] for p in parts for row in r.read(p)]
        assert sorted(got) == sorted(want) and len(parts) >= min(entries, len(want)) // 4
    with pytest.raises(NotADirectoryError):
        files.FileTreeReader(str(tmp_path / "none")).partitions()


def test_output_guard(tmp_path):
    with pytest.raises(ValueError):
        files.check_output(str(tmp_path / "x/../y"), str(tmp_path))
    files.check_output("/elsewhere", str(tmp_path))


def test_queries_reader(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"query_id":"a","query":"x","type":"lexical","relevant":["d"],"approved":true}\n{"query_id":"b","query":"y","type":"semantic","relevant":["d"],"approved":false}\n')
    assert [r.query_id for r in files.read_queries(spark, str(p)).collect()] == ["a"]
    p.write_text('{"query_id":"a","query":"x","type":"odd","relevant":["d"],"approved":true}\n')
    with pytest.raises(Exception, match="lacks"):
        files.read_queries(spark, str(p)).collect()


def test_archives(spark, tmp_path):
    inner = zipped({"deep/f.txt": b"inner"})
    (tmp_path / "o.zip").write_bytes(zipped({"a.txt": b"hello", "i.zip": inner, "../evil": b"x", "bomb": b"\0" * 3_000_000}))
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    rows = {r.member: r for r in archives.archive_members(archives.read_archives(spark, str(tmp_path))).collect()}
    assert rows["o.zip!i.zip!deep/f.txt"].crc_ok and rows["o.zip!i.zip!deep/f.txt"].depth == 2
    assert rows["o.zip!../evil"].status == "unsafe_path" and rows["o.zip!bomb"].status == "expansion"
    assert rows["bad.zip"].status == "error"
    shallow = {r.member: r.status for r in archives.archive_members(archives.read_archives(spark, str(tmp_path)), max_depth=1).collect()}
    assert shallow["o.zip!i.zip!"] == "max_depth"


def test_text(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    docx = zipped({"word/document.xml": f'<w:document xmlns:w="{w}"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>'})
    assert archives.text_of("a.docx", docx) == "one\ntwo"
    assert archives.text_of("a.txt", "é\0x".encode()) == "éx"
    assert archives.text_of("a.txt", "é".encode("utf-16")) == "é"
    assert archives.text_of("a.md", b"---\ntitle: T\nempty:\n---\nsee [[a|b]]") == "Title: T\n\nsee b"
    assert archives.text_of("a.docx", b"broken") is None
    df = spark.createDataFrame([("a.txt", bytearray(b"hi"))], "path string, content binary")
    assert archives.extract_text(df).first().text == "hi"
    assert archives.safe_name("../a:b/" + "x" * 300 + ".txt").endswith("x.txt")


def test_sqlite_table(spark, tmp_path):
    import sqlite3

    from lodestack.sources.sqlite import SqliteTable

    c = sqlite3.connect(tmp_path / "x.db")
    c.execute('CREATE TABLE "odd name" (path TEXT, size INTEGER, extra TEXT)')
    c.executemany('INSERT INTO "odd name" VALUES (?, ?, ?)', [(f"p{i}", i if i % 7 else None, "z") for i in range(250)])
    c.execute('CREATE TABLE empty (path TEXT)')
    c.execute('CREATE TABLE keyed (path TEXT PRIMARY KEY, size INTEGER) WITHOUT ROWID')
    c.executemany('INSERT INTO keyed VALUES (?, ?)', [(f"k{i}", i) for i in range(120)])
    c.execute('CREATE VIEW seen AS SELECT path, size + 1 AS size FROM keyed')
    c.commit()
    c.close()
    spark.dataSource.register(SqliteTable)
    df = spark.read.format("sqlitetable").schema("path string, size long").option("table", "odd name").option("rows", "100").load(str(tmp_path / "x.db"))
    assert df.rdd.getNumPartitions() == 3 and sorted((r.path, r["size"]) for r in df.collect()) == sorted((f"p{i}", i if i % 7 else None) for i in range(250))
    for name, more in (("keyed", 0), ("seen", 1)):
        df = spark.read.format("sqlitetable").schema("path string, size long").option("table", name).option("rows", "50").load(str(tmp_path / "x.db"))
        assert sorted((r["size"], r.path) for r in df.collect()) == [(i + more, f"k{i}") for i in range(120)]
    with pytest.raises(Exception, match="no such table"):
        spark.read.format("sqlitetable").schema("path string").option("table", "none").load(str(tmp_path / "x.db")).count()
    assert spark.read.format("sqlitetable").schema("path string").option("table", "empty").load(str(tmp_path / "x.db")).count() == 0
