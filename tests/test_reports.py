"""Scans as tables, reports in sections, hashes of reports, chains of members."""

import datetime
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from lodestack.operators import lookups
from lodestack.sources import archives, reports


def tree(tmp_path):
    for name, body in (("a/x.txt", "x" * 10), ("a/b/y.TXT", "yy"), ("z", "")):
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_text(body)
    os.symlink("x.txt", tmp_path / "root/a/link")
    return str(tmp_path / "root")


def test_scan_to_tables(spark, tmp_path):
    root, target = tree(tmp_path), str(tmp_path / "scans")
    first = reports.record_scan(spark, root, target)
    (tmp_path / "root/new").write_text("12345")
    second = reports.record_scan(spark, root, target)
    runs = {r.run: r for r in reports.scan_runs(spark, target).collect()}
    assert (runs[first].files, runs[first].dirs, runs[first].symlinks, runs[first].errors, runs[first].bytes) == (3, 2, 1, 0, 12)
    assert (runs[second].files, runs[second].bytes, runs[second].root) == (4, 17, root) and runs[first].completed <= runs[second].started
    assert {r.path for r in reports.scan_entries(spark, target).where("kind = 'file'").collect()} == {"a/x.txt", "a/b/y.TXT", "z", "new"}
    assert reports.scan_entries(spark, target, first).count() == 6
    with pytest.raises(ValueError, match="tree"):
        reports.record_scan(spark, root, root + "/a/out")


def test_sections_and_hashes(spark, tmp_path):
    root = tree(tmp_path)
    groups = spark.createDataFrame([("a/x.txt", 2, 10), ("z", 3, None)], "first_path string, n long, reclaimable long")
    dirs = spark.createDataFrame([("a", 3, 12)], "first_dir string, n long, bytes long")
    totals = reports.reclaimable_totals(groups, dirs)
    assert tuple(totals.first()) == (10, 24) and tuple(reports.reclaimable_totals(groups.limit(0), dirs.limit(0)).first()) == (0, 0)
    at = str(tmp_path / "d1")
    reports.write_sections({"exact": groups, "directories": dirs, "totals": totals}, at, root, "D1")
    said = json.loads((tmp_path / "d1/report.json").read_text())
    assert (said["kind"], said["root"], said["sections"]["exact"]) == ("D1", root, {"rows": 2, "columns": ["first_path", "n", "reclaimable"]})
    back = reports.read_section(spark, at, "exact", "first_path string, n long, reclaimable long")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, groups.collect()), key=str)
    with pytest.raises(Exception, match="exist"):
        reports.write_sections({"exact": groups}, at, root, "D1")
    for bad in (root, root + "/sub/report"):
        with pytest.raises(ValueError, match="tree"):
            reports.write_sections({"exact": groups}, bad, root, "D0")
    # A file's hash is that of its bytes; a folder's follows what its files say.
    assert reports.report_hash(spark, at + "/report.json") == hashlib.sha256((tmp_path / "d1/report.json").read_bytes()).hexdigest()
    one = reports.report_hash(spark, at)
    assert one == reports.report_hash(spark, at)
    (tmp_path / "d1/report.json").write_text("{}")
    assert reports.report_hash(spark, at) != one
    t = datetime.datetime(2024, 1, 2, 3, 4, 5)
    sha = reports.record_run(spark, str(tmp_path / "runs"), "D1", root, at + "/report.json", t, t)
    r = spark.read.parquet(str(tmp_path / "runs")).first()
    assert (r.kind, r.root, r.report_sha256) == ("D1", root, sha) and sha == hashlib.sha256(b"{}").hexdigest()
    with pytest.raises(ValueError):
        reports.record_run(spark, str(tmp_path / "runs"), "D9", root, at, t, t)


def test_write_report_and_chain(spark, tmp_path):
    lookups.write_report(spark.createDataFrame([(1, None), (2, "b")], "n int, t string"), str(tmp_path / "r"))
    lines = sorted(x for p in (tmp_path / "r").glob("*.json") for x in p.read_text().splitlines())
    assert [json.loads(x) for x in lines] == [{"n": 1, "t": None}, {"n": 2, "t": "b"}]
    with pytest.raises(Exception, match="exist"):
        lookups.write_report(spark.range(1).toDF("n"), str(tmp_path / "r"))
    got = spark.createDataFrame([("o.zip!i.7z!d/f",), ("x",), (None,)], "m string").select(archives.chain(F.col("m")).alias("c")).collect()
    assert [(x.kind, x.path) for x in got[0].c] == [("FILE", "o.zip"), ("ARCHIVE_MEMBER", "i.7z"), ("ARCHIVE_MEMBER", "d/f")]
    assert [(x.kind, x.path) for x in got[1].c] == [("FILE", "x")] and got[2].c is None
