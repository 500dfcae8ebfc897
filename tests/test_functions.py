import os

import pytest
from pyspark.sql import functions as F

from lodestack.functions import paths as P
from lodestack.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (999, 1), (1000, 1), (1001, 2), (1800, 2), (1801, 3), (2600, 3)])
def test_chunk_counts(spark, n, want):
    got = one(spark, "  " + "x" * n + "\n", T.chunks)
    assert len(got) == want and (not got or got[-1] == "x" * (n - 800 * (want - 1)))


def test_chunk_arguments():
    with pytest.raises(ValueError):
        T.chunks(F.lit("x"), 100, 100)


def test_tokens(spark):
    assert one(spark, "Été 2x_Y naïve", T.tokens) == ["t", "2x_y", "na", "ve"]
    assert one(spark, "b A b c", T.or_query) == "b | a | c"


@pytest.mark.parametrize("name", ["a.txt", ".txt", "a.", "a.b.TXT", "..x", "a/b.c/d", "x.pdf_12", "n.tar.gz", "a/.b.c"])
def test_suffix(spark, name):
    want = os.path.basename(name)
    i = want.rfind(".")
    want = want[i:].lower() if 0 < i < len(want) - 1 else ""
    assert one(spark, name, P.suffix) == want


def test_paths(spark):
    assert one(spark, "a/b/c.txt", P.ancestors) == ["a", "a/b"]
    assert one(spark, "c.txt", P.ancestors) == []
    assert one(spark, "x.tar.ZST", P.extension) == ".tar.zst"
    assert one(spark, "x", P.extension) == "(no extension)"
    assert one(spark, "x.pdf_7", P.source_suffix) == ".pdf"
    assert one(spark, "o.zip!i.7z!f", P.archive_levels) == ["o.zip!", "i.7z!", "f"]


def test_dates(spark):
    got = one(spark, "a/31022026_01032024 20240229 123456789 05-06-2031 99-99-2020", T.date_tokens)
    assert got == ["2024-03-01", "2024-02-29", "2031-06-05"]


def test_links_and_labels(spark):
    assert one(spark, "a ![[pic]] [[x|y]] [[z]]", T.clean_wikilinks) == "a  y z"
    assert spark.range(1).select(T.time_label(F.lit(3725)).alias("x")).first().x == "[01:02:05]"


def test_a_text_is_stripped_once_for_all_its_chunks(spark):
    """The stripped text was part of each chunk's own expression, so a text was stripped once a chunk."""
    assert str(T.chunks(F.col("whole_text"))).count("whole_text") == 1


def test_strip_takes_all_white_space_and_nothing_else(spark):
    d = spark.createDataFrame([(None,), ("",), (" \n",)] + [(f"{chr(c)}a {chr(c)}",) for c in [*range(1, 0x250), *range(0x1600, 0x1900), *range(0x2000, 0x2100), 0x3000, 0xFEFF]], "t string")
    assert d.where(~T.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
