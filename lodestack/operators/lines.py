"""Line filters of screen text."""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.shared import shared_dir


def keep_good_lines(docs: DataFrame, share: float = 0.6, floor: int = 2) -> DataFrame:
    """doc_id, text -> doc_id, line_no, line, n, share of the lines with enough words, of which enough are in the vocabulary.

    The vocabulary is the words found ``floor`` times or more. It is large and its words are frequent, so
    words out of it are taken off instead: those found once have their line in the aggregate that counts
    words, which combines before the shuffle; others that are found too seldom are met again by a join.
    """
    lines = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    found = F.regexp_extract_all("line", F.lit("([A-Za-z]{3,})"), F.lit(1))
    words = lines.select("doc_id", "line_no", F.explode(found).alias("word")).withColumn("word", F.lower("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("doc_id", "line_no")).alias("_at"))
    rare = counts.where((F.col("_n") == 1) & (F.col("_n") < floor)).select("_at.doc_id", "_at.line_no")
    if floor > 2:
        rare = rare.unionByName(words.join(counts.where((F.col("_n") > 1) & (F.col("_n") < floor)).select("word"), "word", "left_semi").select("doc_id", "line_no"))
    own = lines.select("doc_id", "line_no", F.size(found).cast("long").alias("n"), F.lit(0).cast("long").alias("off")).where("n > 0")
    each = own.unionByName(rare.select("doc_id", "line_no", F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("off")))
    r = each.groupBy("doc_id", "line_no").agg(F.sum("n").alias("n"), F.sum("off").alias("off"))
    r = r.select("doc_id", "line_no", "n", ((F.col("n") - F.col("off")) / F.col("n")).alias("share")).where(F.col("share") >= share)
    # What is asked of the line itself is known before the join, which then carries its text only for those who want it.
    lines = lines.withColumn("_least", F.when(F.col("line").rlike(r"[0-9=()+\-/*<>^]"), 1).otherwise(2))
    return lines.join(r, ["doc_id", "line_no"]).where(F.col("n") >= F.col("_least")).select("doc_id", "line_no", "line", "n", "share")


#: Frame numbers of a range: a recording is dealt out by ranges, however long it is.
STEP = 1000


def normalise(line: str) -> str:
    """What lines are compared by: their letters and digits, in lower case."""
    return "".join(c.lower() for c in line if c.isalnum())


def letter_places(line: str) -> dict[str, int]:
    """Of each character, a number whose set bits are its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(line):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_length(short: str, places: dict[str, int], n: int) -> int:
    """Length of the longest common subsequence with the line of ``n`` characters that has these places (a column of the table is one number)."""
    whole = (1 << n) - 1
    row = whole
    for c in short:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & whole
    return n - row.bit_count()


def _before(frames: DataFrame, window: int, step: float) -> DataFrame:
    """recording, _b, frame: of each range of frame numbers, the last ``window`` frames before it. Windows run over ranges, not over frames."""
    f = frames.select("recording", "frame").distinct().withColumn("_b", F.floor(F.col("frame") / F.lit(step)))
    last = f.withColumn("_n", F.row_number().over(Window.partitionBy("recording", "_b").orderBy(F.desc("frame")))).where(F.col("_n") <= window)
    last = last.groupBy("recording", "_b").agg(F.sort_array(F.collect_list("frame")).alias("_f"))
    # A range that is there has a frame at least, so as many ranges hold them all.
    w = Window.partitionBy("recording").orderBy("_b").rowsBetween(-window, -1)
    past = last.select("recording", "_b", F.flatten(F.collect_list("_f").over(w)).alias("_f"))
    return past.select("recording", "_b", F.explode(F.slice("_f", F.greatest(F.lit(1), F.size("_f") - window + 1), window)).alias("frame"))


def drop_repeated_lines(frames: DataFrame, window: int = 4, ratio: float = 0.8, step: float = STEP) -> DataFrame:
    """recording, frame (a number), line_no, line -> lines that say something new.

    Lines are compared by ``normalise``; those without a letter or digit go. A line is no news if it is
    contained in, contains or is similar (difflib) to any line of the recording's last ``window`` frames,
    or to a line kept of its own frame. difflib's matches are a common subsequence, so lines whose
    longest one is too short are not similar and are told apart without it. As no decision depends on an earlier frame's, a recording is
    dealt out in ranges, each with the ``window`` frames before it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        places: dict[str, dict[str, int]] = {}

        def near(a: str, b: str) -> bool:
            if a in b or b in a:
                return True
            short, long = (a, b) if len(a) <= len(b) else (b, a)
            most = lambda n: 2.0 * n / (len(a) + len(b))
            if most(len(short)) < ratio:
                return False
            if long not in places:
                places[long] = letter_places(long)
            return most(common_length(short, places[long], len(long))) >= ratio and SequenceMatcher(None, a, b).ratio() >= ratio

        past: list[list[str]] = []
        out = []
        rows = pdf[pdf["frame"].notna()].sort_values(["frame", "line_no"], kind="stable")
        for _, g in groupby(rows.itertuples(index=False), lambda r: r.frame):
            seen, fresh, own = {x for f in past for x in f}, [], []
            places = {x: p for x, p in places.items() if x in seen}
            for r in g:
                key = normalise(r.line or "")
                if not key:
                    continue
                own.append(key)
                if not r.own or key in seen or any(near(key, x) for x in seen) or any(near(key, x) for x in fresh):
                    continue
                fresh.append(key)
                out.append(r)
            past = [*past, own][-window:] if window else []
        return pd.DataFrame(out, columns=pdf.columns).drop(columns=["_b", "own"])

    rows = frames.withColumns({"_b": F.floor(F.col("frame") / F.lit(step)), "own": F.lit(True)})
    if window:
        past = frames.join(_before(frames, window, step), ["recording", "frame"]).withColumn("own", F.lit(False))
        rows = rows.unionByName(past.select(*frames.columns, "_b", "own"))
    return rows.groupBy("recording", "_b").applyInPandas(run, frames.schema)


def skip_unchanged_frames(frames: DataFrame, least: float = 1.5, step: float = STEP) -> DataFrame:
    """recording, frame (a number, one row each), pixels (array) -> frames whose mean absolute difference from the last kept frame is ``least`` or more.

    A range of frames is a function of the frame that was kept last before it. Ranges start from a guess
    (none), all at once; those whose true predecessor turns out to be another are scanned again, until
    none is. Each round settles the first open range of every recording at least, and mostly all, since
    two scans agree from the first frame that both keep.
    """
    import numpy as np

    spark = frames.sparkSession
    shared_dir(spark)
    b = frames.select("recording", "frame", "pixels").withColumn("_b", F.floor(F.col("frame") / F.lit(step)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        last, keep = None, []
        for r in pdf.itertuples(index=False):
            x = np.asarray(r.pixels, float)
            if not r.own:
                last = x
            elif last is None or len(x) != len(last) or not len(x) or np.abs(x - last).mean() >= least:
                keep.append((r.recording, r.bucket, r.frame))
                last = x
        return pd.DataFrame(keep, columns=["recording", "_b", "frame"])

    types = {f.name: f.dataType.simpleString() for f in b.schema}
    kept_schema = f"recording {types['recording']}, _b {types['_b']}, frame {types['frame']}"

    def scan(state: DataFrame) -> DataFrame:
        own = b.join(state.select("recording", "_b"), ["recording", "_b"], "left_semi").withColumn("own", F.lit(True))
        past = state.where("incoming is not null").select("recording", "_b", F.col("incoming").alias("frame")).join(frames.select("recording", "frame", "pixels"), ["recording", "frame"])
        rows = own.unionByName(past.select("recording", "frame", "pixels", "_b").withColumn("own", F.lit(False)))
        return rows.withColumn("bucket", F.col("_b")).groupBy("recording", "_b").applyInPandas(run, kept_schema)

    ranges = b.select("recording", "_b").distinct()
    state = ranges.withColumn("incoming", F.lit(None).cast(types["frame"])).checkpoint()
    kept = scan(state).checkpoint()
    before = Window.partitionBy("recording").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        out = kept.groupBy("recording", "_b").agg(F.max("frame").alias("out"))
        now = state.join(out, ["recording", "_b"], "left").withColumn("now", F.last("out", ignorenulls=True).over(before)).checkpoint()
        changed = now.where(~F.col("incoming").eqNullSafe(F.col("now"))).select("recording", "_b", F.col("now").alias("incoming"))
        if changed.isEmpty():
            return frames.join(kept.select("recording", "frame"), ["recording", "frame"], "left_semi").select(*frames.columns)
        again = scan(changed)
        kept = kept.join(changed, ["recording", "_b"], "left_anti").unionByName(again).checkpoint()
        state = now.select("recording", "_b", F.col("now").alias("incoming"))
