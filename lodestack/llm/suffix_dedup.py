"""Operator 11: removal of repeated byte strings by suffix arrays of shards.

Shards must meet at every repeat, wherever its copies stand. So each window of LENGTH bytes is known
by its anchor, the place of the least hash of ANCHOR bytes in it (the leftmost of equal ones): equal
windows have equal anchors at equal offsets. Successive windows of one anchor make a piece, and pieces
of a document overlap but share no window. An anchor found once rules all windows of its piece out.
Of the others, anchors whose pieces are all equal are settled by counts; pieces that differ are dealt
by anchor, one copy of each, and a shard's suffix array (``suffix_array``: classes of suffixes, leftmost
smaller substrings, induced order) with its permuted common prefixes gives the windows that come again.
An anchor of more than HOT_PIECES different pieces is not dealt to one task: one copy of each is cut
again by longer anchors, of which each piece has several, until anchors are as long as windows; such
pieces are single windows, and those of an anchor are all equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import apart, read, slices, small, written
from lodestack.llm.suffix_array import repeated_starts

LENGTH, ANCHOR = 200, 64
HOT_PIECES = 500
#: Bytes of a shard's suffix array, and of the windows that are hashed at a time.
SHARD_BYTES, SLICE_BYTES = 2 << 20, 2 << 20
_PLACE = 24
_KEY = ["doc_id", "th"]


def _byte_values() -> np.ndarray:
    x = np.arange(1, 257, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = _byte_values()


def run_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes, from those of its halves."""
    power, have, at = _VALUE[data], 1, 0
    out, base = None, 0x9E3779B97F4A7C15
    while True:
        if size & have:
            out = power if out is None else out[: len(out) - have if len(out) > have else 0] * np.uint64(pow(base, have, 1 << 64)) + power[at : at + max(0, len(out) - have)]
            at += have
        if 2 * have > size:
            break
        power = power[: max(0, len(power) - have)] * np.uint64(pow(base, have, 1 << 64)) + power[have:]
        have *= 2
    n = max(0, len(data) - size + 1)
    out = out[:n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` successive keys."""
    have = 1
    while 2 * have <= width:
        keys = np.minimum(keys[: len(keys) - have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (width - have)], keys[width - have :])


def pieces_of(data: np.ndarray, starts: np.ndarray, length: int, anchor: int):
    """(string, first byte, size, anchor's hash) of all pieces of the strings in a buffer of less than 2 ** 24 bytes (``starts``: where each begins, and the end)."""
    none = np.zeros(0, "i8")
    if len(data) < length:
        return none, none, none, none.astype("u8")
    h = run_hashes(data, anchor)
    keys = (h & ~np.uint64((1 << _PLACE) - 1)) | np.arange(len(h), dtype="u8")
    at = (least_of(keys, length - anchor + 1) & np.uint64((1 << _PLACE) - 1)).astype("i8")
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    # No window goes beyond its string: the first that would ends the piece before.
    new[starts[:-1][starts[:-1] < len(at)]] = True
    over = starts[1:] - length + 1
    new[over[(over >= 0) & (over < len(at))]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    which = np.searchsorted(starts, first, "right") - 1
    ok = first + length <= starts[which + 1]
    first, last, which = first[ok], last[ok], which[ok]
    return which, first - starts[which], last - first + length, h[at[first]]


def _pieces(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """``texts`` (doc_id, th, base, data: bytes that begin at ``base`` of a text) -> doc_id, th, at, size, a (hash of the anchor), c (hash of the whole piece) of all pieces.

    Long texts are taken in parts that overlap by a window.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int64()), ("size", pa.int32()), ("a", pa.int64()), ("c", pa.int64())])
    most = SLICE_BYTES

    def made(ids, hashes, offsets, strings):
        from xxhash import xxh3_64_intdigest

        raw = b"".join(strings)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype("i8")
        which, first, size, a = pieces_of(np.frombuffer(raw, "u1"), starts, length, anchor)
        at = first + starts[which]
        c = np.fromiter((xxh3_64_intdigest(raw[i:j], 11) for i, j in zip(at.tolist(), (at + size).tolist(), strict=True)), "u8", len(at))
        pick = pa.array(which)
        cols = [pa.array(ids, pa.int64()).take(pick), pa.array(hashes, pa.int64()).take(pick), pa.array(first + np.array(offsets, "i8")[which]), pa.array(size.astype("i4")), pa.array(a.view("i8")), pa.array(c.view("i8"))]
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def run(batches):
        for b in slices(batches, rows=2000, most=most):
            held, total = [], 0
            for d, h, base, t in zip(*(b[x].to_pylist() for x in ("doc_id", "th", "base", "data")), strict=True):
                n = len(t)
                for off in range(0, max(0, n - length + 1), most):
                    part = t[off : off + most + length - 1]
                    held.append((d, h, base + off, part))
                    total += len(part)
                    if total >= most:
                        yield made(*zip(*held, strict=True))
                        held, total = [], 0
            if held:
                yield made(*zip(*held, strict=True))

    return texts.select(*_KEY, "base", "data").mapInArrow(run, "doc_id long, th long, at long, size int, a long, c long")


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def _with_bytes(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """``reps`` (a, c, doc_id, th, at, size) with their bytes out of ``texts`` (doc_id, th, base, data)."""
    schema = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int64()), ("data", pa.binary())])
    need = reps.groupBy(*_KEY).agg(F.collect_list(F.struct("at", "size", "a", "c")).alias("need"))
    rows = texts.alias("x").join(need.alias("y"), _same("x", "y")).select("x.*", "y.need")

    def run(batches):
        for b in slices(batches, rows=2000, most=4 << 20):
            for d, h, base, t, need in zip(*(b[x].to_pylist() for x in ("doc_id", "th", "base", "data")), b["need"], strict=True):
                x = need.values.flatten()
                first = x[0].to_numpy() - base
                last = first + x[1].to_numpy()
                # Texts in parts: a piece lies in one of them.
                i = pa.array(np.flatnonzero((first >= 0) & (last <= len(t))))
                first, last = first[i], last[i]
                data = pa.array([t[p:q] for p, q in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([x[2].take(i), x[3].take(i), pa.array([d] * len(i), pa.int64()), pa.array([h] * len(i), pa.int64()), x[0].take(i), data], schema=schema)

    return rows.mapInArrow(run, "a long, c long, doc_id long, th long, at long, data binary")


_SPAN = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_SPAN_DDL = "doc_id long, th long, start long, end long"


def _shard_spans(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows among pieces dealt by anchor, one shard's suffix array at a time."""
    shard_bytes = SHARD_BYTES

    def solve(held):
        ids, hashes, at, data = zip(*held, strict=True)
        which, first = repeated_starts(list(data), length)
        if not len(which):
            return None
        # Successive windows make one span.
        new = np.concatenate(([True], (np.diff(which) != 0) | (np.diff(first) != 1)))
        i = np.flatnonzero(new)
        j = np.append(i[1:], len(which)) - 1
        base = np.array(at, "i8")[which[i]]
        pick = pa.array(which[i])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pick), pa.array(hashes, pa.int64()).take(pick), pa.array(base + first[i]), pa.array(base + first[j] + length)], schema=_SPAN)

    def run(batches):
        held, total, last = [], 0, None
        for b in batches:
            for a, c, d, h, at, data in zip(*(b[x].to_pylist() for x in ("a", "c", "doc_id", "th", "at", "data")), strict=True):
                if (a, c) == last:  # the same piece of a row that repeats
                    continue
                if total >= shard_bytes and a != last[0]:
                    if (out := solve(held)) is not None:
                        yield out
                    held, total = [], 0
                last = (a, c)
                held.append((d, h, at, data))
                total += len(data)
        if held and (out := solve(held)) is not None:
            yield out

    return pieces.repartition("a").sortWithinPartitions("a", "c").mapInArrow(run, _SPAN_DDL)


def longer_anchor(length: int, anchor: int) -> int:
    """The next anchor's size: a quarter of the places are left, and at last one."""
    return length if length - anchor <= 8 else length - (length - anchor) // 4


def repeated_spans(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """``texts`` (doc_id, th, base, data: bytes that begin at ``base`` of a text) -> doc_id, th, start, end: spans that together cover every ``length`` bytes that also start elsewhere. Spans may overlap.

    Rows of one (doc_id, th, base) are copies of each other. Joins are by shuffle at any size: all sides grow with the texts.
    """
    found = written(_pieces(texts, length, anchor), "pieces")
    counts = found.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1")
    # Written, so that the join shuffles both sides and AQE can split a hot anchor.
    counts = written(counts.select("a", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    hits = written(found.join(counts, "a"), "hits")
    whole = [*_KEY, F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end")]
    out, mixed = hits.where("not mixed").select(*whole), hits.where("mixed")
    if anchor == length:  # pieces are windows: equal anchors, equal pieces
        return out.unionByName(mixed.select(*whole))
    reps = mixed.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "at", "size")).alias("r"))
    reps = written(reps.select("a", "c", "n", "r.*"), "different-pieces")
    out = out.unionByName(mixed.join(reps.where("n > 1").select("a", "c"), ["a", "c"], "left_semi").select(*whole))
    hot = written(reps.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot_pieces).select("a"), "hot-anchors")
    pieces = written(_with_bytes(texts, reps), "piece-bytes")
    if hot.isEmpty():
        return out.unionByName(_shard_spans(pieces, length))
    hot = small(hot)
    out = out.unionByName(_shard_spans(pieces.join(hot, "a", "left_anti"), length))
    again = pieces.join(hot, "a", "left_semi").groupBy("a", "c").agg(F.first(F.struct("doc_id", "th", F.col("at").alias("base"), "data")).alias("x")).select("x.*")
    return out.unionByName(repeated_spans(written(again, "hot-pieces"), length, longer_anchor(length, anchor), hot_pieces))


def drop_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """``docs`` (with doc_id and text) -> the same columns and n_bytes, n_removed, spans, kept.

    ``kept`` is the text's UTF-8 bytes without those covered by a string of ``length`` bytes that starts
    at another place too, in the same text or another; ``spans`` are the maximal removed runs (start,
    end). Strings are judged on the input. Null is an empty text; texts under ``length`` bytes stay
    whole. Each row is a document of its own, also where doc_ids repeat or are null, so rows of one
    text of ``length`` bytes or more lose it all. Columns of the new names are replaced, others go
    through. doc_id is an integer or null.
    """
    if not 0 < anchor <= length:
        raise ValueError("anchor must be from 1 to length")
    if (made := apart(docs, lambda d: drop_repeats(d, length, anchor, hot_pieces))) is not None:
        return made
    docs = docs.drop("n_bytes", "n_removed", "spans", "kept")
    texts = docs.where(F.octet_length("text") >= length).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.lit(0).cast("long").alias("base"), F.col("text").cast("binary").alias("data"))
    spans = repeated_spans(texts, length, anchor, hot_pieces).groupBy(*_KEY).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    spans = written(spans.withColumnsRenamed({"doc_id": "_id", "th": "_th"}), "spans")
    rows = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left").drop("_id", "_th")
    cols = docs.columns
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["n_bytes long", "n_removed long", "spans array<struct<start:bigint,end:bigint>>", "kept binary"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in slices(batches, most=4 << 20):
            sizes, gone, runs, kept = [], [], [], []
            for t, s in zip(b["text"].cast(pa.binary()).to_pylist(), b["_spans"], strict=True):
                t = t or b""
                out, left, at = [], [], 0
                if s.is_valid:
                    start, end = (x.to_numpy() for x in s.values.flatten())
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], np.maximum.accumulate(end[order])
                    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
                    for i, j in zip(start[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist(), strict=True):
                        out.append({"start": i, "end": j})
                        left.append(t[at:i])
                        at = j
                left.append(t[at:])
                sizes.append(len(t))
                runs.append(out)
                kept.append(b"".join(left))
                gone.append(len(t) - len(kept[-1]))
            arrays = [*(b[c] for c in cols), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*cols, "n_bytes", "n_removed", "spans", "kept"])

    return rows.mapInArrow(run, ", ".join(types))


def op11_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = drop_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as pairs of hex digits; every window is counted by its digest.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT r, x, unnest(range(length(x) // 2 - 199)) AS i FROM d WHERE length(x) >= 400)),
hit AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
runs AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM
  (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM hit)) GROUP BY r, g),
s AS (SELECT r, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a)::BIGINT AS gone FROM runs GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(len(a), 0) AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN x ELSE array_to_string([substr(x, 2 * e[1] + 1, 2 * (e[2] - e[1])) FOR e IN list_zip(list_concat([0], b), list_concat(a, [length(x) // 2]))], '') END)) AS kept_sha256
FROM d LEFT JOIN s ON d.r = s.r
"""
