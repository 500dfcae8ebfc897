"""Operator 9: line dedup with two Bloom filters.

Every task hashes the distinct line keys of each document (128 bits). Keys that it meets more than once
are repeats already and go on as counts. The others are dealt by range of hash, with their place. The
task of a range holds its own pair of bit arrays, seen once and seen twice, of a fixed size at any size
of the input; they never leave the task. A key in the second array is a suspect. Only suspected repeats
go on, as hashes and counts, to be confirmed exactly and to find the first place; texts stay where they
are. The filters err on one side only: a line that is found twice is always a suspect, so results are
exact at any load.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import apart, by_shuffle, read, slices, written

WHITE = b" \t\n\x0b\x0c\r"
#: Lines of a range, and bits of its arrays for each line; there are LEAST_RANGES ranges at least.
RANGE_LINES, LINE_BITS, LEAST_RANGES = 1 << 20, 16, 64
#: Line keys to drop (16 bytes each) are broadcast up to this many; more are joined by a shuffle.
KEYS = 300_000
#: Lines that a task gathers before it tells repeats from others.
FLUSH = 500_000


def keys_of(text: str | None) -> list[bytes]:
    """Each line's key: ASCII white space stripped, A-Z lower-cased (bytes.lower and strip touch ASCII only)."""
    return [x.strip(WHITE) for x in (text or "").encode().lower().split(b"\n")]


def _digests(keys) -> list[bytes]:
    from xxhash import xxh3_128_digest

    return [xxh3_128_digest(k) for k in keys]


class Ranges:
    """How 64-bit hashes are dealt to ranges, and to the bits of a range's arrays."""

    def __init__(self, lines: int):
        self.log_n = (max(LEAST_RANGES, -(-lines // RANGE_LINES)) - 1).bit_length()
        self.n = 1 << self.log_n
        self.log_bits = max(10, (max(1, LINE_BITS * lines // self.n) - 1).bit_length())

    def of(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.log_n)).astype("i8")

    def bits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (h & np.uint64((1 << self.log_bits) - 1)).astype("i8"), (mixed >> np.uint64(64 - self.log_bits)).astype("i8")

    def has(self, array: np.ndarray, h: np.ndarray, first: np.ndarray | int = 0) -> np.ndarray:
        """Whether both bits of each hash are set; ``first``: where its range begins in the array, in bits."""
        p, q = (x + first for x in self.bits(h))
        return ((array[p >> 3] >> (p & 7)) & (array[q >> 3] >> (q & 7)) & 1).astype(bool)

    def add(self, array: np.ndarray, h: np.ndarray) -> None:
        for b in self.bits(h):
            np.bitwise_or.at(array, b >> 3, (1 << (b & 7)).astype("u1"))


def _first_lines(text: str | None) -> dict[bytes, int]:
    """The place of the first line of each key that is not empty."""
    first: dict[bytes, int] = {}
    for i, k in enumerate(keys_of(text)):
        if k:
            first.setdefault(k, i)
    return first


_LINE = pa.schema([("range", pa.int32()), ("h", pa.binary()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("lines", pa.list_(pa.int32()))])
_LINE_DDL = "range int, h binary, n long, ids array<bigint>, lines array<int>"


def _least(ids: pa.Array, doc: np.ndarray, lines: np.ndarray) -> tuple[int | None, int]:
    """The first place of one key: of the least doc_id (null before all), then the least line."""
    own = ids.take(pa.array(doc))
    missing = np.asarray(own.is_null().to_numpy(zero_copy_only=False))
    if missing.any():
        return None, int(lines[missing].min())
    at = own.to_numpy()
    return int(at.min()), int(lines[at == at.min()].min())


def line_rows(docs: DataFrame, ranges: Ranges) -> DataFrame:
    """Hashes of line keys (16 bytes each, joined) by range. Rows with n = 0 hold keys that a task met once, and their places; rows with n > 0 one key that it met n times, and its first place."""
    most = FLUSH

    def flush(held):
        """``held``: (doc_id, hashes, places) of documents. Arrays from here on: 28 bytes a line."""
        h = np.frombuffer(b"".join([x for _, x, _ in held]), "<u8").reshape(-1, 2)
        lines = np.concatenate([x for _, _, x in held])
        doc = np.repeat(np.arange(len(held)), [len(x) for _, _, x in held])
        ids = pa.array([d for d, _, _ in held], pa.int64())
        order = np.lexsort((h[:, 1], h[:, 0]))
        h, lines, doc = h[order], lines[order], doc[order]
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]).any(axis=1))))
        times = np.diff(np.append(new, len(h)))
        out = []
        for i, n in zip(new[times > 1].tolist(), times[times > 1].tolist(), strict=True):
            d, line = _least(ids, doc[i : i + n], lines[i : i + n])
            out.append((int(ranges.of(h[i, :1])[0]), h[i].tobytes(), n, [d], [line]))
        counted = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [()] * 5, _LINE, strict=True)], schema=_LINE)
        once = new[times == 1]
        h, lines, doc = h[once], lines[once], doc[once]
        cuts = np.searchsorted(ranges.of(h[:, 0]), np.arange(ranges.n + 1))  # ranges are the leading bits, so they are in order
        full = np.flatnonzero(np.diff(cuts))
        ends = pa.array(np.append(cuts[full], len(h)).astype("i4"))
        parts = [h[cuts[r] : cuts[r + 1]].tobytes() for r in full.tolist()]
        lists = [pa.ListArray.from_arrays(ends, x) for x in (ids.take(pa.array(doc)), pa.array(lines))]
        return counted, pa.RecordBatch.from_arrays([pa.array(full.astype("i4")), pa.array(parts, pa.binary()), pa.array(np.zeros(len(full), "i8")), *lists], schema=_LINE)

    def run(batches):
        held, n = [], 0
        for b in slices(batches):
            for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                first = _first_lines(t)
                if first:
                    held.append((d, b"".join(_digests(first)), np.fromiter(first.values(), "i4", len(first))))
                    n += len(first)
                if n >= most:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _LINE_DDL)


def suspects(rows: DataFrame, ranges: Ranges) -> DataFrame:
    """h, n, doc_id, line of suspected repeats: what tasks counted, and of the others the keys in a range's second array, one by one.

    Keys that some task counted enter the arrays too (as seen twice), so that their single copies are suspects.
    """
    schema = pa.schema([("h", pa.binary()), ("n", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32())])
    counted = rows.where("n > 0").select("h", "n", F.col("ids")[0].alias("doc_id"), F.col("lines")[0].alias("line"))
    # A counted key enters its range once for each task that met it often; its copies do not.
    seen = rows.where("n > 0").select("range", "h", "n", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("array<int>").alias("lines"))

    def run(batches):
        now, held = -1, []
        once = twice = np.zeros(0, "u1")

        def finish():
            h = np.concatenate([x for x, _, _ in held])
            on = np.flatnonzero(ranges.has(twice, h[:, 0]))
            ids, lines = (pa.concat_arrays([x[i] for x in held]).take(pa.array(on)) for i in (1, 2))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in h[on]], pa.binary()), pa.array(np.ones(len(on), "i8")), ids, lines], schema=schema)

        for b in batches:
            for r, h, n, ids, lines in zip(b["range"].to_pylist(), b["h"].to_pylist(), b["n"].to_pylist(), b["ids"], b["lines"], strict=True):
                if r != now:
                    if held:
                        yield finish()
                    now, held = r, []
                    once, twice = (np.zeros((1 << ranges.log_bits) // 8, "u1") for _ in range(2))
                h = np.frombuffer(h, "<u8").reshape(-1, 2)
                if n:
                    ranges.add(twice, h[:, 0])
                    continue
                ranges.add(twice, h[ranges.has(once, h[:, 0]), 0])
                ranges.add(once, h[:, 0])
                held.append((h, ids.values, lines.values))
        if held:
            yield finish()

    dealt = rows.where("n = 0").unionByName(seen).repartition(ranges.n, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, "h binary, n long, doc_id long, line int").unionByName(counted)


def _dropped_places(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """_id, _drop: the keys to drop in each document (with their first places), met by a join of hashes."""
    schema = pa.schema([("_id", pa.int64()), ("h", pa.binary())])

    def run(batches):
        for b in slices(batches):
            for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                h = _digests(_first_lines(t))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(h), pa.int64()), pa.array(h, pa.binary())], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "_id long, h binary")
    return own.join(by_shuffle(dropped), "h").groupBy("_id").agg(F.collect_set(F.struct("h", F.col("first.doc_id").alias("d"), F.col("first.line").alias("line"))).alias("_drop"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, broadcast_keys: int = KEYS) -> DataFrame:
    """``docs`` (with doc_id and text) -> the same columns with text rewritten, and n_lines, n_dropped.

    A line whose key (see keys_of) is found in at least ``min_docs`` documents is dropped everywhere;
    with ``keep_first`` its first line in the document of the smallest doc_id stays. Each row counts
    as a document, also where doc_ids repeat. Lines with an empty key always stay. Null text is one
    empty line and comes out as empty text. Other columns go through as they are (columns named
    n_lines or n_dropped are replaced). doc_id is an integer or null.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    if (made := apart(docs, lambda d: dedup_lines(d, min_docs, keep_first, broadcast_keys))) is not None:
        return made
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 1
    ranges = Ranges(int(lines))
    found = suspects(written(line_rows(docs, ranges), "line-hashes"), ranges)
    first = F.min(F.struct("doc_id", "line")).alias("first")
    dropped = written(found.groupBy("h").agg(F.sum("n").alias("n"), first).where(F.col("n") >= min_docs).drop("n"), "lines")
    cols = docs.columns
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["n_lines long", "n_dropped long"]
    shared = None
    if dropped.count() <= broadcast_keys:
        shared = spark.sparkContext.broadcast({bytes(r.h): (r.d, r.line) for r in dropped.select("h", F.col("first.doc_id").alias("d"), F.col("first.line").alias("line")).collect()})
        rows = docs
    else:
        own = _dropped_places(docs, dropped)
        rows = docs.join(own, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left").drop("_id")

    def rewrite(batches):
        for b in slices(batches):
            texts, totals, lost = [], [], []
            drops = [shared.value] * b.num_rows if shared else [{x["h"]: (x["d"], x["line"]) for x in r or []} for r in b["_drop"].to_pylist()]
            for d, t, drop in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), drops, strict=True):
                raw = (t or "").split("\n")
                keys = _digests(keys_of(t)) if drop else raw
                kept = [x for i, (x, k) in enumerate(zip(raw, keys, strict=True)) if not drop or k not in drop or (keep_first and drop[k] == (d, i))]
                texts.append("\n".join(kept))
                totals.append(len(raw))
                lost.append(len(raw) - len(kept))
            arrays = [pa.array(texts, b.schema.field(c).type) if c == "text" else b[c] for c in cols]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(totals, pa.int64()), pa.array(lost, pa.int64())], names=[*cols, "n_lines", "n_dropped"])

    return rows.mapInArrow(rewrite, ", ".join(types))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, p, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS p FROM documents)),
drops AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(drops.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE drops.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN drops ON l.k = drops.k GROUP BY doc_id
"""
