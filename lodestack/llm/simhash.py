"""Operator 8: SimHash near-dedup with the generalised pigeonhole principle.

Fingerprints of 64 bits link at ``tau`` or fewer differing bits. The bits are dealt to ``m``
partitions, correlated bits together. If thresholds T_i of the partitions (-1 or more) sum to
tau - m + 1, two fingerprints within tau agree to within T_i bits in some partition i. Every
fingerprint takes the thresholds for which a dynamic program finds the least cost, from estimates
of how many fingerprints lie within each distance of it in each partition (histograms of all
fingerprints over groups of up to 8 bits, distances of groups taken as independent). It probes
each partition for the values within T_i; what is found is verified. Equal fingerprints are one
row throughout, and each link is found from both its ends but kept once.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import by_shuffle, read, slices, small, written
from lodestack.llm.components import connected_components

BITS = 64
SEED = 42
#: Cost of sending one probe, in verified candidates.
PROBE = 0.5
#: Candidates met for each that even bits would give.
UNEVEN = 2.0
#: The largest radius that a fingerprint probes in a partition.
REACH = 3


# ---------------------------------------------------------------- fingerprints


def shingles(text: str | None, k: int) -> list[bytes]:
    """A-Z lower-cased, words are runs of anything but ASCII white space; k words joined by blanks, repeats included."""
    words = (text or "").encode().lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    joined, ends, at = b" ".join(words), [], 0
    for w in words:
        at += len(w)
        ends.append(at)
        at += 1
    starts = [0] + [e + 1 for e in ends[:-k]]
    return [joined[s:e] for s, e in zip(starts, ends[k - 1 :], strict=True)]


def simhash(parts) -> int:
    """Bit i is set if it is set in over half of the parts' XXH64 hashes; 0 without parts."""
    from xxhash import xxh64_digest

    if not parts:
        return 0
    raw = np.frombuffer(b"".join([xxh64_digest(p, SEED) for p in parts]), "u1").reshape(-1, 8)
    ones = np.unpackbits(raw, axis=1).sum(0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def wide_simhash(parts) -> tuple[int, int]:
    """A SimHash of 128 bits, as two numbers of 64."""
    from xxhash import xxh128_digest

    if not parts:
        return 0, 0
    raw = np.frombuffer(b"".join([xxh128_digest(p, SEED) for p in parts]), "u1").reshape(-1, 16)
    ones = np.unpackbits(raw, axis=1).sum(0, dtype="i8")
    out = np.packbits(2 * ones > len(raw)).tobytes()
    return int.from_bytes(out[:8], "big"), int.from_bytes(out[8:], "big")


def fingerprints(docs: DataFrame, words: int = 4, distinct: bool = False, wide_words: int = 0) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, fp (long; the 64 bits), s0, s1. ``distinct``: each shingle counts once. Null text is empty.

    s0 and s1 are the wide fingerprint over distinct runs of ``wide_words`` words (0 where that is 0).
    """
    id_type = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("fp", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64())])

    def run(batches):
        for b in slices(batches):
            texts = b["text"].to_pylist()
            fps = [simhash(set(s) if distinct else s) for s in (shingles(t, words) for t in texts)]
            wide = [wide_simhash(set(shingles(t, wide_words))) for t in texts] if wide_words else [(0, 0)] * len(texts)
            signed = lambda x: pa.array(np.array(x, "u8").view("i8"))
            yield pa.RecordBatch.from_arrays([b["doc_id"], signed(fps), signed([x for x, _ in wide]), signed([x for _, x in wide])], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type.simpleString()}, fp long, s0 long, s1 long")


# ---------------------------------------------------------------- partitions and thresholds


def _sums(fps: DataFrame, count) -> dict[int, int]:
    """Sum over all fingerprints of the counts that ``count`` gives for an array of them: (place, count) a task, summed by place."""
    schema = pa.schema([("at", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = 0
        for b in batches:
            total = total + count(b["fp"].to_numpy(zero_copy_only=False).view("u8"))
        if not isinstance(total, int):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(total[at].astype("i8"))], schema=schema)

    rows = fps.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    return {r["at"]: r["n"] for r in rows.collect()}  # BITS * BITS or BITS * 32 places at most


def bit_groups(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Deal the bits to m partitions of equal size (to within 1), correlated ones together.

    ``together[i, j]``: fingerprints with bits i and j set. Greedy: a partition starts with the bit
    left that is most correlated with any other, and takes the bit most correlated with its own.
    """
    p = np.diag(together) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(1, n) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for g in range(m):
        size = (BITS - sum(map(len, groups)) + (m - g) - 1) // (m - g)
        mine: list[int] = []
        while len(mine) < size:
            rest = sorted(left)
            gain = corr[np.ix_(rest, mine)].sum(1) if mine else corr[np.ix_(rest, rest)].max(1)
            best = rest[int(np.argmax(gain))]
            mine.append(best)
            left.remove(best)
        groups.append(sorted(mine))
    return groups


def _compact(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), "i8")
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype("i8") << k
    return out


def _chunks(group: list[int]) -> list[list[int]]:
    n = -(-len(group) // 8)
    return [group[i::n] for i in range(n)]


class Estimator:
    """For a fingerprint: about how many fingerprints lie within distance t of it in each partition."""

    def __init__(self, groups: list[list[int]], hist: dict[int, int], n: int, most: int):
        self.groups, self.n, self.most = groups, n, most
        self.tables, at = [], 0
        pop = np.array([bin(i).count("1") for i in range(256)])
        for g in groups:
            mine = []
            for bits in _chunks(g):
                size = 1 << len(bits)
                h = np.array([hist.get(at * 256 + v, 0) for v in range(size)], float) / max(1, n)
                dist = pop[np.arange(size)[:, None] ^ np.arange(size)[None, :]]
                mine.append((bits, np.stack([(h[None, :] * (dist == d)).sum(1) for d in range(len(bits) + 1)], 1)))
                at += 1
            self.tables.append(mine)

    @staticmethod
    def histogram(groups: list[list[int]]):
        chunks = [c for g in groups for c in _chunks(g)]

        def count(fps):
            return np.concatenate([np.bincount(_compact(fps, c), minlength=256) for c in chunks])

        return count

    def within(self, fps: np.ndarray) -> np.ndarray:
        """(fingerprints, partitions, most + 1)"""
        out = []
        for mine in self.tables:
            dist = np.ones((len(fps), 1))
            for bits, table in mine:
                p = table[_compact(fps, bits)]
                new = np.zeros((len(fps), min(self.most, dist.shape[1] + p.shape[1] - 2) + 1))
                for i in range(dist.shape[1]):
                    for j in range(p.shape[1]):
                        if i + j <= self.most:
                            new[:, i + j] += dist[:, i] * p[:, j]
                dist = new
            out.append(self.n * np.cumsum(dist, 1))
        return np.stack(out, 1)


def allocate(within: np.ndarray, sizes: list[int], tau: int, held: int) -> np.ndarray:
    """Thresholds (fingerprints, partitions) of least cost that sum to tau - m + 1, each from -1 to REACH + held.

    ``held``: the index holds the values within this distance of each fingerprint, so a probe of
    radius T - held finds all within T. Dynamic program over partitions and the sum so far.
    """
    n, m, _ = within.shape
    goal, most = tau - m + 1, min(tau, REACH + held)
    if m * most < goal:
        raise ValueError("the thresholds cannot reach the sum")
    choices = list(range(-1, most + 1))
    cost = np.stack([[np.zeros(n) if t < 0 else within[:, i, t] + PROBE * sum(math.comb(sizes[i], r) for r in range(max(0, t - held) + 1)) for t in choices] for i in range(m)])
    low, high = -m, m * most
    best = np.full((high - low + 1, n), np.inf)
    best[-low] = 0
    picks = []
    for i in range(m):
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, "i4")
        for c, t in enumerate(choices):
            for s in range(low, high + 1):
                if 0 <= s - t - low < len(best):
                    x = best[s - t - low] + cost[i, c]
                    better = x < new[s - low]
                    new[s - low][better] = x[better]
                    pick[s - low][better] = t
        best = new
        picks.append(pick)
    out, s = np.zeros((n, m), "i4"), np.full(n, goal)
    for i in reversed(range(m)):
        out[:, i] = picks[i][s - low, np.arange(n)]
        s = s - out[:, i]
    return out


def _flips(group: list[int], radius: int) -> np.ndarray:
    """Masks that change up to ``radius`` bits of the group."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(group, r)], "u8")


# ---------------------------------------------------------------- links


def layout(n: int, tau: int) -> tuple[int, int]:
    """(number of partitions, radius that the index holds) of least cost for ``n`` fingerprints.

    For a fingerprint the cost is its index rows, its probes, and UNEVEN times the candidates that
    it would meet if bits were even, with thresholds as equal as they can be. All choices find the same links;
    more fingerprints want fewer and wider partitions.
    """
    best = (math.inf, 2, 0)
    for m in range(2, tau + 2):
        for held in (0, 1):
            goal, w = tau - m + 1, BITS // m
            ts = [goal // m + (i < goal % m) for i in range(m)]
            if max(ts) > REACH + held:
                continue
            ball = lambda r: sum(math.comb(w, k) for k in range(r + 1))
            index, probes = m * ball(held), sum(ball(max(0, t - held)) for t in ts if t >= 0)
            met = sum(n * ball(t) / 2.0**w for t in ts if t >= 0)
            best = min(best, (index + probes + UNEVEN * met, m, held))
    return best[1:]


def _within(tau: int, wide: int | None):
    """Whether fingerprints a and b (with ``wide``, also s0, s1 and t0, t1) are near."""
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau
    if wide is not None:
        near = near & (F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) <= wide)
    return near


def fingerprint_links(fps: DataFrame, tau: int, wide: int | None = None, crowd: int | None = None) -> DataFrame:
    """``fps`` (written; column fp, distinct) -> a, b (a < b): all pairs within ``tau`` bits, each once.

    With ``wide``, pairs must also lie within so many bits of their wide fingerprints (columns s0
    and s1, of 128 bits), which is decided where pairs meet, before they are rows. With ``crowd``, for
    callers that find what is left in another way: where more than so many fingerprints have one value
    in a partition, each meets the least of them alone, so their pairs are as many as they are.
    """
    n = fps.count()
    m, held = layout(n, tau)

    def together(a):
        x = np.unpackbits(a.byteswap().view("u1").reshape(-1, 8), axis=1)[:, ::-1].astype("f8")
        return (x.T @ x).astype("i8").ravel()

    both = np.zeros(BITS * BITS)
    for at, k in _sums(fps, together).items():
        both[at] = k
    groups = bit_groups(both.reshape(BITS, BITS), n, m)
    estimate = Estimator(groups, _sums(fps, Estimator.histogram(groups)), n, min(tau, REACH + held))
    sizes = [len(g) for g in groups]
    masks = [np.uint64(sum(1 << b for b in g)) for g in groups]
    flips = [{r: _flips(g, r) for r in range(REACH + 1)} for g in groups]
    more = ["s0", "s1"] if wide is not None else []
    schema = pa.schema([("part", pa.int8()), ("value", pa.int64()), ("fp", pa.int64()), ("far", pa.int8()), *((c, pa.int64()) for c in more)])
    ddl = "part tinyint, value long, fp long, far tinyint" + "".join(f", {c} long" for c in more)
    columns = lambda b: [b[c].to_numpy(zero_copy_only=False).view("u8") for c in ("fp", *more)]

    def rows(part, cols, flip, far):
        values = ((cols[0] & masks[part])[:, None] ^ flip[None, :]).ravel()
        fp, *rest = (pa.array(np.repeat(c, len(flip)).view("i8")) for c in cols)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(values), part, "i1")), pa.array(values.view("i8")), fp, pa.array(np.full(len(values), far, "i1")), *rest], schema=schema)

    def probes(batches):
        for b in batches:
            every = columns(b)
            for at in np.array_split(np.arange(b.num_rows), max(1, b.num_rows // 2000)):
                cols = [c[at] for c in every]
                t = allocate(estimate.within(cols[0]), sizes, tau, held)
                for i in range(m):
                    for v in np.unique(t[:, i]):
                        if v >= 0:
                            # far: how far from its own value an index row may be.
                            yield rows(i, [c[t[:, i] == v] for c in cols], flips[i][max(0, int(v) - held)], min(held, int(v)))

    def index(batches):
        for b in batches:
            cols = columns(b)
            for i in range(m):
                yield rows(i, cols, np.zeros(1, "u8"), 0)
                if held:
                    yield rows(i, cols, flips[i][1][1:], 1)

    q = fps.select("fp", *more).mapInArrow(probes, ddl).withColumnsRenamed({"fp": "a", "far": "may"})
    x = fps.select("fp", *more).mapInArrow(index, ddl).withColumnsRenamed({"fp": "b", "far": "is", "s0": "t0", "s1": "t1"})
    x = by_shuffle(x)  # many rows a fingerprint, of which Spark counts one
    near = (F.col("a") < F.col("b")) & (F.col("is") <= F.col("may")) & _within(tau, wide)
    on = (q["part"] == x["part"]) & (q["value"] == x["value"]) & near
    if crowd is None:
        return q.join(x, on).select("a", "b").distinct()
    own = fps.select("fp", *more).withColumn("part", F.explode(F.lit(list(range(m)))))
    mask = F.element_at(F.lit([int(np.array(k, "u8").view("i8")) for k in masks]), F.col("part") + 1)
    own = own.select(F.col("part").cast("tinyint").alias("part"), F.col("fp").bitwiseAND(mask).alias("value"), F.struct("fp", *more).alias("x"))
    full = own.groupBy("part", "value").agg(F.count(F.lit(1)).alias("k"), F.min("x").alias("x")).where(F.col("k") > crowd)
    full = written(full.select("part", "value", F.col("x.fp").alias("b"), *[F.col(f"x.s{i}").alias(f"t{i}") for i in range(len(more))]), "crowds")
    full = small(full)
    led = q.join(full, ["part", "value"]).withColumn("is", F.lit(0)).where((F.col("a") != F.col("b")) & _within(tau, wide))
    led = led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = q.join(full.select("part", "value"), ["part", "value"], "left_anti")
    return rest.join(x, ["part", "value"]).where((F.col("a") < F.col("b")) & (F.col("is") <= F.col("may")) & _within(tau, wide)).select("a", "b").unionByName(led).distinct()


def near_duplicates(docs: DataFrame, tau: int = 4, words: int = 4, verify=None, distinct: bool = False, wide_words: int = 0, wide: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, fp, component_id (the least doc_id reachable, itself included).

    Null, empty and blank texts have fingerprint 0 and link like any other. Rows that repeat a
    doc_id count each; a null doc_id is never a component_id. Extra columns are ignored. ``verify``
    takes (links, fps) and may drop links (a, b) between fingerprints before components are made.
    ``wide_words`` and ``wide``: links must also lie within so many bits of the 128-bit fingerprints
    over runs of so many words.
    """
    fps = written(fingerprints(docs, words, distinct, wide_words), "fps")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "s0", "s1")).alias("s"))
    reps = written(reps.select("fp", "rep", F.col("s.s0").alias("s0"), F.col("s.s1").alias("s1")), "reps")
    links = fingerprint_links(reps, tau, wide)
    parts = written(connected_components(verify(links, fps) if verify else links, "a", "b"), "parts")
    whole = reps.join(parts, reps["fp"] == parts["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = written(whole.join(least, "component").select("fp", "component_id"), "ids")
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_verifier(docs: DataFrame, words: int, least: float):
    """A ``verify`` for near_duplicates: keep links whose first documents share ``least`` of their distinct shingles (Jaccard).

    The shingle sets of linked documents only are made; a link without a doc_id on both sides is dropped.
    """
    schema = pa.schema([("fp", pa.int64()), ("s", pa.list_(pa.int64()))])

    def sets(batches):
        from xxhash import xxh64_intdigest

        for b in slices(batches):
            out = [np.unique(np.array([xxh64_intdigest(x) for x in shingles(t, words)], "u8")).view("i8") for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["fp"], pa.array(out, schema[1].type)], schema=schema)

    def verify(links: DataFrame, fps: DataFrame) -> DataFrame:
        links = written(links, "candidates")
        ends = links.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        need = small(written(ends.join(fps.groupBy("fp").agg(F.min("doc_id").alias("_id")), "fp"), "linked"))
        texts = docs.select("doc_id", "text").join(need, F.col("doc_id") == F.col("_id")).select("fp", "text")
        one = texts.groupBy("fp").agg(F.max("text").alias("text"))  # rows may repeat a doc_id
        s = written(one.mapInArrow(sets, "fp long, s array<long>"), "shingles")
        s = by_shuffle(s)
        pairs = links.join(s.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.where(both >= least * (F.size("sa") + F.size("sb") - both)).select("a", "b")

    return verify
