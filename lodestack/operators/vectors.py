"""Vectors in blocks: nearest neighbours by matrix products, and near pairs by banded hyperplane keys (T-1, J03, T-9)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is broadcast at once: bytes of query vectors, and of the k best that a task keeps for each.
QUERY_BYTES, KEPT_BYTES = 32 << 20, 32 << 20
#: Distances in a tile of a product.
TILE = 1 << 20
#: Probability that a near pair right at the threshold is missed by all bands, and by the sketch.
MISS = 1e-7
SKETCH = 128
#: Banded keys are used where unrelated vectors meet in less than this share of pairs; else all blocks are multiplied.
MOST_MET = 0.02
BLOCK_ROWS = 1024


def matrix(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``col`` that are vectors of ``size``, and these as a matrix of doubles (a null entry: NaN)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    at = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(col), size), False).to_numpy(zero_copy_only=False)))
    flat = col.take(pa.array(at)).flatten()
    return at, np.asarray(flat.to_numpy(zero_copy_only=False), "f8").reshape(len(at), size)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; a zero row becomes NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Best:
    """The k nearest of each query so far: distances and ids, ties by id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.found: list[list] = [[] for _ in queries]
        self.worst = np.full(len(queries), np.inf)

    def add(self, ids: list, x: np.ndarray) -> None:
        step = max(1, TILE // max(1, len(x)))
        for first in range(0, len(self.q), step):
            q = self.q[first : first + step]
            d = 1 - q @ x.T
            np.nan_to_num(d, copy=False, nan=np.inf)
            # Products of blocks differ in the last bits by where a row stands: what is close is worked out alone.
            for i in np.flatnonzero(d.min(axis=1) <= self.worst[first : first + step] + 1e-9):
                row = d[i]
                bound = np.partition(row, self.k - 1)[self.k - 1] if len(row) > self.k else np.inf
                near = np.flatnonzero(row <= min(bound, self.worst[first + i]) + 1e-9)
                exact = 1 - (x[near] * q[i]).sum(axis=1)
                got = [(e, ids[j]) for e, j in zip(np.nan_to_num(exact, nan=np.inf).tolist(), near.tolist(), strict=True)]
                kept = sorted(self.found[first + i] + got, key=lambda r: (r[0], r[1] is None, r[1]))[: self.k]
                self.found[first + i] = kept
                if len(kept) == self.k:
                    self.worst[first + i] = kept[-1][0]


def nearest(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """chunks (chunk_id, embedding), queries (query_id, q) -> query_id, chunk_id, distance: of each task, the k nearest of each query.

    Query vectors are broadcast in blocks of bounded bytes; a task multiplies its rows with a block at
    once and passes on k rows a query, so no row is made for a pair that cannot be among the first k.
    """
    spark, ident = chunks.sparkSession, chunks.schema["chunk_id"].dataType
    asked = queries.where("q is not null").select("query_id", F.col("q").cast("array<double>").alias("q"))
    n, total = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("q")), F.lit(0))).first()
    blocks = max(1, -(-8 * total // QUERY_BYTES), -(-64 * n * k // KEPT_BYTES))
    rows = chunks.where("embedding is not null").select("chunk_id", "embedding")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {ident.simpleString()}, distance double"
    out = None
    for b in range(blocks):
        held = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)) == b)
        by_size: dict[int, tuple[list, list]] = {}
        for r in held.collect():  # at most QUERY_BYTES
            x = by_size.setdefault(len(r.q), ([], []))
            x[0].append(r.query_id)
            x[1].append(r.q)
        shared = spark.sparkContext.broadcast({s: (x[0], unit_rows(np.array(x[1], "f8").reshape(len(x[0]), s))) for s, x in by_size.items() if s})

        def run(batches, shared=shared, k=k):
            best = {s: Best(q, k) for s, (_, q) in shared.value.items()}
            first = None
            for batch in batches:
                first = first or batch
                for s, have in best.items():
                    at, x = matrix(batch["embedding"], s)
                    for i in range(0, len(at), 4096):
                        have.add(batch["chunk_id"].take(pa.array(at[i : i + 4096])).to_pylist(), unit_rows(x[i : i + 4096]))
            for s, have in best.items():
                ids = shared.value[s][0]
                flat = [(q, c, None if d == math.inf else d) for q, hits in zip(ids, have.found, strict=True) for d, c in hits]
                if flat:
                    q, c, d = zip(*flat, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c, first.schema.field("chunk_id").type), pa.array(d, pa.float64())], names=["query_id", "chunk_id", "distance"])

        made = rows.mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
    return out


# ---------------------------------------------------------------- near pairs


def band_plan(below: float, n: int, miss: float = MISS) -> tuple[int, int, float] | None:
    """(bits a band, bands, share of unrelated pairs met) for cosine distances under ``below`` among n vectors; None if too many would meet.

    Two vectors at angle t differ in a hyperplane's sign with probability t / pi; a band meets them if at
    most one of its signs differs. Bits are chosen for the fewest rows and candidates together.
    """
    x = math.acos(max(-1.0, 1 - below)) / math.pi
    plans = []
    for bits in range(8, 49):
        p = (1 - x) ** bits + bits * x * (1 - x) ** (bits - 1)
        bands = max(1, math.ceil(math.log(miss) / math.log1p(-p))) if p < 1 else 1
        met = bands * (bits + 1) / 2**bits
        if met <= MOST_MET and bands <= 512:
            plans.append((n * bands * (bits + 2) + met * n * n / 2, bits, bands, met))
    return min(plans)[1:] if plans else None


def _sketch_bound(below: float, bits: int, miss: float = MISS) -> int:
    """The most of ``bits`` random signs in which two vectors under the distance differ, but for a probability of ``miss``."""
    x = math.acos(max(-1.0, 1 - below)) / math.pi
    term, below_it = (1 - x) ** bits, 0.0
    for k in range(bits + 1):
        below_it += term
        if 1 - below_it < miss:
            return k
        term *= (bits - k) / (k + 1) * x / (1 - x)
    return bits


def vector_classes(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """id, rep, u: each vector that is not null or zero, in doubles, with the least id of those equal to it. One aggregate, no class is gathered."""
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("u"))
    v = v.where(F.exists("u", lambda e: e != 0))
    reps = v.groupBy("u").agg(F.min("id").alias("rep"))
    return v.join(reps, "u").select("id", "rep", "u")


def _keys(reps: DataFrame, size: int, bits: int, bands: int) -> DataFrame:
    """id, keys (a number of ``bits`` signs for each band), s1, s2 (signs of SKETCH more hyperplanes)."""
    kind = reps.schema["id"].dataType.simpleString()

    def run(batches):
        planes = np.random.default_rng(20).standard_normal((bands * bits + SKETCH, size))
        weights = (1 << np.arange(bits, dtype="i8"))[None, None, :]
        for b in batches:
            at, x = matrix(b["u"], size)
            signs = (x @ planes.T) > 0
            keys = (signs[:, : bands * bits].reshape(len(at), bands, bits) * weights).sum(axis=2)
            sketch = np.packbits(signs[:, bands * bits :], axis=1).view("<i8").reshape(len(at), 2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * bands + 1, bands, dtype="i4")), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at)), lists, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], names=["id", "keys", "s1", "s2"])

    return reps.select("id", "u").mapInArrow(run, f"id {kind}, keys array<bigint>, s1 bigint, s2 bigint")


def met_pairs(reps: DataFrame, size: int, below: float, bits: int, bands: int) -> DataFrame:
    """a < b: vectors (id, u) that meet in a band (at most one sign differs). Keys and ids are joined; vectors stay where they are."""
    k = _keys(reps, size, bits, bands)
    left = k.select(F.col("id").alias("a"), F.col("s1").alias("s1"), F.col("s2").alias("s2"), F.posexplode("keys").alias("band", "key"))
    probes = F.expr(f"concat(array(key), transform(sequence(0, {bits - 1}), i -> key ^ shiftleft(1L, i)))")
    right = k.select(F.col("id").alias("b"), F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.posexplode("keys").alias("band", "key"))
    right = right.select("b", "t1", "t2", "band", F.explode(probes).alias("key"))
    return left.join(right, ["band", "key"]).where("a < b").select("a", "b", F.expr("bit_count(s1 ^ t1) + bit_count(s2 ^ t2)").alias("signs"))


def _decided(pairs: DataFrame, reps: DataFrame, below: float) -> DataFrame:
    """a, b, distance of the pairs that are near by their whole vectors."""
    kind = pairs.schema["a"].dataType.simpleString()
    x, y = reps.select(F.col("id").alias("a"), F.col("u").alias("ua")), reps.select(F.col("id").alias("b"), F.col("u").alias("ub"))

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            size = len(b["ua"][0])
            (_, u), (_, v) = matrix(b["ua"], size), matrix(b["ub"], size)
            d = 1 - (unit_rows(u) * unit_rows(v)).sum(axis=1)
            on = pa.array(np.flatnonzero(d < below))
            yield pa.RecordBatch.from_arrays([b["a"].take(on), b["b"].take(on), pa.array(d).take(on)], names=["a", "b", "distance"])

    return pairs.join(x, "a").join(y, "b").select("a", "b", "ua", "ub").mapInArrow(run, f"a {kind}, b {kind}, distance double")


def block_pairs(reps: DataFrame, size: int, below: float, n: int) -> DataFrame:
    """a < b, distance of all pairs under the distance, exactly: blocks of rows are multiplied with one another, a pair of blocks in a task."""
    kind = reps.schema["id"].dataType.simpleString()
    blocks = max(1, -(-n // BLOCK_ROWS))
    rows = reps.select("id", "u", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("i"))
    packed = rows.groupBy("i").agg(F.collect_list(F.struct("id", "u")).alias("xs"))  # about BLOCK_ROWS each
    left = packed.select("xs", F.explode(F.expr(f"sequence(i, {blocks - 1}L)")).alias("j"), "i")
    both = left.join(packed.select(F.col("i").alias("j"), F.col("xs").alias("ys")), "j").select("i", "j", "xs", "ys")

    def run(batches):
        for b in batches:
            for i, j, xs, ys in zip(b["i"].to_pylist(), b["j"].to_pylist(), b["xs"], b["ys"], strict=True):
                (ia, ua), (ib, ub) = (x.values.flatten() for x in (xs, ys))
                (pa_, x), (pb, y) = matrix(ua, size), matrix(ub, size)
                x, y = unit_rows(x), unit_rows(y)
                p, q = np.nonzero(1 - x @ y.T < below + 1e-9)
                d = 1 - (x[p] * y[q]).sum(axis=1)
                a, c = ia.take(pa.array(pa_[p])), ib.take(pa.array(pb[q]))
                less = np.asarray(pc.less(a, c).to_numpy(zero_copy_only=False))
                on = (d < below) & (less if i == j else np.ones(len(d), bool))
                lo, hi = pc.if_else(pa.array(less), a, c), pc.if_else(pa.array(less), c, a)
                pick = pa.array(np.flatnonzero(on))
                yield pa.RecordBatch.from_arrays([lo.take(pick), hi.take(pick), pa.array(d).take(pick)], names=["a", "b", "distance"])

    return both.mapInArrow(run, f"a {kind}, b {kind}, distance double")


def near_representatives(reps: DataFrame, below: float, miss: float = MISS, exact: bool = False) -> DataFrame:
    """``reps`` (id, u: different vectors of one size) -> a < b, distance: all pairs under the distance, each once.

    Pairs meet by bands (see ``band_plan``), are thinned by a sketch of SKETCH signs, and the whole
    vectors decide. A pair at the threshold is missed with a probability of about twice ``miss``, a
    nearer one with less. Where the distance is so wide that unrelated vectors would meet too often, or
    with ``exact``, all blocks are multiplied.
    """
    n, least, most = reps.agg(F.count(F.lit(1)), F.min(F.size("u")), F.max(F.size("u"))).first()
    if n and least != most:
        raise ValueError("vectors have several sizes")
    plan = None if exact or not n else band_plan(below, n, miss)
    if plan is None:
        return block_pairs(reps, most or 1, below, n)
    bits, bands, _ = plan
    met = met_pairs(reps, most, below, bits, bands).where(F.col("signs") <= _sketch_bound(below, SKETCH, miss))
    return _decided(met.select("a", "b").distinct(), reps, below)


def near_pairs(vectors: DataFrame, ident: str, vector: str, below: float, miss: float = MISS, exact: bool = False) -> DataFrame:
    """All pairs a < b with cosine distance below ``below`` (strict), as a, b, distance.

    Equal vectors are joined once, by their least id, and their pairs written out after; with very many
    copies use ``vector_classes`` and ``near_representatives`` themselves. Null and zero vectors have no
    pairs; all others must have one size.
    """
    classes = vector_classes(vectors, ident, vector)
    reps = classes.where("id = rep").select("id", "u").dropDuplicates(["id"])
    pairs = near_representatives(reps, below, miss, exact)
    a, b = classes.select(F.col("rep").alias("a"), F.col("id").alias("ia")), classes.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    across = pairs.join(a, "a").join(b, "b").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "distance")
    if below <= 0:
        return across
    same = a.join(b.withColumnRenamed("b", "a"), "a").where("ia < ib").select(F.col("ia").alias("a"), F.col("ib").alias("b"), F.lit(0.0).alias("distance"))
    return across.unionByName(same)
