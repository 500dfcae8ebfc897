"""Operator 13: fill-in-the-middle by a parallel automaton scan.

Units are ``[A-Za-z]+|[^A-Za-z]``. The automaton has two states, outside a word and inside one. A
chunk of bytes is a function of the state it is entered in: the state it leaves, and the units that
begin in it. Functions of neighbouring chunks compose, in any grouping, so chunks are scanned without
knowledge of what stands before them. Texts of up to CHUNK bytes are one chunk and are scanned, many
at a time, where they are. Longer texts are cut into chunks that are dealt over tasks; their functions
are composed for each text, which gives the entry state of each chunk, the number of units and the
chunk that holds each cut; only these chunks are looked at again. A text of 2 GB, the most that a row
holds, has 32,768 functions of a few bytes each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import apart, read, slices, small, written

CHUNK = 1 << 16
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Scan:
    """Chunks in one buffer (``starts``: where each begins, and the end), entered outside a word."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.starts, letter = starts, _LETTER[data]
        self.points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
        unit = (data & 0xC0) != 0x80
        before = np.concatenate(([False], letter[:-1])) if len(data) else letter
        filled = starts[:-1][starts[1:] > starts[:-1]]
        before[filled] = False
        unit &= ~(letter & before)
        self.at = np.flatnonzero(unit)
        self.first = np.searchsorted(self.at, starts)
        #: Units that begin in each chunk; its code points; whether its first and last characters are letters.
        self.units, self.chars = np.diff(self.first), np.diff(self.points[starts])
        ends = np.maximum(starts[1:] - 1, 0)
        some = starts[1:] > starts[:-1]
        self.opens = some & (letter[np.minimum(starts[:-1], max(0, len(data) - 1))] if len(data) else False)
        self.closes = some & (letter[ends] if len(data) else False)

    def chars_before(self, chunk: np.ndarray, unit: np.ndarray, inside: np.ndarray | int = 0) -> np.ndarray:
        """Code points of a chunk before its unit number ``unit``, if it was entered in the state ``inside`` (then a leading word is no unit of its own)."""
        i = self.first[chunk] + unit + (self.opens[chunk] & (np.asarray(inside) == 1))
        at = np.append(self.at, 0)[np.minimum(i, len(self.at))]
        return self.points[np.where(i < self.first[chunk + 1], at, self.starts[chunk + 1])] - self.points[self.starts[chunk]]


def _buffer(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    got = [t or b"" for t in texts]
    return np.frombuffer(b"".join(got), "u1"), np.concatenate(([0], np.cumsum([len(t) for t in got]))).astype("i8")


def _short_cuts(rows: DataFrame) -> DataFrame:
    """``rows`` (text, _h1, _h2 and others; texts of one chunk) with _n, _prefix, _middle."""
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["_n long", "_prefix long", "_middle long"]

    def run(batches):
        for b in slices(batches, rows=5000):
            scan = Scan(*_buffer(b["text"].cast(pa.binary()).to_pylist()))
            i = np.arange(b.num_rows)
            a, c = (np.asarray(b[h].to_numpy(zero_copy_only=False)) % (scan.units + 1) for h in ("_h1", "_h2"))
            p, q = scan.chars_before(i, np.minimum(a, c)), scan.chars_before(i, np.maximum(a, c))
            more = [pa.array(x.astype("i8")) for x in (scan.units, p, q - p)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "_n", "_prefix", "_middle"])

    return rows.mapInArrow(run, ", ".join(types))


def text_chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """_id, _th, chunk, data: the bytes of each text in chunks of about ``size``, cut between code points and dealt over tasks."""
    schema = pa.schema([("_id", rows.schema["_id"].dataType.typeName() == "string" and pa.string() or pa.int64()), ("_th", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary())])

    def cut(batches):
        for b in batches:
            for i in range(b.num_rows):
                d, h, t = b["_id"][i].as_py(), b["_th"][i].as_py(), b["text"][i].as_buffer()
                at, k = 0, 0
                while at < len(t):
                    held, at, k, first = [], at, k, k
                    while at < len(t) and len(held) < 64:
                        end = min(at + size, len(t))
                        while end < len(t) and t[end] & 0xC0 == 0x80:
                            end += 1
                        held.append(t[at:end])
                        at, k = end, k + 1
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(held), schema.field(0).type), pa.array([h] * len(held), pa.int64()), pa.array(range(first, k), pa.int32()), pa.array([x.to_pybytes() for x in held], pa.binary())], schema=schema)

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_id", "_th", "text").mapInArrow(cut, f"_id {kind}, _th long, chunk int, data binary").repartition("_id", "_th", "chunk")


def chunk_functions(chunks: DataFrame) -> DataFrame:
    """Each chunk as a function of its entry state: exit state and units for either (``out0``, ``out1``, ``n0``, ``n1``), and its code points."""
    kind = chunks.schema["_id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches, rows=256):
            s = Scan(*_buffer(b["data"].to_pylist()))
            out = s.closes.astype("i4")
            made = [out, out, s.units.astype("i8"), (s.units - s.opens).astype("i8"), s.chars.astype("i8")]
            yield pa.RecordBatch.from_arrays([b["_id"], b["_th"], b["chunk"], *(pa.array(x) for x in made)], names=["_id", "_th", "chunk", "out0", "out1", "n0", "n1", "chars"])

    return chunks.mapInArrow(run, f"_id {kind}, _th long, chunk int, out0 int, out1 int, n0 long, n1 long, chars long")


def _composed(parts: DataFrame) -> DataFrame:
    """A row per text: n units, and for each chunk, in order, its entry state and the units and code points before it."""
    step = "named_struct('state', if(a.state = 0, x.out0, x.out1), 'units', a.units + if(a.state = 0, x.n0, x.n1), 'chars', a.chars + x.chars, 'seen', array_append(a.seen, named_struct('chunk', x.chunk, 'state', a.state, 'units', a.units, 'chars', a.chars)))"
    zero = "named_struct('state', 0, 'units', 0L, 'chars', 0L, 'seen', cast(array() as array<struct<chunk:int,state:int,units:bigint,chars:bigint>>))"
    block = F.expr("chunk div 256")
    # Blocks of 256 chunks are composed first, then the blocks' functions: no array is long.
    inner = parts.withColumn("block", block).groupBy("_id", "_th", "block").agg(F.array_sort(F.collect_list(F.struct("chunk", "out0", "out1", "n0", "n1", "chars"))).alias("xs"))
    both = "named_struct('s0', if(a.s0 = 0, x.out0, x.out1), 's1', if(a.s1 = 0, x.out0, x.out1), 'n0', a.n0 + if(a.s0 = 0, x.n0, x.n1), 'n1', a.n1 + if(a.s1 = 0, x.n0, x.n1), 'chars', a.chars + x.chars)"
    inner = inner.withColumn("f", F.expr(f"aggregate(xs, named_struct('s0', 0, 's1', 1, 'n0', 0L, 'n1', 0L, 'chars', 0L), (a, x) -> {both})"))
    blocks = inner.groupBy("_id", "_th").agg(F.array_sort(F.collect_list(F.expr("struct(block as chunk, f.s0 as out0, f.s1 as out1, f.n0, f.n1, f.chars)"))).alias("bs"))
    blocks = blocks.withColumn("all", F.expr(f"aggregate(bs, {zero.replace('chunk:int', 'chunk:bigint')}, (a, x) -> {step})"))
    entered = blocks.select("_id", "_th", F.col("all.units").alias("n"), F.col("all.chars").alias("total"), F.explode("all.seen").alias("e"))
    start = "named_struct('state', e.state, 'units', e.units, 'chars', e.chars, 'seen', cast(array() as array<struct<chunk:int,state:int,units:bigint,chars:bigint>>))"
    joined = inner.join(entered.withColumn("block", F.col("e.chunk")), ["_id", "_th", "block"])
    return joined.select("_id", "_th", "n", "total", F.explode(F.expr(f"aggregate(xs, {start}, (a, x) -> {step}).seen")).alias("s")).select("_id", "_th", "n", "total", "s.*")


def long_cuts(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """``rows`` (_id, _th, text, _h1, _h2) -> _id, _th, _n, _prefix, _middle: a row per different text and id, its chunks scanned wherever they are dealt to."""
    rows = rows.select("_id", "_th", "text", "_h1", "_h2").dropDuplicates(["_id", "_th"])
    chunks = written(text_chunks(rows, size), "fim-chunks")
    # A null id is joined by a flag: equality of keys drops nulls.
    flat = [F.col("_id").isNull().alias("_none"), F.coalesce("_id", F.lit(0).cast(rows.schema["_id"].dataType)).alias("_key")]
    entered = written(_composed(chunk_functions(chunks).select(F.struct(*flat).alias("_id"), "_th", "chunk", "out0", "out1", "n0", "n1", "chars")), "fim-states")
    h = rows.select(F.struct(*flat).alias("_id"), "_th", "_h1", "_h2")
    cuts = entered.join(h, ["_id", "_th"]).withColumn("cuts", F.expr("array(least(_h1 % (n + 1), _h2 % (n + 1)), greatest(_h1 % (n + 1), _h2 % (n + 1)))"))
    spans = "lead(units, 1, n + 1) over (partition by _id, _th order by chunk)"
    cuts = cuts.withColumn("until", F.expr(spans)).select("_id", "_th", "chunk", "state", "units", "chars", "n", "until", F.posexplode("cuts").alias("which", "cut"))
    wanted = cuts.where("cut >= units and cut < until").select("_id", "_th", "chunk", "state", "chars", "n", "which", (F.col("cut") - F.col("units")).alias("unit"))
    found = chunks.select(F.struct(*flat).alias("_id"), "_th", "chunk", "data").join(small(written(wanted, "fim-cuts")), ["_id", "_th", "chunk"])
    kind = rows.schema["_id"].dataType.simpleString()

    def look(batches):
        for b in slices(batches, rows=256):
            s = Scan(*_buffer(b["data"].to_pylist()))
            at = s.chars_before(np.arange(b.num_rows), b["unit"].to_numpy(), b["state"].to_numpy())
            yield pa.RecordBatch.from_arrays([b["_none"], b["_key"], b["_th"], b["n"], b["which"], pa.array(at + b["chars"].to_numpy())], names=["_none", "_key", "_th", "n", "which", "at"])

    at = found.select("_id.*", "_th", "n", "which", "unit", "state", "chars", "data").mapInArrow(look, f"_none boolean, _key {kind}, _th long, n long, which int, at long")
    first, last = (F.max(F.when(F.col("which") == i, F.col("at"))) for i in (0, 1))
    got = at.groupBy("_none", "_key", "_th").agg(F.max("n").alias("_n"), first.alias("_prefix"), (last - first).alias("_middle"))
    return got.select(F.when(~F.col("_none"), F.col("_key")).alias("_id"), "_th", "_n", "_prefix", "_middle")


def _draws(doc_id, seed: str) -> list[F.Column]:
    """Four numbers below 2 ** 32 out of the digest of ``seed:doc_id`` (a null id: an empty one)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, chunk: int = CHUNK) -> DataFrame:
    """``docs`` (with doc_id and text) -> the same columns and n, form, prefix_chars, middle_chars, output.

    n is the number of units. ``output`` is the text (form plain), or the three pieces between two cuts
    at units, prefix-suffix-middle (psm) or suffix-prefix-middle (spm), each after its mark. Cuts and
    form depend on ``seed`` and doc_id alone. Texts that are empty or hold a mark stay plain; null is
    an empty text, a null doc_id counts as an empty one, and rows that repeat give equal rows. Columns
    of the same names as the new ones are replaced; others go through. doc_id is an integer, string or null.
    """
    if (made := apart(docs, lambda d: fill_in_middle(d, seed, plain_percent, spm_percent, chunk))) is not None:
        return made
    docs = docs.drop("n", "form", "prefix_chars", "middle_chars", "output")
    h1, h2, h3, h4 = _draws(F.col("doc_id"), seed)
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumns({"_h1": h1, "_h2": h2})
    long = F.octet_length("text") > chunk
    short = _short_cuts(rows.where(~long))
    keyed = rows.where(long).withColumns({"_id": F.col("doc_id"), "_th": F.xxhash64("text")})
    cuts = long_cuts(keyed, chunk).withColumnsRenamed({"_id": "_cid", "_th": "_cth"})
    dealt = keyed.join(cuts, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_th") == F.col("_cth"))).select(*short.columns)
    both = short.unionByName(dealt)
    mark = F.col("text").contains("<P>") | F.col("text").contains("<S>") | F.col("text").contains("<M>")
    form = F.when((F.col("text") == "") | mark | (h3 % 100 >= 100 - plain_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    both = both.withColumn("form", form)
    prefix, middle, suffix = F.expr("left(text, int(_prefix))"), F.expr("substring(text, int(_prefix) + 1, int(_middle))"), F.expr("substring(text, int(_prefix + _middle) + 1)")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle))
    output = output.otherwise(F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle))
    cut = F.col("form") != "plain"
    made = both.withColumn("output", output).withColumns({"n": F.col("_n"), "prefix_chars": F.when(cut, F.col("_prefix")), "middle_chars": F.when(cut, F.col("_middle"))})
    return made.select(*docs.columns, "n", "form", "prefix_chars", "middle_chars", "output")


def restored(form: str = "form", output: str = "output") -> F.Column:
    """The text that ``output`` was made of. No piece holds a mark, and marks do not overlap, so the first of each is the mark."""
    o = f"`{output}`"
    second = f"if(`{form}` = 'psm', '<S>', '<P>')"
    a, b = f"instr({o}, {second})", f"instr({o}, '<M>')"
    one, two, three = f"substring({o}, 4, {a} - 4)", f"substring({o}, {a} + 3, {b} - {a} - 3)", f"substring({o}, {b} + 3)"
    return F.expr(f"case `{form}` when 'plain' then {o} when 'psm' then concat({one}, {three}, {two}) else concat({two}, {three}, {one}) end")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, len(u) AS n, [('0x' || h[8 * i + 1 : 8 * i + 8])::BIGINT FOR i IN range(4)] AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS p, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS q,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
t AS (SELECT *, coalesce(array_to_string(u[1 : p], ''), '') AS a, coalesce(array_to_string(u[p + 1 : q], ''), '') AS m, coalesce(array_to_string(u[q + 1 : n], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM t
"""
