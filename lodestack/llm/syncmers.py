"""Operator 5: document fingerprints from closed syncmers, in DataFrame operations only.

The letters are words (runs of anything but white space); characters of scripts that are written
without blanks, and those of very long words, are letters of their own. Of every ``K`` consecutive
letters the ``K - S + 1`` inner runs of ``S`` are hashed; the k-mer is an anchor if the least of
these hashes is its first or its last. Whether a k-mer is an anchor depends on its own letters
alone, so equal passages have equal anchors wherever they stand. The fingerprint holds the
``SKETCH`` least anchor hashes in the order of their places in the text, and likeness matches two
fingerprints by place: only anchors that come in the same order in both count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestack.llm.common import read, small, written

K, S = 5, 2
SKETCH = 64
#: Words of more characters than this are read as their characters.
LONG = 64
# Scripts that are written without blanks, and ranges that hold them all (quick to test for).
BEYOND = r"[\u0E00-\u109F\u1780-\u17FF\u19E0-\u19FF\u2E80-\x{10FFFF}]"
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: A bucket of neighbours holds 2 ** BITS consecutive ids.
BITS = 9
#: A level of at most so many rows is the top one.
TOP = 4096
#: Rows of one doc_id that go with their neighbours; more are dealt out by a hash.
ROWS = 64


def _word_hashes(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    text = F.when(F.rlike(text, F.lit(BEYOND)), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)
    words = F.split(text, r"[\x20\x09-\x0D]+")
    letters = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG, F.split(w, "")).otherwise(F.array(w))))
    words = F.when(F.exists(words, lambda w: F.length(w) > LONG), letters).otherwise(words)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array of struct(pos, hash), the closed syncmers of column ``text`` in order.

    A text without a closed syncmer (as of fewer than K words), but not without words, has one anchor
    over all its words; an empty, blank or null text has none.
    """
    h, s, k = f"_{out}_h", f"_{out}_s", f"_{out}_k"
    df = df.withColumn(h, _word_hashes(F.col(text)))
    n = F.size(h)
    df = df.withColumn(s, F.when(n >= K, F.transform(F.sequence(F.lit(0), n - S), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(S)]))))
    last = K - S
    inner = lambda i: F.least(*[F.get(s, i + j) for j in range(1, last)])
    at = F.filter(F.sequence(F.lit(0), n - K), lambda i: F.least(F.get(s, i), F.get(s, i + last)) <= inner(i))
    kmer = F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(h, i + j) for j in range(K)]).alias("hash")))
    short = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(h).alias("hash")))
    df = df.withColumn(k, F.when(n >= K, kmer))
    return df.withColumn(out, F.when(F.size(k) > 0, F.col(k)).when(n > 0, short).otherwise(F.slice(short, 1, 0))).drop(h, s, k)


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the SKETCH least distinct 32-bit anchor hashes of column ``text``, in the order of their first places."""
    a, d, m = f"_{out}_a", f"_{out}_d", f"_{out}_m"
    df = with_anchors(df, text, a)
    df = df.withColumn(d, F.array_distinct(F.transform(a, lambda x: x["hash"].bitwiseAND(F.lit(0xFFFFFFFF)))))
    df = df.withColumn(m, F.when(F.size(d) > SKETCH, F.get(F.array_sort(d), F.lit(SKETCH - 1))))
    return df.withColumn(out, F.when(F.col(m).isNull(), F.col(d)).otherwise(F.filter(d, lambda x: x <= F.col(m)))).drop(a, d, m)


def as_string(sketch: str) -> Column:
    """Eight hex digits for each hash of the sketch."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.substring(F.hex(x + F.lit(1 << 32)), 2, 8)), ""))


def _longest_rise(places: Column) -> Column:
    """Length of the longest rising subsequence of distinct numbers. A rising array is measured as it is."""
    rising = F.forall(F.zip_with(places, F.slice(places, 2, SKETCH), lambda x, y: y.isNull() | (x < y)), lambda ok: ok)
    # The fold keeps, for each length, the least number that such a subsequence ends with.
    step = lambda ends, x: F.concat(F.filter(ends, lambda y: y < x), F.array(x), F.slice(F.filter(ends, lambda y: y > x), 2, SKETCH))
    return F.when(rising, F.size(places)).otherwise(F.aggregate(places, F.array().cast("array<int>"), step, F.size))


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add ``out``, 0 to 1: of the least hashes of both sketches together, the share that both have in one order. 1 if both are empty."""
    u, p = f"_{out}_u", f"_{out}_p"
    df = df.withColumn(u, F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH))
    both = F.filter(F.array_intersect(a, b), lambda x: F.array_contains(u, x))  # in the order of a
    df = df.withColumn(p, F.transform(both, lambda x: F.array_position(b, x).cast("int")))
    return df.withColumn(out, F.when(F.size(u) == 0, F.lit(1.0)).otherwise(_longest_rise(F.col(p)) / F.size(u))).drop(u, p)


def _followers(keys: DataFrame) -> DataFrame:
    """Distinct numbers k -> k, next: the next lower one, after the least the greatest.

    Numbers meet in windows of 2 ** BITS neighbouring values at most, level on level, so no task
    sees more than that of a level, however they are spread; the top level has few rows.
    """
    levels, cur = [], keys.select("k", F.col("k").alias("hi"), F.col("k").alias("lo"))
    while True:
        top = cur.count() <= TOP
        w = (Window.partitionBy(F.lit(0)) if top else Window.partitionBy(F.shiftright("k", BITS))).orderBy(F.desc("k"))
        got = cur.select(F.col("lo").alias("from"), F.lead("hi").over(w).alias("to"), "hi")
        levels.append(got.where("to is not null").select("from", "to"))
        if top:
            ends = cur.agg(F.min("lo").alias("from"), F.max("hi").alias("to")).where("`from` is not null")
            levels.append(ends)
            break
        cur = written(cur.groupBy(F.shiftright("k", BITS).alias("k")).agg(F.max("hi").alias("hi"), F.min("lo").alias("lo")), "levels")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def _crowded(docs: DataFrame, heads: DataFrame) -> DataFrame | None:
    """_k, many: ids of more than ROWS rows in buckets of more rows than ids; None if there are none."""
    full = heads.where(F.col("rows") > 1 << BITS).select("_b")
    if full.isEmpty():
        return None
    some = docs.withColumn("_b", F.shiftright("_k", BITS)).join(small(full), "_b", "left_semi")
    many = written(some.groupBy("_k").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > ROWS), "crowded")
    return None if many.isEmpty() else many


def _next_of_crowded(docs: DataFrame, many: DataFrame, carry: list[str], add) -> tuple[DataFrame, DataFrame]:
    """For the rows of crowded ids: (rows with next_<c>, those that have their next among them), (the first and the last row of each id, with _o 0 and 1).

    Rows that repeat each other are one, counted by an aggregate. The others are dealt by leading bits
    of a hash, and each group of them also gets the first row of the group after it.
    """
    most = many.agg(F.max("many")).first()[0]
    bits = max(1, (most // ROWS).bit_length())
    cols = [c for c in docs.columns if c != "_k"]
    rows = docs.join(small(many.select("_k")), "_k", "left_semi").groupBy("_k", *cols).agg(F.count(F.lit(1)).alias("_n"))
    rows = written(rows.withColumn("_h", F.xxhash64(*cols)).withColumn("_c", F.shiftright("_h", 64 - bits)), "crowd")
    order = Window.partitionBy("_k").orderBy("_c")
    # One row a group: its first and last hash.
    groups = written(rows.groupBy("_k", "_c").agg(F.min("_h").alias("first"), F.max("_h").alias("last")), "groups")
    heads = groups.select("_k", F.lag("_c").over(order).alias("_c"), F.col("first").alias("_h")).where("_c is not null")
    ends = groups.groupBy("_k").agg(F.min("first").alias("lo"), F.max("last").alias("hi"))
    ghosts = rows.drop("_c").join(small(written(heads, "heads")), ["_k", "_h"]).withColumn("_g", F.lit(1))
    both = add(rows.withColumn("_g", F.lit(0)).unionByName(ghosts.select(*rows.columns, "_g")))
    w = Window.partitionBy("_k", "_c").orderBy("_g", "_h")
    got = both.select("*", F.lead("_h").over(w).alias("_after"), *[F.lead(c).over(w).alias(f"next_{c}") for c in carry]).where("_g = 0")
    # All copies of a row but the last have their like as next; the last row of an id has its next elsewhere.
    copies = F.sequence(F.lit(1), F.col("_n"))
    got = got.withColumn("_i", F.explode(copies)).where((F.col("_i") < F.col("_n")) | F.col("_after").isNotNull())
    own = F.col("_i") < F.col("_n")
    plain = [c for c in got.columns if not c.startswith("next_") or c.removeprefix("next_") not in carry]
    got = got.select(*plain, *[F.when(own, F.col(c)).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in carry])
    edge = rows.join(small(written(ends, "ends")), "_k").where((F.col("_h") == F.col("lo")) | (F.col("_h") == F.col("hi")))
    edge = edge.withColumn("_o", (F.col("_h") == F.col("hi")).cast("int")).select(*docs.columns, "_o", (F.col("lo") == F.col("hi")).alias("_one"))
    return got.drop("_n", "_h", "_c", "_g", "_after", "_i"), edge


def with_next(docs: DataFrame, carry: list[str], add=lambda rows: rows) -> DataFrame:
    """Add next_<c> for each column c of ``carry``: its value in the next row by descending doc_id (after the last: the first).

    Rows of equal doc_id go by text, and more than ROWS of them by a hash of all their columns, rows that
    repeat each other one after the other; rows without a doc_id come last. A single row is its own next.
    ``add`` makes columns to carry (row by row) once it is known which rows are needed twice. No task has
    more than some rows of 2 ** BITS ids, or of one id.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    docs = docs.withColumn("_k", key)
    ids = docs.select("_k", F.shiftright("_k", BITS).alias("_b")).groupBy("_b").agg(F.max("_k").alias("k"), F.count(F.lit(1)).alias("rows"))
    heads = written(ids, "heads")  # the greatest id of each bucket
    links = _followers(heads.select("k"))
    many = _crowded(docs, heads)
    most, out = docs.withColumns({"_o": F.lit(0), "_one": F.lit(True)}), None
    if many is not None:
        # Of a crowded id, the first row is met by what stands before it, and the last meets what comes after.
        out, edge = _next_of_crowded(docs, many, carry, add)
        most = most.join(small(many.select("_k")), "_k", "left_anti").select(*most.columns).unionByName(edge)
    # The first row of each bucket is also needed at the end of the bucket before it.
    ghosts = links.select(F.col("to").alias("_k"), F.shiftright("from", BITS).alias("_b"))
    ghosts = small(written(ghosts, "ghosts"))
    own = most.select("*", F.shiftright("_k", BITS).alias("_b"), F.lit(0).alias("_g"))
    extra = most.join(ghosts, "_k").select(*most.columns, "_b", F.lit(1).alias("_g"))
    w = Window.partitionBy("_b").orderBy("_g", F.desc("_k"), "_o", "text")
    rows = add(own.unionByName(extra))
    rows = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
    rows = rows.where("_g = 0")
    if out is not None:
        rows = rows.join(small(many.select("_k", F.lit(True).alias("_crowd"))), "_k", "left").where(F.col("_crowd").isNull() | (F.col("_o") == 1) | F.col("_one"))
        rows = rows.drop("_crowd", "_b", "_g", "_o", "_one").unionByName(out)
    return rows.drop("_k", "_b", "_g", "_o", "_one")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n, fp, next_fp, edited, efp, near_edited, near_next: one row per row.

    ``edited`` is the text with its last half (rounded down) replaced by as many characters of the
    next document's beginning, by descending doc_id. A null text is empty and has an empty
    fingerprint, as has a blank one. Rows without a doc_id come last; rows that repeat a doc_id go by
    text and have each other as next. Texts may have any length. Extra columns are ignored; an empty
    table gives none.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs, ["text", "fp"], lambda rows: with_sketch(rows, "text", "fp"))
    docs = docs.withColumn("n", F.length("text"))
    half = (F.col("n") / 2).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.substring("next_text", F.lit(1), half)))
    docs = with_sketch(docs.select("doc_id", "n", "fp", "next_fp", "edited"), "edited", "efp")
    return with_likeness(with_likeness(docs, "fp", "efp", "near_edited"), "fp", "next_fp", "near_next")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fingerprint_documents(read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_string("fp").alias("fingerprint"), as_string("efp").alias("edited_fingerprint"), "near_edited", "near_next")
