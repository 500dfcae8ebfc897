"""Operator 1: benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is ``window`` consecutive words of a benchmark item (an item of fewer words, but not
none, is one window). A window is the set of its five-word shingles, and a document contains it
only if it contains every one of them; so under a containment of 1 the necessary prefix, with
shingles ordered by rarity over all documents, is the rarest shingle alone. Documents meet windows
on that shingle; the length and position bounds drop pairs whose window would start before or end
after the document; the words themselves then decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import ascii_lower, read, small, written

#: Words before A-Z are lower-cased; lower-casing changes no boundary.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHINGLE = 5
#: Benchmark shingles broadcast at once (8 bytes each); more are met in several passes over blocks.
BLOCK = 4_000_000


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _shingle(hashes: str, at: Column, n: int) -> Column:
    """Hash of the ``n`` words from index ``at``."""
    return F.xxhash64(F.lit(n), *[F.get(hashes, at + k) for k in range(n)])


def _windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, wtext: each window's words joined by a blank (no word holds one)."""
    w = items.select("item_id", _words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda s: F.array_join(F.slice("w", s, window), " "))).alias("wtext")).distinct()


def _shingled(rows: DataFrame, lengths: list[int]) -> tuple[DataFrame, Column]:
    """rows (h, pos: a place in h, 0 for the document itself) -> rows, and the hash of the shingle that begins there (null without one)."""
    pos, n_words = F.col("pos"), F.size("h") - 1
    if len(lengths) == 1:
        return rows, F.when((pos > 0) & (pos + (lengths[0] - 1) <= n_words), _shingle("h", pos, lengths[0]))
    rows = rows.select("*", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n")).where((pos > 0) | (F.col("n") == lengths[0]))
    return rows, F.coalesce(*[F.when((F.col("n") == n) & (pos > 0) & (pos + (n - 1) <= n_words), _shingle("h", pos, n)) for n in lengths])


def _counts(docs: DataFrame, shingles: DataFrame, lengths: list[int]) -> DataFrame:
    """sh, seen: how often each of ``shingles`` (sh) begins in all documents."""
    # Words are lower-cased one by one, as in the second pass: in a text, a sigma's form depends on what follows.
    h = F.concat(F.array(F.lit(0).cast("long")), F.transform(_words(F.col("text")), lambda x: F.xxhash64(F.lower(x))))
    rows, sh = _shingled(docs.select(h.alias("h")).select("h", F.posexplode_outer("h").alias("pos", "_")), lengths)
    rows = rows.select(sh.alias("sh"))
    blocks = max(1, -(-shingles.count() // BLOCK))
    out = None
    for b in range(blocks):
        block = F.broadcast(shingles.where(F.pmod("sh", F.lit(blocks)) == b))  # at most about BLOCK rows
        got = rows.join(block, "sh", "left_semi").groupBy("sh").agg(F.count(F.lit(1)).alias("seen"))
        out = got if out is None else out.unionByName(got)
    return written(out, "bench-counts")


def find_benchmark_hits(docs: DataFrame, items: DataFrame, window: int = 13, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` (doc_id, text), ``items`` (item_id, text) -> doc_id, n_words, n_hit, items (array of item_ids as strings, sorted).

    One row per row of ``docs``; rows that repeat a doc_id are judged each on its own. The columns
    ``carry`` go through, other extra columns are ignored. A null or wordless text has no words and no hits. Items without words
    have no windows; repeated items count once by item_id; a null item_id is not listed. Either
    table may be empty. Words are compared after A-Z are lower-cased and nothing else.
    """
    docs = docs.select("text", F.struct(*carry).alias("doc"))
    pairs = written(_windows(items, window), "bench-windows")
    wins = pairs.select("wtext").distinct().withColumn("w", F.split("wtext", " ")).withColumn("h", F.transform("w", lambda x: F.xxhash64(F.lower(x)))).withColumn("wlen", F.size("h"))
    parts = wins.select("wtext", "wlen", "h", F.posexplode_outer("h").alias("off", "_"))
    lengths = list(range(1, SHINGLE + 1))
    sh = F.coalesce(*[F.when((F.least(F.lit(SHINGLE), F.col("wlen")) == n) & (F.col("off") + n <= F.col("wlen")), _shingle("h", F.col("off"), n)) for n in lengths])
    parts = written(parts.select("wtext", "wlen", "off", sh.alias("sh"), F.least(F.lit(SHINGLE), F.col("wlen")).alias("n")).where("sh is not null"), "bench-shingles")
    lengths = [r.n for r in parts.select("n").distinct().collect()] or [SHINGLE]  # at most SHINGLE numbers

    rarity = _counts(docs, parts.select("sh").distinct(), lengths)
    prefix = parts.join(rarity, "sh", "left").groupBy("wtext", "wlen").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "sh", "off")).alias("p"))
    prefix = written(prefix.select(F.col("p.sh").alias("sh"), F.col("p.off").alias("off"), "wtext", "wlen").where("p.seen > 0"), "bench-prefix")

    keys = prefix.select(F.col("sh").alias("key")).distinct()
    blocks = max(1, -(-keys.count() // BLOCK))
    docs = docs.withColumn("rid", F.monotonically_increasing_id())
    if blocks > 1:  # every block must see the same numbers
        docs = written(docs, "bench-rows")
    base = docs.select("rid", "doc", _words(F.col("text")).alias("w"))
    base = base.withColumn("h", F.concat(F.array(F.lit(0).cast("long")), F.transform("w", lambda x: F.xxhash64(F.lower(x)))))
    # Index 0 of h stands for the document itself, so that one with no match still gives a row. (Of the
    # outer explode Spark infers no filter, which would make the array twice.)
    rows, sh = _shingled(base.select("rid", "doc", "w", "h", F.posexplode_outer("h").alias("pos", "_")), lengths)
    n_words, pos = F.size("h") - 1, F.col("pos")
    reach = max(0, window - min(lengths))
    first = F.greatest(F.lit(1), pos - reach)
    found = None
    for b in range(blocks):
        block = F.broadcast(keys.where(F.pmod("key", F.lit(blocks)) == b))  # at most about BLOCK rows
        got = rows.withColumn("sh", sh).join(block, F.col("sh") == F.col("key"), "left").where(F.col("key").isNotNull() | ((pos == 0) & F.lit(b == 0)))
        got = got.select("rid", "doc", n_words.alias("n_words"), "pos", F.col("key").alias("sh"), first.alias("first"), F.when(pos > 0, F.slice("w", first, F.lit(window) + pos - first)).alias("around"))
        found = got if found is None else found.unionByName(got)
    found = written(found, "bench-matches")
    met = found.where("pos > 0").select("rid", "n_words", "pos", "sh", "first", "around")

    start = F.col("pos") - F.col("off")
    same = ascii_lower(F.array_join(F.slice("around", start - F.col("first") + 1, F.col("wlen")), " ")) == F.col("wtext")
    inside = (start >= 1) & (start + F.col("wlen") - 1 <= F.col("n_words")) & (start >= F.col("first"))
    m, p = met, small(prefix)
    hits = m.join(p, (m["sh"] == p["sh"]) & F.when(inside, same).otherwise(False)).select("rid", start.alias("s"), (start + F.col("wlen")).alias("e"), "wtext")
    hits = hits.join(small(pairs), "wtext").select("rid", F.struct("s", "e").alias("span"), F.col("item_id").cast("string").alias("item"))

    both = found.where("pos = 0").select("rid", "doc", "n_words").unionByName(hits, allowMissingColumns=True)
    per = both.groupBy("rid").agg(F.max("doc").alias("doc"), F.max("n_words").cast("long").alias("n_words"), F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    # Length of the union of [s, e): each span adds what lies beyond the end so far.
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end"))
    return per.select("doc.*", "n_words", F.aggregate("spans", zero, step, lambda a: a["n"]).cast("long").alias("n_hit"), "items")


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_benchmark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


OP1_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[s : s + 12], ' ') AS t, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.s, g.n, x.item_id FROM grams g JOIN win x ON g.t = x.t AND g.n = x.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
