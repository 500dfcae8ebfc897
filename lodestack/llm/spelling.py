"""Operator 12: spelling variants by a self-join of the vocabulary's trie with active-node sets.

The active nodes of a node u are the nodes v one edit from it, each unordered pair held once: v
differs in one character (and is greater), or has one more. They follow from those of u's parent: a
pair (u, v) goes on to (uc, vc) where both exist; children c < c' of u give (uc, uc'); a child c' with
a child c of its own gives (uc, uc'c). Pairs (u, uc') are known from u alone. The trie's upper levels,
down to the shortest word's length, are tables of nodes, and a level's pairs are joins with the next
level's nodes. Below, the trie is partitioned by prefix: a task has the words under a prefix and those
under its active nodes, and goes on in the same way. Prefixes with over GROUP_WORDS of these go down
level by level instead, so a frequent prefix is split and no word is left out. A node's children are
bounded by the alphabet of words, and so are its pairs.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import BROADCAST_ROWS, read, slices, small, written

GROUP_WORDS = 20_000
#: Counts that a task holds before it passes them on: words, and their characters together.
HELD_WORDS, HELD_CHARS = 300_000, 16_000_000
_ONE = "[A-Za-zÀ-ÿ]"


def count_words(docs: DataFrame, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """``docs`` (doc_id, text) -> word, n: runs of letters, A-Z lower-cased, some with a planted slip.

    The slip is a function of doc_id (null: an empty one) and run, so it is worked out once for each
    different run of a row.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        find = re.compile(_ONE + "{%d,}" % min_chars).findall
        held: dict[str, int] = {}
        chars = 0
        for b in slices(batches):
            for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                if not t:
                    continue
                start = zlib.crc32(f"{'' if d is None else d}:".encode())
                for w, n in Counter(find(t.encode().lower().decode())).items():
                    h = zlib.crc32(w.encode(), start)
                    if h % 97 == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < min_chars:
                            continue
                    if w in held:
                        held[w] += n
                    else:
                        held[w] = n
                        chars += len(w)
                if len(held) > HELD_WORDS or chars > HELD_CHARS:
                    yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, schema=schema)
                    held, chars = {}, 0
        if held:
            yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, schema=schema)

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Branch:
    """Nodes of a trie as ranges (first, end, depth) of sorted words."""

    def __init__(self, words: list[str]):
        self.words, self.all, self.known = words, set(words), {}

    def node(self, prefix: str) -> tuple[int, int, int]:
        last = bisect_left(self.words, prefix[:-1] + chr(ord(prefix[-1]) + 1)) if prefix else len(self.words)
        return bisect_left(self.words, prefix), last, len(prefix)

    def ends(self, node) -> bool:
        return node[0] < node[1] and len(self.words[node[0]]) == node[2]

    def children(self, node) -> dict[str, tuple[int, int, int]]:
        if node not in self.known:
            out, (at, end, depth) = {}, node
            at += self.ends(node)
            while at < end:
                c, first = self.words[at][depth], at
                while at < end and self.words[at][depth] == c:
                    at += 1
                out[c] = (first, at, depth + 1)
            self.known[node] = out
        return self.known[node]


def near_in_branch(prefix: str, words: list[str], visits: list[str]):
    """Pairs (a, b) one edit apart with a under ``prefix``; b under it too (each pair once) or under one of ``visits``, its active nodes that do not begin with it."""
    t = Branch(words)
    stack = [(t.node(prefix), [t.node(v) for v in visits])]
    while stack:
        u, active = stack.pop()
        if u[1] - u[0] == 1:  # one word left: what is left of its partner is the same
            w = t.words[u[0]]
            for v in active:
                other = t.words[v[0]][: v[2]] + w[u[2] :]
                if other in t.all:
                    yield w, other
            continue
        kids = t.children(u)
        if t.ends(u):
            for v in (*active, *kids.values()):
                if t.ends(v):
                    yield t.words[u[0]], t.words[v[0]]
        t.known.pop(u, None)
        below = [t.children(v) for v in active]
        for c, child in kids.items():
            on = [x[c] for x in below if c in x]
            on += [v for d, v in kids.items() if d > c]
            on += [x[c] for d, v in kids.items() if d != c and c in (x := t.children(v))]
            if on or child[1] - child[0] > 1:
                stack.append((child, on))


def _nodes(vocab: DataFrame, first: int, last: int) -> DataFrame:
    """p, n: the trie's nodes of these depths and the words under each."""
    some = vocab.where(F.length("word") >= first).select(F.explode(F.expr(f"transform(sequence({first}, least({last}, length(word))), k -> left(word, k))")).alias("p"))
    return some.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


class Nodes:
    """The trie's nodes of some depths: ``table`` (p, n), written. A depth's nodes are broadcast if there are few."""

    def __init__(self, vocab: DataFrame, first: int, last: int):
        self.table = written(_nodes(vocab, first, last), "trie-nodes")
        self.count = {r.depth: r["count"] for r in self.table.groupBy(F.length("p").alias("depth")).count().collect()}

    def some(self, df: DataFrame, *depths: int) -> DataFrame:
        """``df``, made of the nodes of these depths, with a broadcast hint if they are few."""
        return F.broadcast(df) if sum(self.count.get(k, 0) for k in depths) <= BROADCAST_ROWS else df

    def at(self, depth: int, name: str) -> DataFrame:
        return _level(self.table, depth, name)


def _level(nodes: DataFrame, depth: int, name: str) -> DataFrame:
    """The nodes of a depth: ``name``, its parent ``up``, grandparent ``top``, last character ``c`` and the one before, ``d``."""
    p = F.col("p")
    cols = [p.alias(name), F.expr(f"left(p, {depth - 1})").alias("up"), F.expr(f"left(p, {max(0, depth - 2)})").alias("top"), F.substring(p, depth, 1).alias("c"), F.substring(p, max(1, depth - 1), 1).alias("d")]
    return nodes.where(F.length("p") == depth).select(*cols)


def _down(pairs: DataFrame | None, nodes: Nodes, depth: int) -> DataFrame:
    """Active pairs (u, v) of the nodes at ``depth``, from those of their parents (and all parents that ``nodes`` has). v never begins with u."""
    u, same, longer = nodes.at(depth, "u"), nodes.at(depth, "v"), nodes.at(depth + 1, "v")
    sibling = u.join(nodes.some(same.select("v", "up", F.col("c").alias("c2")), depth), "up").where("c < c2").select("u", "v")
    inserted = u.select("u", "up", "c").join(nodes.some(longer.where("c <> d").select("v", F.col("top").alias("up"), "c"), depth + 1), ["up", "c"]).select("u", "v")
    out = sibling.unionByName(inserted)
    if pairs is not None:
        step = pairs.withColumnsRenamed({"u": "pu", "v": "up"}).join(nodes.some(u.select("u", F.col("up").alias("pu"), "c"), depth), "pu").select("up", "u", "c")
        partners = same.select("v", "up", "c").unionByName(longer.select("v", "up", "c"))
        out = out.unionByName(step.join(nodes.some(partners, depth, depth + 1), ["up", "c"]).select("u", "v"))
    return out


def _in_branches(groups: DataFrame, vocab: DataFrame, depth: int) -> DataFrame:
    """a, na, b, nb: near pairs of the words under each ready prefix (``groups``: u, v, also with v = u)."""
    under = vocab.select("word", "n", F.explode(F.expr(f"array_distinct(array(left(word, {depth}), left(word, {depth + 1})))")).alias("v"))
    rows = groups.join(under, "v").select("u", "v", "word", "n").repartition("u").sortWithinPartitions("u")
    schema = pa.schema([("a", pa.string()), ("na", pa.int64()), ("b", pa.string()), ("nb", pa.int64())])

    def run(batches):
        now, words, visits, out = None, {}, set(), []

        def finish():
            for a, b in near_in_branch(now, sorted(words), sorted(visits)):
                out.append((a, words[a], b, words[b]))

        def flush():
            got = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return got

        for b in batches:
            for u, v, w, n in zip(*(b[c].to_pylist() for c in ("u", "v", "word", "n")), strict=True):
                if u != now:
                    if now is not None:
                        finish()
                        if len(out) > 50_000:
                            yield flush()
                    now, words, visits = u, {}, set()
                words[w] = n
                if v != u:
                    visits.add(v)
        if now is not None:
            finish()
        if out:
            yield flush()

    return rows.mapInArrow(run, "a string, na long, b string, nb long")


def near_words(vocab: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """``vocab`` (word, n; distinct words, written) -> a, na, b, nb: every pair one inserted, deleted or replaced code point apart, once."""
    shortest = vocab.agg(F.min(F.length("word"))).first()[0]
    if shortest is None or shortest < 1:
        vocab = vocab.where("word <> ''")
        shortest = vocab.agg(F.min(F.length("word"))).first()[0] or 1
    nodes, pairs = Nodes(vocab, 1, shortest + 1), None
    for depth in range(1, shortest + 1):
        pairs = written(_down(pairs, nodes, depth), "trie-pairs")
    depth, out, open_ = shortest, None, None
    while True:
        here = nodes.table.where(F.length("p") == depth)
        own = here.select(F.col("p").alias("u"), "n") if open_ is None else here.select(F.col("p").alias("u"), "n").join(open_, F.expr(f"left(u, {depth - 1})") == F.col("up"), "left_semi")
        visitors = pairs.join(nodes.some(nodes.table.withColumnRenamed("p", "v"), *nodes.count), "v").groupBy("u").agg(F.sum("n").alias("more"))
        sizes = written(own.join(nodes.some(visitors, depth), "u", "left").select("u", "n", (F.col("n") + F.coalesce("more", F.lit(0))).alias("total")), "trie-sizes")
        # A single word without active nodes has no near word.
        ready = nodes.some(sizes.where((F.col("total") <= group_words) & (F.col("total") > 1)).select("u"), depth)
        groups = pairs.join(ready, "u", "left_semi").select("u", "v").unionByName(ready.select("u", F.col("u").alias("v")))
        made = _in_branches(groups, vocab, depth)
        out = made if out is None else out.unionByName(made)
        large = sizes.where(F.col("total") > group_words).select("u")
        if large.isEmpty():
            return out
        large = small(large)
        # Words that end at a node that goes down meet those that end at its active nodes and children.
        nodes = Nodes(vocab, depth + 1, depth + 2)
        on = pairs.join(large, "u", "left_semi").select("u", "v")
        child = nodes.table.where(F.length("p") == depth + 1).select(F.expr(f"left(p, {depth})").alias("u"), F.col("p").alias("v"))
        met = on.unionByName(child.join(large, "u", "left_semi"))
        ended = met.join(vocab.select(F.col("word").alias("u"), F.col("n").alias("na")), "u").join(vocab.select(F.col("word").alias("v"), F.col("n").alias("nb")), "v")
        out = out.unionByName(ended.select(F.col("u").alias("a"), "na", F.col("v").alias("b"), "nb"))
        open_ = large.withColumnRenamed("u", "up")
        depth += 1
        # Siblings and insertions arise under nodes that go down alone; partners of their pairs may be anywhere.
        new = _down(on, nodes, depth).join(open_, F.expr(f"left(u, {depth - 1})") == F.col("up"), "left_semi")
        pairs = written(new, "trie-pairs")


def spelling_forms(vocab: DataFrame, near: DataFrame, times: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root. A form is at least ``times`` as frequent, so chains are short; roots are found by doubling steps."""
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    best = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("nb")).alias("m"), "b")).alias("best"))
    taken = (-F.col("best.m")) >= times * F.col("n")
    rows = vocab.join(best.withColumnRenamed("a", "word"), "word", "left")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.b")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n"))
    rows = written(rows, "forms")
    steps = written(rows.where("form is not null").select("word", F.col("form").alias("root")), "steps")
    while True:
        on = small(steps.select(F.col("word").alias("root"), F.col("root").alias("next")))
        after = written(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        steps = after.select("word", "root")
        if after.where("moved").isEmpty():
            break
    return rows.join(small(steps), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, times: int = 2, group_words: int = GROUP_WORDS) -> DataFrame:
    """``docs`` (doc_id, text; other columns are not looked at) -> a row per word: word, n, n_near, form, form_n, root.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that is at
    least ``times`` its own n, else null; root follows forms to the last. Null and empty texts have no
    words, rows that repeat count again, and an empty table has no rows.
    """
    vocab = written(count_words(docs, min_chars, min_count), "vocabulary")
    near = written(near_words(vocab, group_words), "near-words")
    return spelling_forms(vocab, near, times)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spelling_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 is linear, so it is the exclusive or of each byte's share by its distance from the end; the first four bytes are inverted.
OP12_SQL = r"""
WITH RECURSIVE l AS (SELECT coalesce(doc_id::VARCHAR, '') AS k, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
g AS (SELECT k, r, count(*) AS n, hex(encode(k || ':' || r)) AS x FROM l WHERE length(r) >= 5 GROUP BY k, r),
t0(b, i, s) AS (SELECT b, 0, b::BIGINT FROM range(256) q(b) UNION ALL SELECT b, i + 1, xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END) FROM t0 WHERE i < 8),
tab AS (SELECT b, s FROM t0 WHERE i = 8),
t(dist, b, s) AS (SELECT 0, b, s FROM tab UNION ALL SELECT t.dist + 1, t.b, xor(t.s >> 8, tab.s) FROM t JOIN tab ON tab.b = (t.s & 255) WHERE t.dist < (SELECT max(length(x)) // 2 FROM g)),
y AS (SELECT k, r, n, x, unnest(range(length(x) // 2)) AS i FROM g),
h AS (SELECT y.k, y.r, any_value(y.n) AS n, xor(bit_xor(t.s), 4294967295) AS h FROM y
  JOIN t ON t.dist = length(y.x) // 2 - 1 - y.i AND t.b = xor(('0x' || substr(y.x, 2 * y.i + 1, 2))::BIGINT, CASE WHEN y.i < 4 THEN 255 ELSE 0 END) GROUP BY y.k, y.r),
v AS (SELECT CASE WHEN h % 97 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gone AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT a.word, a.n, b.word AS o, b.n AS m FROM gone a JOIN gone b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gone a JOIN w b ON a.s = b.word UNION SELECT b.word, b.n, a.word, a.n FROM gone a JOIN w b ON a.s = b.word),
f AS (SELECT word, n, count(*) AS n_near, first(o ORDER BY m DESC, o) AS o, max(m) AS m FROM near GROUP BY word, n),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN o END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN f ON w.word = f.word),
c(word, root, k) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, forms.form, c.k + 1 FROM c JOIN forms ON forms.word = c.root WHERE forms.form IS NOT NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, k) AS root FROM c GROUP BY word) r ON r.word = forms.word
"""
