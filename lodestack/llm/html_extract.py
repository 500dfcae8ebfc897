"""Operator 10: main text of web pages by equivalence-class template deduction.

1. Every page is cut into tokens: tags, qualified by their path of enclosing tags, and short texts.
2. For every host, tokens with the same occurrence vector (how often on which page) are one
   equivalence class: an order-free hash of (page, count) pairs is summed for each token by an
   aggregate, so no vector and no host is gathered anywhere. Classes of two tokens or more that
   occur on enough pages are template candidates.
3. A class is valid if its tags pair up properly in page order; valid classes nest by their paths
   and make the host's template: known tags and texts, with slots between them.
4. Each page is read against its host's template. A slot is main if it holds a fair share of what
   the host's fullest slot holds and its text differs from page to page; text in main slots is kept,
   text in the template's other slots and texts that belong to the template are not. Reader comments
   have a rule of their own: records of several slots that come again on a page, and slots that are
   named as comments, are not main where something else is. Menus, headers, footers, sidebars, forms,
   scripts and styles are dropped by their elements. Other class names and ids, and article and main
   elements, are asked only about what the template does not know (also on hosts of few pages).
"""

from __future__ import annotations

import html as htmllib
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import read, slices, written

#: A class needs so many tokens, pages, and this share of its host's pages.
LEAST_TOKENS, LEAST_PAGES, LEAST_SHARE = 2, 5, 0.5
#: Template text needs this share of the host's pages; longer texts are never tokens.
TEXT_SHARE, TEXT_CHARS = 0.9, 200
#: A slot is main if it holds this share of the characters in its host's fullest slot.
SLOT_SHARE = 0.1
#: Comments are left out if the fullest of the other slots has this share of the fullest of all.
LEAST_LEFT = 0.05
#: Different texts that a main slot has for each page that has it; and the times that a record comes on a page.
VARIETY, RECORDS = 0.5, 1.5
#: Article and main elements decide if they hold this share of the text that is neither noise nor template.
MAIN_SHARE = 0.25
#: A host's template is broadcast with all others up to this many token rows; beyond, by a shuffle join.
TEMPLATE_ROWS = 200_000

# Element and class names of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr big acronym".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe object svg canvas math button select textarea input option dialog menu audio video title".split())
SILENT = frozenset("script style noscript template meta link base".split())
MAIN = frozenset("article main".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption table thead tbody tr td th center hr".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())

#: Columns of a template's rows.
TEMPLATE = ("token", "class", "support", "pages", "place", "chars", "times", "texts")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^>]*\Z|[^<]+|<", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def host_of(url: str) -> F.Column:
    """Lower-cased host of a URL column; empty for null and for what is no URL."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def _is_dropped(tag: str, attrs: dict[str, str]) -> bool:
    """Whether the element itself says that it holds no main text."""
    return tag in DROPPED or "hidden" in attrs or attrs.get("role", "").lower() in NOISE_ROLES or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))


def _sounds_like(names: str, words: frozenset[str]) -> bool:
    return any(n in words for n in re.split(r"[\s_-]+", names.lower()))


def _named(tag: str, attrs: dict[str, str], words: frozenset[str]) -> bool:
    """Whether class names or ids are among ``words``."""
    return tag not in ("html", "body", *MAIN) and ("class" in attrs or "id" in attrs) and _sounds_like(f"{attrs.get('class', '')} {attrs.get('id', '')}", words)


def walk(page: str):
    """Yield (kind, name, path, data): starts ("<", data: attributes), ends (">", data: label) and texts ("t", data: raw text).

    ``path`` is the tuple of open elements, each with its class. Ends that were left out are made
    up where HTML has them (p, li, ...), a raw element's content is skipped, and a tag or comment
    that breaks off at the end of the page is dropped.
    """
    stack: list[str] = []
    names: list[str] = []

    def close(to: int):
        while len(names) > to:
            n, label = names.pop(), stack.pop()
            yield ">", n, tuple(stack), label

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                yield "t", "", tuple(stack), m[0]
            continue
        tag = tag.lower()
        if m[1]:
            if tag in names:
                # An inline end tag does not reach over a block.
                i = len(names) - 1 - names[::-1].index(tag)
                if tag not in INLINE or all(n in INLINE for n in names[i:]):
                    yield from close(i)
            continue
        attrs = {k.lower(): htmllib.unescape(a or b or c) for k, a, b, c in _ATTR.findall(m[3])} if m[3].strip(" /") else {}
        if tag in ENDS_P and "p" in names:
            yield from close(len(names) - 1 - names[::-1].index("p"))
        if tag in ("li", "tr", "td", "th", "option", "dt", "dd"):
            same = ("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else (tag,)
            for i in range(len(names) - 1, -1, -1):
                if names[i] in same:
                    yield from close(i)
                    break
                if names[i] in ("ul", "ol", "table", "dl", "select"):
                    break
        yield "<", tag, tuple(stack), attrs
        label = f"{tag}.{attrs['class']}" if attrs.get("class") else tag
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end if stop is None else page.find(">", stop.end())
            at = end if at in (-1, end) else at + 1
            yield ">", tag, tuple(stack), label
        elif tag not in VOID:
            names.append(tag)
            stack.append(label)
    yield from close(0)


def _squeeze(text: str) -> str:
    return " ".join(htmllib.unescape(text).split())


def _key(path: tuple[str, ...], *own: str) -> str:
    return "/".join([*(p for p in path if p.split(".", 1)[0] not in INLINE), *own])


def _slot(path: tuple[str, ...]) -> str:
    """The element that a text fills: its path without inline and text elements at the end."""
    n = len(path)
    while n and (path[n - 1].split(".", 1)[0] in INLINE or path[n - 1].split(".", 1)[0] in FLOW):
        n -= 1
    return _key(path[:n])


def tokens(page: str) -> dict[str, list[int]]:
    """Token -> [count, first place, characters that fill it, their hash] of a page. Paths leave out inline tags."""
    out: dict[str, list[int]] = {}
    noise: list[int] = []
    for place, (kind, name, path, data) in enumerate(walk(page)):
        if kind == "t":
            s = _squeeze(data)
            if s and not noise:
                slot = out.setdefault("<" + _slot(path), [0, place, 0, 0])
                slot[2:] = slot[2] + len(s), zlib.crc32(s.encode(), slot[3])
            if not s or len(s) > TEXT_CHARS:
                continue
            key = "t" + s
        else:
            if kind == "<" and name not in VOID and _is_dropped(name, data):
                noise.append(len(path))
            if kind == ">" and noise and noise[-1] == len(path):
                noise.pop()
            if name in INLINE:
                continue
            key = kind + _key(path, (f"{name}.{data['class']}" if data.get("class") else name) if kind == "<" else data)
        out.setdefault(key, [0, place, 0, 0])[0] += 1
    return {k: v for k, v in out.items() if v[0]}


def occurrence_classes(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html) -> host, token, class, support, pages, place, chars, times, texts: tokens of frequent classes of two or more.

    ``times`` is how often the token occurs on all pages, ``texts`` about how many different texts fill it.
    """
    schema = pa.schema([("host", pa.string()), ("token", pa.string()), ("h", pa.int64()), ("place", pa.int32()), ("chars", pa.int32()), ("n", pa.int32()), ("text", pa.int64())])

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in slices(batches):
            cols: list[list] = [[] for _ in schema]
            for site, h, n in zip(b["_host"].to_pylist(), b["html"].to_pylist(), b["n"].to_pylist(), strict=True):
                found = {"": [1, -1, 0, 0]} | tokens(h or "")
                cols[0] += [site] * len(found)
                cols[1] += found
                cols[2] += [xxh64_intdigest(f"{n} {c}") - (1 << 63) for c, _, _, _ in found.values()]
                for k, i in ((3, 1), (4, 2), (5, 0)):
                    cols[k] += [x[i] for x in found.values()]
                cols[6] += [x[3] if x[2] else None for x in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    rows = pages.select(host_of("url").alias("_host"), "html", F.monotonically_increasing_id().alias("n")).mapInArrow(run, "host string, token string, h long, place int, chars int, n int, text long")
    sums = [F.avg("place").alias("place"), F.sum("chars").alias("chars"), F.sum("n").alias("times"), F.approx_count_distinct("text", 0.2).alias("texts")]
    g = rows.groupBy("host", "token").agg(F.bit_xor("h").alias("class"), F.count(F.lit(1)).alias("support"), *sums)
    g = written(g.where(F.col("support") >= LEAST_PAGES), "tokens")
    whole = g.where("token = ''").select("host", F.col("support").alias("pages"))
    g = g.join(whole, "host").where(F.col("support") >= LEAST_SHARE * F.col("pages"))
    sizes = g.groupBy("host", "class").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= LEAST_TOKENS)
    return g.join(sizes.drop("size"), ["host", "class"]).where("token <> ''").select("host", *TEMPLATE)


class Template:
    """A host's template from its valid classes: texts that belong to it, its slots, and which of these are main."""

    def __init__(self, rows):
        classes: dict[int, list] = {}
        for token, cls, support, n, place, chars, *more in rows:
            times, texts = more or (support, support)
            classes.setdefault(cls, []).append((place, token, support, n, chars, times, texts))
        self.texts: set[str] = set()
        self.records: set[str] = set()
        sizes: dict[str, int] = {}
        varied: set[str] = set()
        for members in classes.values():
            members.sort()
            if self._valid([m[1] for m in members]):
                self.texts |= {t[1:] for _, t, s, n, *_ in members if t[0] == "t" and s >= TEXT_SHARE * n}
                own = {t[1:]: c for _, t, _, _, c, *_ in members if t[0] == "<" and c > 0}
                sizes |= own
                varied |= {t[1:] for _, t, s, *_, texts in members if t[1:] in own and texts >= VARIETY * s}
                if len(own) > 1 and all(times >= RECORDS * s for _, _, s, _, _, times, _ in members):
                    self.records |= set(own)
        comments = self.records | {x for x in sizes if any(_sounds_like(p.split(".", 1)[1], COMMENTS) for p in x.split("/") if "." in p)}
        fullest = max(sizes.values(), default=0)
        left = max((c for x, c in sizes.items() if x not in comments and x in varied), default=0)
        # Rules about comments and about variety are heard only if they leave something.
        self.deaf = left < LEAST_LEFT * fullest
        if self.deaf:
            self.records = set()
        least = SLOT_SHARE * (fullest if self.deaf else left)
        self.slots = set(sizes)
        self.main = {x for x, c in sizes.items() if c >= least and (self.deaf or (x not in comments and x in varied))}
        #: Slots and what they stand in: elements that the template knows.
        self.known = {"/".join(p[:n]) for p in (x.split("/") for x in sizes) for n in range(1, len(p) + 1)}
        self.places: dict[tuple[str, ...], str] = {}

    def knows(self, path: tuple[str, ...]) -> bool:
        return _key(path) in self.known

    def place(self, path: tuple[str, ...]) -> str:
        """Where a text with this path is: in a ``main`` slot, in an ``other`` slot of the template, or ``""``: unknown."""
        got = self.places.get(path)
        if got is None:
            if len(self.places) > 10_000:
                self.places.clear()
            above = {_key(path[:n]) for n in range(1, len(path) + 1)}
            got = self.places[path] = "other" if above & self.records else "main" if above & self.main else "other" if _slot(path) in self.slots else ""
        return got

    @staticmethod
    def _valid(ordered: list[str]) -> bool:
        """In page order the class's starts and ends pair up, each end with the last open start."""
        starts, ends = ({t[1:] for t in ordered if t[0] == k} for k in "<>")
        opened: list[str] = []
        for t in ordered:
            if t[0] == "<" and t[1:] in ends:
                opened.append(t[1:])
            elif t[0] == ">" and t[1:] in starts and (not opened or opened.pop() != t[1:]):
                return False
        return not opened


@lru_cache(maxsize=256)
def _template(rows: tuple) -> Template:
    return Template(rows)


def extract(page: str, template: Template) -> str:
    """Main text: blocks joined by newlines."""
    # A block is a list of (place, whether inside an article or main element, text).
    blocks: list[list[tuple[str, bool, str]]] = [[]]
    noise: list[int] = []  # depths at which dropped elements began
    main: list[int] = []
    titles: list[int] = []
    fits = False

    def named(name: str, data: dict[str, str], here: tuple[str, ...]) -> bool:
        """Names are asked about elements that the template does not know; those of comments about all."""
        return _named(name, data, COMMENTS if template.knows(here) else NOISE) and not (template.deaf and template.knows(here))

    for kind, name, path, data in walk(page):
        depth = len(path)
        if kind == "<":
            header = name == "header" and not main
            here = (*path, f"{name}.{data['class']}" if data.get("class") else name)
            if name not in VOID and (header or _is_dropped(name, data) or named(name, data, here)):
                noise.append(depth)
            elif name in MAIN and not noise:
                main.append(depth)
            if name == "h1":
                titles.append(depth)
            fits = fits or (bool(template.main) and name not in INLINE and template.place(here) == "main")
            if name not in INLINE and name not in SILENT and name != "br":
                blocks.append([])
            elif name == "br" and blocks[-1]:
                blocks[-1].append(("", bool(main), " "))
        elif kind == ">":
            if noise and noise[-1] == depth:
                noise.pop()
            if main and main[-1] == depth and name in MAIN:
                main.pop()
            if titles and titles[-1] == depth:
                titles.pop()
            if name not in INLINE and name not in SILENT:
                blocks.append([])
        elif not noise:
            blocks[-1].append(("main" if titles and template.main else template.place(path), bool(main), data))
    # A block of nothing but template texts goes; one that says something else is kept whole.
    blocks = [b for b in blocks if any(x and x not in template.texts for x in (_squeeze(t) for _, _, t in b))]
    size = lambda inside: sum(len(_squeeze(x)) for b in blocks for _, m, x in b if m >= inside)
    within = size(True)
    # Articles decide what the template leaves open, unless most of the text lies elsewhere; a teaser is no main text.
    decided = within > 0 and within >= MAIN_SHARE * size(False)

    # Where such an article holds text of a main slot, other main slots are more than the article.
    whole = decided and any(p == "main" and m and x.strip() for b in blocks for p, m, x in b)

    def kept(place: str, inside: bool) -> bool:
        if fits and place:
            return (place == "main" and (inside or not whole)) or (decided and inside)
        return inside or not decided

    lines = (_squeeze("".join(x for p, m, x in b if kept(p, m))) for b in blocks)
    return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, url, text (empty if none).

    One row per row. Null html is empty, a null or odd URL belongs to the host ''. Repeated rows and
    null page_ids go through; extra columns are ignored; an empty table gives none.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    found = written(occurrence_classes(pages), "templates")
    cols = TEMPLATE
    if found.count() <= TEMPLATE_ROWS:
        held: dict[str, list] = {}
        for r in found.collect():  # at most TEMPLATE_ROWS
            held.setdefault(r.host, []).append(tuple(r[c] for c in cols))
        shared = spark.sparkContext.broadcast({k: tuple(sorted(v)) for k, v in held.items()})
        rows = pages.withColumn("_host", host_of("url")).withColumn("t", F.lit(None).cast("array<struct<token:string,class:bigint,support:bigint,pages:bigint,place:double,chars:bigint,times:bigint,texts:bigint>>"))
    else:
        shared = None
        per = found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("t"))  # a template, not the pages
        rows = pages.withColumn("_host", host_of("url")).join(per, F.col("_host") == F.col("host"), "left").select("page_id", "url", "html", "_host", "t")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select("page_id", "url").schema)

    def run(batches):
        for b in slices(batches):
            out = []
            for site, h, t in zip(b["_host"].to_pylist(), b["html"].to_pylist(), b["t"].to_pylist(), strict=True):
                known = shared.value.get(site, ()) if shared else tuple(tuple(x[c] for c in cols) for x in t or ())
                out.append(extract(h or "", _template(known)))
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, f"{kinds}, text string")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = main_text(read(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
