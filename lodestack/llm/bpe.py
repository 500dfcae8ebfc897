"""Operator 6: BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that its encoding can end with. It is found
from left to right: the automaton over all tokens' strings gives the tokens that are suffixes of
the prefix; such a token is the last one if the prefix before it ends with a token that it is
compatible with, that is, if BPE applied to the two tokens' string gives just these two. The
back-pointers from the whole word then give its ids, exactly those that merging by rank gives.

Texts are normalised and cut into words as the tokenizers library does for the given file (NFC,
white space runs to one blank, lower case; its word pattern; added tokens cut out first). A slice
of texts is split at blanks by Arrow, so that each distinct string between blanks is looked at once,
and a worker encodes each of its words once while it remembers it. Characters that Python's tables
do not know yet (unassigned there) may be letters to the library: texts with them are encoded by it.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import read, slices

#: Words that a worker remembers, and as many from before.
CACHE = 250_000
#: The last character of a word stands this much higher in the automaton's alphabet: the sign of the word's end.
LAST = 0x1000


def _byte_chars() -> list[str]:
    """The printable character of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + rest.index(b)) for b in range(256)]


class PrefixBpe:
    """A BPE vocabulary whose ids (after the single characters) are in the order of the merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        import ahocorasick

        self.end = end
        flat = lambda t: t[: -len(end) - 1] + chr(ord(t[-len(end) - 1]) + LAST) if end and t.endswith(end) and len(t) > len(end) else t
        self.pairs = {(vocab[a], vocab[b]): vocab[a + b if not (end and a.endswith(end)) else a[: -len(end)] + b] for a, b in merges}
        self.split = {i: (i, i) for i in vocab.values()}
        for (a, b), i in self.pairs.items():
            if self.split[i] != (i, i):
                raise ValueError("two merges give one token")
            if i <= max(a, b):
                raise ValueError("ids are not in the order of the merges")
            self.split[i] = (a, b)
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            self.automaton.add_word(flat(t), (i, len(flat(t))))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' string is just (a, b): no merge across the border comes before those that made them."""
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) > 200_000:
                self.fits.clear()
            self.fits[key] = self._compatible(a, b)
        return self.fits[key]

    def _compatible(self, a: int, b: int) -> bool:
        limit = 1 << 62
        while True:
            made = self.pairs.get((a, b))
            if made is not None and made < limit:
                return False
            # Undo the later of the two tokens' merges; the border's neighbours are then older.
            if a > b:
                limit = a
                a = self.split[a][1]
                if a == limit:
                    limit = b + 1
                    b = self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = self.split[b][0]
                if b + 1 == limit:
                    limit = a
                    a = self.split[a][1]
                    if a == limit:
                        return True

    def encode(self, word: str) -> list[int]:
        """Ids of a word of byte characters (without the end sign)."""
        s = word[:-1] + chr(ord(word[-1]) + LAST) if self.end else word
        n = len(s)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        seen = [False] * (n + 1)
        seen[0] = True
        for at, (token, size) in self.automaton.iter(s):
            at += 1
            if seen[at]:
                continue
            before = at - size
            if before == 0 or (seen[before] and self.compatible(last[before], token)):
                last[at], back[at], seen[at] = token, before, True
        if not seen[n]:
            raise ValueError(f"the vocabulary does not cover {word!r}")
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]


class WordTokenizer:
    """Encodes and decodes texts for a tokenizers-library file of this kind (see the module's text)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        pre = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pre] != ["Split", "ByteLevel"] or spec["decoder"]:
            raise ValueError("a tokenizer of another kind")
        self.path, self.lib = path, None
        self.bpe = PrefixBpe(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.words = regex.compile(pre[0]["pattern"]["Regex"]).findall
        self.chars = _byte_chars()
        added = spec["added_tokens"]
        self.name = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in added}
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = regex.compile("(" + "|".join(regex.escape(k) for k in sorted(self.added, key=len, reverse=True)) + ")").split
        self.known: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def _entry(self, ids: list[int]) -> tuple[bytes, str]:
        return np.array(ids, "<u4").tobytes(), " ".join([self.name[i] for i in ids])

    def _by_library(self, text: str) -> tuple[bytes, str]:
        if self.lib is None:
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(self.path)
        return self._entry(self.lib.encode(text, add_special_tokens=False).ids)

    def _word(self, w: str) -> tuple[bytes, str] | None:
        """A new word's ids and tokens; None if a character is unassigned."""
        got = self.old.get(w)
        if got is None:
            if not w.isascii() and any(unicodedata.category(c) == "Cn" for c in w):
                return None
            got = self._entry(self.bpe.encode("".join([self.chars[b] for b in w.encode()])))
        self.known[w] = got
        return got

    def _string(self, s: str) -> tuple[bytes, str] | None:
        """Ids and tokens of a normalised string; None if the library has to be asked."""
        known = self.known
        parts = [known.get(w) or self._word(w) for w in self.words(s)]
        if len(parts) == 1:
            return parts[0]
        return None if None in parts else (b"".join([x[0] for x in parts]), " ".join([x[1] for x in parts]))

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the library lower-cases one character at a time
        return text.lower()

    def encode_decode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and what decoding them gives."""
        parts = []
        for x in self.cut(text) if any(k in text for k in self.added) else [text]:
            got = self._entry([self.added[x]]) if x in self.added else self._string(self.normal(x))
            if got is None:
                return self._by_library(text)
            if got[0]:
                parts.append(got)
        return b"".join([x[0] for x in parts]), " ".join([x[1] for x in parts])

    def encode_decode_all(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """encode_decode of each text."""
        if len(self.known) > CACHE:  # what is still in use comes back from the old words
            self.old, self.known = self.known, {}
        split = pc.split_pattern(pa.array([self.normal(t).replace("\n", " ") for t in texts], pa.string()), " ")
        at = split.flatten().dictionary_encode()
        found = [self._string(w) for w in at.dictionary.to_numpy(zero_copy_only=False).tolist()]
        where, ends = at.indices.to_numpy(), split.offsets.to_numpy() - split.offsets[0].as_py()
        # Strings without a word (empty, or other white space) are no part of what decoding gives.
        filled = np.array([x is None or len(x[0]) > 0 for x in found], bool)[where]
        odd = np.array([x is None for x in found], bool)[where]
        sums = lambda x: np.concatenate([[0], np.cumsum(x)])[ends]
        offsets, take = pa.array(sums(filled), pa.int32()), pa.array(where[filled])
        out = []
        for i, (kind, sep) in enumerate(((pa.binary(), b""), (pa.string(), " "))):
            parts = pa.array([x[i] if x else sep[:0] for x in found], kind).take(take)
            out.append(pc.binary_join(pa.ListArray.from_arrays(offsets, parts), pa.scalar(sep, kind)).to_numpy(zero_copy_only=False).tolist())
        special = np.array([any(k in t for k in self.added) for t in texts], bool)
        for i in np.flatnonzero(special | (np.diff(sums(odd)) > 0)).tolist():
            out[0][i], out[1][i] = self.encode_decode(texts[i])
        return out[0], out[1]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, the library joins the tokens' names with blanks."""
        return " ".join([self.name[i] for i in ids])


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, ids (binary, little-endian unsigned 32-bit), decoded (string).

    One row per row. Null text is empty (no ids, empty text). Rows that repeat each other and null
    doc_ids go through; extra columns are ignored; an empty table gives none.
    """
    id_type = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches):
        t = tokenizer(path)
        for b in slices(batches, 2000, 4 << 20):
            ids, decoded = t.encode_decode_all([x or "" for x in b["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type.simpleString()}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """What encode_decode gives -> doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
