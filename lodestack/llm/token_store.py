"""Operator 4: token ids in a binary file format with a shared zstandard dictionary.

A store is a folder with two Parquet tables that Spark writes and commits (so lost tasks are
simply run again, on any file system that Spark knows): ``dictionary`` (hash, bytes) and
``blocks`` (part, block, first_doc, last_doc, n_docs, n_tokens, data). ``data`` is one block file:

    magic "TIDB", version u8, width u8 (2 or 4 bytes an id), n_docs u32, dictionary sha256 (32 bytes),
    index: n_docs x (doc_id i64, frame offset u64, n_tokens u32), then the zstandard frames.

All numbers are little-endian. Each document is a frame of its own, compressed with the shared
dictionary (trained on serialized id arrays), so one document is read by a binary search in the
index and one frame. Blocks are in ascending doc_id order within and across parts.
"""

from __future__ import annotations

import codecs
import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestack.llm.common import new_path, read, slices, written

MAGIC = b"TIDB"
HEAD = struct.Struct("<4sBBI32s")
INDEX = np.dtype([("doc", "<i8"), ("off", "<u8"), ("n", "<u4")])
#: A block is closed when its frames reach this many bytes.
BLOCK_BYTES = 1 << 20
#: The dictionary is trained on at most this many documents (and ids a document) and has at most so many bytes.
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES = 2000, 4096, 64 << 10
#: Bytes of words that a worker remembers, and as many from before; what an entry takes besides its word and ids.
CACHE, ENTRY = 88 << 20, 220
#: Bytes of frames for each range of ids that one task writes.
RANGE_BYTES = 64 << 20
#: Fixed value: the splitting pattern of byte-level BPE (its pieces are encoded one by one).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_table() -> str:
    """The printable character of each byte in byte-level vocabularies, as a decoding table."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return "".join(chr(b) if b in plain else chr(0x100 + rest.index(b)) for b in range(256))


class PieceEncoder:
    """The tokenizers library's encoding of texts, from words that were met before.

    The library cuts a text into pieces and encodes each on its own. A blank before a word belongs to
    the word's first piece, so a text is the sum of its words, split at blanks, unless a word is empty
    or begins with white space; such a text is cut into pieces as a whole. Arrow splits a slice of
    texts and finds its distinct words; only words not remembered go to the library's model.
    """

    def __init__(self, path: str, width: int):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenize = Tokenizer.from_file(path).model.tokenize
        self.kind, self.table = {2: "H", 4: "I"}[width], _byte_table()
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}
        self.held = self.held_inner = 0
        self.pieces = regex.compile(PIECES).findall
        with open(path, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.added = {k: v.to_bytes(width, "little") for k, v in added.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(k) for k in sorted(added, key=len, reverse=True)) + ")").split if added else None

    def _ids(self, pieces: list[str]) -> bytes:
        ids = [t.id for p in pieces for t in self.tokenize(codecs.charmap_decode(p.encode(), "strict", self.table)[0])]
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens, piece by piece."""
        return self._ids(self.pieces(text))

    def encode(self, text: str) -> bytes:
        """Ids of one text, ``width`` bytes each; nothing is remembered."""
        if self.cut and any(k in text for k in self.added):
            return b"".join(self.added.get(x) or self._plain(x) for x in self.cut(text) if x)
        return self._plain(text)

    def _learn(self, word: str) -> bytes:
        """Ids of a new word with a blank before it: its first piece is a word too, the others (signs, a next line) are known by themselves."""
        first, *rest = self.pieces(" " + word)
        stem = first[1:]
        ids = self.words.get(stem) or self.old.get(stem) or self._ids([first])
        self._keep(stem, ids)
        for p in rest:
            if p not in self.inner:
                self.inner[p] = self._ids([p])
                self.held_inner += ENTRY + len(p) + len(self.inner[p])
            ids += self.inner[p]
        return ids

    def _keep(self, word: str, ids: bytes) -> bytes:
        if word not in self.words:
            self.held += ENTRY + len(word) + len(ids)
        self.words[word] = ids
        return ids

    def _known(self, words: list[str], used: list[bool]) -> list[bytes]:
        """Ids of each used word with a blank before it."""
        if self.held > CACHE:  # what is still in use comes back from the old words
            self.old, self.words, self.held = self.words, {}, 0
        if self.held_inner > CACHE // 4:
            self.inner, self.held_inner = {}, 0
        known, old = self.words, self.old
        out = [known.get(w) if u else b"" for w, u in zip(words, used, strict=True)]
        for i, x in enumerate(out):
            if x is None:
                w = words[i]
                out[i] = self._keep(w, old.get(w) or self._learn(w))
        return out

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (no nulls)."""
        if not len(texts):
            return []
        split = pc.split_pattern(texts, " ")
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        at = split.flatten().dictionary_encode()
        words, where = at.dictionary.to_numpy(zero_copy_only=False).tolist(), at.indices.to_numpy().copy()
        # A text's first word has no blank before it.
        firsts, starts = [words[i] for i in where[ends[:-1]]], ends[:-1]
        plain = np.array([bool(w) and not w[0].isspace() for w in words])
        whole = plain[where]
        whole[starts] = True
        good = np.minimum.reduceat(whole, starts)
        for k in self.added:
            good &= ~pc.match_substring(texts, k).to_numpy(zero_copy_only=False)
        used = np.zeros(len(words), bool)
        inner = np.repeat(good, np.diff(ends))
        inner[starts] = False
        used[where[inner]] = True
        where[starts] = np.arange(len(words), len(words) + len(texts))
        data = self._known(words, used.tolist()) + [self._plain(w) if g else b"" for w, g in zip(firsts, good.tolist(), strict=True)]
        ids = pa.array(data, pa.binary()).take(pa.array(where))
        out = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), pa.scalar(b"", pa.binary())).to_numpy(zero_copy_only=False).tolist()
        for i in np.flatnonzero(~good).tolist():
            out[i] = self.encode(texts[i].as_py())
        return out


_ENCODERS: dict = {}


def encoder(path: str, width: int) -> PieceEncoder:
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = PieceEncoder(path, width)
    return _ENCODERS[path, width]


def id_width(path: str) -> int:
    """Two bytes an id if the whole vocabulary fits, else four."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def write_block(docs: list[tuple[int, int, bytes]], dict_hash: bytes, width: int) -> bytes:
    """(doc_id, n_tokens, frame) in ascending doc_id order -> one block file."""
    index = np.zeros(len(docs), INDEX)
    ends = np.cumsum([0] + [len(f) for _, _, f in docs])
    index["doc"], index["n"], index["off"] = [d for d, _, _ in docs], [n for _, n, _ in docs], ends[:-1]
    return b"".join([HEAD.pack(MAGIC, 1, width, len(docs), dict_hash), index.tobytes(), *[f for _, _, f in docs]])


class Block:
    """Reads one block file; checks that its dictionary is the one given."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        magic, version, self.width, n, dict_hash = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token block")
        if dict_hash != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        self.index = np.frombuffer(data, INDEX, n, HEAD.size)
        self.frames = memoryview(data)[HEAD.size + n * INDEX.itemsize :]
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids_at(self, i: int) -> np.ndarray:
        off = int(self.index["off"][i])
        end = int(self.index["off"][i + 1]) if i + 1 < len(self.index) else len(self.frames)
        return np.frombuffer(self.zstd.decompress(self.frames[off:end]), f"<u{self.width}")

    def ids(self, doc_id: int) -> np.ndarray | None:
        """Ids of one document: binary search in the index, one frame."""
        i = int(np.searchsorted(self.index["doc"], doc_id))
        return self.ids_at(i) if i < len(self.index) and self.index["doc"][i] == doc_id else None


def _train(docs: DataFrame, path: str, width: int, end_id: int) -> bytes:
    """A dictionary from a bounded sample: SAMPLE_DOCS documents by hash, about SAMPLE_IDS ids of each. Empty if there is too little.

    Of a longer text the sample is a span that begins anywhere, by the same hash.
    """
    import zstandard

    n = docs.count()
    h, span, long = F.xxhash64("doc_id"), 4 * SAMPLE_IDS, F.length("text")
    some = docs.where(F.pmod(h, F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, 1.5 * SAMPLE_DOCS / max(1, n))))
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), long - span)).cast("int") + 1
    texts = some.select(h.alias("h"), F.substring("text", start, F.lit(span)).alias("text")).orderBy("h", "text").limit(SAMPLE_DOCS).select("text")

    def run(batches):
        enc = encoder(path, width)
        for b in slices(batches):
            yield pa.RecordBatch.from_pydict({"ids": [x[: SAMPLE_IDS * width] + end_id.to_bytes(width, "little") for x in enc.encode_all(b["text"])]}, schema=pa.schema([("ids", pa.binary())]))

    samples = [bytes(r.ids) for r in texts.mapInArrow(run, "ids binary").toLocalIterator()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short samples to learn from
        return b""


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode ``docs`` (doc_id, text) with a tokenizers-library file, append ``end_id`` to each document, write a store.

    Null text is empty; a null doc_id is refused (the format is ordered by it). Rows that repeat a
    doc_id are all kept, side by side. Extra columns are ignored. An empty table gives a store
    without blocks.
    """
    spark = docs.sparkSession
    docs = docs.select(F.when(F.col("doc_id").isNull(), F.raise_error(F.lit("doc_id is null"))).otherwise(F.col("doc_id").cast("long")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    width = id_width(tokenizer)
    dictionary = _train(docs, tokenizer, width, end_id)
    dict_hash = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(dict_hash.hex(), bytearray(dictionary))], "hash string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    end = end_id.to_bytes(width, "little")
    frame_schema = pa.schema([("doc_id", pa.int64()), ("salt", pa.int64()), ("n", pa.int32()), ("frame", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = encoder(tokenizer, width)
        d = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        z = zstandard.ZstdCompressor(level=3, dict_data=d)
        for b in slices(batches, 4000):
            ids = [x + end for x in enc.encode_all(b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["salt"], pa.array([len(x) // width for x in ids], pa.int32()), pa.array([z.compress(x) for x in ids], pa.binary())], schema=frame_schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            return pa.RecordBatch.from_pydict({"part": [part], "block": [block], "first_doc": [held[0][0]], "last_doc": [held[-1][0]], "n_docs": [len(held)], "n_tokens": [sum(n for _, n, _ in held)], "data": [write_block(held, dict_hash, width)]}, schema=block_schema)

        for b in batches:
            for row in zip(b["doc_id"].to_pylist(), b["n"].to_pylist(), b["frame"].to_pylist(), strict=True):
                held.append(row)
                size += len(row[2])
                if size >= BLOCK_BYTES:
                    yield close()
                    block, held, size = block + 1, [], 0
        if held:
            yield close()

    block_schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("data", pa.binary())])
    # The salt parts rows that repeat a doc_id, however many there are.
    frames = docs.withColumn("salt", F.monotonically_increasing_id()).mapInArrow(encode, "doc_id long, salt long, n int, frame binary")
    frames = written(frames, "frames")
    size = frames.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    frames = frames.repartitionByRange(n, "doc_id", "salt").sortWithinPartitions("doc_id", "salt").drop("salt")
    frames.mapInArrow(pack, "part int, block int, first_doc long, last_doc long, n_docs int, n_tokens long, data binary").write.parquet(f"{path}/blocks")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().bytes)  # at most DICT_BYTES
    shared = spark.sparkContext.broadcast(dictionary)
    blocks = spark.read.parquet(f"{path}/blocks")
    # Sums before a block: within its part by a window, of the parts before it by one over a row a part.
    sizes = blocks.select("part", "block", "n_tokens")
    before = sizes.select("part", "block", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")).alias("a"))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("b"))
    starts = before.join(parts, "part").select("part", "block", (F.col("a") + F.col("b")).alias("start"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, start in zip(b["data"].to_pylist(), b["start"].to_pylist(), strict=True):
                block = Block(data, shared.value)
                n = block.index["n"].astype("i8")
                ids = [block.ids_at(i).astype("<u4").tobytes() for i in range(len(n))]
                yield pa.RecordBatch.from_arrays([pa.array(block.index["doc"].astype("i8")), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(ids, pa.binary())], schema=schema)

    joined = blocks.join(F.broadcast(starts) if starts.count() <= 200_000 else starts, ["part", "block"])
    return joined.select("data", "start").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def fetch(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """Ids of one document: the block by its id range (pushed down to the Parquet statistics), then one frame."""
    rows = spark.read.parquet(f"{path}/blocks").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).select("data").take(1)
    if not rows:
        return None
    got = Block(bytes(rows[0].data), bytes(spark.read.parquet(f"{path}/dictionary").first().bytes)).ids(doc_id)
    return None if got is None else got.tolist()


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-store")
    write_store(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
