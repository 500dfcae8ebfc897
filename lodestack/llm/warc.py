"""Operator 7: WARC archives with a two-level capture index.

``write_archive`` lets every task write its pages to WARC 1.1 files of its own (each record a gzip
member) under names that no other attempt uses, through a file system that executors share; only
files of attempts that Spark accepted are in the index, so lost executors leave at most files that
nothing names. The index sorts captures by reversed-host URL key into compressed blocks, written one
after the other to index files; the sparse directory holds each block's first and last key and its
place. Blocks grow with the archive, so that the directory never has much more than ``DIRECTORY``
rows and is always broadcast. A look-up searches the directory by bisection, reads the blocks' byte
ranges, searches each by bisection, and then reads the records' byte ranges.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import new_path, read, slices, small, written

#: Captures of an index block, more where the directory would have more rows than DIRECTORY.
BLOCK, DIRECTORY = 2000, 100_000
#: Bytes after which a task starts a new file; span of a file read at once; bytes of records, and captures, for each task.
FILE_BYTES, SPAN, TASK_BYTES, TASK_CAPTURES = 256 << 20, 8 << 20, 64 << 20, 500_000
#: Smaller payloads are always written in full.
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Reversed host, then the path and query in lower case: ``com,example,www)/a?b``. Empty for no URL."""
    try:
        u = urlsplit(url or "")
        host, port = (u.hostname or ""), u.port
    except ValueError:  # not a URL: sorted as it is
        return re.sub(r"\s+", "%20", (url or "").lower())
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")
    return re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02x}", key.lower()) if url else ""


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record(page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, refers_to: tuple[int, int] | None) -> bytes:
    """One WARC record (uncompressed). ``row`` tells records of one page_id apart. With ``refers_to`` (page_id, row) a revisit: the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}:{row}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {safe}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to[0]}:{refers_to[1]}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """One uncompressed record -> headers, page_id, payload (None for a revisit), payload_bytes, payload_digest, record_type, refers_to."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if not lines[0].startswith("WARC/") or len(block) != int(h["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a damaged WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda x: int(m[1]) if x and (m := re.search(r"page:(-?\d+):", x)) else None
    digest, revisit = h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    return {"headers": h, "record_id": h["WARC-Record-ID"], "page_id": number(h["WARC-Record-ID"]), "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": number(h.get("WARC-Refers-To"))}


INDEX = "key string, page_id long, file string, offset long, length long, type string, digest string"


def write_archive(pages: DataFrame, path: str) -> None:
    """``pages`` (page_id, url, html) -> WARC files in ``path``/warc, index in ``path``/index and ``path``/directory.

    Texts may have any length. Null html is an empty payload, a null URL gives a record without a target, a null page_id one
    without a number. Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the
    smallest page_id are responses and the others revisit it. Extra columns are ignored; an empty
    table gives an archive without records.
    """
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.monotonically_increasing_id().alias("row"))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first")
    same = pages.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(least, F.count(F.lit(1)).alias("n"))
    same = small(written(same.where("n > 1").select(F.col("digest").alias("_digest"), "first"), "repeats"))
    rows = pages.join(same, F.col("digest") == F.col("_digest"), "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    rows = rows.select("page_id", "row", "url", "html", "digest", *[F.when(other, F.col(f"first.{c}")).alias(f"to_{c}") for c in ("page_id", "row")])
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("digest", pa.string())])

    def write(batches):
        fs, root = _filesystem(f"{path}/warc")
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for b in slices(batches):
                got = []
                for p, n, u, h, d, r, r_n in zip(*(b[c].to_pylist() for c in ("page_id", "row", "url", "html", "digest", "to_page_id", "to_row")), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        info = gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % str(uuid.uuid4()).encode(), mtime=0)
                        out.write(info)
                        at = len(info)
                    data = gzip.compress(record(p, n, u, h.encode(), d, None if r is None else (r, r_n)), 4, mtime=0)
                    out.write(data)
                    got.append((url_key(u), p, name, at, len(data), "response" if r is None else "revisit", d))
                    at += len(data)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), schema.types, strict=True)], schema=schema)
        finally:
            if out:
                out.close()

    captures = written(rows.mapInArrow(write, INDEX), "captures")
    build_index(captures, path)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def build_index(captures: DataFrame, path: str) -> None:
    """Sort captures (columns of INDEX; written) into compressed blocks in ``path``/index, and write their directory."""
    schema = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("n", pa.int64()), ("bytes", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    total = captures.count()
    lines = max(BLOCK, -(-total // DIRECTORY))

    def pack(batches):
        fs, root = _filesystem(f"{path}/index")
        fs.create_dir(root, recursive=True)
        name, out, at, held, size = f"{uuid.uuid4().hex}.idx", None, 0, [], 0

        def close():
            nonlocal out, at
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            data = zlib.compress("\n".join(held).encode(), 6)
            out.write(data)
            at += len(data)
            keys = held[0].split(" ", 1)[0], held[-1].split(" ", 1)[0]
            row = (*keys, len(held), size, name, at - len(data), len(data))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

        try:
            for b in batches:
                for row in b.to_pylist():
                    key = row.pop("key")
                    held.append(f"{key} {json.dumps(row, separators=(',', ':'))}")
                    size += row["length"]
                    if len(held) == lines:
                        yield close()
                        held, size = [], 0
            if held:
                yield close()
        finally:
            if out:
                out.close()

    order = ["key", "file", "offset"]
    n = max(1, min(_partitions(captures.sparkSession), total // lines), -(-total // max(lines, TASK_CAPTURES)))
    blocks = captures.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(pack, "first_key string, last_key string, n long, bytes long, file string, offset long, length long")
    blocks.write.parquet(f"{path}/directory")


def _directory(spark: SparkSession, path: str) -> list:
    """The sparse directory in order of keys: DIRECTORY rows, and at most one more for each task that wrote it."""
    return sorted(spark.read.parquet(f"{path}/directory").collect())


def _reader(folder: str):
    """A function (file, offset, length) -> bytes that keeps the last file open."""
    fs, root = _filesystem(folder)
    name, f = None, None

    def get(file: str, offset: int, length: int) -> bytes:
        nonlocal name, f
        if file != name:
            if f:
                f.close()
            name, f = file, fs.open_input_file(f"{root}/{file}")
        return f.read_at(length, offset)

    return get


def _lines(data: bytes) -> list[str]:
    return zlib.decompress(data).decode().split("\n")


def index_entries(spark: SparkSession, path: str) -> DataFrame:
    """All captures of the index (columns of INDEX), block by block."""
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("digest", pa.string())])

    def run(batches):
        get = _reader(f"{path}/index")
        for b in batches:
            for x in zip(*(b[c].to_pylist() for c in ("file", "offset", "length")), strict=True):
                rows = [{"key": k, **json.loads(v)} for k, v in (line.split(" ", 1) for line in _lines(get(*x)))]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.parquet(f"{path}/directory").select("file", "offset", "length").mapInArrow(run, INDEX)


def url_keys(pages: DataFrame) -> DataFrame:
    """``pages`` (url) -> key: the distinct URL keys; a null URL has the empty key."""
    schema = pa.schema([("key", pa.string())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b["url"].to_pylist()], pa.string())], schema=schema)

    return pages.select("url").distinct().mapInArrow(run, "key string").distinct()


def blocks_of(keys: DataFrame, path: str) -> DataFrame:
    """``keys`` (key) -> block (its place in the directory), key: every block that may hold a key, found by bisection in the directory."""
    rows = _directory(keys.sparkSession, path)
    shared = keys.sparkSession.sparkContext.broadcast(([r.first_key for r in rows], [r.last_key for r in rows]))
    schema = pa.schema([("block", pa.int64()), ("key", pa.string())])

    def run(batches):
        firsts, lasts = shared.value
        for b in batches:
            at, found = [], []
            for k in b["key"].to_pylist():
                # Blocks are in order, so both key columns are: those that begin at k or before, and end at k or after.
                for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k)):
                    at.append(i)
                    found.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found, pa.string())], schema=schema)

    return keys.mapInArrow(run, "block long, key string")


def find_captures(keys: DataFrame, path: str) -> DataFrame:
    """``keys`` (key) -> file, offset, length of each capture: the directory's blocks are read by their ranges and searched by bisection.

    A key captured many times fills many blocks, which are searched by different tasks. Keys without
    a capture give no rows, as does an empty archive.
    """
    rows = _directory(keys.sparkSession, path)
    places = keys.sparkSession.sparkContext.broadcast([(r.file, r.offset, r.length) for r in rows])
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        get, now, lines = _reader(f"{path}/index"), -1, []
        for b in batches:
            got = []
            for block, k in zip(b["block"].to_pylist(), b["key"].to_pylist(), strict=True):
                if block != now:
                    now, lines = block, _lines(get(*places.value[block]))
                i = bisect.bisect_left(lines, f"{k} ")
                while i < len(lines) and lines[i].startswith(f"{k} "):
                    x = json.loads(lines[i][len(k) + 1 :])
                    got.append((x["file"], x["offset"], x["length"]))
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate(schema.types)], schema=schema)

    n = max(1, min(_partitions(keys.sparkSession), len(rows)), -(-sum(r.n for r in rows) // TASK_CAPTURES))
    return blocks_of(keys, path).repartition(n, "block").sortWithinPartitions("block", "key").mapInArrow(run, "file string, offset long, length long")


RECORDS = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_records(entries: DataFrame, path: str, headers: bool = False) -> DataFrame:
    """Range-read the records of index ``entries`` (file, offset, length): columns of RECORDS (record_id if ``headers``). Neighbouring ranges of a file are read together.

    The archive's bytes are dealt out to tasks by spans of its files. Entries that repeat give rows that repeat.
    """
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        get = _reader(f"{path}/warc")
        for b in batches:
            todo = list(zip(*(b[c].to_pylist() for c in ("file", "offset", "length")), strict=True))
            i = 0
            while i < len(todo):
                j = i + 1
                while j < len(todo) and todo[j][0] == todo[i][0] and todo[j][1] == todo[j - 1][1] + todo[j - 1][2] and todo[j][1] - todo[i][1] < SPAN:
                    j += 1
                start = todo[i][1]
                data = get(todo[i][0], start, todo[j - 1][1] + todo[j - 1][2] - start)
                got = [parse(gzip.decompress(data[off - start : off - start + n])) for _, off, n in todo[i:j]]
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in got], schema=schema)
                i = j

    spark = entries.sparkSession
    size = spark.read.parquet(f"{path}/directory").agg(F.sum("bytes")).first()[0] or 0
    n = max(_partitions(spark), -(-size // TASK_BYTES))
    piece = (F.col("offset") / SPAN).cast("long")
    got = entries.select("file", "offset", "length").repartition(n, "file", piece).sortWithinPartitions("file", "offset").mapInArrow(run, RECORDS)
    return got if headers else got.drop("record_id")


def look_up(spark: SparkSession, path: str, urls: list[str]) -> DataFrame:
    """Records captured under ``urls`` (a short list)."""
    keys = spark.createDataFrame([(k,) for k in sorted({url_key(u) for u in urls})], "key string")
    return read_records(find_captures(keys, path), path)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    pages = read(spark, sf_dir, "pages")
    write_archive(pages, path)
    return read_records(find_captures(url_keys(pages), path), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to
FROM d
"""
