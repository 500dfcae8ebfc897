"""Archive members and extracted text."""

from __future__ import annotations

import io
import itertools
import re
import shutil
import tempfile
import zipfile
import zlib
from hashlib import sha256
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources import pdf, seven_zip
from lodestack.sources.files import open_file
from lodestack.sources.frontmatter import readable

MEMBERS = "archive string, member string, size long, compressed long, crc32 long, sha string, crc_ok boolean, depth int, status string"
#: Nested archives that are opened, and how far a member may expand.
MAX_DEPTH, MAX_RATIO = 6, 1000
#: Bytes of a member in memory at once; nested archives beyond KEPT are spooled by their task, as long as RESERVE bytes of its disk stay free.
PIECE, KEPT, RESERVE = 1 << 20, 64 << 20, 1 << 30
ROWS = 1000
ARCHIVES = (".zip", ".7z")


def fits(size: int, reserve: int = RESERVE) -> bool:
    """Whether a nested archive of this size may be spooled: in memory, or with ``reserve`` bytes left on the task's disk."""
    return size <= KEPT or size + reserve <= shutil.disk_usage(tempfile.gettempdir()).free


def _members(archive: str, file, prefix: str, depth: int, hashes: bool, most: int):
    """Rows of an archive's members, nested ones too; the kind of archive is told by its first bytes."""
    try:
        file.seek(0)
        kind = _seven_zip if bytes(file.read(6)) == seven_zip.SIGNATURE else _zip
        file.seek(0)
        entries = kind(file)
    except (zipfile.BadZipFile, NotImplementedError, OSError, ValueError):  # Arrow's seek beyond a file's ends is a ValueError
        yield archive, prefix.rstrip("!"), None, None, None, None, None, depth, "error"
        return
    for path, size, compressed, crc, status, pieces in entries:
        name, row = prefix + path, (size, compressed, crc)
        if status == "ok" and unsafe(path):
            status = "unsafe_path"
        if status != "ok" or not hashes:
            yield archive, name, *row, None, None, depth, status
            continue
        nested = path.lower().endswith(ARCHIVES)
        if nested and depth < most and not fits(size):
            yield archive, name, *row, None, None, depth, "no_space"
            continue
        with tempfile.SpooledTemporaryFile(KEPT) as body:
            sha, got = sha256(), 0
            try:
                for piece in pieces():
                    sha.update(piece)
                    got = zlib.crc32(piece, got)
                    if nested:
                        body.write(piece)
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, seven_zip.Damaged):
                yield archive, name, *row, None, False, depth, "error"
                continue
            if crc is not None and got != crc:
                yield archive, name, *row, None, False, depth, "error"
                continue
            yield archive, name, *row, sha.hexdigest(), None if crc is None else True, depth, "ok"
            if nested and depth >= most:
                yield archive, name + "!", None, None, None, None, None, depth + 1, "max_depth"
            elif nested:
                body.seek(0)
                yield from _members(archive, body, name + "!", depth + 1, hashes, most)


def _expands(size: int, compressed: int) -> bool:
    return bool(size) and (compressed == 0 or size / compressed > MAX_RATIO)


def _zip(file):
    """(path, size, compressed, crc, status, pieces) of a zip file's members."""
    z = zipfile.ZipFile(file)

    def pieces(i):
        with z.open(i) as f:
            while piece := f.read(PIECE):
                yield piece

    def entries():
        for i in z.infolist():
            if not i.is_dir():
                status = "encrypted" if i.flag_bits & 1 else "unsafe_path" if unsafe(i.filename) else "expansion" if _expands(i.file_size, i.compress_size) else "ok"
                yield i.filename, i.file_size, i.compress_size, i.CRC, status, lambda i=i: pieces(i)

    return entries()


def _seven_zip(file):
    """The same of a 7z file. Members of a folder are one stream: it is read on as they are asked for; those passed over are read and dropped.

    A member's packed size is known only if it has its folder alone.
    """
    folders, members = seven_zip.read_header(file)

    def entries():
        at, stream, ahead = None, None, 0
        for m in members:
            if m.is_dir:
                continue
            if m.folder is None:
                yield m.name, 0, 0, None, "ok", lambda: iter(())
                continue
            f = folders[m.folder]
            packed = sum(f.packs)
            if m.folder != at:
                at, ahead, status = m.folder, 0, "expansion" if _expands(f.size, packed) else "ok"
                if status == "ok":
                    try:
                        stream = seven_zip.Pieces(file, f)
                        seven_zip._steps(f)
                    except seven_zip.Unsupported as e:
                        status = "encrypted" if str(e) == "encrypted" else "unsupported"
                    except seven_zip.Damaged:
                        status = "error"
            read = []

            def pieces(m=m, skip=ahead, read=read, stream=stream):
                read.append(True)
                for _ in seven_zip.file_pieces(stream, skip):
                    pass
                yield from seven_zip.file_pieces(stream, m.size)

            yield m.name, m.size, packed if len(f.files) == 1 else None, m.crc, status, pieces
            ahead = 0 if read else ahead + m.size

    return entries()


def unsafe(name: str) -> bool:
    """Whether a member would land outside of its folder."""
    parts = name.replace("\\", "/").split("/")
    return name.startswith(("/", "\\")) or ".." in parts or bool(re.match(r"[A-Za-z]:", name))


def archive_members(archives: DataFrame, hashes: bool = True, max_depth: int = MAX_DEPTH) -> DataFrame:
    """path of zip and 7z files -> their members, those of nested ones as ``outer.zip!inner/x``; hashes and CRC checks unless only listed.

    Archives and members may have any size: executors read them in pieces. Members that would expand
    too far or leave the folder are reported and not read, nested ones that the task's disk cannot
    hold have the status ``no_space``; an archive that cannot be opened is a row of status ``error``,
    ``denied`` or ``missing``.
    """
    names = [c.split()[0] for c in MEMBERS.split(", ")]

    def run(batches):
        for pdf in batches:
            for path in pdf["path"]:
                prefix = f"{path.rsplit('/', 1)[-1]}!"
                frame = lambda rows: pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("size", "compressed", "crc32")})
                try:
                    store, at = open_file(path)
                    with store.open_input_file(at) as f:
                        found = _members(path, f, prefix, 1, hashes, max_depth)
                        while rows := list(itertools.islice(found, ROWS)):
                            yield frame(rows)
                except OSError as e:
                    status = "denied" if isinstance(e, PermissionError) else "missing" if isinstance(e, FileNotFoundError) else "error"
                    yield frame([(path, prefix.rstrip("!"), None, None, None, None, None, 1, status)])

    return archives.select("path").mapInPandas(run, MEMBERS)


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[zZ][iI][pP],7[zZ]}").load(root)


def chain(member: Column) -> Column:
    """``a.zip!b.zip!c`` -> array of struct(kind, path), the file first."""
    parts = F.split(member, "!")
    return F.transform(parts, lambda p, i: F.struct(F.when(i == 0, "FILE").otherwise("ARCHIVE_MEMBER").alias("kind"), p.alias("path")))


# The codes of failures, by what was seen. Archives that go too deep count as oversized.
FAILURES = {
    "denied": "PERMISSION_DENIED",
    "missing": "T7_UNAVAILABLE",
    "no_space": "INSUFFICIENT_DISK_SPACE",
    "expansion": "OVERSIZED_OR_EXPANSION_LIMIT",
    "max_depth": "OVERSIZED_OR_EXPANSION_LIMIT",
    "error": "MALFORMED_ARCHIVE",
    "unsafe_path": "MALFORMED_ARCHIVE",
    "encrypted": "EXTRACTION_ERROR_OTHER",
}


def failure_code(status: Column) -> Column:
    """struct(code, retryable), null for ``ok`` and null; an unknown status is EXTRACTION_ERROR_OTHER. Only the depth limit can never be cured by another try."""
    code = F.lit("EXTRACTION_ERROR_OTHER")
    for seen, name in FAILURES.items():
        code = F.when(status == seen, name).otherwise(code)
    return F.when(status != "ok", F.struct(code.alias("code"), (status != "max_depth").alias("retryable")))


def _xml_text(data: bytes, paragraph: str, text: str) -> str:
    root = ElementTree.fromstring(data)
    return "\n".join("".join(t.text or "" for t in p.iter(text)) for p in root.iter(paragraph))


def _office(data: bytes, suffix: str) -> str:
    z = zipfile.ZipFile(io.BytesIO(data))
    w, a, s = ("{http://schemas.openxmlformats.org/%s/2006/main}" % k for k in ("wordprocessingml", "drawingml", "spreadsheetml"))
    number = lambda n: int(re.findall(r"\d+", n)[-1])
    if suffix == ".docx":
        return _xml_text(z.read("word/document.xml"), f"{w}p", f"{w}t")
    if suffix == ".pptx":
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
        return "\n".join(_xml_text(z.read(n), f"{a}p", f"{a}t") for n in names)
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in i.iter(f"{s}t")) for i in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{s}si")]
    rows = []
    for n in sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=number):
        for r in ElementTree.fromstring(z.read(n)).iter(f"{s}row"):
            cells = []
            for c in r.iter(f"{s}c"):
                v = c.find(f"{s}v")
                if c.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{s}t")))
                elif v is not None and v.text is not None:
                    cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
            rows.append("\t".join(cells))
    return "\n".join(rows)


def text_of(name: str, data: bytes) -> str | None:
    """Text by suffix (a conflict number is allowed: ``.pdf_123``); None where the file cannot be read."""
    suffix = re.sub(r"^(\.[a-z0-9]+)_\d+$", r"\1", (re.search(r"[^/](\.[^./]+)$", name.lower()) or ["", ""])[1])
    try:
        if suffix in (".docx", ".pptx", ".xlsx"):
            text = _office(data, suffix)
        elif suffix == ".pdf":
            text = "\n".join(pdf.page_texts(data))
        else:
            text = data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8")
    except (UnicodeDecodeError, zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError):
        return None
    if suffix == ".md":
        text = readable(text)
    return text.replace("\0", "")


def extract_text(files: DataFrame) -> DataFrame:
    """path, content -> path, text (null: unreadable)."""

    @F.pandas_udf("string")
    def run(path: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([text_of(p, bytes(c)) for p, c in zip(path, content, strict=True)], dtype=object)

    return files.select("path", run("path", "content").alias("text"))


def pdf_pages(files: DataFrame) -> DataFrame:
    """path, content -> path, page (from 1), text: a row for each page of each PDF file; one with a null page where a file cannot be read."""

    def run(batches):
        for pdf_ in batches:
            for path, content in zip(pdf_["path"], pdf_["content"], strict=True):
                try:
                    texts = pdf.page_texts(bytes(content))
                    rows = [(path, i + 1, t.replace("\0", "")) for i, t in enumerate(texts)]
                except ValueError:
                    rows = [(path, None, None)]
                yield pd.DataFrame(rows, columns=["path", "page", "text"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string")


def safe_name(name: str, most: int = 120) -> str:
    """A relative path without unsafe parts, each part shortened with its suffix kept."""
    parts = [re.sub(r'[<>:"|?*\x00-\x1f]', "_", p).strip(" .") or "_" for p in name.replace("\\", "/").split("/") if p not in ("", ".", "..")]
    cut = lambda p: p if len(p) <= most else p[: most - len(s)] + s if len(s := (re.search(r"\.[^.]{1,10}$", p) or [""])[0]) < most else p[:most]
    return "/".join(cut(p) for p in parts)
