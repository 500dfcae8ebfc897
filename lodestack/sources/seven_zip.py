"""Members of 7z archives, by the public format description, with the standard library's decoders.

A signature header points to the header at the archive's end: packed streams, folders (graphs of
coders, of which chains are read: Copy, LZMA, LZMA2, Delta, the branch converters that the lzma module
has, Deflate, BZip2) and files. The header itself may be packed as such a folder. A folder's files
are one stream, read in pieces.
"""

from __future__ import annotations

import bz2
import itertools
import lzma
import struct
import zlib
from dataclasses import dataclass, field

SIGNATURE = b"7z\xbc\xaf\x27\x1c"
PIECE = 1 << 20
#: Headers beyond this size are refused: names and sizes alone are not as long.
MOST_HEADER = 256 << 20
MOST_ITEMS = 50_000_000

# Property ids of the header, and ids of coders.
END, HEADER, STREAMS, FILES, PACK, UNPACK, SUB, SIZE, CRC, FOLDER, UNPACK_SIZE, NUM_UNPACK, EMPTY_STREAM, EMPTY_FILE, ANTI, NAMES, ENCODED = 0, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 23
COPY, LZMA, LZMA2, DELTA, DEFLATE, BZIP2, AES = "00", "030101", "21", "03", "040108", "040202", "06f10701"
BRANCHES = {"03030103": lzma.FILTER_X86, "04": lzma.FILTER_X86, "05": lzma.FILTER_POWERPC, "03030205": lzma.FILTER_POWERPC, "06": lzma.FILTER_IA64, "03030401": lzma.FILTER_IA64, "07": lzma.FILTER_ARM, "03030501": lzma.FILTER_ARM, "08": lzma.FILTER_ARMTHUMB, "03030701": lzma.FILTER_ARMTHUMB, "09": lzma.FILTER_SPARC, "03030805": lzma.FILTER_SPARC}


class Damaged(ValueError):
    pass


class Unsupported(ValueError):
    """Well formed, but encrypted or of a coder that is not here."""


class _Bytes:
    def __init__(self, data: bytes):
        self.d, self.i = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.i + n > len(self.d):
            raise Damaged("header ends early")
        self.i += n
        return self.d[self.i - n : self.i]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        first, mask, value = self.byte(), 0x80, 0
        for k in range(8):
            if not first & mask:
                return value | ((first & (mask - 1)) << (8 * k))
            value |= self.byte() << (8 * k)
            mask >>= 1
        return value

    def count(self) -> int:
        n = self.number()
        if n > MOST_ITEMS:
            raise Damaged("too many items")
        return n

    def bits(self, n: int) -> list[bool]:
        data = self.take((n + 7) // 8)
        return [bool(data[i >> 3] & (0x80 >> (i & 7))) for i in range(n)]

    def defined(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)

    def digests(self, n: int) -> list[int | None]:
        return [struct.unpack("<I", self.take(4))[0] if x else None for x in self.defined(n)]


@dataclass
class Coder:
    method: str
    inputs: int
    outputs: int
    properties: bytes


@dataclass
class Folder:
    coders: list[Coder]
    bonds: list[tuple[int, int]]
    packed: list[int]
    sizes: list[int] = field(default_factory=list)
    crc: int | None = None
    files: list[tuple[int, int | None]] = field(default_factory=list)  # (size, crc)
    at: int = 0
    packs: list[int] = field(default_factory=list)

    def main(self) -> int:
        """The output that no other coder reads: the folder's own."""
        bound = {o for _, o in self.bonds}
        left = [i for i in range(len(self.sizes)) if i not in bound]
        if len(left) != 1:
            raise Unsupported("coder graph")
        return left[0]

    @property
    def size(self) -> int:
        return self.sizes[self.main()]

    def chain(self) -> list[int]:
        """Numbers of the coders from the packed stream to the folder's output."""
        if any(c.inputs != 1 or c.outputs != 1 for c in self.coders) or len(self.packed) != 1:
            raise Unsupported("coder graph")
        to = {o: i for i, o in self.bonds}
        order, at = [], self.packed[0]
        for _ in self.coders:
            order.append(at)
            if at not in to:
                break
            at = to[at]
        if len(order) != len(self.coders):
            raise Unsupported("coder graph")
        return order


def _folder(b: _Bytes) -> Folder:
    coders, inputs, outputs = [], 0, 0
    for _ in range(b.count()):
        flags = b.byte()
        method = b.take(flags & 15).hex()
        if flags & 0x80:
            raise Damaged("coder flags")
        i, o = (b.count(), b.count()) if flags & 16 else (1, 1)
        coders.append(Coder(method, i, o, b.take(b.count()) if flags & 32 else b""))
        inputs, outputs = inputs + i, outputs + o
    if not coders or outputs < 1 or inputs < outputs - 1:
        raise Damaged("folder")
    bonds = [(b.count(), b.count()) for _ in range(outputs - 1)]
    n = inputs - len(bonds)
    bound = {i for i, _ in bonds}
    packed = [i for i in range(inputs) if i not in bound] if n == 1 else [b.count() for _ in range(n)]
    if len(packed) != n:
        raise Damaged("folder")
    return Folder(coders, bonds, packed, [0] * outputs)


def _streams(b: _Bytes) -> list[Folder]:
    """Packed streams, folders and the files' sizes in them."""
    folders: list[Folder] = []
    packs: list[int] = []
    first, kind, told = 0, b.byte(), False
    while kind != END:
        if kind == PACK:
            first, n = b.number(), b.count()
            kind = b.byte()
            while kind != END:
                if kind == SIZE:
                    packs = [b.number() for _ in range(n)]
                elif kind == CRC:
                    b.digests(n)
                else:
                    raise Damaged("packed streams")
                kind = b.byte()
        elif kind == UNPACK:
            if b.byte() != FOLDER:
                raise Damaged("folders")
            n = b.count()
            if b.byte():
                raise Unsupported("external folders")
            folders = [_folder(b) for _ in range(n)]
            if b.byte() != UNPACK_SIZE:
                raise Damaged("sizes")
            for f in folders:
                f.sizes = [b.number() for _ in f.sizes]
            kind = b.byte()
            while kind != END:
                if kind != CRC:
                    raise Damaged("folders")
                for f, crc in zip(folders, b.digests(len(folders)), strict=True):
                    f.crc = crc
                kind = b.byte()
        elif kind == SUB:
            told = True
            counts = [1] * len(folders)
            kind = b.byte()
            if kind == NUM_UNPACK:
                counts = [b.count() for _ in folders]
                kind = b.byte()
            sizes = []
            for f, n in zip(folders, counts, strict=True):
                own = [b.number() for _ in range(n - 1)] if kind == SIZE and n else []
                left = f.size - sum(own)
                if n and (left < 0 or (n > 1 and kind != SIZE)):
                    raise Damaged("sizes")
                sizes.append([*own, left] if n else [])
            if kind == SIZE:
                kind = b.byte()
            known = [[f.crc] if n == 1 and f.crc is not None else [None] * n for f, n in zip(folders, counts, strict=True)]
            while kind != END:
                if kind != CRC:
                    raise Damaged("streams")
                open_ = [(i, j) for i, x in enumerate(known) for j, crc in enumerate(x) if crc is None]
                for (i, j), crc in zip(open_, b.digests(len(open_)), strict=True):
                    known[i][j] = crc
                kind = b.byte()
            for f, own, crcs in zip(folders, sizes, known, strict=True):
                f.files = list(zip(own, crcs, strict=True))
        else:
            raise Damaged("streams")
        kind = b.byte()
    at, used = 32 + first, 0
    for f in folders:
        f.at, f.packs = at, packs[used : used + len(f.packed)]
        if len(f.packs) != len(f.packed):
            raise Damaged("packed streams")
        at, used = at + sum(f.packs), used + len(f.packed)
        if not told:
            f.files = [(f.size, f.crc)]
    return folders


@dataclass
class Member:
    name: str
    size: int
    crc: int | None
    is_dir: bool
    folder: int | None  # None: no data


def _files(b: _Bytes, folders: list[Folder]) -> list[Member]:
    n = b.count()
    names, empty, empty_file, anti = [""] * n, [False] * n, None, None
    while (kind := b.byte()) != END:
        part = _Bytes(b.take(b.number()))
        if kind == NAMES:
            if part.byte():
                raise Unsupported("external names")
            names = part.take(len(part.d) - 1).decode("utf-16-le", "surrogatepass").split("\0")[:n]
            if len(names) != n:
                raise Damaged("names")
        elif kind == EMPTY_STREAM:
            empty = part.bits(n)
        elif kind == EMPTY_FILE:
            empty_file = part.bits(sum(empty))
        elif kind == ANTI:
            anti = part.bits(sum(empty))
    no_data = iter(range(n))
    with_data = iter([(i, size, crc) for i, f in enumerate(folders) for size, crc in f.files])
    out = []
    for name, e in zip(names, empty, strict=True):
        if e:
            k = next(no_data)
            if not (anti and anti[k]):
                out.append(Member(name, 0, None, not (empty_file and empty_file[k]), None))
            continue
        got = next(with_data, None)
        if got is None:
            raise Damaged("files")
        out.append(Member(name, got[1], got[2], False, got[0]))
    return out


def _unpacked(d):
    """Pieces through a decompressor of the lzma or bz2 module, PIECE bytes at a time however far they expand."""

    def run(parts):
        for p in parts:
            while not d.eof:
                if out := d.decompress(p, PIECE):
                    yield out
                if d.eof or d.needs_input:
                    break
                p = b""

    return run


def _inflated(parts):
    d = zlib.decompressobj(-15)
    for p in parts:
        while p and not d.eof:
            if out := d.decompress(p, PIECE):
                yield out
            p = d.unconsumed_tail
    yield d.flush()


def _unfiltered(filters: list[dict]):
    """Pieces through filters of the lzma module that stand alone: they are wrapped as chunks of LZMA2 that are not packed."""

    def chunks(parts):
        begun = False
        for p in parts:
            for at in range(0, len(p), 1 << 16):
                piece = p[at : at + (1 << 16)]
                yield bytes([2 if begun else 1]) + struct.pack(">H", len(piece) - 1) + piece
                begun = True
        yield b"\0"

    run = _unpacked(lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[*filters, {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}]))
    return lambda parts: run(chunks(parts))


def _steps(folder: Folder) -> list:
    """The folder's decoders in order, as functions of pieces. Filters of the lzma module after LZMA2 are one decoder with it."""
    out: list = []
    filters: list[dict] = []  # of the lzma module, an LZMA2 coder last, that await more

    def close() -> None:
        if filters:
            out.append(_unpacked(lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=list(filters))))
            filters.clear()

    for k in folder.chain():
        c, p = folder.coders[k], folder.coders[k].properties
        own = {"id": lzma.FILTER_DELTA, "dist": (p[0] if p else 0) + 1} if c.method == DELTA else {"id": BRANCHES[c.method]} if c.method in BRANCHES else None
        if own and filters and len(filters) < 4:
            filters.insert(0, own)
            continue
        close()
        if own:
            out.append(_unfiltered([own]))
        elif c.method == DEFLATE:
            out.append(_inflated)
        elif c.method == BZIP2:
            out.append(_unpacked(bz2.BZ2Decompressor()))
        elif c.method == LZMA:
            if len(p) < 5:
                raise Damaged("properties")
            # The stream as the lzma module knows it: its old header is the properties and the size.
            head, run = p[:5] + struct.pack("<Q", folder.sizes[k]), _unpacked(lzma.LZMADecompressor(lzma.FORMAT_ALONE))
            out.append(lambda parts, head=head, run=run: run(itertools.chain([head], parts)))
        elif c.method == LZMA2:
            bits = p[0] if p else 0
            if bits > 40:
                raise Damaged("properties")
            filters.append({"id": lzma.FILTER_LZMA2, "dict_size": 0xFFFFFFFF if bits == 40 else (2 | bits & 1) << (bits // 2 + 11)})
        elif c.method == AES:
            raise Unsupported("encrypted")
        elif c.method != COPY:
            raise Unsupported(f"coder {c.method}")
    close()
    return out


def folder_pieces(file, folder: Folder):
    """The folder's bytes in pieces; Damaged where they end early."""

    def packed():
        at, left = folder.at, folder.packs[0]
        while left:
            file.seek(at)
            data = bytes(file.read(min(PIECE, left)))
            if not data:
                break
            at, left = at + len(data), left - len(data)
            yield data

    parts, given = packed(), 0
    for step in _steps(folder):
        parts = step(parts)
    try:
        for data in parts:
            data = data[: folder.size - given]
            given += len(data)
            if data:
                yield data
            if given == folder.size:
                return
    except (lzma.LZMAError, zlib.error, OSError, EOFError) as e:
        raise Damaged(str(e)) from e
    if given < folder.size:
        raise Damaged("data end early")


def file_pieces(pieces, size: int):
    """The next ``size`` bytes of a folder: (piece, ...) of one member; ``pieces`` is a Pieces."""
    while size:
        data = pieces.take(size)
        size -= len(data)
        yield data


class Pieces:
    """A folder's pieces, taken in the sizes of its members."""

    def __init__(self, file, folder: Folder):
        self.it, self.rest = folder_pieces(file, folder), b""

    def take(self, most: int) -> bytes:
        if not self.rest:
            self.rest = next(self.it, b"")
            if not self.rest:
                raise Damaged("data end early")
        out, self.rest = self.rest[:most], self.rest[most:]
        return out


def read_header(file) -> tuple[list[Folder], list[Member]]:
    """Folders and members of a 7z file (seekable)."""
    file.seek(0)
    start = file.read(32)
    if len(start) < 32 or start[:6] != SIGNATURE:
        raise Damaged("no 7z file")
    crc, at, size, next_crc = struct.unpack("<IQQI", start[8:32])
    if zlib.crc32(start[12:32]) != crc:
        raise Damaged("start header")
    if not size:
        return [], []
    if size > MOST_HEADER:
        raise Damaged("header too long")
    file.seek(32 + at)
    data = bytes(file.read(size))
    if len(data) != size or zlib.crc32(data) != next_crc:
        raise Damaged("header")
    b = _Bytes(data)
    kind = b.byte()
    while kind == ENCODED:
        folders = _streams(b)
        if len(folders) != 1 or folders[0].size > MOST_HEADER:
            raise Damaged("packed header")
        data = b"".join(folder_pieces(file, folders[0]))
        if folders[0].crc is not None and zlib.crc32(data) != folders[0].crc:
            raise Damaged("packed header")
        b = _Bytes(data)
        kind = b.byte()
    if kind != HEADER:
        raise Damaged("header")
    folders: list[Folder] = []
    members: list[Member] = []
    while (kind := b.byte()) != END:
        if kind == STREAMS:
            folders = _streams(b)
        elif kind == FILES:
            members = _files(b, folders)
        elif kind == 2:  # archive properties
            while b.byte() != END:
                b.take(b.number())
        else:
            raise Damaged("header")
    return folders, members
