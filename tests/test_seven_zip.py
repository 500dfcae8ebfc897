"""7z archives made here by the format's description: members, CRCs, solid folders, filters, nested, damaged and encrypted ones."""

import bz2
import hashlib
import io
import lzma
import random
import struct
import zipfile
import zlib

import pytest

from lodestack.sources import archives, seven_zip


def number(n):
    for k in range(8):
        if n < 1 << (7 * (k + 1)):
            first = (0xFF00 >> k) & 0xFF | (n >> (8 * k))
            return bytes([first]) + (n & ((1 << (8 * k)) - 1)).to_bytes(k, "little")
    return b"\xff" + n.to_bytes(8, "little")


def bits(flags):
    out = bytearray((len(flags) + 7) // 8)
    for i, f in enumerate(flags):
        out[i >> 3] |= (0x80 >> (i & 7)) if f else 0
    return bytes(out)


def packed(kind, data):
    """(packed bytes, coders as (method, properties))"""
    lz2, dict16 = {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}, bytes([8])
    raw = lambda *f: lzma.compress(data, lzma.FORMAT_RAW, filters=list(f))
    if kind == "copy":
        return data, [("00", b"")]
    if kind == "lzma2":
        return raw(lz2), [("21", dict16)]
    if kind == "delta+lzma2":
        return raw({"id": lzma.FILTER_DELTA, "dist": 4}, lz2), [("03", b"\x03"), ("21", dict16)]
    if kind == "x86+lzma2":
        return raw({"id": lzma.FILTER_X86}, lz2), [("03030103", b""), ("21", dict16)]
    if kind in ("lzma", "x86+lzma"):
        if kind == "x86+lzma":  # the filter alone: unpacked chunks carry what it makes
            chunks = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_X86}, lz2])
            data = lzma.decompress(chunks, lzma.FORMAT_RAW, filters=[lz2])
        alone = lzma.compress(data, lzma.FORMAT_ALONE)
        return alone[13:], [*([("03030103", b"")] if kind == "x86+lzma" else []), ("030101", alone[:5])]
    if kind == "deflate":
        c = zlib.compressobj(9, zlib.DEFLATED, -15)
        return c.compress(data) + c.flush(), [("040108", b"")]
    if kind == "bzip2":
        return bz2.compress(data), [("040202", b"")]
    return data, [("06f10701", b"\x13")]  # encrypted


def folder(coders):
    out = number(len(coders))
    for method, p in coders:
        m = bytes.fromhex(method)
        out += bytes([len(m) | (32 if p else 0)]) + m + (number(len(p)) + p if p else b"")
    # Coder i reads what coder i + 1 gives.
    return out + b"".join(number(i) + number(i + 1) for i in range(len(coders) - 1))


def streams(blobs, first=0):
    """blobs: (packed, coders, [file bytes])"""
    out = b"\x06" + number(first) + number(len(blobs)) + b"\x09" + b"".join(number(len(p)) for p, _, _ in blobs) + b"\x00"
    out += b"\x07\x0b" + number(len(blobs)) + b"\x00" + b"".join(folder(c) for _, c, _ in blobs)
    out += b"\x0c" + b"".join(number(sum(map(len, f))) * len(c) for _, c, f in blobs) + b"\x00"
    out += b"\x08\x0d" + b"".join(number(len(f)) for _, _, f in blobs)
    out += b"\x09" + b"".join(number(len(x)) for _, _, f in blobs for x in f[:-1])
    crcs = [zlib.crc32(x) for _, _, f in blobs for x in f]
    return out + b"\x0a\x01" + b"".join(struct.pack("<I", c) for c in crcs) + b"\x00\x00"


def make(groups, empty=(), dirs=(), encoded=True):
    """groups: (kind, {name: bytes}) for each folder -> the bytes of a 7z file."""
    blobs, names = [], []
    for kind, files in groups:
        data, coders = packed(kind, b"".join(files.values()))
        blobs.append((data, coders, list(files.values())))
        names += files
    every = [*names, *empty, *dirs]
    header = b"\x01" + (b"\x04" + streams(blobs) if blobs else b"") + b"\x05" + number(len(every))
    if empty or dirs:
        flags = bits([n in empty or n in dirs for n in every])
        header += b"\x0e" + number(len(flags)) + flags
        flags = bits([n in empty for n in [*empty, *dirs]])
        header += b"\x0f" + number(len(flags)) + flags
    text = b"\0" + "".join(n + "\0" for n in every).encode("utf-16-le")
    header += b"\x11" + number(len(text)) + text + b"\x00\x00"
    body = b"".join(p for p, _, _ in blobs)
    if encoded:
        data, coders = packed("lzma", header)
        header = b"\x17" + streams([(data, coders, [header])], len(body))
        body += data
    start = struct.pack("<QQI", len(body), len(header), zlib.crc32(header))
    return seven_zip.SIGNATURE + b"\0\4" + struct.pack("<I", zlib.crc32(start)) + start + body + header


RNG = random.Random(4)
TEXT = {f"d/f{i}.txt": bytes(RNG.choice(b"abcd \xe8\xe9\x00\xff") for _ in range(n)) for i, n in enumerate((1, 3000, 70_000, 5, 200_000))}
KINDS = ["copy", "lzma", "lzma2", "delta+lzma2", "x86+lzma2", "x86+lzma", "deflate", "bzip2"]


def rows(data, **kw):
    return {r[1]: r for r in archives._members("a", io.BytesIO(data), "a!", 1, kw.get("hashes", True), kw.get("most", 3))}


@pytest.mark.parametrize("encoded", [False, True])
@pytest.mark.parametrize("kind", KINDS)
def test_members_of_a_solid_folder(monkeypatch, kind, encoded):
    monkeypatch.setattr(seven_zip, "PIECE", 4096)
    got = rows(make([(kind, TEXT)], ["none"], ["d"], encoded))
    assert set(got) == {f"a!{n}" for n in TEXT} | {"a!none"}
    for n, x in TEXT.items():
        assert got[f"a!{n}"][2:] == (len(x), None, zlib.crc32(x), hashlib.sha256(x).hexdigest(), True, 1, "ok")
    assert got["a!none"][5] == hashlib.sha256(b"").hexdigest() and got["a!none"][-1] == "ok"


def test_folders_nested_archives_and_listing(monkeypatch):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x/in.txt", "deep")
        z.writestr("y.7z", make([("lzma2", {"z.txt": b"deeper"})]))
    data = make([("lzma", {"one.txt": b"1" * 10, "in.zip": inner.getvalue(), "two.txt": b"22"}), ("bzip2", {"../up": b"bad", "ok": b"good"})])
    got = rows(data)
    assert {k: (v[7], v[8]) for k, v in got.items()} == {"a!one.txt": (1, "ok"), "a!in.zip": (1, "ok"), "a!in.zip!x/in.txt": (2, "ok"), "a!in.zip!y.7z": (2, "ok"), "a!in.zip!y.7z!z.txt": (3, "ok"), "a!two.txt": (1, "ok"), "a!../up": (1, "unsafe_path"), "a!ok": (1, "ok")}
    assert got["a!ok"][5] == hashlib.sha256(b"good").hexdigest() and got["a!two.txt"][5] == hashlib.sha256(b"22").hexdigest()
    assert rows(data, most=1)["a!in.zip!"][-1] == "max_depth"
    listed = rows(data, hashes=False)
    assert set(listed) == {"a!one.txt", "a!in.zip", "a!two.txt", "a!../up", "a!ok"} and listed["a!ok"][5] is None


def test_damaged_encrypted_and_odd_archives():
    whole = make([("lzma2", TEXT), ("aes", {"s.txt": b"secret"})], encoded=False)
    got = rows(whole)
    assert got["a!s.txt"][-1] == "encrypted" and got["a!d/f4.txt"][-1] == "ok"
    hurt = bytearray(whole)
    hurt[40] ^= 0xFF
    got = rows(bytes(hurt))
    assert got["a!s.txt"][-1] == "encrypted" and "error" in {v[-1] for v in got.values()}
    odd = make([("copy", {"c.txt": b"abc"})], encoded=False)
    got = rows(odd.replace(b"abc", b"abd"))
    assert got["a!c.txt"][5:] == (None, False, 1, "error")
    for cut in (b"", whole[:20], whole[:-1], whole[:32], b"7z\xbc\xaf\x27\x1c" + b"\0" * 26, whole[:32] + b"\xff" * (len(whole) - 32)):
        assert [(r[1], r[-1]) for r in rows(cut).values()] == [("a", "error")] or rows(cut) == {}
    # However a header is hurt, rows come out or the archive is an error.
    rng = random.Random(1)
    for _ in range(300):
        x = bytearray(whole)
        at = rng.randrange(len(x) - 200, len(x))
        x[at] = rng.randrange(256)
        start = bytearray(x[12:32])
        size = struct.unpack("<Q", start[8:16])[0]
        start[16:20] = struct.pack("<I", zlib.crc32(bytes(x[-size:])))
        x[12:32] = start
        x[8:12] = struct.pack("<I", zlib.crc32(bytes(start)))
        assert all(r[-1] in ("ok", "error", "encrypted", "unsupported", "unsafe_path", "expansion") for r in rows(bytes(x)).values())
    bomb = make([("lzma2", {"b": b"\0" * 5_000_000})])
    assert rows(bomb)["a!b"][-1] == "expansion"
    assert rows(make([]))  == {}


def test_read_by_spark(spark, tmp_path):
    (tmp_path / "s.7z").write_bytes(make([("lzma2", TEXT)]))
    (tmp_path / "t.7Z").write_bytes(b"broken")
    got = archives.archive_members(archives.read_archives(spark, str(tmp_path))).collect()
    assert len(got) == 6 and {r.status for r in got} == {"ok", "error"}
    assert {r.member: r.sha for r in got if r.sha} == {f"s.7z!{n}": hashlib.sha256(x).hexdigest() for n, x in TEXT.items()}
