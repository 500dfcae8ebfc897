"""PDF files made here: cross-reference and object streams, nested page trees, subsets with ToUnicode maps, forms, damaged and encrypted files."""

import base64
import zlib

import pytest

from lodestack.sources import archives, pdf

CMAP = b"""/CIDInit /ProcSet findresource begin begincmap
1 begincodespacerange <0000> <FFFF> endcodespacerange
3 beginbfchar <0001> <0048> <0002> <00E9> <0003> <D83DDE42> endbfchar
2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00660069> <65E5>] endbfrange
endcmap end"""


def stream(body, extra=b"", deflate=True):
    data = zlib.compress(body) if deflate else body
    return b"<< /Length %d %s%s >>\nstream\n" % (len(data), b"/Filter /FlateDecode " if deflate else b"", extra) + data + b"\nendstream"


def make(contents, packed=False, fonts=b"/F1 10 0 R /F2 11 0 R", extra=b""):
    """A file with a page for each content (bytes, or a list of them), in a tree of two levels."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    half = (len(contents) + 1) // 2
    objects[2] = b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count %d /Resources << /Font << %s >> /XObject << /X 12 0 R >> >> >>" % (len(contents), fonts)
    for node, first, last in ((3, 0, half), (4, half, len(contents))):
        objects[node] = b"<< /Type /Pages /Parent 2 0 R /Kids [%s] >>" % b" ".join(b"%d 0 R" % (20 + i) for i in range(first, last))
    streams = {}
    for i, c in enumerate(contents):
        parts = c if isinstance(c, list) else [c]
        for j, x in enumerate(parts):
            streams[100 + 10 * i + j] = x if x.startswith(b"<<") else stream(x)
        objects[20 + i] = b"<< /Type /Page /Parent 3 0 R /Contents [%s] >>" % b" ".join(b"%d 0 R" % (100 + 10 * i + j) for j in range(len(parts)))
    objects[10] = b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>"
    objects[11] = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 13 0 R >>"
    objects[14] = b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /B /uni00E9 /space 70 /fi] >> >>"
    streams[12] = stream(b"BT /F1 9 Tf (in a form) Tj ET", b"/Type /XObject /Subtype /Form")
    streams[13] = stream(CMAP)
    out = b"%PDF-1.5\n" + extra
    if packed:
        body, heads = b"", b""
        for n, x in objects.items():
            heads += b"%d %d " % (n, len(body))
            body += x + b" "
        streams[200] = stream(heads + body, b"/Type /ObjStm /N %d /First %d" % (len(objects), len(heads)))
        objects = {}
    for n, x in {**objects, **streams}.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (n, x)
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGES = [
    b"BT /F1 12 Tf 72 700 Td (Plain \\(text\\) with \\351 and \\\nmore) Tj 0 -14 Td (next line) Tj ET",
    b"BT /F2 12 Tf 1 0 0 1 72 700 Tm <000100020003> Tj [<0010> 50 <0011> -300 <0012>] TJ T* <00200021> Tj ET",
    [b"BT /F1 10 Tf (split ", b"string) Tj ET BT /F1 10 Tf (same height) Tj ET q /X Do Q"],
    b"BT /F1 1 Tf 14 TL (a) Tj (b) ' 1 2 (c) \" ET BI /W 1 ID \x00(Tj) EI BT /F1 1 Tf (d) Tj ET",
]
TEXTS = ["Plain (text) with é and more\nnext line", "Hé🙂ab c\nfi日", "split \nstringsame height\nin a form", "a\nb\nc\nd"]


@pytest.mark.parametrize("packed", [False, True])
def test_pages(packed):
    # A string that is cut in two streams goes on over the line's end between them.
    assert pdf.page_texts(make(PAGES, packed)) == TEXTS


def test_encodings_and_filters():
    body = b"BT /F3 9 Tf (ABCF) Tj ET"
    hexed = stream(body.hex().encode() + b">", b"/Filter /ASCIIHexDecode", False)
    b85 = stream(base64.a85encode(body) + b"~>", b"/Filter [/ASCII85Decode]", False)
    rows = zlib.compress(b"".join(bytes([2]) + bytes((x - y) & 255 for x, y in zip(body[i : i + 4].ljust(4), (b"\0" * 4 + body)[i : i + 4].ljust(4), strict=True)) for i in range(0, len(body), 4)))
    up = b"<< /Length %d /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> >>\nstream\n" % len(rows) + rows + b"\nendstream"
    wrong = stream(body).replace(b"/Length ", b"/Length 9")
    image = stream(body, b"/Filter /DCTDecode", False)
    fonts = b"/F3 14 0 R"
    assert pdf.page_texts(make([hexed, b85, up, wrong, image], fonts=fonts)) == ["Bé fi"] * 4 + [""]


def test_files_that_are_not_read():
    whole = make(PAGES)
    assert archives.text_of("a.pdf", b"no pdf") is None
    assert archives.text_of("a.pdf", make(PAGES, extra=b"1 0 obj << /Encrypt 5 0 R >> endobj ")) is None
    assert archives.text_of("a.PDF_17", make(PAGES[:1])) == TEXTS[0]
    # The last object of a number counts; loops in the tree end; cut files give what is there.
    again = whole + b"\n20 0 obj << /Type /Page /Contents 300 0 R >> endobj 300 0 obj " + stream(b"BT /F1 9 Tf (new) Tj ET") + b" endobj"
    assert pdf.page_texts(again)[0] == "new"
    loop = whole + b"\n4 0 obj << /Type /Pages /Kids [2 0 R 4 0 R 22 0 R] >> endobj"
    assert len(pdf.page_texts(loop)) == 3
    for cut in range(10, len(whole), 37):
        assert isinstance(archives.text_of("a.pdf", whole[:cut]), (str, type(None)))


def test_pages_as_rows(spark):
    df = spark.createDataFrame([("a.pdf", bytearray(make(PAGES, True))), ("b.pdf", bytearray(b"broken"))], "path string, content binary")
    got = [tuple(r) for r in archives.pdf_pages(df).orderBy("path", "page").collect()]
    assert [r[:2] for r in got] == [("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3), ("a.pdf", 4), ("b.pdf", None)] and got[0][2] == TEXTS[0]
