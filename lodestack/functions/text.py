"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Unicode's White_Space.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Strip all Unicode white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores; accents split words."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), F.lit(1))


def or_query(c: Column) -> Column:
    """Distinct terms in order of first sight, joined by `` | ``."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))), " | ")


def chunks(c: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Array of chunks of ``size`` characters, each starting ``size - overlap`` after the one before; none for a blank text.

    The last chunk ends where the stripped text ends.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap from 0 to below it")
    stride = size - overlap

    def cut(t: Column) -> Column:
        last = F.greatest(F.ceil((F.length(t) - size) / F.lit(stride)), F.lit(0)).cast("int")
        return F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(t, i * stride + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    # Through an array of one, so that the text is stripped once and not once a chunk.
    return F.get(F.transform(F.array(strip(c)), cut), F.lit(0))


def clean_wikilinks(c: Column) -> Column:
    """``![[x]]`` goes, ``[[a|b]]`` becomes b, ``[[a]]`` becomes a, both without white space at their ends; empty ones stay."""
    c = F.regexp_replace(c, r"!\[\[[^\]|]+(?:\|[^\]]+)?\]\]", "")
    return F.regexp_replace(c, r"(?U)\[\[(?:[^\]|]+\|(?=[^\]])|(?=[^\]|]+\]\]))\s*([^\]]*?)\s*\]\]", "$1")


def truncated(c: Column, most: int) -> Column:
    """struct(text, truncated)"""
    return F.struct(F.substring(c, 1, most).alias("text"), (F.length(c) > most).alias("truncated"))


def time_label(seconds: Column) -> Column:
    """``[HH:MM:SS]`` of whole seconds."""
    s = F.floor(seconds).cast("int")
    return F.format_string("[%02d:%02d:%02d]", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), s % 60)


def date_tokens(c: Column, first_year: int = 2000, last_year: int = 2035) -> Column:
    """Dates named in a path: isolated runs of eight digits (day first, else year first), then ``DD-MM-YYYY``; invalid ones are left out."""
    digits = F.regexp_extract_all(c, F.lit(r"(?<!\d)(\d{8})(?!\d)"), F.lit(1))
    good = lambda d: F.when(F.year(d).between(first_year, last_year), d)
    eight = F.transform(digits, lambda x: F.coalesce(good(F.to_date(F.try_to_timestamp(x, F.lit("ddMMyyyy")))), good(F.to_date(F.try_to_timestamp(x, F.lit("yyyyMMdd"))))))
    dashed = F.transform(F.regexp_extract_all(c, F.lit(r"(?<!\d)(\d{2}-\d{2}-\d{4})(?!\d)"), F.lit(1)), lambda x: good(F.to_date(F.try_to_timestamp(x, F.lit("dd-MM-yyyy")))))
    return F.transform(F.array_compact(F.concat(eight, dashed)), lambda d: F.date_format(d, "yyyy-MM-dd"))


def json_string(c: Column) -> Column:
    """A JSON string in ASCII: short escapes, and four hex digits for other control characters and all beyond ASCII (in pairs beyond the first plane)."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def one(x: Column) -> Column:
        n = F.ascii(x)
        out = F.when(n > 0xFFFF, F.concat(unit(F.shiftright(n - 0x10000, 10) + 0xD800), unit((n - 0x10000) % 0x400 + 0xDC00))).when((n > 0x7E) | (n < 0x20), unit(n)).otherwise(x)
        for k, v in short.items():
            out = F.when(x == k, v).otherwise(out)
        return out

    plain = F.rlike(c, F.lit(r'\A[ !#-\[\]-~]*\z'))
    return F.concat(F.lit('"'), F.when(plain, c).otherwise(F.array_join(F.transform(F.split(c, ""), one), "")), F.lit('"'))
