"""The YAML head of a note as readable lines, and its links as plain text.

Of YAML it reads what note heads have: a mapping of keys to scalars (plain, quoted, over several lines,
``|`` and ``>`` blocks), to lists (``[a, b]`` or dashes, at any indent) and to one level of mappings.
Scalars have YAML 1.1's types. A head with anything else (anchors, tags, deeper nesting, keys in
brackets, tabs as indent) is taken as no head, so the text stays as it is.
"""

from __future__ import annotations

import datetime
import re

# Where a head stands, and how links are written.
HEAD = re.compile(r"\A---\r?\n(.*?\r?\n)---\r?\n?", re.DOTALL)
LINK = re.compile(r"(!?)\[\[([^\]|]+)(?:\|([^\]]+))?\]\]")

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`][^#]*?|[-?:](?=\S)[^#]*?)\s*:(?:[ ]+|$)""")
_DATE = re.compile(r"(\d{4})-(\d\d)-(\d\d)$")
_TIME = re.compile(r"(\d{4})-(\d\d?)-(\d\d?)(?:[Tt]|[ \t]+)(\d\d?):(\d\d):(\d\d)(?:\.(\d*))?(?:[ \t]*(Z|[-+]\d\d?(?::?\d\d)?))?$")


class NotRead(ValueError):
    """What is here is no YAML mapping, or none of the kind that is read."""


def scalar(text: str):
    """A plain scalar by YAML 1.1's rules."""
    low = text.lower()
    if low in ("", "~", "null") and text in ("", "~", "null", "Null", "NULL"):
        return None
    if low in ("yes", "true", "on", "no", "false", "off") and text in (low, low.capitalize(), low.upper()):
        return low in ("yes", "true", "on")
    if m := _DATE.match(text):
        return datetime.date(*map(int, m.groups()))
    if m := _TIME.match(text):
        y, mo, d, h, mi, s = map(int, m.groups()[:6])
        t = datetime.datetime(y, mo, d, h, mi, s, int((m[7] or "")[:6].ljust(6, "0")) if m[7] else 0)
        if m[8] and m[8] != "Z":
            hours, minutes = re.match(r"[-+](\d\d?):?(\d\d)?", m[8]).groups()
            zone = datetime.timedelta(hours=int(hours), minutes=int(minutes or 0)) * (-1 if m[8][0] == "-" else 1)
            return t.replace(tzinfo=datetime.timezone(zone))
        return t.replace(tzinfo=datetime.timezone.utc) if m[8] else t
    digits = text.replace("_", "")
    if re.fullmatch(r"[-+]?(?:0b[01_]+|0x[0-9a-fA-F_]+|0[0-7_]*|[1-9][0-9_]*)", text):
        body, sign = digits.lstrip("+-"), -1 if digits[0] == "-" else 1
        return sign * (int(body, 0) if body[:2] in ("0b", "0x") else int(body, 8) if body[0] == "0" else int(body))
    if re.fullmatch(r"[-+]?[1-9][0-9_]*(?::[0-5]?[0-9])+", text):
        total = 0
        for part in digits.lstrip("+-").split(":"):
            total = 60 * total + int(part)
        return -total if digits[0] == "-" else total
    if re.fullmatch(r"[-+]?(?:[0-9][0-9_]*)\.[0-9_]*(?:[eE][-+][0-9]+)?|\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?", text):
        return float(digits)
    if re.fullmatch(r"[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", text):
        return float(low.replace(".", ""))
    return text


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "e": "\x1b", " ": " ", "/": "/", "N": "\x85", "_": "\xa0"}


def _quoted(text: str) -> str:
    if text[0] == "'":
        return text[1:-1].replace("''", "'")

    return re.sub(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text[1:-1])


def _bare(text: str) -> str:
    """A line's rest without its comment."""
    return re.split(r"(?:^|\s)#", text, maxsplit=1)[0].strip()


class _Flow:
    """``[a, "b", {c: d}]`` from its text."""

    def __init__(self, text: str):
        self.t, self.i = text, 0

    def space(self) -> None:
        while self.i < len(self.t) and self.t[self.i].isspace():
            self.i += 1

    def value(self):
        self.space()
        c = self.t[self.i : self.i + 1]
        if c == "[":
            return self._many("]", list)
        if c == "{":
            return dict(self._many("}", dict))
        if c in ("'", '"'):
            m = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"\\]|\\.)*\"", re.S).match(self.t, self.i)
            if not m:
                raise NotRead
            self.i = m.end()
            return _quoted(m[0])
        m = re.compile(r"(?:[^,\[\]{}:#]|:(?=\S)(?![,\[\]{}])|(?<=\S)#)*").match(self.t, self.i)
        self.i = m.end()
        if c in ("&", "*", "!", "@", "`", "%", "|", ">"):
            raise NotRead
        return scalar(m[0].strip())

    def _many(self, close: str, kind):
        self.i += 1
        out = []
        while True:
            self.space()
            if self.t[self.i : self.i + 1] == close:
                self.i += 1
                return out
            item = self.value()
            self.space()
            if kind is dict:
                if self.t[self.i : self.i + 1] != ":":
                    raise NotRead
                self.i += 1
                item = (item, self.value())
                self.space()
            out.append(item)
            c = self.t[self.i : self.i + 1]
            if c == ",":
                self.i += 1
            elif c != close:
                raise NotRead


def _inline(text: str):
    """The value that stands in one line (or, in brackets and quotes, in joined ones)."""
    if text[:1] in "[{'\"" and text:
        f = _Flow(text)
        v = f.value()
        if _bare(text[f.i :]):
            raise NotRead
        return v
    if text[:1] in ("&", "*", "!", "%", "@", "`"):
        raise NotRead
    text = _bare(text)
    if re.search(r":(?:\s|$)", text):
        raise NotRead
    return scalar(text)


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _blank(line: str) -> bool:
    return not line.strip() or line.lstrip().startswith("#")


def _block(lines: list[str], style: str) -> str:
    """A ``|`` or ``>`` block; ``style`` is its mark with a chomping sign."""
    depth = min((_indent(x) for x in lines if x.strip()), default=0)
    rows = [x[depth:] if x.strip() else "" for x in lines]
    kept = "\n".join(rows).rstrip("\n")
    if style[0] == ">":
        kept = re.sub(r"(?<=[^\n])\n(?=[^\n ])(?<! )", " ", kept)
        kept = re.sub(r"\n(\n+)(?=[^\n ])", r"\1", kept)
    return kept if "-" in style or not kept else kept + "\n"


def _value(rest: str, lines: list[str], depth: int, nested: bool):
    """The value after a key: ``rest`` of its line and the ``lines`` that belong to it."""
    if m := re.fullmatch(r"([|>][-+]?)\s*(?:#.*)?", rest):
        return _block(lines, m[1])
    some = [x for x in lines if not _blank(x)]
    if _bare(rest):
        if rest[:1] in "[{'\"" or not some:
            return _inline(" ".join([rest, *(x.strip() for x in some)]))
        if any(re.search(r":(?:\s|$)", x) for x in some):
            raise NotRead
        return scalar(" ".join([_bare(rest), *(_bare(x) for x in some)]))
    if not some:
        return None
    first = some[0].lstrip()
    if first.startswith("- ") or first == "-":
        depth, out = _indent(some[0]), []
        for x in some:
            if _indent(x) == depth and (x.lstrip().startswith("- ") or x.strip() == "-"):
                out.append([x.lstrip()[1:].strip()])
            elif _indent(x) > depth and out:
                out[-1].append(x.strip())
            else:
                raise NotRead
        return [_item(x, nested) for x in out]
    if nested:
        return mapping(lines, False)
    raise NotRead


def _item(parts: list[str], nested: bool):
    text = " ".join(parts)
    if _KEY.match(text) and text[:1] not in "'\"":
        if not nested:
            raise NotRead
        return mapping(parts, False)
    return _inline(text)


def mapping(lines: list[str], nested: bool = True) -> dict:
    """The mapping that these lines are."""
    some = [x for x in lines if not _blank(x)]
    if not some:
        raise NotRead
    depth, out, at = _indent(some[0]), {}, 0
    while at < len(lines):
        line = lines[at]
        at += 1
        if _blank(line):
            continue
        m = _KEY.match(line[depth:])
        if _indent(line) != depth or not m or "\t" in line[: len(line) - len(line.lstrip())]:
            raise NotRead
        own = []
        while at < len(lines) and (_blank(lines[at]) or _indent(lines[at]) > depth or (_indent(lines[at]) == depth and re.match(r"-(?:\s|$)", lines[at][depth:]))):
            own.append(lines[at])
            at += 1
        key = _quoted(m[1]) if m[1][0] in "'\"" else scalar(m[1])
        out[key] = _value(line[depth:][m.end() :].strip(), own, depth, nested)
    return out


def split_head(text: str) -> tuple[dict | None, str]:
    """(fields, body); (None, the whole text) where there is no head that is read."""
    m = HEAD.match(text)
    if not m:
        return None, text
    try:
        return mapping(m[1].splitlines()), text[m.end() :]
    except (NotRead, ValueError):
        return None, text


def plain_links(text: str) -> str:
    """Links as what a reader sees; embedded ones go."""
    return LINK.sub(lambda m: "" if m[1] else (m[3] or m[2]).strip(), text)


def readable(text: str) -> str:
    """A note: its head as ``Label: value`` lines, its links as plain text."""
    fields, body = split_head(text)
    body = plain_links(body)
    shown = {k: v for k, v in (fields or {}).items() if v not in (None, "", [], {})}
    if not shown:
        return body
    label = lambda k: str(k).replace("_", " ").strip().capitalize()
    value = lambda v: ", ".join(map(str, v)) if isinstance(v, list) else str(v)
    return "\n".join(f"{label(k)}: {value(v)}" for k, v in shown.items()) + "\n\n" + body.strip()
