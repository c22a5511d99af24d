"""Texts to read aloud: elements of documents, and pieces of them that a voice can take."""

from __future__ import annotations

import re
from bisect import bisect_right as bisect
from collections.abc import Iterable
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from foliomill.functions.rows import each

#: Elements that are read; of images, the description.
READ = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote figcaption".split())
#: Attributes of images whose description is still to be written.
MISSING = ("data-alt-missing",)
#: Elements whose text nobody reads, and elements that end an open paragraph.
_SILENT, _ENDS_P = frozenset(("script", "style")), READ | frozenset("div ul ol table section article figure".split())
#: Full stops that need no space after them, marks that may follow a stop, pause marks, scripts without spaces.
WIDE_STOPS, CLOSING, PAUSES, WIDE_PAUSES = "。！？।॥", "\"'”’»」）)]", ",;", "，；、"
_WIDE = re.compile("[　-〿぀-ヿ一-鿿＀-￯]")
#: Ends of sentences, and other places where a text may be cut; the group says how well. No character is part of both.
_STOP = re.compile(rf"[.!?{WIDE_STOPS}][.!?{WIDE_STOPS}{re.escape(CLOSING)}]*")
_MARK = re.compile(rf"(?P<pause>[{WIDE_PAUSES}]|[{PAUSES}](?= ))|(?P<space> )")


class _Reader(HTMLParser):
    """Collects (tag, parts of text); an element's text holds that of the elements inside it."""

    def __init__(self, missing: Iterable[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.missing = frozenset(missing)
        self.found: list[tuple[str, list[str]]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        self.silent += tag in _SILENT
        if tag == "img" and given.get("alt") and not self.missing & given.keys():
            self.found.append((tag, ["Image: ", given["alt"] or ""]))
        if tag in _ENDS_P:
            self.close_one("p")
        if tag == "li":
            self.close_one("li", within=("ul", "ol"))
        if tag in READ:
            item = (tag, [])
            self.found.append(item)
            self.open.append(item)
        elif tag in ("ul", "ol"):
            self.open.append((tag, []))

    def close_one(self, tag: str, within: tuple[str, ...] = ()) -> None:
        """Closes the innermost open ``tag``, unless a list opened since."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in within:
                return

    def handle_endtag(self, tag: str) -> None:
        self.silent -= tag in _SILENT and self.silent > 0
        if tag in READ or tag in ("ul", "ol"):
            self.close_one(tag)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            for _, parts in self.open:
                parts.append(data)


def elements(html: str, missing: Iterable[str] = MISSING) -> list[tuple[str, str]]:
    reader = _Reader(missing)
    reader.feed(html)
    reader.close()
    rows = ((tag, " ".join("".join(parts).split())) for tag, parts in reader.found)
    return [(tag, text) for tag, text in rows if text]


_SPOKEN = StructType([StructField("tag", StringType()), StructField("text", StringType())])


def spoken_elements(docs: DataFrame, key: str = "doc_id", missing: Iterable[str] = MISSING) -> DataFrame:
    """key, seq (from 1), tag and text of what is read aloud of HTML documents (key, html).

    Images without a description, and those with an attribute of ``missing`` that says so, are left out.
    """
    missing = tuple(missing)
    return each(docs.select(key, "html"), ["html"], _SPOKEN, lambda html: elements(html or "", missing), "seq")


def joined(text: str) -> tuple[str, list[int]]:
    """A text with single spaces, and the ends of its sentences.

    A stop ends one before a space or at the end of the text, a wide one everywhere. No space stays beside
    a character of a script without spaces where a sentence ends.
    """
    text = " ".join(text.split())
    ends = {m.end() for m in _STOP.finditer(text) if m[0][0] in WIDE_STOPS or text[m.end() : m.end() + 1] in ("", " ")} | {len(text)}
    dropped = [e for e in sorted(ends) if text[e : e + 1] == " " and (_WIDE.match(text, e - 1) or _WIDE.match(text, e + 1))]
    kept, last = [], 0
    for e in dropped:
        kept.append(text[last:e])
        last = e + 1
    return "".join([*kept, text[last:]]), [e - bisect(dropped, e - 1) for e in sorted(ends)]


def cuts(text: str, most: int) -> list[tuple[int, int]]:
    """(from, to) of the pieces of a :func:`joined` text, each as long as ``most`` allows.

    A piece ends with a sentence if one ends within reach; else behind the last pause mark of its second half, else
    at the last space there, else at ``most``.
    """
    return _cuts(*joined(text), most)


def _cuts(text: str, ends: list[int], most: int) -> list[tuple[int, int]]:
    if 0 < len(text) <= most:
        return [(0, len(text))]
    marks: dict[str, list[int]] = {"stop": ends, "pause": [], "space": []}
    for m in _MARK.finditer(text):
        marks[m.lastgroup].append(m.end())
    out, at = [], 0
    while at < len(text):
        reach = at + most
        for kind, least in (("stop", at + 1), ("pause", at + most // 2 + 1), ("space", at + most // 2 + 1)):
            k = bisect(marks[kind], reach)
            if k and marks[kind][k - 1] >= least:
                reach = marks[kind][k - 1]
                break
        out.append((at, reach))
        at = reach + (text[reach : reach + 1] == " ")
    return out


def pieces(text: str, most: int) -> list[str]:
    whole, ends = joined(text)
    return [x for x in (whole[a:b].strip() for a, b in _cuts(whole, ends, most)) if x]


_PIECE = StructType([StructField("piece", StringType())])


def speech_pieces(blocks: DataFrame, most: int = 220) -> DataFrame:
    """The rows of ``blocks`` (with a text) as pieces of at most ``most`` code points, with piece_no from 1 and ``piece``."""
    rows = each(blocks, ["text"], _PIECE, lambda text: [(x,) for x in pieces(text or "", most)], "piece_no")
    return rows.select(*(c for c in blocks.columns if c != "text"), "piece", "piece_no")
