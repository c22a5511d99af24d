"""Markdown documents to blocks and table cells."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from foliomill.functions.rows import each

#: Quotes and items inside one another that are taken apart.
DEEPEST = 8
_MATTER = re.compile("---\n(?:.*\n)*?---[ \t]*(?:\n|$)")
# Starts of blocks, as the public description of CommonMark has them.
_FENCE = re.compile(r" {0,3}(?P<marks>(?P<mark>`)`{2,}(?=[^`]*$)|(?P<wave>~)~{2,})")
_ATX = re.compile(r" {0,3}(?P<level>#{1,6})(?:[ \t]+(?P<text>.*?))??(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(?:(?P<first>=+)|-+)[ \t]*$")
_THEMATIC = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_MARKER = re.compile(r"(?P<indent> *)(?:[-+*]|(?P<number>\d{1,9})[.)])[ \t]+(?P<text>\S.*)")
_DELIMITERS = re.compile(r"[ \t|]*:?--+:?[ \t]*(?:\|[ \t]*:?--+:?[ \t]*)*\|?[ \t]*$")


@dataclass
class _Container:
    """A quote, or an item with its indent and kind of marker."""

    kind: str
    indent: int = 0
    ordered: bool = False

    def enter(self, line: str) -> str | None:
        """What is left of a line that belongs inside; None if it doesn't."""
        bare = line.lstrip(" ")
        indent = len(line) - len(bare)
        if self.kind == "quote":
            return bare[1:].removeprefix(" ") if indent < 4 and bare.startswith(">") else None
        if not bare:
            return ""
        inside = indent > self.indent + bool(_MARKER.match(line))
        return line[min(indent, self.indent + 2) :] if inside else None


@dataclass
class _Block:
    """A block in the order of its opening; ``lines`` grow while it is open."""

    kind: str
    level: int
    depth: int
    lines: list[str] = field(default_factory=list)


class _Walk:
    """Each line walks down the open containers, then opens new ones, and what is left of it goes to a leaf."""

    def __init__(self) -> None:
        self.blocks: list[_Block] = []
        self.inside: list[_Container] = []
        self.leaf: _Block | None = None
        self.fence = ""
        self.empty = False  # whether the line before was blank

    def open(self, kind: str, *lines: str, level: int = 0) -> _Block:
        self.blocks.append(_Block(kind, level, len(self.inside), list(lines)))
        return self.blocks[-1]

    def line(self, line: str) -> None:
        bare = line.lstrip(" \t")
        line = line[: len(line) - len(bare)].expandtabs(4) + bare
        held = 0
        for container in self.inside:
            rest = container.enter(line)
            if rest is None:
                break
            line, held = rest, held + 1
        outside = self.inside[held:]
        if self.fence and not outside:
            self.code(line)
        elif not line.strip():
            self.blank(held)
        elif not (outside and self.lazy(line, outside)):
            if outside:
                self.leave(held)
            self.start(line)
        self.empty = not line.strip()

    def leave(self, held: int) -> None:
        del self.inside[held:]
        self.leaf, self.fence = None, ""

    def blank(self, held: int) -> None:
        """Ends text and the quotes that the line is outside of; an item waits for the next line."""
        quote = next((i for i in range(held, len(self.inside)) if self.inside[i].kind == "quote"), None)
        if quote is not None:
            self.leave(quote)
        self.leaf = None

    def code(self, line: str) -> None:
        bare = line.strip()
        if len(bare) >= len(self.fence) and not bare.strip(self.fence[0]) and len(line) - len(line.lstrip(" ")) < 4:
            self.leaf, self.fence = None, ""
        else:
            self.leaf.lines.append(line)

    def lazy(self, line: str, outside: list[_Container]) -> bool:
        """Text of a paragraph in an item may go on without its indent."""
        goes_on = self.in_text and not self.empty and all(c.kind == "item" for c in outside) and not _MARKER.match(line) and not self.interrupts(line)
        if goes_on:
            self.leaf.lines.append(line.lstrip())
        return goes_on

    @property
    def in_text(self) -> bool:
        return self.leaf is not None and self.leaf.kind not in ("code", "table")

    @staticmethod
    def interrupts(line: str) -> bool:
        marker = _MARKER.match(line)
        listed = marker and len(marker["indent"]) < 4 and marker["number"] in (None, "1")
        return bool(listed or _FENCE.match(line) or _ATX.match(line) or _THEMATIC.match(line) or re.match(" {0,3}>", line))

    def start(self, line: str) -> None:
        if self.leaf and self.leaf.kind == "table":
            if "|" in line:
                return self.leaf.lines.append(line)
            self.leaf = None
        if self.in_text:
            if self.becomes(line):
                return None
            if not self.interrupts(line):
                return self.leaf.lines.append(line)
            self.leaf = None
        lead = None  # the item that this line opened last, while it has no text
        while len(self.inside) <= DEEPEST:
            if (m := _FENCE.match(line)) and not lead:
                self.leaf, self.fence = self.open("code"), m["marks"]
            elif m := _ATX.match(line):
                self.open("heading", m["text"] or "", level=len(m["level"]))
            elif _THEMATIC.match(line):
                self.open("rule")
            elif (rest := _Container("quote").enter(line)) is not None:
                self.inside.append(_Container("quote"))
                line, lead = rest, None
                if line.strip():
                    continue
            elif m := _MARKER.match(line):
                lead = self.open("number" if m["number"] else "bullet")
                self.inside.append(_Container("item", len(m["indent"]), bool(m["number"])))
                line = m["text"]
                continue
            else:
                break
            return None
        if lead:
            lead.lines.append(line)
        self.leaf = lead or self.open("quote" if any(c.kind == "quote" for c in self.inside) else "paragraph", line)
        return None

    def becomes(self, line: str) -> bool:
        """A line of delimiters makes a table of the one line above, an underline a heading of all."""
        own = self.leaf.kind not in ("bullet", "number")
        if own and len(self.leaf.lines) == 1 and "|" in self.leaf.lines[0] and _DELIMITERS.match(line):
            self.leaf.kind = "table"
            self.leaf.lines.append(line)
        elif own and (m := _SETEXT.match(line)):
            self.leaf.kind, self.leaf.level, self.leaf = "heading", 1 if m["first"] else 2, None
        else:
            return False
        return True


Block = tuple[str, int, int, str]  # kind, level, depth, text


def blocks(text: str) -> list[Block]:
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    matter, walk = _MATTER.match(text), _Walk()
    for line in text[matter.end() if matter else 0 :].split("\n"):
        walk.line(line)
    return [(b.kind, b.level, b.depth, "\n".join(b.lines)) for b in walk.blocks]


_SHAPE = StructType([StructField("kind", StringType()), StructField("level", IntegerType()), StructField("depth", IntegerType()), StructField("text", StringType())])


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_no (from 1), kind, level (of headings), depth and text of Markdown documents (doc_id, text).

    Kinds are heading, paragraph, code, rule, quote, bullet, number and table; front matter goes. Blocks in quotes and
    items follow their place in the text, one deeper each. A null text has no blocks.
    """
    return each(docs.select("doc_id", "text"), ["text"], _SHAPE, lambda text: blocks(text or ""), "block_no")


def markdown_table_cells(found: DataFrame) -> DataFrame:
    """doc_id, block_no, row_no (0: header), col_no, is_header, align and text of the cells of table blocks; an escaped bar stays in its cell."""
    edge = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"^\|", ""), r"\|$", "")
    cells = lambda c: F.split(edge(c), r"(?<!\\)\|")
    lines = found.filter("kind = 'table'").select("doc_id", "block_no", F.split("text", "\n").alias("lines")).withColumn("dashes", cells(F.get("lines", F.lit(1))))
    rows = lines.select("doc_id", "block_no", "dashes", F.posexplode("lines").alias("n", "line")).filter("n <> 1")
    out = rows.select("doc_id", "block_no", "dashes", F.greatest(F.col("n") - 1, F.lit(0)).alias("row_no"), F.posexplode(cells(F.col("line"))).alias("col_no", "text"))
    sign = F.trim(F.coalesce(F.get("dashes", F.col("col_no")), F.lit("")))
    left, right = sign.startswith(":"), sign.endswith(":")
    align = F.when(left & right, "center").when(right, "right").when(left, "left").otherwise("")
    return out.select("doc_id", "block_no", "row_no", "col_no", (F.col("row_no") == 0).alias("is_header"), align.alias("align"), F.trim("text").alias("text"))
