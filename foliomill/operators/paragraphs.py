"""Printed lines to paragraphs, paragraphs over page breaks, and lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from foliomill.functions import text as T
from foliomill.functions.lines import join_lines, join_two, mend
from foliomill.functions.rows import each

from . import structure

#: What a sentence ends with.
TERMINAL = '.!?:"”»。！？」』।॥'
#: Characters of a line that may be the label over a list.
LABEL = 60
_BULLET, _ORDERED = re.compile(structure.BULLET), re.compile(f"{structure.NUMBER}|{structure.LETTER}")
_LEADER_END = re.compile(T.LEADER + r"[ \t]*[0-9]{1,4}$")


def _opens(line: str, above: str, in_item: bool) -> bool:
    """Whether a line starts a paragraph of its own under the text ``above``."""
    if _BULLET.match(line):
        return True
    if _ORDERED.match(line):
        return in_item or len(above) <= LABEL
    return in_item and not line[:1].islower()


def _closes(above: str) -> bool:
    """The end of a sentence, or the page number of a contents entry; a text is searched only if it may have one."""
    if above[-1] in TERMINAL:
        return True
    return above[-1] in "0123456789" and above.rstrip("0123456789").rstrip(" \t")[-1:] in ("…", "_", ".") and _LEADER_END.search(above) is not None


def _paragraphs(text: str, lang: str) -> list[tuple[str]]:
    out, above, in_item = [], "", False
    for line in [*(mend(x.strip(), lang or "") for x in text.split("\n")), ""]:
        if above and (not line or _opens(line, above, in_item)):
            out.append(above)
            above = ""
        if not line:
            continue
        if not above:
            in_item = bool(_BULLET.match(line) or _ORDERED.match(line))
        above = join_two(above, line, lang or "") if above else line
        if _closes(above):
            out.append(above)
            above = ""
    return [(" ".join(x.split()),) for x in out]


_TEXT = StructType([StructField("text", StringType())])


def rebuild_paragraphs(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, block_no (from 1), text and lang: the paragraphs of pages (doc_id, page_no, text, lang).

    A blank line, the end of a sentence and the page number of a contents entry close a paragraph; the
    marker of a list opens one. A null text has no paragraphs; a page is what one row holds.
    """
    lines = structure.rejoin_toc_breaks(pages.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")))
    rows = lines.select("doc_id", "page_no", F.col("lang").alias("_lang"), "lang", "text")
    rows = each(rows, ["text", "_lang"], _TEXT, _paragraphs, "block_no")
    return rows.select("doc_id", "page_no", "block_no", "text", "lang")


def _judged(items: DataFrame) -> DataFrame:
    """Items of pages with list_no and ``_good``, by the rules of ``confirm_lists``; rows without a family are no items and end a run."""
    page = Window.partitionBy("doc_id", "page_no").orderBy("block_no")
    item = F.col("family").isNotNull()
    gap = ~item | F.coalesce(F.lag(F.when(item, F.col("block_no"))).over(page) != F.col("block_no") - 1, F.lit(True))
    turn = gap | (F.lag("family").over(page) != F.col("family"))
    step = F.coalesce(F.lag("value").over(page) + 1 == F.col("value"), F.lit(False))
    rows = items.withColumns({"_gap": gap, "_turn": turn, "_step": turn | step})
    rows = rows.withColumns({"_run": F.sum(F.col("_gap").cast("int")).over(page), "list_no": F.sum(F.col("_turn").cast("int")).over(page)})
    before = F.lag("value").over(Window.partitionBy("doc_id", "page_no", "_run", "family").orderBy("block_no"))
    rows = rows.withColumn("_goes_on", F.coalesce(F.col("_turn") & (before + 1 == F.col("value")) & (F.col("kind") == "ol"), F.lit(False)))
    group = Window.partitionBy("doc_id", "page_no", "list_no")
    rows = rows.withColumns({"_n": F.count("*").over(group), "_even": F.min("_step").over(group), "_from": F.max(F.when(F.col("_turn"), F.col("value"))).over(group), "_follows": F.max("_goes_on").over(group)})
    rows = rows.withColumn("_sure", item & ((F.col("_n") >= 2) | F.col("_follows")) & ((F.col("kind") == "ul") | F.col("_even")))
    numbered = F.coalesce(F.lag(F.col("_sure") & F.startswith("family", F.lit("number"))).over(page), F.lit(False))
    rows = rows.withColumn("_numbered", F.col("_turn") & ~F.col("_gap") & numbered)
    under = F.max("_numbered").over(group) & (F.col("_from") == 1) & F.col("family").isin("lower", "upper") & F.col("_even")
    return rows.withColumn("_good", item & (F.col("_sure") | under)).drop("_gap", "_turn", "_step", "_run", "_goes_on", "_n", "_even", "_from", "_follows", "_sure", "_numbered")


def confirm_lists(items: DataFrame) -> DataFrame:
    """Candidates of lists that are lists, with list_no in their page.

    ``items`` are doc_id, page_no, block_no, kind, family and value, as ``list_markers`` gives them. Runs of
    neighbours are cut where the family changes. A group is a list if it has two items, goes on from
    the last value of its family in the run, or is a lone first letter right under a numbered list; the values of an
    ordered one must be consecutive.
    """
    return _judged(items).filter("_good").select(*items.columns, "list_no")


_MARKED = f"^(?:[{structure.BULLETS}{structure.SYMBOLS}]|[0-9]{{1,2}}[.)]|[a-zA-Z]\\))"


def page_blocks(paragraphs: DataFrame) -> DataFrame:
    """doc_id, page_no, block_no (from 1), kind, text, target and lang of rebuilt paragraphs.

    Contents entries are 'toc', with their title as text and the page they name as ``target``; the word "Contents" that
    stuck to the first one of a run is a 'toc-heading', and what stood before it a 'p'. Items of lists are 'ul', without
    their bullet, or 'ol'. Everything else is 'p'.
    """
    page = Window.partitionBy("doc_id", "page_no")
    text, title = F.col("text"), F.col("_title")
    rows = paragraphs.withColumn("_toc", F.coalesce(F.substring(text, -1, 1).between("0", "9") & text.rlike(structure.ENTRY), F.lit(False)))
    rows = rows.withColumn("_first", F.col("_toc") & ~F.coalesce(F.lag("_toc").over(page.orderBy("block_no")), F.lit(False)))
    rows = rows.withColumns({"_title": F.when(F.col("_toc"), structure.entry_title()), "_target": F.when(F.col("_toc"), F.regexp_extract("text", structure.ENTRY, 2).cast("int"))})
    part = lambda kind, text, target=None: F.struct(F.lit(kind).cast("string").alias("_kind"), text.alias("text"), F.lit(target).cast("int").alias("target"))
    stuck = lambda i: F.regexp_extract(title, structure.STUCK, i)
    lead = F.when(stuck(1) != "", F.array(part("p", stuck(1)))).otherwise(F.array().cast("array<struct<_kind:string,text:string,target:int>>"))
    parts = F.when(~F.col("_toc"), F.array(part(None, text))).when(F.col("_first") & title.rlike(structure.STUCK), F.concat(lead, F.array(part("toc-heading", stuck(2)), part("toc", stuck(3), F.col("_target"))))).otherwise(F.array(part("toc", title, F.col("_target"))))
    rows = rows.select("doc_id", "page_no", "block_no", "lang", F.posexplode(parts).alias("_at", "_part")).select("doc_id", "page_no", "block_no", "lang", "_at", "_part.*")
    rows = rows.withColumn("block_no", F.row_number().over(page.orderBy("block_no", "_at")))
    # What begins like no item isn't searched for one.
    may = F.col("_kind").isNull() & F.substring(text, 1, 3).rlike(_MARKED)
    rows = structure.with_markers(rows.withColumns({"_text": text, "text": F.when(may, text)}))
    rows = _judged(rows.drop("text").withColumnRenamed("_text", "text"))
    kind = F.when(F.col("_good"), F.col("kind")).otherwise(F.coalesce("_kind", F.lit("p")))
    return rows.select("doc_id", "page_no", "block_no", kind.alias("kind"), F.when(F.col("_good"), F.col("item")).otherwise(text).alias("text"), "target", "lang")


#: What is no text at the ends of one.
_ENDS = " \t\n\r\0\v"


def stitch_pages(blocks: DataFrame, markers: bool = False) -> DataFrame:
    """A sentence that goes on on the next page is one paragraph, on the page where it starts.

    ``blocks`` are doc_id, page_no, block_no, kind ('p', 'toc' or other), text and lang. The last paragraph
    of a page that ends no sentence takes in the first paragraph or contents entry of the page after it. A
    paragraph that was taken in is closed; pages without blocks stop a sentence. With a column ``target``, the page
    that a contents entry names, a paragraph that takes in an entry is one, with its target. With ``markers`` between
    the pages it takes in nothing but an entry without a title, whose title it is.

    Only the first and the last block of each page meet by document; the others stay with their page.
    """
    page = Window.partitionBy("doc_id", "page_no").orderBy("block_no")
    edge = lambda other: other(F.lit(1)).over(page).isNull()
    rows = blocks.withColumns({"_top": edge(F.lag), "_end": edge(F.lead)})
    rows = rows.withColumn("_inner", F.when(~F.col("_top") & ~F.col("_end"), F.col("page_no")))
    order = Window.partitionBy("doc_id", "_inner").orderBy("page_no", "block_no")
    open_ = F.col("_end") & (F.col("kind") == "p") & ~F.substring(F.rtrim("text", F.lit(_ENDS)), -1, 1).isin(*TERMINAL)
    rows = rows.withColumn("_open", F.coalesce(open_, F.lit(False)))
    taken = (F.col("kind") == "toc") & (F.col("text") == "") if markers else F.col("kind").isin("p", "toc")
    after = F.lag("_open").over(order) & (F.lag("page_no").over(order) == F.col("page_no") - 1) & taken
    rows = rows.withColumn("_link", F.coalesce(after, F.lit(False)))
    # Along pages of one open paragraph each, every second one is taken in.
    rows = rows.withColumn("_island", F.sum((~F.col("_link")).cast("int")).over(order))
    steps = F.row_number().over(Window.partitionBy("doc_id", "_inner", "_island").orderBy("page_no", "block_no")) - 1
    rows = rows.withColumn("_taken", F.col("_link") & (steps % 2 == 1))
    rows = rows.withColumn("_takes", F.coalesce(F.lead("_taken").over(order), F.lit(False)))
    following = lambda c: F.when(F.col("_takes"), F.lead(c).over(order))
    rows = rows.withColumn("_next", F.when(F.col("_takes"), F.coalesce(F.lead("text").over(order), F.lit(""))))
    if "target" in blocks.columns:
        rows = rows.withColumns({"_kind": following("kind"), "_target": following("target")})
        entry = F.col("_kind") == "toc"
        rows = rows.withColumns({"kind": F.when(entry, F.lit("toc")).otherwise(F.col("kind")), "target": F.when(entry, F.col("_target")).otherwise(F.col("target"))})
    text = F.when(F.col("_takes"), F.trim(join_lines(F.when(F.col("_takes"), F.col("text")), "_next", "lang"), F.lit(_ENDS))).otherwise(F.col("text"))
    return rows.filter(~F.col("_taken")).withColumn("text", text).select(blocks.columns)


def _outlined(blocks: list[tuple[str, str]], entries: list[tuple[str, int]]) -> list[tuple[str, int | None, str]]:
    """One page: each entry, in order, takes its title off the first paragraph from the cursor on that starts with it."""
    flat = lambda x: " ".join(x.split())
    row = lambda kind, level, text: (kind, level, text, (even := flat(text)), even.lower())
    rows, cursor = [row(kind, None, text) for kind, text in blocks], 0
    for title, level in entries:
        heading, name = row("h", level, title), flat(title).lower()
        at = next((i for i in range(cursor, len(rows)) if rows[i][0] == "p" and rows[i][4].startswith(name)), None)
        if at is None:
            rows.insert(cursor, heading)
            cursor += 1
            continue
        rest = rows[at][3][len(name) :].strip()
        rows[at : at + 1] = [heading, *([row("p", None, rest)] if rest else [])]
        cursor = at + 1
    return [x[:3] for x in rows]


_OUTLINED = {"doc_id": pa.int64(), "page_no": pa.int64(), "block_no": pa.int64(), "kind": pa.string(), "level": pa.int32(), "text": pa.string()}
#: Rows of the batches that go back.
_ROWS = 4_096


def _outlined_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, then entries, of page after page; only the page at hand is kept between batches."""
    made, page, blocks, entries = [], None, [], []

    def close() -> None:
        if page is not None:
            made.extend((*page, n, *x) for n, x in enumerate(_outlined(blocks, entries), 1))
            blocks.clear(), entries.clear()

    def batch_of() -> pa.RecordBatch:
        columns = zip(*made) if made else [()] * len(_OUTLINED)
        out = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, _OUTLINED.values())], list(_OUTLINED))
        made.clear()
        return out

    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            for doc, number, entry, kind, level, text in zip(*(c.to_pylist() for c in batch.slice(at, _ROWS).columns)):
                if (doc, number) != page:
                    close()
                    page = doc, number
                    if len(made) >= _ROWS:
                        yield batch_of()
                if entry:
                    entries.append((text, level))
                else:
                    blocks.append((kind, text))
    close()
    yield batch_of()


def merge_outline(blocks: DataFrame, outline: DataFrame) -> DataFrame:
    """doc_id, page_no, block_no, kind, level and text of pages with the headings that their outline names.

    ``blocks`` are doc_id, page_no, block_no, kind and text, ``outline`` doc_id, page_no, entry_no, title and level.
    A title that no paragraph starts with is put in where the entry before it stands. Null texts count as empty; a page
    is what meets in one task. Pages come in Spark's order, one after the other.
    """
    page = [F.col("doc_id").cast("long").alias("doc_id"), F.col("page_no").cast("long").alias("page_no")]
    rows = blocks.select(*page, F.lit(False).alias("entry"), F.col("block_no").cast("long").alias("n"), "kind", F.lit(None).cast("int").alias("level"), F.coalesce("text", F.lit("")).alias("text"))
    entries = outline.select(*page, F.lit(True).alias("entry"), F.col("entry_no").cast("long").alias("n"), F.lit(None).cast("string").alias("kind"), F.col("level").cast("int").alias("level"), F.coalesce("title", F.lit("")).alias("text"))
    both = rows.unionByName(entries).repartition("doc_id", "page_no").sortWithinPartitions("doc_id", "page_no", "entry", F.asc_nulls_last("n"), "kind", "level", "text").drop("n")
    return both.mapInArrow(_outlined_pages, "doc_id long, page_no long, block_no long, kind string, level int, text string")


def keep_reordered_text(pages: DataFrame, share: float = 0.9, probes: int = 5, text: int = 200) -> DataFrame:
    """doc_id, page_no and text: the reordered text of pages (doc_id, page_no, plain, ordered) where it can be trusted, else the plain one.

    It needs ``share`` of the letters and digits of the plain text. A document whose first ``probes`` pages of more
    than ``text`` characters have none is read as it is to the end.
    """
    marks = lambda c: T.count(F.coalesce(F.col(c), F.lit("")), r"[\p{L}\p{N}]")
    rows = pages.withColumn("_good", F.col("ordered").isNotNull() & (marks("ordered") >= share * marks("plain")))
    rows = rows.withColumn("_first", F.min(F.when(F.col("_good"), F.col("page_no"))).over(Window.partitionBy("doc_id")))
    probe = (F.col("page_no") < F.col("_first")) & (F.length(F.trim("plain")) > text)
    rows = rows.withColumn("_probed", F.sum(probe.cast("int")).over(Window.partitionBy("doc_id")))
    return rows.select("doc_id", "page_no", F.when(F.col("_good") & (F.coalesce("_probed", F.lit(0)) < probes), F.col("ordered")).otherwise(F.col("plain")).alias("text"))
