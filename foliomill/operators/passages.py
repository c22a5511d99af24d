"""Passages and parts of long documents, and the passages that go with a question.

A null text or HTML is empty: it has no passages, and one empty part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T

from . import answers

#: Elements without content.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
_TAG = re.compile(rb"<(/?)([A-Za-z][A-Za-z0-9]*)\b[^>]*?(/?)>")
_HEADING = re.compile(rb"[hH][1-3]")
HEADING_ID = r'(?i)<h[1-6]\b[^>]*\bid="([^"]+)"'


def plain_lines(text: Column) -> Column:
    """Lines with a visible character, white space collapsed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), T.collapse), lambda x: x != "")


def _packed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lines in batch.column(1).to_pylist():
                ends, at, found = np.cumsum([0, *(len(x) + 1 for x in lines)]), 0, []
                while at < len(lines):
                    to = max(at + 1, int(np.searchsorted(ends, ends[at] + size + 2, "right")) - 1)
                    found.append("\n".join(lines[at:to]))
                    at = to
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["doc_id", "passages"])

    return run


def passages(docs: DataFrame, size: int = 1200) -> DataFrame:
    """doc_id, passage_no (from 1) and text: lines packed up to ``size`` characters, line breaks before the last line counted; a line is never cut."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_lines(F.col("text")).alias("lines"))
    rows = lines.mapInArrow(_packed(size), "doc_id long, passages array<string>")
    return rows.select("doc_id", F.posexplode("passages").alias("n", "text")).select("doc_id", (F.col("n") + 1).cast("long").alias("passage_no"), "text")


def build_context(questions: DataFrame, docs: DataFrame, limit: int = 6000, size: int = 1200) -> DataFrame:
    """question_id and context: passages of the question's document, best first while they fit, in reading order with […] in gaps.

    A document of at most ``limit`` characters goes whole, and a question without usable words gets
    its beginning. A passage without a word of the question is taken only if no other one fits.
    Only numbers and lengths of a document's passages are folded; their texts are joined afterwards.
    """
    asked = questions.select("question_id", F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_join(plain_lines(F.col("text")), "\n").alias("whole"))
    rows = asked.join(whole, "doc_id")
    ranks = (F.length("whole") > limit) & (F.size(answers.terms(F.coalesce("text", F.lit("")))) > 0)
    easy = rows.filter(~ranks).select("question_id", F.substring("whole", 1, limit).alias("context"))
    long = rows.filter(ranks).select("question_id", "doc_id", "text")
    cut = passages(docs.join(long.select("doc_id").distinct(), "doc_id", "left_semi"), size)
    scores = answers.rank_passages(long, answers.passage_terms(cut)).select("question_id", "passage_no", "score")
    sized = long.drop("text").join(cut.select("doc_id", "passage_no", F.length("text").alias("size")), "doc_id").join(scores, ["question_id", "passage_no"], "left")
    order = F.sort_array(F.collect_list(F.struct((-F.coalesce("score", F.lit(0.0))).alias("low"), "passage_no", "size")))

    def step(state: Column, x: Column) -> Column:
        fits = (state["used"] + x["size"] <= limit) & ((x["low"] < 0) | (F.size(state["chosen"]) == 0))
        return F.when(fits, F.struct((state["used"] + x["size"]).alias("used"), F.array_append(state["chosen"], x["passage_no"]).alias("chosen"))).otherwise(state)

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<long>").alias("chosen"))
    folded = sized.groupBy("question_id", "doc_id").agg(order.alias("order")).select("question_id", "doc_id", F.explode(F.aggregate("order", start, step, lambda s: s["chosen"])).alias("passage_no"))
    before = F.lag("passage_no").over(Window.partitionBy("question_id").orderBy("passage_no"))
    piece = F.concat(F.when(before < F.col("passage_no") - 1, "[…]\n").otherwise(""), "text").alias("piece")
    pieces = folded.join(cut, ["doc_id", "passage_no"]).select("question_id", "passage_no", piece)
    joined = pieces.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("passage_no", "piece"))).alias("p"))
    chosen = joined.select("question_id", F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("context"))
    return easy.unionByName(long.select("question_id").join(chosen, "question_id", "left").select("question_id", F.coalesce("context", F.lit("")).alias("context")))


def _cuts(html: bytes, soft: int, hard: int) -> list[int]:
    """Ends of the parts of one document."""
    if len(html) <= hard:
        return [len(html)]
    tags = [(m.start(), bool(m[1]), m[2], bool(m[3])) for m in _TAG.finditer(html)]
    closing = np.array([x[1] for x in tags], bool)
    void = np.array([x[3] or x[2].lower().decode() in VOID for x in tags], bool)
    depth = np.cumsum(np.where(closing, -1, np.where(void, 0, 1)))
    depth -= np.minimum(np.minimum.accumulate(depth), 0) if len(depth) else 0  # stray closing tags don't count
    top = ~closing & (np.r_[0, depth[:-1]] == 0) if len(tags) else closing
    every = np.array([x[0] for x in tags], np.int64)[top]
    heads = np.array([x[0] for x, t in zip(tags, top) if t and _HEADING.fullmatch(x[2])], np.int64)
    ends, at = [], 0
    while True:
        following = [list_[i] for list_, least in ((every, hard), (heads, soft)) if (i := int(np.searchsorted(list_, at + max(least, 1)))) < len(list_)]
        if not following:
            return [*ends, len(html)]
        at = int(min(following))
        ends.append(at)


def _parts(soft: int, hard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in (x.encode() for x in batch.column(1).to_pylist()):
                ends = _cuts(raw, soft, hard)
                out.append([raw[a:b].decode() for a, b in zip([0, *ends], ends)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["doc_id", "parts"])

    return run


def split_parts(docs: DataFrame, soft: int = 60_000, hard: int = 120_000) -> DataFrame:
    """doc_id, part_no (from 1), bytes and html: cut where a block of the top level starts, at h1 to h3 from ``soft`` bytes on and at any block from ``hard`` on.

    The parts of a document end to end are the document; one of at most ``hard`` bytes stays whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_parts(soft, hard), "doc_id long, parts array<string>")
    parts = rows.select("doc_id", F.posexplode("parts").alias("n", "html"))
    return parts.select("doc_id", (F.col("n") + 1).cast("long").alias("part_no"), F.octet_length("html").cast("long").alias("bytes"), "html")


def part_titles(parts: DataFrame) -> DataFrame:
    """With title: the first heading, '' without one."""
    return parts.withColumn("title", T.collapse(T.no_tags(F.regexp_extract("html", r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>", 1))))


def toc_with_parts(toc: DataFrame, parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Contents entries with the part whose heading carries their id, the first such part; 1 without one."""
    ids = parts.select(key, "part_no", F.explode(F.regexp_extract_all("html", F.lit(HEADING_ID), 1)).alias("id"))
    owner = ids.groupBy(key, "id").agg(F.min("part_no").cast("long").alias("part"))
    return toc.join(owner, [key, "id"], "left").withColumn("part", F.coalesce("part", F.lit(1).cast("long")))
