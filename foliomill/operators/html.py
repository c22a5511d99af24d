"""HTML documents: headings, contents, titles, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T

HEADING = r"(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]>"
BLOCK = r"(?is)<(?:p|li|h[1-6]|figcaption)\b[^>]*>(.*?)</(?:p|li|h[1-6]|figcaption)>"


def title_of(html):
    return T.collapse(T.no_tags(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)))


def build_toc(docs: DataFrame) -> DataFrame:
    """page_id, seq, id, level and text of the headings with text; documents with one heading have no contents."""
    levels, bodies = (F.regexp_extract_all("html", F.lit(HEADING), i) for i in (1, 2))
    heads = F.filter(F.transform(F.arrays_zip(levels.alias("level"), bodies.alias("body")), lambda x: F.struct(x["level"].cast("int").alias("level"), T.collapse(T.no_tags(x["body"])).alias("text"))), lambda x: x["text"] != "")
    rows = docs.select("page_id", heads.alias("heads")).filter(F.size("heads") > 1)
    return rows.select("page_id", F.posexplode("heads").alias("n", "head")).select("page_id", (F.col("n") + 1).alias("seq"), F.concat(F.lit("section-"), F.col("n") + 1).alias("id"), "head.level", "head.text")


def toc_tree(docs: DataFrame) -> DataFrame:
    """page_id, seq and depth: one step deeper than the entry before at most.

    An entry's depth is the least of its own level and, for every entry before it, that one's level and the
    steps since: a running minimum.
    """
    levels = F.transform(F.regexp_extract_all("html", F.lit(HEADING), 1), lambda x: x.cast("int"))
    rows = docs.select("page_id", levels.alias("levels")).filter(F.size("levels") > 1).select("page_id", F.array_min("levels").alias("top"), F.posexplode("levels").alias("n", "level"))
    own = F.when(F.col("n") == 0, 0).otherwise(F.col("level") - F.col("top")) - F.col("n")
    return rows.select("page_id", (F.col("n") + 1).alias("seq"), (F.col("n") + F.min(own).over(Window.partitionBy("page_id").orderBy("n"))).cast("int").alias("depth"))


def demote_headings(docs: DataFrame) -> DataFrame:
    """All headings of a document with an h1 one level down; h6 stays."""
    html = F.col("html")
    for level in range(5, 0, -1):
        html = F.regexp_replace(html, f"(?i)<(/?)h{level}\\b", f"<$1h{level + 1}")
    return docs.withColumn("html", F.when(F.col("html").rlike(r"(?i)<h1\b"), html).otherwise(F.col("html")))


def html_blocks(docs: DataFrame) -> DataFrame:
    """page_id, block_no and text of paragraphs, items, headings and captions."""
    texts = F.filter(F.transform(F.regexp_extract_all("html", F.lit(BLOCK), 1), lambda x: T.collapse(T.no_tags(x))), lambda x: x != "")
    return docs.select("page_id", F.posexplode(texts).alias("n", "text")).select("page_id", (F.col("n") + 1).alias("block_no"), "text")


def needs_parts(docs: DataFrame, text: str, always: int = 350_000, asked: int = 120_000) -> DataFrame:
    """Whether a document is cut into parts, unasked and when asked for, by its bytes."""
    return docs.withColumns({"bytes": F.octet_length(text).cast("long"), "always": F.octet_length(text) >= always, "if_asked": F.octet_length(text) >= asked})


def same_titles(docs: DataFrame) -> DataFrame:
    """Titles that stand more than once, without regard to case and space; an empty one never matches."""
    return docs.select(F.lower(title_of(F.col("html"))).alias("title")).filter("title <> ''").groupBy("title").agg(F.count("*").alias("n")).filter("n > 1")


def structure_counts(docs: DataFrame) -> DataFrame:
    """Headings with text, images, and images without a description."""
    html = F.col("html")
    heads = F.size(F.filter(F.regexp_extract_all(html, F.lit(HEADING), 2), lambda x: T.collapse(T.no_tags(x)) != "")).cast("long")
    return docs.select("page_id", heads.alias("headings"), T.count(html, r"(?i)<img\b").alias("images"), T.count(html, r'(?i)<img\b[^>]*\balt=""').alias("missing_alt"))


def shift_title_headings(headings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Where a document has a title above its headings (``level`` 0), every level goes one down; 6 stays."""
    titled = F.min("level").over(Window.partitionBy(key)) == 0
    return headings.withColumn("level", F.when(titled, F.least(F.col("level") + 1, F.lit(6))).otherwise(F.col("level")))
