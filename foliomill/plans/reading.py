"""Queries over passages and parts of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.operators import html
from foliomill.operators import passages as P

from . import tables as t
from .registry import _COLLAPSE, _HEADS, _NOTAGS, query


@query("passages", t.sql("d").replace("WITH", "WITH RECURSIVE", 1) + f""", l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_COLLAPSE.format('x')}), lambda x: x <> '') AS ls FROM d),
e AS (SELECT doc_id, ls, list_transform(range(0, len(ls) + 1), lambda i: coalesce(list_sum(list_transform(ls[1:i], lambda x: length(x) + 1)), 0)::BIGINT) AS s FROM (SELECT * FROM l WHERE len(ls) < 64) UNION ALL
 SELECT doc_id, any_value(ls), list_prepend(0::BIGINT, list(c ORDER BY i)) FROM (SELECT doc_id, ls, i, sum(length(ls[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS c FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l WHERE len(ls) >= 64)) GROUP BY doc_id),
r AS (SELECT doc_id, 0::BIGINT AS no, 0::BIGINT AS a, 0::BIGINT AS b FROM e WHERE len(ls) > 0 UNION ALL
 SELECT r.doc_id, no + 1, b, greatest(b + 1, len(list_filter(s, lambda x: x <= s[b + 1] + 1202)) - 1)::BIGINT FROM r JOIN e ON e.doc_id = r.doc_id WHERE b < len(ls))
SELECT r.doc_id, no AS passage_no, array_to_string(ls[a + 1:b], chr(10)) AS text FROM r JOIN e ON e.doc_id = r.doc_id WHERE no > 0""")
def passages(spark, sf):
    return P.passages(t.documents(spark, sf))


@query("build_context")
def build_context(spark, sf):
    return P.build_context(t.questions(spark, sf), t.documents(spark, sf))


def _articles(spark, sf):
    return t.pages(spark, sf).select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", r"(?is)<article\b[^>]*>(.*)</article>", 1).alias("html"))


@query("split_parts")
def split_parts(spark, sf):
    """Articles of the pages, in parts small enough that they are cut."""
    return P.split_parts(_articles(spark, sf), 400, 900)


_FIRST = _COLLAPSE.format(_NOTAGS.format("regexp_extract(html, '(?is)<h[1-6]\\b[^>]*>(.*?)</h[1-6]>', 1)"))


@query("part_titles", t.sql("p") + f"SELECT page_id AS doc_id, 1 AS part_no, {_FIRST} AS title FROM p")
def part_titles(spark, sf):
    return P.part_titles(t.pages(spark, sf).select(F.col("page_id").alias("doc_id"), F.lit(1).alias("part_no"), "html")).drop("html")


_MORE = '<h2 id="section-2">More</h2>'


@query("toc_with_parts", f"""WITH p AS (SELECT page_id, coalesce(html, '') || '{_MORE}' AS html FROM pages), {_HEADS},
h3 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i)::INT AS seq, count(*) OVER (PARTITION BY page_id) AS n FROM h2 WHERE text <> ''),
parts AS (SELECT page_id, 1 AS part_no, left(html, length(html) // 2) AS html FROM p UNION ALL SELECT page_id, 2, substr(html, length(html) // 2 + 1) FROM p),
o AS (SELECT page_id, id, min(part_no)::BIGINT AS part FROM (SELECT page_id, part_no, unnest(regexp_extract_all(html, '{P.HEADING_ID}', 1)) AS id FROM parts) GROUP BY ALL),
c AS (SELECT page_id, seq, 'section-' || seq AS id, level, text FROM h3 WHERE n > 1)
SELECT c.page_id, seq, c.id, level, text, coalesce(part, 1) AS part FROM c LEFT JOIN o ON o.page_id = c.page_id AND o.id = c.id""")
def toc_with_parts(spark, sf):
    """Two halves of each page as its parts, the second with one more heading."""
    pages = t.pages(spark, sf).withColumn("html", F.concat("html", F.lit(_MORE)))
    half = F.floor(F.length("html") / 2).cast("int")
    first = pages.select("page_id", F.lit(1).alias("part_no"), F.substring("html", F.lit(1), half).alias("html"))
    second = pages.select("page_id", F.lit(2).alias("part_no"), F.substring("html", half + 1, F.length("html")).alias("html"))
    return P.toc_with_parts(html.build_toc(pages), first.unionByName(second), "page_id")
