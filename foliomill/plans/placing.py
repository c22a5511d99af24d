"""The reading order of pages that are made from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators import layout

from . import tables as t
from .registry import _COLLAPSE, query

#: Characters of a line, and lines of a page in two columns.
LINE, SHEET = 40, 30


def runs(spark, sf):
    """Each document as pages of two columns, a line in two pieces.

    The stream goes across the columns, but in every third document down them; every other page is upside down.
    """
    size = LINE * SHEET
    whole = t.documents(spark, sf).select("doc_id", T.collapse(F.col("text")).alias("whole")).filter("whole <> ''")
    # Pages are cut first, so that a line is no row with its whole document.
    sheets = F.transform(F.sequence(F.lit(0), F.floor((F.length("whole") - 1) / size).cast("int")), lambda p: F.substring(F.col("whole"), p * size + 1, F.lit(size)))
    rows = whole.select("doc_id", F.posexplode(sheets).alias("page_no", "sheet"))
    last = F.floor((F.length("sheet") - 1) / LINE).cast("int")
    lines = F.transform(F.sequence(F.lit(0), last), lambda n: F.trim(F.substring(F.col("sheet"), n * LINE + 1, F.lit(LINE))))
    rows = rows.select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.ceil((last + 1) / 2).alias("half"), F.posexplode(lines).alias("at", "text"))
    right = (F.col("at") >= F.col("half")).cast("int")
    row = F.col("at") - right * F.col("half")
    order = F.when(F.col("doc_id") % 3 == 0, F.col("at")).otherwise(2 * row + right)
    y = F.when((F.col("doc_id") + F.col("page_no")) % 2 == 0, 13 * row).otherwise(700 - 13 * row)
    cut = F.array(*(F.struct(F.lit(k).alias("k"), x.alias("x"), piece.alias("text")) for k, x, piece in ((0, F.lit(0), F.substring("text", 1, 17)), (1, F.least(F.length("text"), F.lit(17)) * 5, F.substring("text", 18, LINE)))))
    placed = rows.select("doc_id", "page_no", order.alias("o"), (50 + 260 * right).alias("margin"), y.alias("y"), F.inline(cut))
    return placed.select("doc_id", "page_no", (2 * F.col("o") + F.col("k")).alias("ord"), (F.col("margin") + F.col("x")).cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(10.0).alias("size"), "text")


@query("reading_order", t.sql("d") + f"""
, w AS (SELECT doc_id, {_COLLAPSE.format("text")} AS text FROM d),
ls AS (SELECT doc_id, unnest(range(0, (length(text) - 1) // {LINE} + 1)) AS n, text FROM w WHERE length(text) > 0),
l AS (SELECT doc_id, n // {SHEET} AS page_no, n % {SHEET} AS k, trim(substr(text, n * {LINE} + 1, {LINE})) AS line FROM ls),
m AS (SELECT *, (count(*) OVER (PARTITION BY doc_id, page_no) + 1) // 2 AS half, count(*) OVER (PARTITION BY doc_id, page_no) // 2 AS other FROM l),
c AS (SELECT doc_id, page_no, k, line, k >= half AS rgt, other, half FROM m),
side AS (SELECT doc_id, page_no, rgt, max(other) AS other, max(half) AS half, list_sort(list(length(line)))[count(*) // 2 + 1] AS med,
  sum(length(regexp_replace(line, '\\P{{L}}', '', 'g'))) AS let, sum(length(regexp_replace(line, '[\\s\\p{{Z}}\\x85]', '', 'g'))) AS marks FROM c GROUP BY ALL),
good AS (SELECT doc_id, page_no FROM side GROUP BY ALL HAVING max(other) >= 4 AND max(other) + max(half) >= 9 AND min(med) >= 20 AND bool_and(let >= 0.6 * marks))
SELECT doc_id, page_no, string_agg(line, chr(10) ORDER BY k) AS text FROM c JOIN good USING (doc_id, page_no) WHERE doc_id % 3 <> 0 GROUP BY ALL""")
def reading_order(spark, sf):
    """Pages whose columns the stream mixes, read down the left one and down the right one."""
    return layout.reading_order(runs(spark, sf))
