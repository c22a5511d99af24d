"""Characters by number, and searches in parts."""

import html

from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators.answers import search_blocks


def test_numbered_characters(spark):
    cases = {
        "caf&#233; &#xE9; &#XE9;&#0233;": "café é éé", "&#128512;&#x1F600;": "\U0001f600\U0001f600", "&amp;#233; &#38;eacute; &amp;lt;": "&#233; &eacute; &lt;", "&#8212;&#8212;a": "——a",
        "&#0; &#xD800; &#1114112; &#; &#x; &#12 &#99999999;": "&#0; &#xD800; &#1114112; &#; &#x; &#12 &#99999999;", "": "", "plain": "plain", "&#233": "&#233",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "text string")
    assert {r.text: r.out for r in rows.select("text", T.entities(F.col("text")).alias("out")).collect()} == cases
    assert cases["&#128512;&#x1F600;"] == html.unescape("&#128512;&#x1F600;")
    assert spark.range(1).select(T.entities(F.lit(None).cast("string")).alias("x")).first().x in (None, "")


def test_searches_in_parts(spark):
    blocks = spark.createDataFrame([(1, 1, "One Tree, two trees"), (1, 2, "No\u00ebl"), (2, 1, None)], "doc_id long, block_no long, text string")
    queries = spark.createDataFrame([(i, x) for i, x in enumerate(["tree", "noel", "one", "", None, "zzz", "two"])], "query_id long, needle string")
    rows = lambda part: sorted(tuple(r) for r in search_blocks(blocks, queries, part).collect())
    assert rows(20_000) == rows(2) and [r[0] for r in rows(2)] == [0, 1, 2, 6]
