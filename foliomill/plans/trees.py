"""Trees and details of web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.operators import pagecheck, tree

from . import tables as t
from .registry import query


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in words) + ")"


#: Every start is followed to the first end at which its tag is no longer open; what is around a node is looked up among all.
_TREE = t.sql("p") + f"""
, k0 AS (SELECT page_id AS doc_id, regexp_extract_all(html, '(?s)<!--.*?-->|(?i:<script)\\b.*?(?i:</script)\\s*>|(?i:<style)\\b.*?(?i:</style)\\s*>|</?[a-zA-Z][^>]*>|[^<]+|<') AS l FROM p),
k1 AS (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS token FROM k0),
k2 AS (SELECT *, CASE WHEN regexp_matches(token, '(?i)^<(script|style)\\b') THEN '' ELSE lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) END AS tag, starts_with(token, '</') AS ends FROM k1),
k3 AS (SELECT *, CASE WHEN tag = '' OR tag IN {_list(tree.VOID)} OR ends_with(token, '/>') THEN 0 WHEN ends THEN -1 ELSE 1 END AS way FROM k2),
k4 AS (SELECT *, sum(way) OVER w AS b FROM k3 WINDOW w AS (PARTITION BY doc_id, tag ORDER BY pos)),
k5 AS (SELECT *, greatest(0, -min(b) OVER (PARTITION BY doc_id, tag ORDER BY pos)) AS lost FROM k4),
k6 AS (SELECT *, b + lost AS open, max(pos) OVER (PARTITION BY doc_id) AS final,
  (NOT ends AND tag IN {_list(tree.ENDS_P)}) OR (ends AND tag <> '' AND tag NOT IN {_list(tree.INLINE)}) AS edge FROM k5),
k7 AS (SELECT *, CASE WHEN way < 0 AND lost > lag(lost, 1, 0) OVER (PARTITION BY doc_id, tag ORDER BY pos) THEN 0 ELSE way END AS step FROM k6),
k8 AS (SELECT *, sum(CASE WHEN tag IN ('ul', 'ol') THEN step ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS lists FROM k7),
s AS (SELECT doc_id, pos, tag, open, final, lists FROM k8 WHERE way = 1),
it AS (SELECT s.doc_id, s.pos, arg_min(k8.pos - (NOT (k8.tag = 'li' AND k8.ends))::INT, k8.pos) AS item FROM s JOIN k8 ON s.tag = 'li' AND k8.doc_id = s.doc_id AND k8.pos > s.pos AND ((k8.tag = 'li' AND k8.lists = s.lists) OR (k8.tag IN ('ul', 'ol') AND k8.step = -1 AND k8.lists = s.lists - 1)) GROUP BY ALL),
e AS (SELECT s.doc_id, s.pos, s.tag, s.final, min(k6.pos) AS stop FROM s LEFT JOIN k6 ON k6.doc_id = s.doc_id AND k6.tag = s.tag AND k6.way = -1 AND k6.pos > s.pos AND k6.open = s.open - 1 GROUP BY ALL),
g AS (SELECT e.doc_id, e.pos, e.tag, e.final, e.stop, min(k6.pos) AS edge FROM e LEFT JOIN k6 ON k6.doc_id = e.doc_id AND k6.edge AND k6.pos > e.pos GROUP BY ALL),
n AS (SELECT g.doc_id, g.pos AS node, tag, CASE WHEN tag = 'li' THEN coalesce(item, final) WHEN tag = 'p' THEN CASE WHEN edge IS NULL THEN final WHEN edge = stop THEN edge ELSE edge - 1 END WHEN stop IS NOT NULL THEN stop WHEN tag IN {_list(tree.INLINE)} THEN coalesce(edge - 1, final) ELSE final END AS last FROM g LEFT JOIN it ON it.doc_id = g.doc_id AND it.pos = g.pos),
d AS (SELECT a.doc_id, a.node, a.tag, a.last, count(o.node) AS depth FROM n a LEFT JOIN n o ON o.doc_id = a.doc_id AND o.node < a.node AND o.last >= a.node GROUP BY ALL)
SELECT a.doc_id, a.node::INT AS node, a.tag, a.last::INT AS last, a.depth::INT AS depth, max(o.node)::INT AS parent FROM d a LEFT JOIN d o ON o.doc_id = a.doc_id AND o.depth = a.depth - 1 AND o.node < a.node AND o.last >= a.node GROUP BY ALL"""


@query("document_tree", _TREE)
def document_tree(spark, sf):
    """Elements of web pages as intervals, with what is around them."""
    return tree.document_tree(t.pages(spark, sf).select(F.col("page_id").alias("doc_id"), "html"))


@query("page_details")
def page_details(spark, sf):
    """Checks of pages that get cards and JSON-LD, some of it broken, by their number."""
    n = F.col("page_id")
    article = F.concat(F.lit('{"@type": "Article", "inLanguage": "en", "timeRequired": "PT'), n % 9, F.when(n % 5 == 0, " min").otherwise("M"), F.lit('", "author": {"name": "'), F.when(n % 7 == 0, "Admin").otherwise("A. Writer"), F.lit('"}, "accessibilityFeature": ["readingOrder"]'), F.when(n % 3 == 0, "").otherwise("}"))
    script = F.concat(F.lit('<script type="application/ld+json">'), article, F.lit('</script><meta name="twitter:card" content="summary"></head>'))
    return pagecheck.page_details(t.rich_pages(spark, sf).withColumn("html", F.replace("html", F.lit("</head>"), script)))
