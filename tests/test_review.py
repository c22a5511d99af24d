"""Goldens of the structure review."""

from foliomill.operators import review
from foliomill.operators.tree import document_tree
from foliomill.plans import tables
from tests.conftest import SF


LONG = "word " * 40
CASES = [
    ("<h1>A</h1><p>Just text.</p>", [], None), ("", [], ""), ("<p>Text</p><p> &nbsp;</p>", [("empty-block", "")], "<p>Text</p>"), ("<h2> </h2><p>x.</p>", [("empty-block", "")], "<p>x.</p>"),
    ('<p><img src="a"></p>', [], None), ("<p><strong>The plan &amp; more</strong></p><p>x.</p>", [("heading-like", "The plan & more")], "<h2>The plan &amp; more</h2><p>x.</p>"),
    ("<p><b>Bold sentence.</b></p>", [], None), ("<p>Some <b>bold</b></p>", [], None), ('<p class="chapter-title">Ends</p>', [("heading-like", "Ends")], "<h2>Ends</h2>"),
    ('<p style="font-size: 18pt; text-align:center">Large</p>', [("heading-like", "Large")], "<h2>Large</h2>"), ('<p style="font-size: 12px; text-align:center">Small</p>', [], None), ("<p>Chapter 3</p>", [("heading-like", "Chapter 3")], "<h2>Chapter 3</h2>"),
    ("<p>Chapter three of the long book on</p>", [], None), ("<p>one<br><br/>two</p>", [("excess-br", "onetwo")], "<p>one</p><p>two</p>"), ("<p>one<br>two</p>", [], None),
    ("<h2>A sentence that</h2><h2>goes on</h2>", [("split-heading", "A sentence that goes on")], "<h2>A sentence that goes on</h2>"), ("<h2>One</h2><h2>Two</h2>", [], None), ("<h2>One</h2><h3>two</h3>", [], None), ("<h2>One</h2>\n<p>x.</p><h2>two</h2>", [], None),
    (f"<h2>{LONG}</h2>", [("long-heading", LONG.strip()[:87] + "…")], f"<p>{LONG}</p>"), ("<h1>A</h1><h3>B</h3><h4>C</h4>", [("heading-skip", "B"), ("heading-skip", "C")], "<h1>A</h1><h2>B</h2><h3>C</h3>"),
    ("<h3>A</h3><h1>B</h1><h2>C</h2>", [], None), ("loose <b>text</b><p>x.</p>", [("loose-text", "loose text")], "<p>loose text</p><p>x.</p>"), ("<div>a<p>x.</p>b</div>", [("loose-text", "a"), ("loose-text", "b")], "<div><p>a</p><p>x.</p><p>b</p></div>"),
    ("<div>a<section>b<p>x.</p></section><blockquote>c</blockquote></div>", [("loose-text", "a"), ("loose-text", "b"), ("loose-text", "c")], "<div><p>a</p><section><p>b</p><p>x.</p></section><blockquote><p>c</p></blockquote></div>"),
    ("<ul><li>item <p>x.</p> tail</li><li>next</ul><p>y.</p>", [], None), ("<table><tr><td>a<div>b</div><p>x.</p>c</td></tr></table>", [], None), ("<div><li>alone</li></div>", [("loose-text", "alone")], "<div><li><p>alone</p></li></div>"),
    ("<ul><li><h3>One</h3>text</li></ul>after", [("loose-text", "after")], "<ul><li><h3>One</h3>text</li></ul><p>after</p>"), ("</div><p>x.</p></ul>end", [("loose-text", "end")], "</div><p>x.</p></ul><p>end</p>"),
    ("<p>x.</p><ul><li>item</li></ul><table><tr><td>y</td></tr></table>", [], None),
]


def by_document(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.doc_id, []).append((r.type, r.excerpt))
    return {k: sorted(v) for k, v in out.items()}


def test_issues(spark):
    docs = spark.createDataFrame([(i, html) for i, (html, _, _) in enumerate(CASES)], "doc_id long, html string")
    assert by_document(review.audit_documents(docs)) == {i: issues for i, (_, issues, _) in enumerate(CASES) if issues}
    fixed = review.fix_documents(docs)
    assert {r.doc_id: r.html for r in fixed.collect()} == {i: html if want is None else want for i, (html, _, want) in enumerate(CASES)}
    assert by_document(review.audit_documents(fixed)) == {}


def test_null_and_empty_tables(spark):
    none = spark.createDataFrame([(1, None)], "doc_id long, html string")
    assert review.audit_documents(none).count() == 0 and review.fix_documents(none).first().html == ""
    assert review.audit_documents(none.filter("false")).count() == review.fix_documents(none.filter("false")).count() == 0


def test_pages_have_no_issue_once_mended(spark):
    pages = tables.rich_pages(spark, SF).withColumnRenamed("page_id", "doc_id")
    before = review.audit_documents(pages)
    assert before.select("type").distinct().count() >= 3
    again = review.audit_documents(review.fix_documents(pages))
    assert again.count() == 0, again.limit(5).collect()


def test_tree(spark):
    html = "<div id=a><p>one<p>two <b>bold</b></div></section><ul><li>x<ul><li>y</ul></li></ul><br><i>open<h2>T</h2><!-- <p> --><script><p></script>"
    docs = spark.createDataFrame([(1, html), (2, None), (3, "text")], "doc_id long, html string")
    got = [(r.tag, r.node, r.last, r.depth, r.parent) for r in document_tree(docs).orderBy("node").collect()]
    assert got == [
        ("div", 0, 8, 0, None), ("p", 1, 2, 1, 0), ("p", 3, 7, 1, 0), ("b", 5, 7, 2, 3), ("ul", 10, 18, 0, None), ("li", 11, 17, 1, 10), ("ul", 13, 16, 2, 11), ("li", 14, 15, 3, 13),
        ("i", 20, 21, 0, None), ("h2", 22, 24, 0, None),
    ]
