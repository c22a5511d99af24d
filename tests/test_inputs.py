"""The derived inputs reach the branches of what runs over them."""

from foliomill.plans.registry import QUERIES
from tests.conftest import SF


def values(spark, query, key, value):
    out = {}
    for r in QUERIES[query](spark, SF).select(key, value).distinct().collect():
        out.setdefault(r[0], set()).add(r[1])
    return out


def test_branches(spark):
    assert QUERIES["split_paragraphs"](spark, SF).filter("para_no > 3").count() > 50
    assert set(values(spark, "promote_headings", "level", "text")) == {2, 3}
    assert QUERIES["heading_jumps"](spark, SF).select("jumps").distinct().count() > 2
    assert QUERIES["toc_tree"](spark, SF).select("depth").distinct().count() > 3
    counts = QUERIES["structure_counts"](spark, SF)
    assert counts.filter("images > missing_alt").count() and counts.filter("missing_alt > 0").count() and counts.filter("images = 0").count()
    checks = values(spark, "audit_pages", "check_id", "result")
    assert {k for k, v in checks.items() if len(v) > 1} >= {"description", "canonical", "lang", "robots", "one_h1", "open_graph", "json_ld", "links"}
    points = values(spark, "scorecard", "check_id", "points")
    assert {k for k, v in points.items() if len(v) > 1} >= {"description", "author", "hierarchy", "alt", "published", "indexable", "seo_tags"}
    assert set(values(spark, "list_markers", "family", "kind")) == {"bullet", "number.", "upper"}
    lists = values(spark, "confirm_lists", "family", "kind")
    assert {"bullet", "number.", "lower"} <= set(lists)
    assert {"", "Contents", "Índice"} == {r.heading for r in QUERIES["extract_toc_entries"](spark, SF).select("heading").distinct().collect()}
    stitched, rebuilt = (QUERIES[q](spark, SF).count() for q in ("stitch_pages", "rebuild_paragraphs"))
    assert stitched < rebuilt


def test_page_breaks_cut_contents_and_lists(spark):
    """stitch_pages met paragraphs alone."""
    kinds = values(spark, "stitch_pages", "kind", "target")
    assert set(kinds) == {"p", "toc", "toc-heading", "ol"} and {3, 30} < kinds["toc"] and kinds["p"] == {None}
    rows = QUERIES["stitch_pages"](spark, SF).filter("kind = 'toc' and target >= 40").collect()
    assert any(r.text for r in rows) and len({r.page_no for r in rows}) > 1
