"""Scorecards of documents and checks of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators import html as H

#: Check, group and most points, in order; they add up to 100.
CHECKS = (
    ("title", "metadata", 5), ("description", "metadata", 10), ("author", "metadata", 10), ("headings", "structure", 10), ("hierarchy", "structure", 15),
    ("length", "content", 10), ("readable", "content", 5), ("alt", "content", 10), ("published", "publish", 15), ("indexable", "publish", 5), ("seo_tags", "publish", 5),
)


def jumps(levels: Column) -> Column:
    """Steps of more than one level down in an array of heading levels."""
    pairs = F.zip_with(F.slice(levels, F.lit(1), F.greatest(F.size(levels) - 1, F.lit(0))), F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0))), lambda a, b: b > a + 1)
    return F.size(F.filter(pairs, lambda x: x))


def page_facts(pages: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Quality facts of web pages, a row each.

    ``shown`` (page_id, page) is the page that shows what ``page_id`` is about, as :func:`records.host_page` finds it;
    without a row, or with the page 0, it isn't published. All facts stand on one exchange of the pages at most.
    """
    html = F.col("html")
    text = T.collapse(T.no_tags(html))
    meta = lambda name: F.regexp_extract(html, f'(?is)<meta[^>]*name="{name}"[^>]*content="([^"]*)"', 1)
    facts = pages.select(
        "page_id", F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang=["']([A-Za-z]+)""", 1)).alias("lang"), H.title_of(html).alias("title"), meta("description").alias("description"), meta("author").alias("author"),
        F.transform(F.regexp_extract_all(html, F.lit(H.HEADING), 1), lambda x: x.cast("int")).alias("levels"), T.words(text).alias("words"), T.unreadable(text).alias("unreadable"),
        T.count(html, r'(?i)<img\b[^>]*\balt=""').alias("missing_alt"), (~html.contains("noindex")).alias("indexable"), html.rlike('(?i)property="og:').alias("seo_tags"),
    )
    if shown is None:
        return facts.withColumn("published", F.lit(False))
    live = shown.select("page_id", (F.coalesce("page", F.lit(0)) != 0).alias("_live")).groupBy("page_id").agg(F.bool_or("_live").alias("_live"))
    return facts.join(live, "page_id", "left").withColumn("published", F.coalesce("_live", F.lit(False))).drop("_live")


def scorecard(facts: DataFrame) -> DataFrame:
    """Long rows page_id, check_id, grp, most, points."""
    n = jumps(F.col("levels"))
    share = {
        "title": F.length("title").between(10, 70).cast("int"), "description": (F.col("description") != "").cast("int"), "author": (F.col("author") != "").cast("int"),
        "headings": (F.size("levels") >= 2).cast("int"), "length": (F.col("words") >= 300).cast("int"), "readable": (~F.col("unreadable")).cast("int"), "alt": (F.col("missing_alt") == 0).cast("int"),
        "published": F.col("published").cast("int"), "indexable": F.col("indexable").cast("int"), "seo_tags": F.col("seo_tags").cast("int"),
    }
    rows = [F.struct(F.lit(c).alias("check_id"), F.lit(g).alias("grp"), F.lit(m).alias("most"), (F.when(n == 0, 15).when(n <= 2, 8).otherwise(0) if c == "hierarchy" else share[c] * m).cast("int").alias("points")) for c, g, m in CHECKS]
    return facts.select("page_id", "words", F.inline(F.array(*rows)))


def totals(checks: DataFrame) -> DataFrame:
    """page_id, score (70 at most with few words) and grade."""
    score = checks.groupBy("page_id").agg(F.sum("points").alias("s"), F.max("words").alias("w")).select("page_id", F.when(F.col("w") < 300, F.least("s", F.lit(70))).otherwise(F.col("s")).alias("score"))
    return score.withColumn("grade", F.when(F.col("score") >= 85, "good").when(F.col("score") >= 60, "fair").otherwise("poor"))


def score_rollup(checks: DataFrame, languages: DataFrame) -> DataFrame:
    """Points and passes by language, group and check, with subtotals; ``languages`` are page_id and lang ('' where none is named)."""
    rows = checks.join(languages.select("page_id", "lang"), "page_id")
    return rows.rollup("lang", "grp", "check_id").agg(F.grouping_id().cast("int").alias("gid"), F.sum("points").alias("points"), F.sum((F.col("points") == F.col("most")).cast("int")).alias("passed"))


def audit_pages(pages: DataFrame) -> DataFrame:
    """page_id, check_id and result (PASS, WARN, FAIL) of page checks."""
    html = F.col("html")
    title, text = H.title_of(html), T.collapse(T.no_tags(html))
    verdict = lambda name, good, bad="FAIL": F.struct(F.lit(name).alias("check_id"), F.when(good, "PASS").otherwise(bad).alias("result"))
    rows = F.array(
        verdict("title", title != ""), verdict("title_length", F.length(title) <= 75, "WARN"), verdict("description", T.count(html, r'(?i)<meta[^>]*name="description"') == 1),
        verdict("canonical", html.rlike(r'(?i)<link[^>]*rel="canonical"'), "WARN"), verdict("lang", html.rlike(r"(?i)<html[^>]*\blang=")), verdict("robots", ~html.contains("noindex")),
        verdict("one_h1", T.count(html, r"(?i)<h1\b") == 1), verdict("open_graph", html.rlike(r'(?i)property="og:title"'), "WARN"), verdict("json_ld", html.contains("application/ld+json"), "WARN"),
        verdict("words", T.words(text) >= 300, "WARN"), verdict("text_share", F.length(text) * 10 >= F.length(html), "WARN"), verdict("links", T.count(html, r"(?i)<a\b") <= 300, "WARN"),
    )
    return pages.select("page_id", F.inline(rows))


def page_scores(results: DataFrame) -> DataFrame:
    """100 less 8 for each failure and 3 for each warning, 0 at least."""
    fails, warns = (F.sum((F.col("result") == x).cast("int")) for x in ("FAIL", "WARN"))
    return results.groupBy("page_id").agg(F.greatest(F.lit(0), 100 - 8 * fails - 3 * warns).alias("score"))
