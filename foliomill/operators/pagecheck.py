"""Further checks of web pages: headings, descriptions, cards, and what their JSON-LD says of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions import text as T

from . import html as H
from .quality import jumps
from .records import PLACEHOLDERS

#: Properties of a shared page's card, and lengths of a description.
CARD = ("og:type", "og:title", "og:description", "og:url", "og:image", "og:locale", "og:updated_time")
SHORT, LONG = 70, 160
_LD = r'(?is)<script type="application/ld\+json"[^>]*>(.*?)</script>'


def _metas(head: Column, attribute: str, name: str) -> Column:
    """Contents of the meta elements of a name, in either order of their attributes."""
    tags = F.regexp_extract_all(head, F.lit(r"(?is)<meta\b[^>]*>"), 0)
    own = F.filter(tags, lambda x: x.rlike(rf'(?i)\b{attribute}="{name}"'))
    return F.transform(own, lambda x: F.regexp_extract(x, r'(?is)\bcontent="([^"]*)"', 1))


def _words(col: Column) -> Column:
    return F.regexp_extract_all(T.fold(col), F.lit(r"\p{L}{4,}"), 0)


def page_details(pages: DataFrame) -> DataFrame:
    """page_id, check_id and result (PASS, WARN, FAIL) of the checks that apply to a page (page_id, html).

    Checks of a description are made where there is one, of an Article where the JSON-LD has one. A null page fails
    what an empty one fails.
    """
    html = F.coalesce("html", F.lit(""))
    head = F.split(html, "(?i)</head>", 2)[0]
    heads = F.arrays_zip(F.regexp_extract_all(html, F.lit(H.HEADING), 1).alias("level"), F.transform(F.regexp_extract_all(html, F.lit(H.HEADING), 2), lambda x: T.collapse(T.no_tags(x))).alias("text"))
    rows = pages.select(
        "page_id", html.alias("html"), head.alias("head"), H.title_of(html).alias("title"), heads.alias("heads"), F.get(_metas(head, "name", "description"), F.lit(0)).alias("description"),
        F.transform(F.regexp_extract_all(html, F.lit(_LD), 1), F.try_parse_json).alias("blocks"), F.regexp_extract_all(html, F.lit(r"(?i)<img\b[^>]*>"), 0).alias("images"),
    )
    field = lambda v, path: F.try_variant_get(v, path, "string")
    rows = rows.withColumn("article", F.get(F.filter("blocks", lambda b: field(b, '$["@type"]') == "Article"), F.lit(0)))
    # A description may hold a word of the title in another form, so that parts of words count.
    wanted, found = _words(F.regexp_replace("title", r"\s[-–—|]\s[^-–—|]*$", "")), _words(F.col("description"))
    shared = (F.size(wanted) == 0) | F.exists(wanted, lambda w: F.exists(found, lambda f: f.contains(w) | w.contains(f)))
    first = F.lower(F.get(F.filter("heads", lambda h: h.level == "1"), F.lit(0)).text)
    card = F.get(_metas(F.col("head"), "property", "og:description"), F.lit(0))
    author = F.lower(F.coalesce(field(F.col("article"), "$.author.name"), F.lit("")))
    features = F.coalesce(F.try_variant_get("article", "$.accessibilityFeature", "array<string>"), F.array().cast("array<string>"))
    described, held = F.coalesce(F.col("description"), F.lit("")) != "", F.col("article").isNotNull()
    always = F.lit(True)
    size = F.length("description")
    checks = [
        ("description_length", described, size.between(SHORT, LONG), "WARN"), ("description_clean", described, ~F.col("description").rlike(r"([=*_#~-])\1{2,}"), "FAIL"),
        ("description_prose", described, F.regexp_count("description", F.lit(r"\b[A-Z][\p{L} ]{1,24}:\s")) < 2, "FAIL"), ("description_title", described, shared, "WARN"),
        ("headings_empty", always, F.forall("heads", lambda h: h.text != ""), "FAIL"), ("headings_order", always, jumps(F.transform("heads", lambda h: h.level.cast("int"))) == 0, "FAIL"),
        ("headings_repeat", always, first.isNull() | (first == "") | ~F.exists("heads", lambda h: (h.level != "1") & (F.lower(h.text) == first)), "FAIL"),
        *((name.replace(":", "_"), always, (F.size(_metas(F.col("head"), "property", name)) == 1) & (F.get(_metas(F.col("head"), "property", name), F.lit(0)) != ""), "FAIL") for name in CARD),
        ("twitter_card", always, F.size(_metas(F.col("head"), "name", "twitter:card")) == 1, "FAIL"), ("card_matches", always, ~described | (F.coalesce(card, F.lit("")) == "") | (card == F.col("description")), "WARN"),
        ("json_ld", always, (F.size("blocks") > 0) & F.forall("blocks", lambda b: b.isNotNull()), "FAIL"), ("json_ld_article", always, held, "FAIL"),
        ("author", held, ~author.isin(*PLACEHOLDERS), "FAIL"), ("author_set", held, author != "", "WARN"), ("in_language", held, F.coalesce(field(F.col("article"), "$.inLanguage"), F.lit("")) != "", "FAIL"),
        ("time_required", held, F.coalesce(field(F.col("article"), "$.timeRequired"), F.lit("")).rlike(r"^PT\d+M$"), "WARN"), ("accessibility", held, F.array_contains(features, "readingOrder"), "FAIL"),
        ("keys", held, F.try_variant_get("article", '$["@Type"]', "variant").isNull(), "FAIL"), ("image_alts", always, F.forall("images", lambda x: x.rlike(r"(?i)\salt=")), "FAIL"),
    ]
    verdict = [F.when(applies, F.struct(F.lit(name).alias("check_id"), F.when(F.coalesce(good, F.lit(False)), "PASS").otherwise(bad).alias("result"))) for name, applies, good, bad in checks]
    return rows.select("page_id", F.inline(F.array_compact(F.array(*verdict))))
