"""Checks of pages, on a good one and on each fault alone."""

import json

from foliomill.operators.pagecheck import CARD, page_details

ARTICLE = {"@context": "https://schema.org", "@type": "Article", "author": {"@type": "Person", "name": "Ana Lima"}, "inLanguage": "pt", "timeRequired": "PT3M", "accessibilityFeature": ["readingOrder", "x"]}
DESCRIPTION = "A long walk through the gardens of the city, told by those who keep them in every season."


def page(description=DESCRIPTION, article=ARTICLE, card=DESCRIPTION, body="<h1>The garden</h1><h2>Spring</h2><img src=a alt=''>", raw=None, title="Gardens - The site", more=""):
    metas = "".join(f'<meta property="{p}" content="{card if p == "og:description" else "x"}">' for p in CARD)
    script = f'<script type="application/ld+json">{raw if raw is not None else json.dumps(article)}</script>'
    return f'<html><head><title>{title}</title><meta name="description" content="{description}"><meta content="y" name="twitter:card">{metas}{more}{script}</head><body>{body}</body></html>'


FAULTS = [
    (page(), set()), (page(description="Gardens.", card="Gardens."), {"description_length"}), (page(description=DESCRIPTION + " ***", card=""), {"description_clean", "og_description"}),
    (page(description="Gardens Name: one Year: two " + DESCRIPTION[:60], card=""), {"description_prose", "og_description"}), (page(title="Nothing alike"), {"description_title"}), (page(card="Another"), {"card_matches"}),
    (page(body="<h1>A</h1><h2> </h2>"), {"headings_empty"}), (page(body="<h1>A</h1><h3>B</h3>"), {"headings_order"}), (page(body="<h1>One</h1><h2>ONE</h2>"), {"headings_repeat"}), (page(body="<img src=a>"), {"image_alts"}),
    (page(raw="{broken"), {"json_ld", "json_ld_article"}), (page(article={"@type": "WebPage"}), {"json_ld_article"}), (page(article={**ARTICLE, "author": {"name": "Admin"}}), {"author"}),
    (page(article={k: v for k, v in ARTICLE.items() if k != "author"}), {"author_set"}), (page(article={**ARTICLE, "inLanguage": None}), {"in_language"}), (page(article={**ARTICLE, "timeRequired": "3 min"}), {"time_required"}),
    (page(article={**ARTICLE, "accessibilityFeature": "readingOrder"}), {"accessibility"}), (page(article={**ARTICLE, "@Type": "x"}), {"keys"}), (page(more='<meta property="og:url" content="z">'), {"og_url"}),
]


def test_each_fault(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(FAULTS)] + [(99, None)], "page_id int, html string")
    got = page_details(df).collect()
    for i, (_, faults) in enumerate(FAULTS):
        assert {r.check_id for r in got if r.page_id == i and r.result != "PASS"} == faults, i
    assert len([r for r in got if r.page_id == 0]) == 25
    assert {r.check_id for r in got if r.page_id == 99} & {"author", "description_length"} == set()
