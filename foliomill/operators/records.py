"""Records about documents: links, languages, metadata, publication, highlights, saved answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T

#: The region that a language without one gets.
REGIONS = {"pt": "BR", "en": "US", "es": "ES", "fr": "FR", "de": "DE", "it": "IT", "nl": "NL", "pl": "PL", "ru": "RU", "uk": "UA", "tr": "TR", "ar": "AR", "hi": "IN", "zh": "CN", "ja": "JP", "ko": "KR", "la": "VA"}
#: Names that stand for no author.
PLACEHOLDERS = ("unknown", "desconhecido", "user", "usuario", "usuário", "admin", "administrator", "administrador", "owner", "author", "autor", "microsoft", "microsoft word", "word", "scanner", "anonymous", "anônimo", "anonimo")
LANGUAGE_TAG = r"^[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})*$"
#: Groups: image sign, text, address, title.
LINK = r'(!?)\[([^\]\n]*)\]\(([^) \t"]+)(?:[ \t]+"([^"]*)")?\)'
SCHEMES = "(?i)^(?:https?://|mailto:|#)"
MASK = "••••"


def markdown_links(docs: DataFrame) -> DataFrame:
    """doc_id, link_no (from 1), text, url and title of ``[text](url "title")``; images and other schemes are no links.

    A null text has no links.
    """
    sign, text, url, title = (F.regexp_extract_all("text", F.lit(LINK), i) for i in (1, 2, 3, 4))
    found = F.arrays_zip(sign.alias("sign"), text.alias("text"), url.alias("url"), title.alias("title"))
    links = F.filter(found, lambda x: (x["sign"] == "") & x["url"].rlike(SCHEMES))
    return docs.select("doc_id", F.posexplode(links).alias("n", "x")).select("doc_id", (F.col("n") + 1).alias("link_no"), "x.text", "x.url", F.coalesce("x.title", F.lit("")).alias("title"))


def locale_of(tag: Column) -> Column:
    """``ll_CC`` of a language tag: its own region of two letters, else the usual one of the language."""
    parts = F.split(F.replace(tag, F.lit("_"), F.lit("-")), "-")
    base, own = F.lower(parts[0]), F.try_element_at(parts, F.lit(2))
    usual = F.try_element_at(F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair]), base)
    return F.concat(base, F.lit("_"), F.when(F.length(own) == 2, F.upper(own)).otherwise(F.coalesce(usual, F.upper(base))))


def resolve_language(docs: DataFrame, default: str) -> DataFrame:
    """Adds tag, locale and subtag: the first of ``saved``, ``chosen`` and ``detected`` that is given, else ``default``."""
    given = [F.nullif(F.col(c), F.lit("")) for c in ("saved", "chosen", "detected")]
    tag = F.coalesce(*given, F.lit(default))
    return docs.withColumn("tag", tag).withColumns({"locale": locale_of(F.col("tag")), "subtag": F.lower(F.split("tag", "[-_]")[0])})


def clean_metadata(raw: DataFrame) -> DataFrame:
    """Cleans author, subject, keywords (text in, array out) and language; nulls become empty.

    Ten keywords at most, the first spelling of each; an unknown form of language goes.
    """
    line = lambda c, most: F.substring(T.collapse(T.no_tags(c)), 1, most)
    given = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    author, language = line(given("author"), 120), F.trim(given("language"))
    words = F.split(given("keywords"), "[;,\n]+")
    # A fold that stops cleaning and taking words at ten: (words, the same in lower case).
    start = F.struct(F.array().cast("array<string>").alias("w"), F.array().cast("array<string>").alias("low"))
    taken = lambda acc, x: F.struct(F.array_append(acc["w"], x).alias("w"), F.array_append(acc["low"], F.lower(x)).alias("low"))
    once = lambda acc, word: F.transform(F.array(line(word, 60)), lambda x: F.when((x == "") | F.array_contains(acc["low"], F.lower(x)), acc).otherwise(taken(acc, x)))[0]
    distinct = F.aggregate(words, start, lambda acc, x: F.when(F.size(acc["w"]) >= 10, acc).otherwise(once(acc, x)), lambda acc: acc["w"])
    return raw.withColumn("author", author).withColumns(
        {"author": F.when(F.lower("author").isin(*PLACEHOLDERS), "").otherwise(F.col("author")), "subject": line(given("subject"), 300), "keywords": distinct, "language": F.when(language.rlike(LANGUAGE_TAG), language).otherwise("")}
    )


def share_images(docs: DataFrame, width: int = 300, height: int = 150, first: int = 20) -> DataFrame:
    """page_id, url, width, height and alt of the first image large enough to share; pages without one are left out."""
    number = lambda x, name: F.coalesce(F.nullif(F.regexp_extract(x, f'(?i)\\b{name}\\s*=\\s*"(\\d{{1,9}})"', 1), F.lit("")).cast("int"), F.lit(0))
    word = lambda x, name: F.regexp_extract(x, f'(?i)\\b{name}\\s*=\\s*"([^"]*)"', 1)
    tags = F.slice(F.regexp_extract_all("html", F.lit(r"(?i)(<img\b[^>]*>)"), 1), 1, first)
    images = F.transform(tags, lambda x: F.struct(word(x, "src").alias("url"), number(x, "width").alias("width"), number(x, "height").alias("height"), word(x, "alt").alias("alt")))
    good = F.filter(images, lambda x: (x["url"] != "") & (x["width"] >= width) & (x["height"] >= height))
    return docs.select("page_id", F.try_element_at(good, F.lit(1)).alias("x")).filter("x is not null").select("page_id", "x.*")


def merge_records(base: Column, extra: Column, never: tuple[str, ...] = ("author", "publisher")) -> Column:
    """Map ``base`` with the entries of ``extra`` whose keys it lacks, but for those of ``never``."""
    return F.map_concat(base, F.map_filter(extra, lambda k, v: ~F.map_contains_key(base, k) & ~k.isin(*never)))


def host_page(docs: DataFrame, edges: DataFrame, posts: DataFrame, hidden: DataFrame) -> DataFrame:
    """doc, page and indexable: the own published post, else the first published host, else 0.

    ``edges`` (doc, host_id, status), ``posts`` (doc, post_id, status), ``hidden`` (host_id of pages that refuse search engines).
    """
    own = posts.filter("status = 'publish'").groupBy("doc").agg(F.min("post_id").alias("own"))
    host = edges.filter("status = 'publish'").groupBy("doc").agg(F.min("host_id").alias("host"))
    rows = docs.select("doc").join(own, "doc", "left").join(host, "doc", "left").select("doc", F.coalesce("own", "host", F.lit(0)).alias("page"))
    refused = hidden.select(F.col("host_id").alias("page")).distinct().withColumn("_refused", F.lit(True))
    return rows.join(refused, "page", "left").select("doc", "page", (F.col("_refused").isNull() | (F.col("page") == 0)).alias("indexable"))


def publication_state(docs: DataFrame, posts: DataFrame, schedule: DataFrame, errors: DataFrame) -> DataFrame:
    """doc_id and kind: a post, else what became of the schedule (by its action's status), else an error, else none."""
    kind = (
        F.when(F.col("post_id").isNotNull(), "post")
        .when(F.col("when").isNotNull(), F.when(F.col("action") == "canceled", "canceled").when(F.col("action") == "failed", "failed").when(F.col("action") == "complete", "removed").otherwise("scheduled"))
        .when(F.coalesce("message", F.lit("")) != "", "error")
        .otherwise("none")
    )
    rows = docs.select("doc_id").join(posts.select("doc_id", "post_id"), "doc_id", "left").join(schedule.select("doc_id", "when", "action"), "doc_id", "left").join(errors.select("doc_id", "message"), "doc_id", "left")
    return rows.select("doc_id", kind.alias("kind"))


def valid_highlights(marks: DataFrame, docs: DataFrame, colours: tuple[str, ...]) -> DataFrame:
    """Marks (doc_id, s, e, c, t) of a known colour whose text still stands at [s, e) of the document."""
    rows = marks.filter(F.col("c").isin(*colours) & (F.col("s") < F.col("e")))
    return rows.join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id").filter(F.substring("_text", (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int")) == F.col("t")).drop("_text")


def redact_messages(messages: DataFrame, secret: Column, most: int = 300) -> DataFrame:
    """``message`` with the row's secret of 8 bytes or more masked, also URL-encoded and JSON-escaped; then cut."""
    plain = F.coalesce(secret, F.lit(""))
    escaped = F.regexp_replace(F.regexp_replace(plain, r"\\", r"\\\\"), '(["/])', r"\\$1")
    text = F.col("message")
    for form in (plain, F.replace(F.url_encode(plain), F.lit("+"), F.lit("%20")), escaped):
        text = F.when(F.octet_length(plain) >= 8, F.replace(text, form, F.lit(MASK))).otherwise(text)
    return messages.withColumn("message", F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text))


def review_log_counts(log: DataFrame) -> DataFrame:
    """doc, origin, reviews and issues of log entries whose context carries them as JSON."""
    part = lambda name: F.get_json_object("context", f"$.{name}")
    return log.select(part("doc").cast("long").alias("doc"), part("origin").alias("origin"), F.coalesce(part("issues").cast("long"), F.lit(0)).alias("i")).groupBy("doc", "origin").agg(F.count("*").alias("reviews"), F.sum("i").alias("issues"))


def trim_answers(answers: DataFrame, current: DataFrame, size: int = 100) -> DataFrame:
    """Answers whose signature is the document's current one, the ``size`` most recently used of each document."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("used_at"), "answer_id")
    return answers.join(current, ["doc_id", "sig"], "left_semi").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= size).drop("_n")


def allowed_terms(docs: DataFrame, allowed: DataFrame) -> DataFrame:
    """doc_id, taxonomy and term: ``terms`` cut at commas, trimmed, distinct, only taxonomies that the row's type allows.

    The rows of a document and taxonomy meet as texts and are cut afterwards, so that no table of all terms is held.
    """
    rows = docs.join(allowed, ["type", "taxonomy"], "left_semi").select("doc_id", "taxonomy", "terms")
    texts = rows.repartition("doc_id", "taxonomy").groupBy("doc_id", "taxonomy").agg(F.collect_list("terms").alias("terms"))
    words = F.filter(F.transform(F.flatten(F.transform("terms", lambda x: F.split(x, ","))), T.collapse), lambda x: x != "")
    return texts.select("doc_id", "taxonomy", F.explode(F.array_distinct(words)).alias("term"))


def search_page(hits: DataFrame, offset: int, size: int = 20) -> DataFrame:
    """Hits (query_id, doc_id, block_no) numbered in the order of their document, one page of each, with the total."""
    order, whole = Window.partitionBy("query_id", "doc_id").orderBy("block_no"), Window.partitionBy("query_id", "doc_id")
    rows = hits.withColumn("total", F.count("*").over(whole)).withColumn("n", F.row_number().over(order))
    return rows.filter((F.col("n") > offset) & (F.col("n") <= offset + size))


def jsonld_records(docs: DataFrame) -> DataFrame:
    """doc_id and record: an Article of schema.org as JSON.

    ``docs`` are doc_id, title, description, language, url, published, modified, image, author, site,
    words, minutes, keywords (array), headings, images, missing_alt and reader. What is null or empty is
    left out, and a feature is named only where the document has it.
    """
    given = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    when = lambda test, *names: F.when(test, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    heads, images, reader = F.col("headings"), F.col("images"), F.coalesce("reader", F.lit(False))
    features = F.concat(
        F.array(F.lit("readingOrder")), when(heads > 0, "structuralNavigation"), when(heads > 1, "tableOfContents"), when((images > 0) & (F.col("missing_alt") == 0), "alternativeText"),
        when(reader, "displayTransformability", "highContrastDisplay"),
    )
    record = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Article").alias("@type"), F.substring("title", 1, 110).alias("headline"), F.col("description"), F.col("language").alias("inLanguage"),
        F.struct(F.lit("WebPage").alias("@type"), F.col("url").alias("@id")).alias("mainEntityOfPage"), F.col("published").alias("datePublished"), F.col("modified").alias("dateModified"), F.lit(True).alias("isAccessibleForFree"),
        F.when(given("author").isNotNull(), F.struct(F.lit("Person").alias("@type"), F.col("author").alias("name"))).alias("author"), F.struct(F.lit("Organization").alias("@type"), F.col("site").alias("name")).alias("publisher"),
        F.when(F.col("words") > 0, F.col("words")).alias("wordCount"), F.when(F.col("words") > 0, F.concat(F.lit("PT"), F.greatest(F.lit(1), F.col("minutes")).cast("string"), F.lit("M"))).alias("timeRequired"),
        F.when(F.size("keywords") > 0, F.array_join("keywords", ", ")).alias("keywords"),
        F.concat(F.array(F.lit("textual")), when(images > 0, "visual")).alias("accessMode"),
        F.array(F.struct(F.lit("ItemList").alias("@type"), F.array(F.lit("textual")).alias("itemListElement"))).alias("accessModeSufficient"),
        F.when(reader, F.array(*map(F.lit, ("fullKeyboardControl", "fullMouseControl", "fullTouchControl")))).alias("accessibilityControl"), features.alias("accessibilityFeature"), given("image").alias("image"),
    )
    return docs.select("doc_id", F.to_json(record).alias("record"))
