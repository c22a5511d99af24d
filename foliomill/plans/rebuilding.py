"""Queries that rebuild paragraphs and lists and suggest titles, summaries and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators import enrich, html, markdown, operations, paragraphs, records, review, speech, structure

from . import tables as t
from .registry import _BULLET, _COLLAPSE, _LET, _NUM, _PROSE, _SAMPLES, _short, query

PAGE = 40


def _pages(spark, sf):
    """Documents as pages of PAGE lines, in two languages; every twentieth space is a break after a hyphen."""
    lines = F.split(F.regexp_replace("text", r"(?<!\S)((?:\S++ ){19}+\S+?)(\S{2}) ", "$1-\n$2 "), "\n")
    rows = t.documents(spark, sf).select("doc_id", F.when(F.col("lang") == "en", "en").otherwise("pt").alias("lang"), lines.alias("lines"))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / PAGE).cast("int")), lambda i: F.array_join(F.slice("lines", i * PAGE + 1, PAGE), "\n"))
    return rows.select("doc_id", "lang", F.posexplode(pages).alias("page_no", "text"))


@query("rebuild_paragraphs")
def rebuild_paragraphs(spark, sf):
    return paragraphs.rebuild_paragraphs(_pages(spark, sf)).drop("lang")


def _printed_pages(spark, sf):
    """Pages with contents and lists at the breaks: a number whose title is on the page before, a list, a heading of contents, an entry at the end."""
    turn, text = (F.col("doc_id") + F.col("page_no")) % 12, F.col("text")
    top = (
        F.when(turn == 0, F.concat(F.lit("........ "), F.col("page_no") % 900 + 40, F.lit(" "), text)).when(turn == 2, F.regexp_replace(text, "^([^\n]*)\n", "1. $1\n2. "))
        .when(turn == 3, F.regexp_replace(text, "^([^\n]*)", "Contents $1 ..... 3")).otherwise(text)
    )
    text = F.when(turn == 6, F.concat(text, F.lit(" ..... 30"))).when(F.col("page_no") > 0, top).otherwise(text)
    return _pages(spark, sf).withColumn("text", text)


@query("stitch_pages")
def stitch_pages(spark, sf):
    """Rebuilt paragraphs, contents entries and items of lists, joined over page breaks."""
    blocks = paragraphs.page_blocks(paragraphs.rebuild_paragraphs(_printed_pages(spark, sf)))
    return paragraphs.stitch_pages(blocks).drop("lang")


@query("join_cut_words")
def join_cut_words(spark, sf):
    """Texts with a hyphen and a space in every tenth word or so."""
    from foliomill.functions.lines import with_cut_words_joined

    docs = t.documents(spark, sf)
    cut = F.regexp_replace("text", r"(?<!\S)((?:\S++ ){9}+\S{2,}?)(\S{2}) ", "$1- $2 ")
    return with_cut_words_joined(docs.select("doc_id", cut.alias("text"), F.when(F.col("lang") == "en", "en").otherwise("pt").alias("lang"))).drop("lang")


@query("join_lines", t.sql("d", "lines") + r"""
, n AS (SELECT doc_id, block_no, text, lead(text) OVER (PARTITION BY doc_id ORDER BY block_no) AS after FROM rows),
b AS (SELECT doc_id, block_no, CASE WHEN block_no % 2 = 0 AND regexp_matches(text, '[\p{L}\p{M}]{2}$') THEN text || '-' ELSE text END AS before, after FROM n WHERE after IS NOT NULL)
SELECT doc_id, block_no, CASE WHEN NOT regexp_matches(before, '[\p{L}\p{M}]-$') OR NOT regexp_matches(after, '^[\p{Lu}\p{Ll}]') THEN before || ' ' || after
  WHEN regexp_matches(after, '^\p{Lu}') THEN before || after ELSE left(before, length(before) - 1) || after END AS text
FROM b""")
def join_lines(spark, sf):
    """Every line and the one after it, a hyphen at every second one; no language has rules of its own here."""
    from pyspark.sql import Window

    from foliomill.functions.lines import join_lines as joined

    lines = t.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).select("doc_id", F.col("n").cast("long").alias("block_no"), "text")
    rows = lines.withColumn("after", F.lead("text").over(Window.partitionBy("doc_id").orderBy("block_no"))).filter("after is not null")
    before = F.when((F.col("block_no") % 2 == 0) & F.col("text").rlike(r"[\p{L}\p{M}]{2}$"), F.concat("text", F.lit("-"))).otherwise(F.col("text"))
    return rows.select("doc_id", "block_no", joined(before, "after", F.lit("")).alias("text"))


_MARKS = {0: "• ", 1: "• ", 2: "{n}. ", 3: "{n}. ", 4: "a) ", 6: "b) ", 8: "3. ", 9: "5. "}


@query("confirm_lists", t.sql("d", "lines") + f"""
, e AS (
  SELECT doc_id, block_no // {PAGE} AS page_no, block_no, CASE block_no % 10 WHEN 0 THEN '• ' WHEN 1 THEN '• ' WHEN 2 THEN (block_no // 10 % 20 * 2 + 1) || '. ' WHEN 3 THEN (block_no // 10 % 20 * 2 + 2) || '. '
    WHEN 4 THEN 'a) ' WHEN 6 THEN 'b) ' WHEN 8 THEN '3. ' WHEN 9 THEN '5. ' ELSE '' END || text AS x FROM rows
), l AS (SELECT *, regexp_matches(x, '{_BULLET}') AS b, regexp_matches(x, '{_NUM}') AS n, regexp_matches(x, '{_LET}') AS a FROM (SELECT doc_id, page_no, block_no, regexp_replace(x, '^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$', '', 'g') AS x FROM e)),
i AS (
  SELECT doc_id, page_no, block_no, CASE WHEN b THEN 'ul' ELSE 'ol' END AS kind,
    CASE WHEN b THEN 'bullet' WHEN n THEN 'number' || regexp_extract(x, '{_NUM}', 2) WHEN lower(regexp_extract(x, '{_LET}', 1)) = regexp_extract(x, '{_LET}', 1) THEN 'lower' ELSE 'upper' END AS family,
    CASE WHEN b THEN 0 WHEN n THEN regexp_extract(x, '{_NUM}', 1)::INT ELSE ascii(lower(regexp_extract(x, '{_LET}', 1))) - 96 END AS value
  FROM l WHERE b OR n OR a
), g AS (
  SELECT *, (block_no - 1 IS DISTINCT FROM lag(block_no) OVER w)::INT AS gap, lag(family) OVER w AS fam0, lag(value) OVER w AS val0 FROM i WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY block_no)
), h AS (
  SELECT *, sum(gap) OVER w AS run, sum(greatest(gap, (fam0 IS DISTINCT FROM family)::INT)) OVER w AS list_no, gap = 1 OR fam0 IS DISTINCT FROM family OR val0 + 1 = value AS step
  FROM g WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY block_no)
), k AS (
  SELECT doc_id, page_no, run, list_no, any_value(kind) AS kind, any_value(family) AS family, count(*) AS n, arg_min(value, block_no) AS v1, arg_max(value, block_no) AS v2, bool_and(step) AS even FROM h GROUP BY ALL
), m AS (
  SELECT *, kind = 'ol' AND coalesce(lag(v2) OVER (PARTITION BY doc_id, page_no, run, family ORDER BY list_no) + 1 = v1, false) AS follows FROM k
), o AS (SELECT *, (n >= 2 OR follows) AND (kind = 'ul' OR even) AS sure FROM m),
p AS (SELECT *, coalesce(lag(sure AND family LIKE 'number%') OVER (PARTITION BY doc_id, page_no, run ORDER BY list_no), false) AS numbered FROM o)
SELECT h.doc_id, h.page_no, h.block_no, h.kind, h.family, h.value, h.list_no::BIGINT AS list_no
FROM h JOIN p USING (doc_id, page_no, run, list_no) WHERE sure OR (numbered AND v1 = 1 AND p.family IN ('lower', 'upper') AND even)""")
def confirm_lists(spark, sf):
    """Lines with markers: bullets, pairs of numbers, letters under them and alone, numbers out of step."""
    lines = t.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).select("doc_id", F.col("n").cast("long").alias("block_no"), F.col("text").alias("x"))
    k, turn = F.col("block_no") % 10, F.floor(F.col("block_no") / 10) % 20 * 2
    mark = F.lit("")
    for number, sign in _MARKS.items():
        own = F.concat((turn + number - 1).cast("string"), F.lit(". ")) if "{n}" in sign else F.lit(sign)
        mark = F.when(k == number, own).otherwise(mark)
    found = structure.list_markers(lines.select("doc_id", F.floor(F.col("block_no") / PAGE).alias("page_no"), "block_no", F.concat(mark, "x").alias("text")))
    return paragraphs.confirm_lists(found.select("doc_id", "page_no", "block_no", "kind", "family", "value"))


@query("shift_title_headings", t.sql("d", "lines") + """
SELECT doc_id, block_no, CASE WHEN min(level) OVER (PARTITION BY doc_id) = 0 THEN least(level + 1, 6) ELSE level END::INT AS level
FROM (SELECT doc_id, block_no, CASE WHEN doc_id % 2 = 0 AND block_no = 0 THEN 0 ELSE 1 + length(text) % 6 END AS level FROM rows)""")
def shift_title_headings(spark, sf):
    """Lines as headings; every second document has a title."""
    lines = t.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).select("doc_id", F.col("n").cast("long").alias("block_no"), "text")
    level = F.when((F.col("doc_id") % 2 == 0) & (F.col("block_no") == 0), 0).otherwise(1 + F.length("text") % 6)
    return html.shift_title_headings(lines.select("doc_id", "block_no", level.cast("int").alias("level")))


def _fit(x: str) -> str:
    cut = f"left({x}, {enrich.TITLE_MAX})"
    space = f"(length({cut}) - instr(reverse({cut}), ' '))"
    word = f"CASE WHEN instr({cut}, ' ') > 0 AND {space} >= {enrich.TITLE_MIN} THEN left({cut}, {space}) ELSE {cut} END"
    return f"CASE WHEN length({x}) > {enrich.TITLE_MAX} THEN regexp_replace({word}, '[ ,;:.–—-]+$', '') ELSE {x} END"


@query("suggest_title", t.sql("d") + f"""
, x AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND length(coalesce(c, '')) < 1500 THEN {_COLLAPSE.format("lang || ' documento ' || source || ' ' || doc_id")} END AS a, CASE WHEN doc_id % 3 = 1 THEN 'Heading of ' || source || ', ' || repeat('long ', (doc_id % 20)::INT) || doc_id END AS b,
    c FROM (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda l: {_COLLAPSE.format('l')}), lambda l: l <> '')[1] AS c FROM d)
), y AS (SELECT doc_id, {_fit('coalesce(a, chr(32))')} AS a, {_fit('coalesce(b, chr(32))')} AS b, {_fit('coalesce(c, chr(32))')} AS c FROM x)
SELECT doc_id, title FROM (SELECT doc_id, CASE WHEN length(a) >= 10 THEN a WHEN length(b) >= 10 THEN b WHEN length(c) >= 10 AND doc_id % 5 <> 0 THEN c END AS title FROM y) WHERE title IS NOT NULL""")
def suggest_title(spark, sf):
    """A labelled second line for a third of the documents, a heading for another; a fifth have their first line as title."""
    docs = t.documents(spark, sf)
    label = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\nTitle: "), "lang", F.lit(" documento "), "source", F.lit(" "), F.col("doc_id"), F.lit("."))).otherwise("")
    lines = F.filter(F.transform(F.split("text", "\n"), T.collapse), lambda x: x != "")
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    rows = docs.select("doc_id", F.concat(first, F.coalesce(label, F.lit("")), F.lit("\n"), "text").alias("text"), first.alias("first"))
    rows = rows.withColumn("current", F.when(F.col("doc_id") % 5 == 0, enrich.fit_title(F.col("first"))))
    words = F.concat(F.lit("Heading of "), "source", F.lit(", "), F.repeat(F.lit("long "), (F.col("doc_id") % 20).cast("int")), F.col("doc_id"))
    heads = docs.filter("doc_id % 3 = 1").select("doc_id", F.lit(1).alias("seq"), F.lit(2).alias("level"), words.alias("text"))
    return enrich.suggest_title(rows, heads)


@query("suggest_summary", t.sql("ds", "paras") + f"""
, q0 AS (SELECT doc_id, para_no, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_COLLAPSE.format('x')}), lambda x: x <> '') AS lines FROM paras WHERE para_no <= 40),
q1 AS (SELECT doc_id, para_no, lines, array_to_string(lines, ' ') AS txt, len(list_filter(lines, lambda x: length(x) <= 80 AND regexp_matches(x, '^\\p{{L}}[\\p{{L}} ._-]{{0,24}}:[ \\t]*[^ \\t]'))) AS sheet FROM q0),
q2 AS (SELECT *, {_COLLAPSE.format("regexp_replace(txt, '={3,}|" + chr(92) + "*{3,}|_{3,}|~{3,}|#{3,}|-{3,}', ' ', 'g')")} AS clean FROM q1),
q3 AS (SELECT *, len(regexp_extract_all(clean, '\\p{{L}}')) AS letters, length(replace(clean, ' ', '')) AS vis, len(regexp_extract_all(clean, '\\p{{L}}{{2,}}')) AS words FROM q2),
q4 AS (SELECT doc_id, para_no, {_PROSE} AS prose FROM q3), q5 AS (SELECT doc_id, arg_min(prose, para_no) AS x FROM q4 WHERE length(prose) >= 70 GROUP BY doc_id)
SELECT doc_id, {_short('x')} AS summary FROM q5""")
def suggest_summary(spark, sf):
    return enrich.suggest_summary(t.spaced_documents(spark, sf))


@query("learn_language_by_page", f"""
WITH w AS (SELECT doc_id, {_COLLAPSE.format("coalesce(text, '')")} AS x FROM documents),
d AS (SELECT doc_id * 2 AS doc_id, left(x, 3000) AS text FROM w UNION ALL SELECT doc_id * 2 + 1, left(x, {T.SAMPLE}) FROM w),
{_SAMPLES}, a AS (SELECT doc_id // 2 AS doc_id, max(CASE WHEN doc_id % 2 = 0 THEN tag END) AS short, max(CASE WHEN doc_id % 2 = 1 THEN tag END) AS long FROM languages GROUP BY ALL)
SELECT doc_id, 0 AS page_no, lower(string_split(CASE WHEN short <> '' THEN short ELSE long END, '-')[1]) AS language FROM a""")
def learn_language_by_page(spark, sf):
    """Every document as one page; tests go through more of them."""
    return enrich.learn_language_by_page(t.documents(spark, sf).select("doc_id", F.lit(0).alias("page_no"), "text"))


@query("jsonld_records", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, 'en') AS lang, coalesce(source, '') AS source FROM documents),
f AS (SELECT *, len(regexp_extract_all(text, '\\p{L}+')) AS words, doc_id % 3 AS headings, doc_id % 4 AS images, doc_id % 2 AS missing FROM d),
p AS (SELECT doc_id, list_filter([
  '"@context":"https://schema.org"', '"@type":"Article"', '"headline":' || to_json('Document ' || doc_id || ' ' || repeat('x', 120)[:110 - length('Document ' || doc_id || ' ')]), '"description":' || to_json(source || ' "' || lang || '"'), '"inLanguage":' || to_json(lang),
  '"mainEntityOfPage":{"@type":"WebPage","@id":"https://e.org/' || doc_id || '"}', '"datePublished":"2024-01-02"', '"isAccessibleForFree":true',
  CASE WHEN source <> '' AND doc_id % 5 > 0 THEN '"author":{"@type":"Person","name":' || to_json(source) || '}' END, '"publisher":{"@type":"Organization","name":"E"}',
  CASE WHEN words > 0 THEN '"wordCount":' || words END, CASE WHEN words > 0 THEN '"timeRequired":"PT' || greatest(1, words // 200) || 'M"' END, CASE WHEN doc_id % 2 = 0 THEN '"keywords":"' || lang || ', corpus"' END,
  '"accessMode":["textual"' || CASE WHEN images > 0 THEN ',"visual"' ELSE '' END || ']', '"accessModeSufficient":[{"@type":"ItemList","itemListElement":["textual"]}]',
  CASE WHEN doc_id % 7 = 0 THEN '"accessibilityControl":["fullKeyboardControl","fullMouseControl","fullTouchControl"]' END,
  '"accessibilityFeature":["readingOrder"' || CASE WHEN headings > 0 THEN ',"structuralNavigation"' ELSE '' END || CASE WHEN headings > 1 THEN ',"tableOfContents"' ELSE '' END
    || CASE WHEN images > 0 AND missing = 0 THEN ',"alternativeText"' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ',"displayTransformability","highContrastDisplay"' ELSE '' END || ']'
], lambda x: x IS NOT NULL) AS parts FROM f)
SELECT doc_id, '{' || array_to_string(parts, ',') || '}' AS record FROM p""")
def jsonld_records(spark, sf):
    """Documents with and without authors, keywords, headings, images, descriptions of images and the reader's modes."""
    i, n = F.col("doc_id"), T.words(F.col("text"))
    docs = t.documents(spark, sf).withColumns({"lang": F.coalesce("lang", F.lit("en")), "source": F.coalesce("source", F.lit(""))}).withColumn("words", n)
    return records.jsonld_records(docs.select(
        "doc_id", F.concat(F.lit("Document "), i, F.lit(" "), F.repeat(F.lit("x"), 120)).alias("title"), F.concat("source", F.lit(' "'), "lang", F.lit('"')).alias("description"), F.col("lang").alias("language"),
        F.concat(F.lit("https://e.org/"), i).alias("url"), F.lit("2024-01-02").alias("published"), F.lit(None).cast("string").alias("modified"), F.lit("").alias("image"),
        F.when(i % 5 > 0, F.col("source")).alias("author"), F.lit("E").alias("site"), "words", F.floor(F.col("words") / 200).alias("minutes"),
        F.when(i % 2 == 0, F.array("lang", F.lit("corpus"))).otherwise(F.array().cast("array<string>")).alias("keywords"), (i % 3).alias("headings"), (i % 4).alias("images"), (i % 2).alias("missing_alt"), (i % 7 == 0).alias("reader"),
    ))


@query("spoken_elements")
def spoken_elements(spark, sf):
    return speech.spoken_elements(t.rich_pages(spark, sf).withColumnRenamed("page_id", "doc_id"))


@query("speech_pieces")
def speech_pieces(spark, sf):
    """Every line of the documents."""
    lines = t.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return speech.speech_pieces(lines.select("doc_id", (F.col("n") + 1).alias("block_no"), "text"))


def _markdown(spark, sf):
    """Documents as Markdown: some lines become headings, items, quotes, code, or rows of a table."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 7 == 0, F.concat(F.repeat(F.lit("#"), (i / 7 % 6 + 1).cast("int")), F.lit(" "), x)).when(i % 7 == 1, F.concat(F.lit("- "), x)).when(i % 7 == 2, F.concat(F.lit("  1. "), x))
        .when(i % 7 == 3, F.concat(F.lit("\n> "), x)).when(i % 7 == 4, F.concat(F.lit("\nA | b \\| c\n--- | :--:\n"), F.replace(x, F.lit(" "), F.lit(" | ")))).when(i % 7 == 5, F.concat(F.lit("\n```\n"), x, F.lit("\n```"))).otherwise(x))
    return t.documents(spark, sf).select("doc_id", F.array_join(lines, "\n").alias("text"))


@query("markdown_blocks")
def markdown_blocks(spark, sf):
    return markdown.markdown_blocks(_markdown(spark, sf))


@query("markdown_table_cells")
def markdown_table_cells(spark, sf):
    return markdown.markdown_table_cells(markdown_blocks(spark, sf))


@query("image_report", """
WITH RECURSIVE i AS (
  SELECT l_orderkey AS doc_id, md5((l_partkey % 5)::VARCHAR) AS m, l_quantity::BIGINT AS size, l_linenumber % 6 <> 0 AS ok, l_suppkey % 2 = 0 AS bare,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, md5((l_partkey % 5)::VARCHAR), l_quantity, l_suppkey % 2 = 0 DESC) AS k FROM lineitem
), f AS (
  SELECT doc_id, 0::BIGINT AS k, []::VARCHAR[] AS kept, 0::BIGINT AS used, NULL::VARCHAR AS verdict, false AS bare FROM i GROUP BY doc_id
  UNION ALL
  SELECT doc_id, k, CASE WHEN v = 'included' THEN list_append(kept, m) ELSE kept END, used + CASE WHEN v = 'included' THEN size ELSE 0 END, v, bare FROM (
    SELECT i.doc_id, i.k, kept, used, m, size, i.bare, CASE WHEN list_contains(kept, m) THEN 'repeat' WHEN len(kept) >= 3 THEN 'limit_count' WHEN used >= 90 THEN 'limit_total' WHEN NOT ok THEN 'invalid'
      WHEN size > 40 THEN 'too_big' WHEN used + size > 90 THEN 'limit_total' ELSE 'included' END AS v FROM f JOIN i ON i.doc_id = f.doc_id AND i.k = f.k + 1)
), c AS (SELECT doc_id, verdict, count(*) AS n FROM f WHERE k > 0 GROUP BY ALL),
s AS (SELECT doc_id, count(*) FILTER (verdict = 'included') AS included, count(*) FILTER (verdict = 'included' AND bare) AS missing_alt, count(*) FILTER (verdict NOT IN ('included', 'repeat')) AS skipped FROM f WHERE k > 0 GROUP BY doc_id),
r AS (SELECT doc_id, string_agg(verdict || '=' || n, ' ' ORDER BY verdict) AS reasons FROM c WHERE verdict NOT IN ('included', 'repeat') GROUP BY doc_id)
SELECT doc_id, included, missing_alt, skipped, coalesce(reasons, '') AS reasons FROM s LEFT JOIN r USING (doc_id)""")
def image_report(spark, sf):
    """Order lines as images, with small limits."""
    n = F.col("l_linenumber")
    rows = t.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), n.alias("ord"), F.md5((F.col("l_partkey") % 5).cast("string")).alias("md5"), F.col("l_quantity").cast("long").alias("bytes"), (n % 6 != 0).alias("valid"),
        F.when(F.col("l_suppkey") % 2 != 0, "x").alias("alt"),
    )
    report = operations.image_report(rows, 3, 90, 40)
    return report.withColumn("reasons", F.array_join(F.transform(F.array_sort(F.map_entries("reasons")), lambda e: F.concat_ws("=", e["key"], e["value"])), " "))


@query("merge_outline")
def merge_outline(spark, sf):
    """Rebuilt pages whose outline names the first words of a paragraph and a title that is nowhere."""
    blocks = paragraphs.rebuild_paragraphs(_pages(spark, sf)).withColumn("kind", F.lit("p")).drop("lang")
    words = F.array_join(F.slice(F.split(F.upper("text"), " "), 1, 3), " ")
    named = blocks.filter("block_no % 3 = 1").select("doc_id", "page_no", F.col("block_no").alias("entry_no"), F.when(F.col("block_no") % 2 == 0, "Nowhere to be found").otherwise(words).alias("title"), F.lit(2).alias("level"))
    return paragraphs.merge_outline(blocks.withColumn("page_no", F.col("page_no").cast("long")), named.withColumn("page_no", F.col("page_no").cast("long")))


@query("keep_reordered_text", t.sql("d", "lines") + r"""
, g AS (SELECT doc_id, block_no AS page_no, text AS plain, CASE WHEN doc_id % 4 = 0 AND block_no < 6 THEN NULL WHEN (doc_id + block_no) % 3 = 0 THEN reverse(text) WHEN (doc_id + block_no) % 3 = 1 THEN left(text, length(text) // 2) END AS ordered FROM rows),
h AS (SELECT *, ordered IS NOT NULL AND len(regexp_extract_all(ordered, '[\p{L}\p{N}]')) >= 0.9 * len(regexp_extract_all(plain, '[\p{L}\p{N}]')) AS good FROM g),
i AS (SELECT *, min(CASE WHEN good THEN page_no END) OVER (PARTITION BY doc_id) AS first FROM h),
j AS (SELECT *, sum((page_no < first AND length(trim(plain)) > 200)::INT) OVER (PARTITION BY doc_id) AS probed FROM i)
SELECT doc_id, page_no, CASE WHEN good AND coalesce(probed, 0) < 5 THEN ordered ELSE plain END AS text FROM j""")
def keep_reordered_text(spark, sf):
    """Lines as pages; the other order is whole, half of the text, or missing, and missing on the first pages of every fourth document."""
    lines = t.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "plain"))
    turn = (F.col("doc_id") + F.col("n")) % 3
    half = F.substring(F.col("plain"), F.lit(1), F.floor(F.length("plain") / 2).cast("int"))
    ordered = F.when((F.col("doc_id") % 4 == 0) & (F.col("n") < 6), None).when(turn == 0, F.reverse("plain")).when(turn == 1, half)
    return paragraphs.keep_reordered_text(lines.select("doc_id", F.col("n").cast("long").alias("page_no"), "plain", ordered.alias("ordered")))


@query("audit_documents")
def audit_documents(spark, sf):
    return review.audit_documents(t.rich_pages(spark, sf).withColumnRenamed("page_id", "doc_id"))


@query("fix_documents")
def fix_documents(spark, sf):
    return review.fix_documents(t.rich_pages(spark, sf).withColumnRenamed("page_id", "doc_id"))
