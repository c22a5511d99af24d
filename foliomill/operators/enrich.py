"""Language, author, title, description and slug of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T

from .records import PLACEHOLDERS

def detect_language(docs: DataFrame) -> DataFrame:
    """doc_id and detected language tag."""
    return T.with_language(docs.select("doc_id", "text"), F.col("text")).select("doc_id", "tag")


def word_counts(docs: DataFrame) -> DataFrame:
    words = T.words(F.col("text"))
    return docs.select("doc_id", words.alias("words"), F.greatest(F.lit(1), F.ceil(words / 200)).cast("long").alias("minutes"))


def text_flags(docs: DataFrame) -> DataFrame:
    """Unreadable texts, and texts with glyphs that have no meaning of their own."""
    return docs.select("doc_id", T.unreadable(F.col("text")).alias("unreadable"), T.count(F.col("text"), "[\ufffd\ue000-\uf8ff]").alias("noise"))


def leading_lines(docs: DataFrame, chars: int = 1500, lines: int = 40) -> DataFrame:
    """doc_id, line_no and text of the first non-blank lines, until ``chars`` characters or ``lines`` lines."""
    kept = F.filter(F.transform(F.split("text", "\n"), T.collapse), lambda x: x != "")
    # The array is cut first: a line has a character at least, so that later ones cannot count.
    rows = docs.select("doc_id", F.posexplode(F.slice(kept, 1, lines)).alias("n", "text"))
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).filter(F.col("_before") < chars).select("doc_id", (F.col("n") + 1).alias("line_no"), "text")


#: Labels of lines that name an author; the short ones count only where no line has another.
AUTHOR_LABELS, SHORT_LABELS = "Author|Authors|Autor|Autores|Autora|Autoras|Autoria|Escrito por|Written by|Auteur|Auteurs|Autore|Verfasser", "By|Por"


def suggest_author(docs: DataFrame) -> DataFrame:
    """doc_id and author: the value of the first labelled leading line, else of the first "By:" line, if it is a name."""
    lines = leading_lines(docs)
    long, short = _labelled(lines, AUTHOR_LABELS, 3, 80), _labelled(lines, SHORT_LABELS, 3, 80, ":").withColumnRenamed("value", "other")
    rows = long.join(short, "doc_id", "full").select("doc_id", F.regexp_replace(F.coalesce("value", "other"), "[.]+$", "").alias("author"))
    name = F.col("author")
    return rows.filter(~F.lower(name).isin(*PLACEHOLDERS) & ~name.rlike(r"\d{3}") & name.rlike(r"\p{L}{2}"))


def descriptions(docs: DataFrame) -> DataFrame:
    """doc_id and description: prose paragraphs of 40 characters or more, cut to 155; without prose, any text."""
    paragraphs = F.split(T.strip(F.col("text")), f"\n{T.BLANK}*\n")
    found = F.array_join(F.filter(T.prose(paragraphs), lambda x: F.length(x) >= 40), " ")
    rows = docs.select("doc_id", "text", found.alias("_prose"))
    rows = rows.select("doc_id", F.when(F.col("_prose") != "", F.col("_prose")).otherwise(T.collapse(F.col("text"))).alias("_lead"))
    return rows.select("doc_id", F.trim("_lead").alias("_lead")).select("doc_id", T.shorten(F.col("_lead")).alias("description"))


def fit_titles(docs: DataFrame, title: str, site: str, limit: int = 75) -> DataFrame:
    """Title with the site's name; without it where both are too long, then cut to 70."""
    both = F.concat_ws(" – ", F.col(title), F.lit(site))
    return docs.withColumn("fitted", F.when(F.length(both) <= limit, both).otherwise(T.shorten(F.col(title), 70)))


def slugs(docs: DataFrame, name: str, kind: str, key: str) -> DataFrame:
    """Slug of a name; repeats within a kind get -2, -3 and so on in the order of ``key``."""
    slug = F.regexp_replace(F.regexp_replace(T.fold(F.col(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    rows = docs.select(key, kind, slug.alias("base"))
    n = F.row_number().over(Window.partitionBy(kind, "base").orderBy(key))
    return rows.select(key, kind, F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n)).alias("slug"))


#: Labels of lines that name a title or a summary.
TITLE_LABELS = "Title|Título|Titulo|Documento|Titre|Titel"
SUMMARY_LABELS = "Summary|Abstract|Resumo|Sinopse|Resumen|Résumé|Resumé|Résume|Resume|Zusammenfassung"
#: Characters of a title, of a labelled summary and of a paragraph that can be one; paragraphs looked at.
TITLE_MIN, TITLE_MAX, SUMMARY_MIN, SUMMARY_MAX, PROSE_MIN, PROSE_FIRST = 10, 70, 30, 300, 70, 40


def _labelled(lines: DataFrame, labels: str, least: int, most: int, signs: str = ":–—-") -> DataFrame:
    """doc_id and the value of the first line ``label: value``."""
    value = F.regexp_extract("text", rf"(?i)^(?:{labels})[ \t]*[{signs}][ \t]*(.{{{least},{most}}})$", 1)
    rows = lines.select("doc_id", "line_no", F.regexp_replace(value, "^[ \t,;]+|[ \t,;]+$", "").alias("value"))
    return rows.filter("value <> ''").groupBy("doc_id").agg(F.min_by("value", "line_no").alias("value"))


def fit_title(title: Column) -> Column:
    """Cut to TITLE_MAX characters at a word; '' under TITLE_MIN."""
    cut = F.substring(title, 1, TITLE_MAX)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    word = F.when((F.instr(cut, " ") > 0) & (space >= TITLE_MIN), F.substring(cut, F.lit(1), space)).otherwise(cut)
    fitted = F.when(F.length(title) > TITLE_MAX, F.regexp_replace(word, "[ ,;:.–—-]+$", "")).otherwise(title)
    return F.when(F.length(fitted) >= TITLE_MIN, fitted).otherwise("")


def suggest_title(docs: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id and title: a labelled line, else the first of the ``headings`` (doc_id, seq, level 1 to 3, text), else the first line.

    ``docs`` are doc_id, text and current, the title that is not suggested again; without a title, no row.
    """
    lines = leading_lines(docs)
    labelled = _labelled(lines, TITLE_LABELS, TITLE_MIN, 200).select("doc_id", F.rtrim(F.regexp_replace("value", "[.]+$", "")).alias("a"))
    heads = headings.filter("level <= 3").groupBy("doc_id").agg(F.min_by("text", "seq").alias("b"))
    first = lines.filter("line_no = 1").select("doc_id", F.col("text").alias("c"))
    rows = docs.select("doc_id", F.trim(F.coalesce("current", F.lit(""))).alias("current")).join(labelled, "doc_id", "left").join(heads, "doc_id", "left").join(first, "doc_id", "left")
    rows = rows.select("doc_id", "current", *(T.collapse(F.coalesce(c, F.lit(""))).alias(c) for c in "abc"))
    fits = rows.select("doc_id", "current", *(fit_title(F.col(c)).alias(c) for c in "abc"))
    picked = F.coalesce(*(F.when((F.col(c) != "") & (F.col(c) != F.col("current")), F.col(c)) for c in "abc"))
    return fits.select("doc_id", picked.alias("title")).filter("title is not null")


def suggest_summary(docs: DataFrame) -> DataFrame:
    """doc_id and summary: a labelled line, else the first prose paragraph of 70 characters among the first 40, cut to 155; without one, no row."""
    paragraphs = F.slice(F.split(T.strip(F.col("text")), f"\n{T.BLANK}*\n"), 1, PROSE_FIRST)
    found = F.filter(T.prose(paragraphs), lambda x: F.length(x) >= PROSE_MIN)
    rows = docs.select("doc_id", F.get(found, F.lit(0)).alias("prose")).join(_labelled(leading_lines(docs), SUMMARY_LABELS, SUMMARY_MIN, SUMMARY_MAX), "doc_id", "left")
    rows = rows.select("doc_id", F.trim(F.coalesce("value", "prose")).alias("lead")).filter("lead is not null")
    return rows.select("doc_id", T.shorten(F.col("lead")).alias("summary"))


def learn_language_by_page(pages: DataFrame, first: int = 3_000) -> DataFrame:
    """doc_id, page_no and language (subtag, '' while unknown) as known after each page (doc_id, page_no, text) of a document.

    The first ``first`` characters decide; where they say nothing, reading goes on to the
    size of the language sample. Once there are enough of them, or a longer sample was needed,
    the language is settled.
    """
    order = Window.partitionBy("doc_id").orderBy("page_no")
    text = T.collapse(F.coalesce("text", F.lit("")))
    rows = pages.select("doc_id", "page_no", text.alias("text"))
    before = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before)
    # Pages beyond the sample cannot change it, so that a prefix is no longer than the sample and a page.
    read = rows.filter(F.col("_before") < T.SAMPLE).withColumn("_parts", F.collect_list("text").over(order))
    read = read.select("doc_id", "page_no", F.substring(F.trim(F.array_join("_parts", " ")), 1, T.SAMPLE).alias("_sample"))
    read = read.withColumn("_first", F.substring("_sample", 1, first))
    read = T.with_language(T.with_language(read, F.col("_first"), "_short"), F.col("_sample"), "_long")
    long_full = F.length("_sample") >= T.SAMPLE
    settled = F.when(F.col("_short") != "", F.length("_first") >= first).otherwise((F.col("_long") != "") | long_full)
    tag = F.when(F.col("_short") != "", F.col("_short")).otherwise(F.col("_long"))
    read = read.select("doc_id", "page_no", F.lower(F.split(tag, "-")[0]).alias("own"), settled.alias("settled"))
    known = rows.select("doc_id", "page_no").join(read, ["doc_id", "page_no"], "left")
    kept = F.first(F.when(F.col("settled"), F.col("own")), ignorenulls=True).over(order)
    return known.select("doc_id", "page_no", F.coalesce(kept, "own", F.last("own", ignorenulls=True).over(order), F.lit("")).alias("language"))
