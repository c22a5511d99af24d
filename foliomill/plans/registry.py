"""Queries over the given tables, and the same results in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators import answers, enrich, html, operations, quality, records, structure, usage
from foliomill.streaming import quotas

from . import tables as t

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) and its SQL."""

    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


_B = r"[ \t\n\f\r]"
_COLLAPSE = "trim(regexp_replace({0}, '[ \\t\\n\\f\\r]+', ' ', 'g'))"
_NOTAGS = "regexp_replace(regexp_replace({0}, '(?is)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>', '', 'g'), '<[^>]*>', '', 'g')"
for _name, _char in T.ENTITIES.items():
    _NOTAGS = f"replace({_NOTAGS}, '&{_name};', '{_char.replace(chr(39), chr(39) * 2)}')"
_COUNT = "len(regexp_extract_all({0}, '{1}'))::BIGINT"
_FOLD = f"translate(lower({{0}}), '{T.ACCENTED}', '{T.PLAIN}')"


def _c(x: str, pattern: str) -> str:
    return _COUNT.format(x, pattern)


def _short(x: str, limit: int = 155) -> str:
    cut = f"left(trim({x}), {limit})"
    space = f"({limit} - instr(reverse({cut}), ' ') + 1)"
    return f"CASE WHEN length(trim({x})) <= {limit} THEN trim({x}) ELSE regexp_replace(CASE WHEN instr({cut}, ' ') > 0 AND {space} > 61 THEN left({cut}, {space} - 1) ELSE {cut} END, '[ ,;:.-]+$', '') || '…' END"


_LISTS = {tag: "[" + ", ".join(f"'{w}'" for w in words) + "]" for tag, words in T.LANGUAGE_WORDS.items()}
_PROSE = f"""CASE WHEN regexp_matches(txt, '^(?:[=*_~#-][ \\t]*){{3,}}') OR (sheet > 0 AND sheet * 2 >= len(lines))
 OR regexp_matches(txt, '(?i)https?://|www\\.|[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+|[A-Za-z0-9_-]+\\.(?:org|com|net|gov|edu|io|br)(?:[^A-Za-z0-9_]|$)')
 OR vis = 0 OR words < 8 OR letters * 100 < vis * 75 OR (words < 20 AND NOT regexp_matches(clean, '[.!?…:;»”")]$')) THEN '' ELSE clean END"""


@query("split_paragraphs", t.sql("ds", "paras") + "SELECT doc_id, para_no, text FROM paras")
def split_paragraphs(spark, sf):
    return structure.split_paragraphs(t.spaced_documents(spark, sf))


_SAMPLES = f"""c AS (SELECT doc_id, {_COLLAPSE.format('text')} AS x FROM d),
s0 AS (SELECT doc_id, unnest(CASE WHEN length(x) <= 20000 THEN [x] ELSE list_transform([1, 3, 5, 7, 9], lambda k: substring(x, greatest((length(x) * k) // 10 - 2000 + 1, 1)::BIGINT, 4000)) END) AS smp FROM c),
s1 AS (SELECT doc_id, smp, string_split_regex(lower(smp), '[^\\p{{L}}]+') AS ws, {_c('smp', chr(92) + 'p{L}')} AS letters, {_c('smp', '[' + chr(92) + 'p{Hiragana}' + chr(92) + 'p{Katakana}]')} AS kana, {_c('smp', chr(92) + 'p{Han}')} AS han, {_c('smp', chr(92) + 'p{Devanagari}')} AS dev, {_c('smp', chr(92) + 'p{Cyrillic}')} AS cyr FROM s0),
s2 AS (SELECT *, list_reverse_sort([{', '.join(f"{{'n': len(list_filter(ws, lambda w: list_contains({words}, w))), 'tag': '{tag}'}}" for tag, words in _LISTS.items())}]) AS r FROM s1),
s3 AS (SELECT doc_id, CASE WHEN letters = 0 THEN '' WHEN (kana + han) * 10 >= letters * 3 THEN CASE WHEN kana * 10 >= kana + han THEN 'ja-JP' ELSE 'zh-CN' END WHEN dev * 10 >= letters * 3 THEN 'hi-IN' WHEN cyr * 10 >= letters * 3 THEN 'ru-RU' WHEN r[1].n >= 3 AND r[1].n > r[2].n THEN r[1].tag ELSE '' END AS tag FROM s2),
v AS (SELECT doc_id, tag, count(*) AS n FROM s3 WHERE tag <> '' GROUP BY ALL),
v1 AS (SELECT doc_id, max(n) AS m FROM v GROUP BY doc_id),
v2 AS (SELECT doc_id, CASE WHEN count(*) = 1 THEN max(tag) ELSE '' END AS tag FROM v JOIN v1 USING (doc_id) WHERE n = m GROUP BY doc_id),
languages AS (SELECT d.doc_id, coalesce(v2.tag, '') AS tag FROM d LEFT JOIN v2 ON d.doc_id = v2.doc_id)"""


@query("detect_language", t.sql("d") + "," + _SAMPLES + " SELECT doc_id, tag FROM languages")
def detect_language(spark, sf):
    return enrich.detect_language(t.documents(spark, sf))


_VISIBLE = "regexp_replace(text, '[ \\t\\n\\f\\r]+', '', 'g')"
_UNREADABLE = f"(length({_VISIBLE}) >= 200 AND {_c(_VISIBLE, '[^' + chr(92) + 'p{L}' + chr(92) + 'p{M}' + chr(92) + 'p{N}]')} * 10 > length({_VISIBLE}) * 3)"


@query("corpus_report", t.sql("d") + "," + _SAMPLES + f""", f AS (SELECT doc_id, {_c('text', chr(92) + 'p{L}+')} AS words, {_UNREADABLE} AS unreadable FROM d)
SELECT tag, count(*) AS documents, sum(words)::BIGINT AS words, sum(CASE WHEN words >= 300 THEN 10 ELSE 0 END + CASE WHEN NOT unreadable THEN 5 ELSE 0 END)::BIGINT AS points FROM languages JOIN f USING (doc_id) GROUP BY tag""")
def corpus_report(spark, sf):
    """Content checks of the scorecard by detected language."""
    text = F.col("text")
    rows = T.with_language(t.documents(spark, sf).select(T.words(text).alias("words"), T.unreadable(text).alias("unreadable"), "text"), text)
    points = F.when(F.col("words") >= 300, 10).otherwise(0) + F.when(~F.col("unreadable"), 5).otherwise(0)
    return rows.groupBy("tag").agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.sum(points).alias("points"))


@query("word_counts", t.sql("d") + f"SELECT doc_id, w AS words, greatest(1, ceil(w / 200))::BIGINT AS minutes FROM (SELECT doc_id, {_c('text', chr(92) + 'p{L}+')} AS w FROM d)")
def word_counts(spark, sf):
    return enrich.word_counts(t.documents(spark, sf))


@query("text_flags", t.sql("d") + f"SELECT doc_id, {_UNREADABLE} AS unreadable, {_c('text', '[' + chr(0xFFFD) + chr(0xE000) + '-' + chr(0xF8FF) + ']')} AS noise FROM d")
def text_flags(spark, sf):
    return enrich.text_flags(t.documents(spark, sf))


_NUMBER = structure.PAGE_NUMBER


@query("drop_page_numbers", t.sql("d", "lines") + f""", pl AS (SELECT doc_id, block_no // 40 AS page_no, block_no % 40 AS line_no, text FROM rows
 UNION ALL SELECT doc_id, n, 40, '- ' || (n + 1) || ' -' FROM (SELECT doc_id, unnest(range(0, (len(ls) - 1) // 40 + 1)) AS n FROM lines0)),
a AS (SELECT *, regexp_replace(text, '^{_B}+|{_B}+$', '', 'g') AS s FROM pl),
b AS (SELECT *, min(CASE WHEN s <> '' THEN line_no END) OVER (PARTITION BY doc_id, page_no) AS lo FROM a),
c AS (SELECT * FROM b WHERE NOT (line_no IS NOT DISTINCT FROM lo AND regexp_matches(s, '{_NUMBER}'))),
e AS (SELECT *, max(CASE WHEN s <> '' THEN line_no END) OVER (PARTITION BY doc_id, page_no) AS hi FROM c)
SELECT doc_id, page_no, line_no, text FROM e WHERE NOT (line_no IS NOT DISTINCT FROM hi AND regexp_matches(s, '{_NUMBER}'))""")
def drop_page_numbers(spark, sf):
    return structure.drop_page_numbers(structure.page_lines(t.documents(spark, sf)))


@query("normalize_ligatures", t.sql("d") + "SELECT doc_id, replace(replace(replace(replace(replace(replace(text, 'fi', 'ﬁ'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl') AS text FROM d")
def normalize_ligatures(spark, sf):
    return structure.normalize_ligatures(t.documents(spark, sf).select("doc_id", F.replace("text", F.lit("fi"), F.lit("ﬁ")).alias("text")))


_ENTRY = "^(.*?)[ \\t]*(?:(?:\\.[ \\t]?){4,}|…{2,}|_{4,})[ \\t]*(\\d{1,4})$"


_STUCK = f"^(?:(.+?)[ \\t]+)?({'|'.join(structure.CONTENTS)})[ \\t]+(.+)$"


@query("extract_toc_entries", t.sql("d", "lines") + f"""
, e AS (
  SELECT doc_id, block_no, CASE WHEN block_no % 5 = 0 THEN 'Booklet Contents ' WHEN block_no % 7 = 0 THEN 'Índice ' ELSE '' END || text || CASE WHEN block_no % 5 IN (0, 2, 3) THEN ' ..... ' || (block_no % 9999 + 1) ELSE '' END AS text FROM rows
), g AS (SELECT *, regexp_matches(text, '{_ENTRY}') AS toc, regexp_replace(regexp_extract(text, '{_ENTRY}', 1), '^[ \\t.]+|[ \\t.]+$', '', 'g') AS raw FROM e),
h AS (SELECT *, toc AND NOT coalesce(lag(toc) OVER (PARTITION BY doc_id ORDER BY block_no), false) AND regexp_matches(raw, '{_STUCK}') AS split FROM g)
SELECT doc_id, block_no, text, regexp_extract(text, '{_ENTRY}', 2)::INT AS toc_page, CASE WHEN split THEN regexp_extract(raw, '{_STUCK}', 1) ELSE '' END AS lead,
  CASE WHEN split THEN regexp_extract(raw, '{_STUCK}', 2) ELSE '' END AS heading, CASE WHEN split THEN regexp_extract(raw, '{_STUCK}', 3) ELSE raw END AS title
FROM h WHERE toc""")
def extract_toc_entries(spark, sf):
    """Three lines of five are entries; some start with the word that stands over them."""
    lines = t.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    head = F.when(F.col("n") % 5 == 0, "Booklet Contents ").when(F.col("n") % 7 == 0, "Índice ").otherwise("")
    tail = F.when((F.col("n") % 5).isin(0, 2, 3), F.concat(F.lit(" ..... "), F.col("n") % 9999 + 1)).otherwise("")
    return structure.extract_toc_entries(lines.select("doc_id", F.col("n").cast("long").alias("block_no"), F.concat(head, "text", tail).alias("text")))


@query("printed_toc_runs", t.sql("d", "lines") + ", e AS (SELECT doc_id, block_no, length(text) % 4 < 2 AS is_toc FROM rows), s AS (SELECT *, CASE WHEN is_toc AND NOT coalesce(lag(is_toc) OVER (PARTITION BY doc_id ORDER BY block_no), false) THEN 1 ELSE 0 END AS st FROM e) SELECT doc_id, block_no, is_toc, run FROM (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY block_no)::BIGINT AS run FROM s) WHERE is_toc")
def printed_toc_runs(spark, sf):
    lines = t.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return structure.printed_toc_runs(lines.select("doc_id", F.col("n").cast("long").alias("block_no"), (F.length("text") % 4 < 2).alias("is_toc")))


_BULLET, _NUM, _LET = f"^[{structure.BULLETS}{structure.SYMBOLS}]{_B}*([^ \\t\\n\\f\\r].*)$", "^(\\d{1,2})([.)])[ \\t]+[^ \\t]", "^([a-zA-Z])\\)[ \\t]+[^ \\t]"


@query("list_markers", t.sql("d", "lines") + f"""
, e AS (
  SELECT doc_id, block_no, CASE block_no % 6 WHEN 0 THEN '• ' || text WHEN 1 THEN (block_no % 120) || '. ' || text WHEN 2 THEN 'B) ' || text
    WHEN 3 THEN '- ' || text WHEN 4 THEN '\uf0b7' || text ELSE text END AS text
  FROM rows
), l AS (SELECT *, regexp_replace(text, '^{_B}+|{_B}+$', '', 'g') AS x FROM e),
k AS (SELECT *, regexp_matches(x, '{_BULLET}') AS b, regexp_matches(x, '{_NUM}') AS n, regexp_matches(x, '{_LET}') AS a, regexp_extract(x, '{_LET}', 1) AS g FROM l)
SELECT doc_id, block_no, text, CASE WHEN b THEN 'ul' ELSE 'ol' END AS kind,
  CASE WHEN b THEN 'bullet' WHEN n THEN 'number' || regexp_extract(x, '{_NUM}', 2) WHEN lower(g) = g THEN 'lower' ELSE 'upper' END AS family,
  CASE WHEN b THEN 0 WHEN n THEN regexp_extract(x, '{_NUM}', 1)::INT ELSE ascii(lower(g)) - 96 END AS value,
  CASE WHEN b THEN regexp_extract(x, '{_BULLET}', 1) ELSE x END AS item
FROM k WHERE b OR n OR a""")
def list_markers(spark, sf):
    """Lines with a bullet, a number, a letter, a dash (which is none), a bullet of a symbol font, or nothing in front."""
    lines = t.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).select("doc_id", F.col("n").cast("long").alias("block_no"), F.col("text").alias("x"))
    k, marks = F.col("block_no") % 6, {0: F.lit("• "), 1: F.concat((F.col("block_no") % 120).cast("string"), F.lit(". ")), 2: F.lit("B) "), 3: F.lit("- "), 4: F.lit("\uf0b7")}
    mark = F.lit("")
    for number, sign in marks.items():
        mark = F.when(k == number, sign).otherwise(mark)
    return structure.list_markers(lines.select("doc_id", "block_no", F.concat(mark, "x").alias("text")))


@query("promote_headings", t.sql("d", "lines") + r""", 
e0 AS (SELECT doc_id, block_no, trim(CASE WHEN block_no % 5 <> 0 THEN text ELSE CASE (doc_id + block_no // 5) % 6 WHEN 0 THEN 'Chapter ' || (block_no + 1) WHEN 1 THEN '2.1 Method' WHEN 2 THEN 'IV. Part of it'
  WHEN 3 THEN 'ALL OF THE REST' WHEN 4 THEN 'A short line' ELSE 'Not one, by its end.' END END) AS text FROM rows),
e AS (SELECT doc_id, block_no AS para_no, text, coalesce(lead(text) OVER w, '') AS nx, coalesce(lag(text) OVER w, '') AS pv FROM e0 WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
h AS (SELECT *, CASE WHEN length(text) < 3 OR length(text) > 80 OR regexp_matches(text, '[.,;:!?…]$') OR NOT regexp_matches(text, '\p{L}') THEN 0
 WHEN regexp_matches(text, '@CHAPTER@') THEN 2
 WHEN regexp_matches(text, '^(\d{1,2}(?:\.\d{1,2}){0,3})[.)]?[ \t]+\p{Lu}') THEN CASE WHEN contains(regexp_extract(text, '^(\d{1,2}(?:\.\d{1,2}){0,3})[.)]?[ \t]+\p{Lu}', 1), '.') THEN 3 ELSE 2 END
 WHEN regexp_matches(text, '^[IVXLC]{1,6}[.)][ \t]+\p{Lu}') THEN 2
 WHEN length(text) <= 60 AND len(regexp_extract_all(text, '\p{L}')) >= 3 AND NOT regexp_matches(text, '\p{Ll}') AND regexp_matches(text, '\p{Lu}') THEN 2
 WHEN length(text) <= 50 AND len(regexp_extract_all(text, '\p{L}+')) <= 8 AND length(nx) >= 100 AND (pv = '' OR regexp_matches(pv, '[.!?…"”»)]$')) THEN 2 ELSE 0 END AS level FROM e),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, sum((level > 0)::INT) OVER (PARTITION BY doc_id) AS m FROM h)
SELECT doc_id, para_no, text, level FROM g WHERE level > 0 AND m <= greatest(3, n * 2 // 5)""".replace("@CHAPTER@", structure.CHAPTER))
def promote_headings(spark, sf):
    """Every fifth line is a heading of some kind, or just none."""
    lines = t.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    kind = (F.col("doc_id") + F.floor(F.col("n") / 5)) % 6
    line = F.when(kind == 0, F.concat(F.lit("Chapter "), F.col("n") + 1)).otherwise("Not one, by its end.")
    for k, words in ((1, "2.1 Method"), (2, "IV. Part of it"), (3, "ALL OF THE REST"), (4, "A short line")):
        line = F.when(kind == k, words).otherwise(line)
    text = F.when(F.col("n") % 5 == 0, line).otherwise(F.col("text"))
    return structure.promote_headings(lines.select("doc_id", F.col("n").cast("long").alias("para_no"), F.trim(text).alias("text")))


@query("leading_lines", t.sql("d", "lines") + f""", c AS (SELECT doc_id, block_no, {_COLLAPSE.format('text')} AS x FROM rows), n AS (SELECT doc_id, x AS text, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS line_no, block_no FROM c WHERE x <> ''),
s AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n)
SELECT doc_id, line_no::INT AS line_no, text FROM s WHERE b < 1500 AND line_no <= 40""")
def leading_lines(spark, sf):
    return enrich.leading_lines(t.documents(spark, sf))


@query("suggest_author", """
SELECT doc_id, author FROM (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'A. ' || source || ' B' ELSE source || ' ' || lang END AS author FROM documents
) WHERE author IS NOT NULL AND NOT regexp_matches(author, '[0-9]{3}')""")
def suggest_author(spark, sf):
    """Labels of both kinds, a placeholder, and a number in the place of a name."""
    n, name = F.col("doc_id"), F.concat("source", F.lit(" "), "lang")
    line = (
        F.when(n % 7 == 0, F.concat(F.lit("By: someone\nAuthor: Admin\nWritten by: "), name)).when(n % 11 == 0, "Verfasser: AB 12345")
        .when(n % 3 == 0, F.concat(F.lit("By my friends\nPor: A. "), "source", F.lit(" B."))).when(n % 3 == 1, F.concat(F.lit("Written by – "), name)).otherwise(F.concat(F.lit("By: nobody\nAUTORES: "), name, F.lit(" ;\nAutor: admin")))
    )
    return enrich.suggest_author(t.documents(spark, sf).select("doc_id", F.concat(line, F.lit("\n"), "text").alias("text")))


@query("descriptions", t.sql("ds", "paras") + f""", q0 AS (SELECT doc_id, para_no, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_COLLAPSE.format('x')}), lambda x: x <> '') AS lines FROM paras),
q1 AS (SELECT doc_id, para_no, lines, array_to_string(lines, ' ') AS txt, len(list_filter(lines, lambda x: length(x) <= 80 AND regexp_matches(x, '^\\p{{L}}[\\p{{L}} ._-]{{0,24}}:[ \\t]*[^ \\t]'))) AS sheet FROM q0),
q2 AS (SELECT *, {_COLLAPSE.format("regexp_replace(txt, '={3,}|" + chr(92) + "*{3,}|_{3,}|~{3,}|#{3,}|-{3,}', ' ', 'g')")} AS clean FROM q1),
q3 AS (SELECT *, {_c('clean', chr(92) + 'p{L}')} AS letters, length(replace(clean, ' ', '')) AS vis, {_c('clean', chr(92) + 'p{L}{2,}')} AS words FROM q2),
q4 AS (SELECT doc_id, para_no, {_PROSE} AS prose FROM q3), q5 AS (SELECT doc_id, string_agg(prose, ' ' ORDER BY para_no) AS j FROM q4 WHERE length(prose) >= 40 GROUP BY doc_id),
q6 AS (SELECT d.doc_id, coalesce(j, {_COLLAPSE.format('text')}) AS x FROM d LEFT JOIN q5 USING (doc_id))
SELECT doc_id, {_short('x')} AS description FROM q6""")
def descriptions(spark, sf):
    return enrich.descriptions(t.spaced_documents(spark, sf))


_TITLE = _COLLAPSE.format(_NOTAGS.format("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)"))


@query("fit_titles", t.sql("p") + f", x AS (SELECT page_id, {_TITLE} AS title FROM p) SELECT page_id, title, CASE WHEN length(title || ' – The Example Collection of Documents') <= 75 THEN title || ' – The Example Collection of Documents' ELSE {_short('title', 70)} END AS fitted FROM x")
def fit_titles(spark, sf):
    rows = t.pages(spark, sf).select("page_id", html.title_of(F.col("html")).alias("title"))
    return enrich.fit_titles(rows, "title", "The Example Collection of Documents")


@query("slugs", t.sql("d") + f", f0 AS (SELECT doc_id, lang, string_split(text, chr(10))[1] AS name FROM d), x AS (SELECT doc_id, lang, regexp_replace(regexp_replace({_FOLD.format(chr(34) + 'name' + chr(34))}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS b FROM f0), n AS (SELECT *, row_number() OVER (PARTITION BY lang, b ORDER BY doc_id) AS n FROM x) SELECT doc_id, lang, CASE WHEN n = 1 THEN b ELSE b || '-' || n END AS slug FROM n")
def slugs(spark, sf):
    """The first line of a text is its name."""
    return enrich.slugs(t.documents(spark, sf).withColumn("name", F.split("text", "\n")[0]), "name", "lang", "doc_id")


_HEADS = f"""h0 AS (SELECT page_id, regexp_extract_all(html, '(?is)<h([1-6])\\b[^>]*>(.*?)</h[1-6]>', 1) AS l, regexp_extract_all(html, '(?is)<h([1-6])\\b[^>]*>(.*?)</h[1-6]>', 2) AS b, html FROM p),
h1 AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS i, unnest(l)::INT AS level, unnest(b) AS body FROM h0), h2 AS (SELECT page_id, i, level, {_COLLAPSE.format(_NOTAGS.format('body'))} AS text FROM h1)"""


@query("build_toc", t.sql("pr") + f", {_HEADS}, h3 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i)::INT AS seq, count(*) OVER (PARTITION BY page_id) AS n FROM h2 WHERE text <> '') SELECT page_id, seq, 'section-' || seq AS id, level, text FROM h3 WHERE n > 1")
def build_toc(spark, sf):
    return html.build_toc(t.rich_pages(spark, sf))


_HTML_BLOCKS = t.sql("p") + f", b0 AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<(?:p|li|h[1-6]|figcaption)\\b[^>]*>(.*?)</(?:p|li|h[1-6]|figcaption)>', 1), lambda x: {_COLLAPSE.format(_NOTAGS.format('x'))}), lambda x: x <> '') AS bs FROM p) SELECT page_id, unnest(range(1, len(bs) + 1))::INT AS block_no, unnest(bs) AS text FROM b0"


@query("html_blocks", _HTML_BLOCKS)
def html_blocks(spark, sf):
    return html.html_blocks(t.pages(spark, sf))


@query("numbered_characters", _HTML_BLOCKS)
def numbered_characters(spark, sf):
    """The blocks of pages whose letters with accents are written by number, every other letter in hexadecimal."""
    text = F.col("html")
    for i, letter in enumerate("äöüßéèêñóíáçëî"):
        text = F.replace(text, F.lit(letter), F.lit(f"&#{ord(letter)};" if i % 2 else f"&#x{ord(letter):X};"))
    return html.html_blocks(t.pages(spark, sf).withColumn("html", text))


@query("toc_tree", t.sql("pr") + f"""
, {_HEADS}, k AS (SELECT page_id, i AS seq, level - min(level) OVER (PARTITION BY page_id) AS a, count(*) OVER (PARTITION BY page_id) AS n FROM h2)
SELECT page_id, seq::INT AS seq, (seq + min(CASE WHEN seq = 1 THEN 0 ELSE a END - seq) OVER (PARTITION BY page_id ORDER BY seq))::INT AS depth FROM k WHERE n > 1""")
def toc_tree(spark, sf):
    return html.toc_tree(t.rich_pages(spark, sf))


@query("demote_headings", t.sql("p") + "SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<h1\\b') THEN " + "".join("regexp_replace(" for _ in range(5)) + "html" + "".join(f", '(?i)<(/?)h{k}\\b', '<\\1h{k + 1}', 'g')" for k in range(5, 0, -1)) + " ELSE html END AS html FROM p")
def demote_headings(spark, sf):
    return html.demote_headings(t.pages(spark, sf)).select("page_id", "html")


@query("needs_parts", t.sql("d") + "SELECT doc_id, strlen(text)::BIGINT AS bytes, strlen(text) >= 30000 AS always, strlen(text) >= 10000 AS if_asked FROM d")
def needs_parts(spark, sf):
    return html.needs_parts(t.documents(spark, sf), "text", 30_000, 10_000).select("doc_id", "bytes", "always", "if_asked")


@query("same_titles", t.sql("p") + f", x AS (SELECT lower({_TITLE}) AS title FROM p) SELECT title, count(*) AS n FROM x WHERE title <> '' GROUP BY title HAVING count(*) > 1")
def same_titles(spark, sf):
    return html.same_titles(t.pages(spark, sf))


_ALT = '(?i)<img\\b[^>]*\\balt=""'


@query("structure_counts", t.sql("pr") + f", {_HEADS}, hc AS (SELECT page_id, count(*) FILTER (text <> '') AS headings FROM h2 GROUP BY page_id) SELECT p.page_id, coalesce(headings, 0) AS headings, {_c('html', '(?i)<img' + chr(92) + 'b')} AS images, {_c('html', _ALT)} AS missing_alt FROM p LEFT JOIN hc USING (page_id)")
def structure_counts(spark, sf):
    return html.structure_counts(t.rich_pages(spark, sf))


@query("usage_edges", t.sql("p", "hosts", "refs", "edges") + "SELECT doc, host_id, status FROM edges")
def usage_edges(spark, sf):
    return usage.usage_edges(t.hosts(spark, sf), t.referenced(spark, sf), t.HREF)


@query("builder_edges", t.sql("p", "hosts", "refs", "edges") + "SELECT doc, host_id, status FROM edges")
def builder_edges(spark, sf):
    """The same edges, from pages of which two in three are kept in the JSON of a page builder."""
    hosts = t.hosts(spark, sf)
    part = F.struct(F.lit("a1").alias("id"), F.array(F.struct(F.struct(F.col("content").alias("html"), F.lit('a "b" \\ c').alias("note")).alias("settings"))).alias("elements"))
    built = F.when(F.col("host_id") % 3 > 0, F.to_json(F.array(part)))
    return usage.usage_edges(hosts.select("host_id", "status", F.when(built.isNull(), F.col("content")).alias("content"), built.alias("builder")), t.referenced(spark, sf), t.HREF)


@query("hosts_of", t.sql("p", "hosts", "refs", "edges") + ", r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY (status <> 'publish')::INT, host_id) AS k FROM edges) SELECT doc, count(*) AS hosts, min_by(host_id, k) AS first_host, string_agg(host_id::VARCHAR, ', ' ORDER BY k) FILTER (k <= 5) AS first_hosts, greatest(count(*) - 5, 0) AS more FROM r WHERE k <= 100 GROUP BY doc")
def hosts_of(spark, sf):
    return usage.hosts_of(usage_edges(spark, sf)).withColumn("first_hosts", F.array_join(F.col("first_hosts").cast("array<string>"), ", "))


@query("orphans", t.sql("p", "hosts", "refs", "edges") + "SELECT doc FROM refs WHERE doc NOT IN (SELECT doc FROM edges WHERE status = 'publish')")
def orphans(spark, sf):
    return usage.orphans(t.referenced(spark, sf), usage_edges(spark, sf))


@query("first_document_of", t.sql("p", "hosts", "refs") + """, x AS (SELECT host_id, regexp_extract_all(content, 'href="([^"]+)"', 1) AS l FROM hosts), y AS (SELECT host_id, unnest(range(0, len(l))) AS n, unnest(l) AS doc FROM x) SELECT host_id, min_by(doc, n) AS doc FROM y WHERE doc IN (SELECT doc FROM refs) GROUP BY host_id""")
def first_document_of(spark, sf):
    return usage.first_document_of(t.hosts(spark, sf), t.referenced(spark, sf), t.HREF)


@query("usage_changes", t.sql("p", "hosts", "refs", "edges") + """, later AS (SELECT DISTINCT host_id, doc FROM (SELECT page_id AS host_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS doc FROM p WHERE page_id % 5 <> 1) WHERE doc IN (SELECT doc FROM refs)), e AS (SELECT host_id, doc FROM edges)
SELECT *, 'removed' AS change FROM (SELECT * FROM e EXCEPT SELECT * FROM later) UNION ALL SELECT *, 'added' AS change FROM (SELECT * FROM later EXCEPT SELECT * FROM e)""")
def usage_changes(spark, sf):
    docs = t.referenced(spark, sf)
    return usage.usage_changes(usage.usage_edges(t.hosts(spark, sf), docs, t.HREF), usage.usage_edges(t.hosts(spark, sf, 1), docs, t.HREF))


_META = "regexp_extract(html, '(?is)<meta[^>]*name=\"{0}\"[^>]*content=\"([^\"]*)\"', 1)"
_PAGE = _COLLAPSE.format(_NOTAGS.format("html"))
_FACTS = f"""r0 AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), 'href="([^"]+)"', 1) AS a FROM pages), r1 AS (SELECT page_id, unnest(range(0, len(a))) AS n, unnest(a) AS doc FROM r0),
r2 AS (SELECT doc FROM r1 GROUP BY doc HAVING count(DISTINCT page_id) >= 2), r3 AS (SELECT page_id, min_by(doc, n) AS doc FROM r1 WHERE doc IN (SELECT doc FROM r2) GROUP BY page_id),
shown AS (SELECT page_id FROM r3 WHERE doc IN (SELECT doc FROM r1 WHERE page_id % 5 = 0)),
f0 AS (SELECT page_id, html, {_TITLE} AS title, {_META.format('description')} AS description, {_META.format('author')} AS author, list_transform(regexp_extract_all(html, '(?is)<h([1-6])\\b[^>]*>(.*?)</h[1-6]>', 1), lambda x: x::INT) AS levels, {_PAGE} AS text FROM p),
f AS (SELECT *, {_c('text', chr(92) + 'p{L}+')} AS words, {_UNREADABLE} AS unreadable, {_c('html', _ALT)} AS missing, page_id IN (SELECT page_id FROM shown) AS published, NOT contains(html, 'noindex') AS indexable, regexp_matches(html, '(?i)property="og:') AS seo,
 len(list_filter(range(1, len(levels)), lambda i: levels[i + 1] > levels[i] + 1)) AS jumps FROM f0),
checks AS (SELECT page_id, words, unnest(['title', 'description', 'author', 'headings', 'hierarchy', 'length', 'readable', 'alt', 'published', 'indexable', 'seo_tags']) AS check_id,
 unnest(['metadata', 'metadata', 'metadata', 'structure', 'structure', 'content', 'content', 'content', 'publish', 'publish', 'publish']) AS grp, unnest([5, 10, 10, 10, 15, 10, 5, 10, 15, 5, 5]) AS most,
 unnest([CASE WHEN length(title) BETWEEN 10 AND 70 THEN 5 ELSE 0 END, CASE WHEN description <> '' THEN 10 ELSE 0 END, CASE WHEN author <> '' THEN 10 ELSE 0 END, CASE WHEN len(levels) >= 2 THEN 10 ELSE 0 END, CASE WHEN jumps = 0 THEN 15 WHEN jumps <= 2 THEN 8 ELSE 0 END,
 CASE WHEN words >= 300 THEN 10 ELSE 0 END, CASE WHEN NOT unreadable THEN 5 ELSE 0 END, CASE WHEN missing = 0 THEN 10 ELSE 0 END, CASE WHEN published THEN 15 ELSE 0 END, CASE WHEN indexable THEN 5 ELSE 0 END, CASE WHEN seo THEN 5 ELSE 0 END]) AS points FROM f)"""


def _facts(spark, sf):
    """Facts of pages; a page is about the first document among its references, and published where a published page shows that."""
    hosts, docs = t.hosts(spark, sf), t.referenced(spark, sf)
    none = hosts.select("host_id", F.lit("").alias("doc"), F.lit(0).cast("long").alias("post_id"), "status").filter(F.lit(False))
    edges = usage.usage_edges(hosts, docs, t.HREF).withColumn("host_id", F.col("host_id") + 1)  # the page 0 is none
    on = records.host_page(docs, edges, none, none.select("host_id"))
    about = usage.first_document_of(hosts, docs, t.HREF)
    return quality.page_facts(t.rich_pages(spark, sf), about.join(on, "doc").select(F.col("host_id").alias("page_id"), "page"))


@query("scorecard", t.sql("pr") + f", {_FACTS} SELECT page_id, words, check_id, grp, most, points FROM checks")
def scorecard(spark, sf):
    return quality.scorecard(_facts(spark, sf))


@query("score_totals", t.sql("pr") + f", {_FACTS}, s AS (SELECT page_id, CASE WHEN max(words) < 300 THEN least(sum(points), 70) ELSE sum(points) END::BIGINT AS score FROM checks GROUP BY page_id) SELECT page_id, score, CASE WHEN score >= 85 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS grade FROM s")
def score_totals(spark, sf):
    return quality.totals(scorecard(spark, sf))


@query("score_rollup", t.sql("pr") + f", {_FACTS} SELECT lang, grp, check_id, grouping_id(lang, grp, check_id)::INT AS gid, sum(points)::BIGINT AS points, sum((points = most)::INT)::BIGINT AS passed FROM checks JOIN (SELECT page_id, lower(regexp_extract(html, '(?i)<html\\b[^>]*\\blang=.([A-Za-z]+)', 1)) AS lang FROM p) USING (page_id) GROUP BY ROLLUP (lang, grp, check_id)")
def score_rollup(spark, sf):
    return quality.score_rollup(scorecard(spark, sf), quality.page_facts(t.rich_pages(spark, sf)))


@query("heading_jumps", t.sql("pr") + f", {_FACTS} SELECT page_id, jumps::INT AS jumps FROM f")
def heading_jumps(spark, sf):
    return quality.page_facts(t.rich_pages(spark, sf)).select("page_id", quality.jumps(F.col("levels")).alias("jumps"))


_AUDIT = f"""a0 AS (SELECT page_id, html, {_TITLE} AS title, {_PAGE} AS text FROM p),
audit AS (SELECT page_id, unnest(['title', 'title_length', 'description', 'canonical', 'lang', 'robots', 'one_h1', 'open_graph', 'json_ld', 'words', 'text_share', 'links']) AS check_id,
unnest([CASE WHEN title <> '' THEN 'PASS' ELSE 'FAIL' END, CASE WHEN length(title) <= 75 THEN 'PASS' ELSE 'WARN' END, CASE WHEN {_c('html', '(?i)<meta[^>]*name="description"')} = 1 THEN 'PASS' ELSE 'FAIL' END,
CASE WHEN regexp_matches(html, '(?i)<link[^>]*rel="canonical"') THEN 'PASS' ELSE 'WARN' END, CASE WHEN regexp_matches(html, '(?i)<html[^>]*\\blang=') THEN 'PASS' ELSE 'FAIL' END, CASE WHEN contains(html, 'noindex') THEN 'FAIL' ELSE 'PASS' END,
CASE WHEN {_c('html', '(?i)<h1' + chr(92) + 'b')} = 1 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN regexp_matches(html, '(?i)property="og:title"') THEN 'PASS' ELSE 'WARN' END, CASE WHEN contains(html, 'application/ld+json') THEN 'PASS' ELSE 'WARN' END,
CASE WHEN {_c('text', chr(92) + 'p{L}+')} >= 300 THEN 'PASS' ELSE 'WARN' END, CASE WHEN length(text) * 10 >= length(html) THEN 'PASS' ELSE 'WARN' END, CASE WHEN {_c('html', '(?i)<a' + chr(92) + 'b')} <= 300 THEN 'PASS' ELSE 'WARN' END]) AS result FROM a0)"""


@query("audit_pages", t.sql("pr") + f", {_AUDIT} SELECT page_id, check_id, result FROM audit")
def audit_pages(spark, sf):
    return quality.audit_pages(t.rich_pages(spark, sf))


@query("page_scores", t.sql("pr") + f", {_AUDIT} SELECT page_id, greatest(0, 100 - 8 * sum((result = 'FAIL')::INT) - 3 * sum((result = 'WARN')::INT))::BIGINT AS score FROM audit GROUP BY page_id")
def page_scores(spark, sf):
    return quality.page_scores(audit_pages(spark, sf))


def _blocks(spark, sf):
    return t.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).select("doc_id", F.col("n").cast("long").alias("block_no"), "text")


@query("block_prefixes", t.sql("d", "lines") + "SELECT doc_id, block_no, left(text, 60) AS block, row_number() OVER (PARTITION BY doc_id, left(text, 60) ORDER BY block_no) - 1 AS dup FROM rows")
def block_prefixes(spark, sf):
    return answers.block_prefixes(_blocks(spark, sf))


@query("search_blocks", t.sql("d", "lines") + f""", n AS (SELECT item_id AS query_id, list_extract(string_split(text, ' '), 2) || ' ' || list_extract(string_split(text, ' '), 3) AS needle FROM benchmark WHERE len(string_split(text, ' ')) >= 3),
n1 AS (SELECT query_id, needle, {_FOLD.format('needle')} AS low FROM n), b1 AS (SELECT *, {_FOLD.format('text')} AS low FROM rows),
h AS (SELECT query_id, doc_id, block_no, text, instr(b1.low, n1.low) AS pos, length(needle) AS k FROM b1, n1 WHERE contains(b1.low, n1.low))
SELECT query_id, doc_id, block_no, substring(text, greatest(pos - 70, 1), least(pos - 1, 70)) AS before, substring(text, pos, k) AS match, substring(text, pos + k, 90) AS after FROM h""")
def search_blocks(spark, sf):
    """The query set: two words of every benchmark item."""
    words = F.split("text", " ")
    needles = t.table(spark, sf, "benchmark").filter(F.size(words) >= 3).select(F.col("item_id").alias("query_id"), F.concat_ws(" ", words[1], words[2]).alias("needle"))
    blocks = _blocks(spark, sf)
    return answers.search_blocks(blocks, needles)


def _terms(x: str) -> str:
    return f"regexp_extract_all({_FOLD.format(x)}, '([\\p{{L}}\\p{{N}}]{{3,}})', 1)"


_INDEX = f"""n AS (SELECT doc_id, count(*) AS n FROM rows GROUP BY doc_id), w AS (SELECT doc_id, block_no AS passage_no, unnest({_terms('text')}) AS term FROM rows), tf AS (SELECT doc_id, passage_no, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
idx AS (SELECT doc_id, term, passage_no, tf, df, n FROM tf JOIN df USING (doc_id, term) JOIN n USING (doc_id))"""


def _passages(spark, sf):
    return t.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).select("doc_id", F.col("n").cast("long").alias("passage_no"), "text")


@query("passage_terms", t.sql("d", "lines") + f", {_INDEX} SELECT doc_id, term, passage_no, tf, df, n FROM idx")
def passage_terms(spark, sf):
    return answers.passage_terms(_passages(spark, sf))


@query("rank_passages", t.sql("d", "lines", "q") + f", {_INDEX}, a AS (SELECT question_id, doc_id, unnest(list_distinct({_terms('text')})) AS term FROM q), s AS (SELECT question_id, passage_no, round(sum((1 + ln(tf)) * ln(1 + n / df)), 6) AS score FROM a JOIN idx USING (doc_id, term) GROUP BY ALL) SELECT question_id, passage_no, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, passage_no)::INT AS rank FROM s")
def rank_passages(spark, sf):
    questions = t.questions(spark, sf)
    asked = _passages(spark, sf).join(questions.select("doc_id").distinct(), "doc_id", "left_semi")
    return answers.rank_passages(questions, answers.passage_terms(asked))


_COMMON = "[" + ", ".join(f"'{w}'" for w in answers.COMMON) + "]"


def _vectors(name: str, key: str, text: str, source: str) -> str:
    return f"{name}0 AS (SELECT {key} AS id, left(x, 6) AS stem, count(*) AS c FROM (SELECT {key}, unnest({_terms(text)}) AS x FROM {source}) WHERE NOT list_contains({_COMMON}, x) GROUP BY ALL), {name} AS (SELECT id, stem, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM {name}0)"


@query("question_vectors", t.sql("q") + ", " + _vectors("v", "question_id", "text", "q") + " SELECT id AS question_id, stem, round(w, 6) AS w FROM v")
def question_vectors(spark, sf):
    return answers.question_vectors(t.questions(spark, sf)).select("question_id", "stem", F.round("w", 6).alias("w"))


@query("reuse_answers", t.sql("q") + ", a AS (SELECT question_id AS answer_id, doc_id, left(text, length(text) - length(text) // 20) AS question FROM q WHERE question_id % 2 = 0), " + _vectors("v", "question_id", "text", "q") + ", " + _vectors("u", "answer_id", "question", "a") + """,
m AS (SELECT v.id AS question_id, u.id AS answer_id, round(sum(v.w * u.w), 6) AS cosine FROM v JOIN q ON q.question_id = v.id JOIN a ON a.doc_id = q.doc_id JOIN u ON u.id = a.answer_id AND u.stem = v.stem GROUP BY ALL)
SELECT question_id, answer_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC, answer_id) AS r FROM m WHERE cosine >= 0.85) WHERE r = 1""")
def reuse_answers(spark, sf):
    questions = t.questions(spark, sf)
    size = F.length("text")
    saved = questions.filter("question_id % 2 = 0").select(F.col("question_id").alias("answer_id"), "doc_id", F.substring("text", F.lit(1), (size - F.floor(size / 20)).cast("int")).alias("question"))
    return answers.reuse_answers(questions, saved)


@query("trim_history", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''), b AS (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS f FROM a WHERE r <= 4)
SELECT conv_id, turn, role, left(text, 2000) AS text FROM b WHERE turn >= f""")
def trim_history(spark, sf):
    return answers.trim_history(t.table(spark, sf, "conversations"))


@query("normalize_log", t.sql("raw", "log") + "SELECT id, ts, level, event, message, k FROM log")
def normalize_log(spark, sf):
    return operations.normalize_log(t.log_raw(spark, sf)).select("id", "ts", "level", "event", "message", F.col("context")["k"].alias("k"))


@query("export_rows", t.sql("raw", "log") + "SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_utc, level, event, CASE WHEN regexp_matches(message, '^[=+@-]') THEN '''' || message ELSE message END AS message, 'k=' || k AS details FROM log")
def export_rows(spark, sf):
    return operations.export_rows(operations.normalize_log(t.log_raw(spark, sf)))


@query("latest_log", t.sql("raw", "log") + "SELECT id, level, event FROM log ORDER BY id DESC LIMIT 200")
def latest_log(spark, sf):
    return operations.latest_log(operations.normalize_log(t.log_raw(spark, sf))).select("id", "level", "event")


@query("log_since", t.sql("raw", "log") + "SELECT id, level, event FROM log WHERE id > 500")
def log_since(spark, sf):
    return operations.log_since(operations.normalize_log(t.log_raw(spark, sf)), 500).select("id", "level", "event")


@query("abandoned_jobs", t.sql("jobs") + ", l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS r FROM jobs) SELECT job_id, page AS last_page FROM l WHERE r = 1 AND status <> 'done' AND ts <= (SELECT max(ts) FROM events) - INTERVAL 600 SECONDS")
def abandoned_jobs(spark, sf):
    jobs = t.jobs(spark, sf)
    now = jobs.agg(F.max("ts")).first()[0]
    return operations.abandoned_jobs(jobs, F.lit(now))


@query("stuck_jobs", t.sql("jobs") + ", a AS (SELECT *, (page IS DISTINCT FROM lag(page) OVER w)::INT AS st FROM jobs WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)), b AS (SELECT *, sum(st) OVER (PARTITION BY job_id ORDER BY ts, event_id)::BIGINT AS run FROM a) SELECT job_id, run, min(page) AS page, count(*) - 1 AS retries FROM b GROUP BY job_id, run HAVING count(*) > 3")
def stuck_jobs(spark, sf):
    return operations.stuck_jobs(t.jobs(spark, sf))


@query("gate_files", t.sql("d") + ", f AS (SELECT doc_id, (['pdf', 'docx', 'txt', 'md', 'doc', 'odt', 'html', 'png'])[doc_id % 8 + 1] AS ext, n_chars * 100 AS size, doc_id // 15 AS batch_id FROM d) SELECT doc_id, ext, size, batch_id, CASE WHEN size = 0 THEN 'empty' WHEN ext IN ('doc', 'odt') THEN 'unsupported: old word processor' WHEN ext = 'html' THEN 'unsupported: html' WHEN ext = 'png' THEN 'unsupported: image' WHEN size > 1000000 THEN 'too large' ELSE 'accepted' END AS verdict FROM f")
def gate_files(spark, sf):
    return operations.gate_files(_files(spark, sf), 1_000_000)


@query("gate_contents", t.sql("d") + """, f AS (SELECT doc_id, (['pdf', 'docx', 'txt', 'md', 'MARKDOWN', 'odt', 'html', 'png'])[doc_id % 8 + 1] AS ext, n_chars * 3000 AS size, doc_id % 5 = 0 OR instr(text, 'a') > 300 AS nul FROM d)
SELECT doc_id, CASE WHEN size = 0 THEN 'empty' WHEN ext = 'odt' THEN 'unsupported: old word processor' WHEN ext = 'html' THEN 'unsupported: html' WHEN ext = 'png' THEN 'unsupported: image' WHEN size > 40000000 THEN 'too large'
  WHEN ext = 'pdf' AND size > 2097152 THEN 'too large for memory' WHEN ext IN ('md', 'MARKDOWN') AND nul THEN 'no text' WHEN ext = 'txt' THEN 'disabled' ELSE 'accepted' END AS verdict FROM f""")
def gate_contents(spark, sf):
    """Files in little memory, with a zero byte in some heads, where plain texts are turned off."""
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "docx", "txt", "md", "MARKDOWN", "odt", "html", "png"))), (F.col("doc_id") % 8 + 1).cast("int"))
    nul = (F.col("doc_id") % 5 == 0) | (F.instr("text", "a") > 300)
    head = F.concat(F.col("text").cast("binary"), F.lit(b"x"))
    files = t.documents(spark, sf).select("doc_id", ext.alias("ext"), (F.col("n_chars") * 3000).alias("size"), F.when(nul, F.concat(F.lit(b"\x00"), head)).otherwise(head).alias("head"))
    return operations.gate_files(files, 40_000_000, 30 << 20, ("pdf", "docx", "md")).select("doc_id", "verdict")


def _files(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "docx", "txt", "md", "doc", "odt", "html", "png"))), (F.col("doc_id") % 8 + 1).cast("int"))
    return t.documents(spark, sf).select("doc_id", ext.alias("ext"), (F.col("n_chars") * 100).alias("size"), F.floor(F.col("doc_id") / 15).alias("batch_id"))


@query("gate_batches", "SELECT batch_id, received, expected, received >= expected AND received <= 20 AS taken FROM (SELECT doc_id // 15 AS batch_id, count(*) AS received, max(doc_id % 16) AS expected FROM documents GROUP BY 1)")
def gate_batches(spark, sf):
    return operations.gate_batches(_files(spark, sf).withColumn("expected", F.col("doc_id") % 16))


@query("decorative_filter", t.sql("images") + "SELECT doc_id, ord, md5, w, h FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, md5 ORDER BY ord) AS n FROM images WHERE w >= 32 AND h >= 32) WHERE n = 1")
def decorative_filter(spark, sf):
    """Order lines as images; of several on one place, the one that stands first in the table."""
    ties = ("file_path", "row_index")
    return operations.decorative_filter(t.images(spark, sf, *t.PLACE), ties=ties).drop(*ties)


@query("fragment_images", t.sql("images") + ", s AS (SELECT doc_id, w, h, count(DISTINCT md5) AS c FROM images WHERE w <= 100 AND h <= 100 GROUP BY ALL) SELECT a.doc_id, a.w, a.h, sum(b.c)::BIGINT AS c FROM s a JOIN s b ON a.doc_id = b.doc_id AND abs(a.w - b.w) <= 2 AND abs(a.h - b.h) <= 2 GROUP BY ALL HAVING sum(b.c) >= 3")
def fragment_images(spark, sf):
    return operations.fragment_images(t.images(spark, sf))


@query("image_alts", t.sql("images") + ", a AS (SELECT doc_id, md5, max(CASE WHEN w % 3 = 0 THEN '' ELSE 'picture ' || w END) AS alt FROM images WHERE ord % 2 = 0 GROUP BY ALL) SELECT i.doc_id, i.md5, ord, w, h, alt, CASE WHEN alt IS NULL THEN 'missing' WHEN alt = '' THEN 'decorative' ELSE 'described' END AS state FROM images i LEFT JOIN a ON a.doc_id = i.doc_id AND a.md5 = i.md5")
def image_alts(spark, sf):
    images = t.images(spark, sf)
    alt = F.when(F.col("w") % 3 == 0, "").otherwise(F.concat(F.lit("picture "), F.col("w")))
    return operations.image_alts(images, images.filter("ord % 2 = 0").groupBy("doc_id", "md5").agg(F.max(alt).alias("alt")))


@query("live_highlights", t.sql("marks") + "SELECT mark_id, reader_id, s, e FROM marks a WHERE action = 'mark' AND s < e AND NOT EXISTS (SELECT 1 FROM marks b WHERE b.reader_id = a.reader_id AND b.s < a.e AND greatest(b.e, b.s) > a.s AND (b.ts > a.ts OR (b.ts = a.ts AND b.mark_id > a.mark_id)))")
def live_highlights(spark, sf):
    return operations.live_highlights(t.marks(spark, sf)).select("mark_id", "reader_id", "s", "e")


@query("publication_times", "SELECT o_custkey AS batch_id, o_orderkey AS item_id, TIMESTAMP '2026-01-01 08:00:00' + INTERVAL 6 HOURS * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS at FROM orders")
def publication_times(spark, sf):
    batch = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("item_id"), F.lit("2026-01-01 08:00:00").cast("timestamp").alias("start"))
    return operations.publication_times(batch, 6).select("batch_id", "item_id", "at")


@query("daily_cap", "SELECT event_id, day FROM (SELECT event_id, ts::DATE AS day, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS n FROM events) WHERE n <= 300")
def daily_cap(spark, sf):
    return quotas.daily_cap(t.table(spark, sf, "events"))


def _quota(most: int, seconds: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT user_id AS reader, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (
  SELECT reader, 0::BIGINT AS k, 0 AS used, NULL::TIMESTAMP AS last, event_id, ts, false AS accepted FROM e WHERE k = 1
  UNION ALL
  SELECT reader, k, before + good::INT, CASE WHEN good THEN ts ELSE last END, event_id, ts, good FROM (
    SELECT *, before < {most} AS good FROM (
      SELECT e.reader, e.k, e.event_id, e.ts, f.last, CASE WHEN f.last IS NULL OR e.ts - f.last >= INTERVAL {seconds} SECONDS THEN 0 ELSE f.used END AS before FROM f JOIN e ON e.reader = f.reader AND e.k = f.k + 1))
)
SELECT reader, event_id, ts, accepted FROM f WHERE k > 0"""


@query("question_quota", _quota(20, 3600))
def question_quota(spark, sf):
    events = t.table(spark, sf, "events").select(F.col("user_id").alias("reader"), "ts", "event_id")
    return quotas.quota(events, 20, 3600)


@query("search_quota", _quota(30, 60))
def search_quota(spark, sf):
    events = t.table(spark, sf, "events").select(F.col("user_id").alias("reader"), "ts", "event_id")
    return quotas.quota(events, 30, 60)
