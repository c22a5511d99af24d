"""The given tables and inputs derived from them, the same in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HREF = r'href="([^"]+)"'
STATUS = ("publish", "draft", "trash", "private", "future")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")


def pages(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))


def spaced_documents(spark, sf) -> DataFrame:
    """Documents with a blank line after every sentence in two, and lines of a sheet at the end of some."""
    docs = documents(spark, sf)
    text = F.regexp_replace("text", r"([.!?]) ([^.!?]*[.!?]) ", "$1\n \t\n$2 ")
    sheet = F.when(F.col("doc_id") % 4 == 0, "\n\nName: one\nYear: two\n\nSee https://e.org/a for more of this and of that and all the other things").otherwise("")
    return docs.withColumn("text", F.concat(text, sheet))


#: What pages get, by their number: (every, pattern, what stands there afterwards) and (every, what comes at the end).
_HEAD = (
    (2, "<head>", '<head><meta name="description" content="Of things.">'), (3, "<head>", '<head><meta name="author" content="A. Writer">'), (4, "<head>", '<head><script type="application/ld+json">{}</script>'),
    (5, "<head>", '<head><meta property="og:title" content="T">'), (7, "<head>", '<head><link rel="canonical" href="/c">'), (11, "<head>", '<head><meta name="robots" content="noindex">'), (6, "<html lang", "<html data_lang"),
)
_TAIL = ((3, '<img src="a.png" alt="">'), (4, '<img src="b.png" alt="A view">'), (13, "<h1>Again</h1>"), (8, "<h6>Deep</h6><p>x</p><h2>  </h2><h3>Up</h3>"), (17, '<a href="#n">x</a>' * 301))


def rich_pages(spark, sf) -> DataFrame:
    """Pages with more headings, images, links and tags in their heads, in many combinations."""
    html, n = F.col("html"), F.col("page_id")
    for every, old, new in _HEAD:
        html = F.when(n % every == 0, F.replace(html, F.lit(old), F.lit(new))).otherwise(html)
    level = lambda x: (x % 5 + 2).cast("string")
    one, two = level(n), level(F.floor(n / 5))
    parts = [F.lit("<h"), one, F.lit(' id="own">Part <b>one</b></h'), one, F.lit("><p>x</p><h"), two, F.lit(">Two &amp; more&hellip;</h"), two, F.lit(">")]
    tails = [F.when(n % every == 0, F.lit(tail)).otherwise("") for every, tail in _TAIL]
    return pages(spark, sf).select("page_id", "url", html.alias("html")).select("page_id", "url", F.concat("html", *parts, *tails).alias("html"))


def _rich_sql() -> str:
    html = "coalesce(html, '')"
    for every, old, new in _HEAD:
        html = f"CASE WHEN page_id % {every} = 0 THEN replace({html}, '{old}', '{new}') ELSE {html} END" if every == _HEAD[0][0] else f"replace({html}, '{old}', CASE WHEN page_id % {every} = 0 THEN '{new}' ELSE '{old}' END)"
    one, two = "(page_id % 5 + 2)", "(page_id // 5 % 5 + 2)"
    parts = f"""'<h' || {one} || ' id="own">Part <b>one</b></h' || {one} || '><p>x</p><h' || {two} || '>Two &amp; more&hellip;</h' || {two} || '>'"""
    tails = " || ".join(f"CASE WHEN page_id % {every} = 0 THEN '{tail}' ELSE '' END" for every, tail in _TAIL)
    return f"p AS (SELECT page_id, url, {html} || {parts} || {tails} AS html FROM pages)"


def hosts(spark, sf, shift: int = 0) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, STATUS)), ((F.col("page_id") + shift) % 5 + 1).cast("int"))
    return pages(spark, sf).select(F.col("page_id").alias("host_id"), status.alias("status"), F.col("html").alias("content"))


def referenced(spark, sf) -> DataFrame:
    """Documents: what two pages or more refer to."""
    refs = pages(spark, sf).select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("doc")).distinct()
    return refs.groupBy("doc").agg(F.count("*").alias("n")).filter("n >= 2").select("doc")


def log_raw(spark, sf) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "trace").otherwise("warning")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", level.alias("level"), F.concat(F.lit("Page."), "event_type").alias("event"), F.concat(F.lit(" =<b>user</b>  "), "user_id").alias("message"), F.col("props").alias("context"))


def jobs(spark, sf) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "done").otherwise("step")
    return table(spark, sf, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", status.alias("status"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("page"))


def marks(spark, sf) -> DataFrame:
    s = F.floor("value").cast("long")
    action = F.when(F.col("event_type") == "error", "remove").otherwise("mark")
    return table(spark, sf, "events").select(F.col("event_id").alias("mark_id"), F.col("user_id").alias("reader_id"), s.alias("s"), (s + F.get_json_object("props", "$.k").cast("long") % 9).alias("e"), action.alias("action"), "ts")


#: Where a row stands in its table: the file, and its number there.
PLACE = ("_metadata.file_path", "_metadata.row_index")


def images(spark, sf, *more: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("ord"), F.md5(F.col("l_partkey").cast("string")).alias("md5"), (F.col("l_quantity").cast("long") + 20).alias("w"), (F.col("l_linenumber").cast("long") + 28).alias("h"), *more
    )


def questions(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").agg(F.count("*").alias("n"))
    rows = table(spark, sf, "conversations").filter("role = 'user'")
    return rows.join(F.broadcast(docs)).select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), (F.col("conv_id") % F.col("n")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))  # one row


SQL = {
    "ds": r"""d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([.!?]) ([^.!?]*[.!?]) ', '\1' || chr(10) || ' ' || chr(9) || chr(10) || '\2 ', 'g')
      || CASE WHEN doc_id % 4 = 0 THEN chr(10) || chr(10) || 'Name: one' || chr(10) || 'Year: two' || chr(10) || chr(10) || 'See https://e.org/a for more of this and of that and all the other things' ELSE '' END AS text, lang, source, n_chars FROM documents)""",
    "pr": _rich_sql(),
    "d": "d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars FROM documents)",
    "p": "p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages)",
    "hosts": "hosts AS (SELECT page_id AS host_id, (['publish', 'draft', 'trash', 'private', 'future'])[page_id % 5 + 1] AS status, html AS content FROM p)",
    "refs": """docs AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS doc FROM p), refs AS (SELECT doc FROM docs GROUP BY doc HAVING count(*) >= 2)""",
    "edges": """edges AS (SELECT DISTINCT doc, host_id, status FROM (SELECT host_id, status, unnest(regexp_extract_all(content, 'href="([^"]+)"', 1)) AS doc FROM hosts WHERE status IN ('publish', 'draft', 'pending', 'private', 'future')) WHERE doc IN (SELECT doc FROM refs))""",
    "raw": """raw AS (SELECT event_id AS id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'trace' ELSE 'warning' END AS level, 'Page.' || event_type AS event, ' =<b>user</b>  ' || user_id AS message, props AS context FROM events)""",
    "log": """log AS (SELECT id, ts, CASE WHEN level IN ('info', 'warning', 'error') THEN level ELSE 'info' END AS level, replace(lower(event), '.', '_') AS event, '=' || substr(message, 6, 4) || '  ' AS m0, trim(regexp_replace(regexp_replace(message, '<[^>]*>', '', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g')) AS message, json_extract_string(context, '$.k') AS k FROM raw)""",
    "jobs": "jobs AS (SELECT user_id AS job_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'step' END AS status, json_extract_string(props, '$.k')::INT % 3 AS page FROM events)",
    "marks": "marks AS (SELECT event_id AS mark_id, user_id AS reader_id, floor(value)::BIGINT AS s, floor(value)::BIGINT + json_extract_string(props, '$.k')::BIGINT % 9 AS e, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'mark' END AS action, ts FROM events)",
    "images": "images AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS ord, md5(l_partkey::VARCHAR) AS md5, l_quantity::BIGINT + 20 AS w, l_linenumber::BIGINT + 28 AS h FROM lineitem)",
    "q": "q AS (SELECT conv_id * 1000 + turn AS question_id, conv_id % (SELECT count(*) FROM documents) AS doc_id, coalesce(text, '') AS text FROM conversations WHERE role = 'user')",
    "paras": """paras0 AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$', '', 'g'), '\\n[ \\t\\n\\f\\r]*\\n'), lambda x: regexp_replace(x, '^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$', '', 'g')), lambda x: x <> '') AS ps FROM d),
paras AS (SELECT doc_id, unnest(range(1, len(ps) + 1))::INT AS para_no, unnest(ps) AS text FROM paras0)""",
    "lines": """lines0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d),
rows AS (SELECT doc_id, unnest(range(0, len(ls))) AS block_no, unnest(ls) AS text FROM lines0)""",
}


def sql(*names: str) -> str:
    """A WITH clause of the derived inputs."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
