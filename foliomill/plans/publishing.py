"""Queries over records of documents: links, languages, metadata, publication, highlights, saved answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators import records, redaction, usage

from . import tables as t
from .registry import _COLLAPSE, _NOTAGS, _SAMPLES, ORACLE_SQL, query, search_blocks

_ANCHOR = '<a href="([^"]*)">([^<]*)</a>'
_LINK = records.LINK


@query("markdown_links", t.sql("p") + f"""x AS (SELECT page_id AS doc_id, regexp_replace(html, '{_ANCHOR}', CASE page_id % 3 WHEN 0 THEN '[\\2](https://e.org\\1 "go")' WHEN 1 THEN '![\\2](https://e.org\\1)' ELSE '[\\2](#\\2) [\\2](\\1)' END, 'g') AS text FROM p),
y AS (SELECT doc_id, {', '.join(f"regexp_extract_all(text, '{_LINK}', {i}) AS g{i}" for i in (1, 2, 3, 4))} FROM x), z AS (SELECT doc_id, unnest(range(1, len(g1) + 1)) AS i, unnest(g1) AS s, unnest(g2) AS text, unnest(g3) AS url, coalesce(unnest(g4), '') AS title FROM y)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT AS link_no, text, url, title FROM z WHERE coalesce(s, '') = '' AND regexp_matches(url, '{records.SCHEMES}')""".replace("x AS (", ", x AS (", 1))
def markdown_links(spark, sf):
    """Anchors of the pages as links, images, and links of a scheme that is refused, by page."""
    form = F.when(F.col("page_id") % 3 == 0, F.lit('[$2](https://e.org$1 "go")')).when(F.col("page_id") % 3 == 1, F.lit("![$2](https://e.org$1)")).otherwise(F.lit("[$2](#$2) [$2]($1)"))
    return records.markdown_links(t.pages(spark, sf).select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", F.lit(_ANCHOR), form).alias("text")))


_REGION = "CASE base " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in records.REGIONS.items()) + " ELSE upper(base) END"


@query("resolve_language", t.sql("d") + "," + _SAMPLES + f""", r AS (SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 5 = 0 THEN nullif(lang, '') END, CASE WHEN d.doc_id % 3 = 0 THEN 'es_mx' END, nullif(tag, ''), 'pt-BR') AS tag FROM d JOIN languages USING (doc_id)),
s AS (SELECT doc_id, tag, string_split(replace(tag, '_', '-'), '-') AS parts, lower(string_split(replace(tag, '_', '-'), '-')[1]) AS base FROM r) SELECT doc_id, tag, base || '_' || CASE WHEN length(parts[2]) = 2 THEN upper(parts[2]) ELSE {_REGION} END AS locale, base AS subtag FROM s""")
def resolve_language(spark, sf):
    docs = t.documents(spark, sf)
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("lang")).alias("saved"), F.when(F.col("doc_id") % 3 == 0, F.lit("es_mx")).alias("chosen"), "text")
    rows = T.with_language(rows, F.col("text"), "detected")
    return records.resolve_language(rows, "pt-BR").select("doc_id", "tag", "locale", "subtag")


def _line(x: str, most: int) -> str:
    return f"left({_COLLAPSE.format(_NOTAGS.format(x))}, {most})"


_PLACEHOLDERS = ", ".join(f"'{x}'" for x in records.PLACEHOLDERS)


@query("clean_metadata", t.sql("d") + f""", r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Admin' ELSE coalesce(source, '') || ' <b>' || text END AS author, text AS subject, replace(text, ' ', ', ') AS keywords, CASE WHEN doc_id % 4 = 0 THEN lang || '?' ELSE lang END AS language FROM d),
w AS (SELECT *, list_filter(list_transform(regexp_split_to_array(keywords, '[;,\\n]+'), lambda x: {_line('x', 60)}), lambda x: x <> '') AS ws FROM r),
k AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
k1 AS (SELECT doc_id, lower(word) AS low, min(i) AS i, arg_min(word, i) AS word FROM k GROUP BY doc_id, low),
k2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM k1),
k3 AS (SELECT doc_id, string_agg(word, '; ' ORDER BY i) AS ten FROM k2 WHERE n <= 10 GROUP BY doc_id)
SELECT doc_id, CASE WHEN lower({_line('author', 120)}) IN ({_PLACEHOLDERS}) THEN '' ELSE {_line('author', 120)} END AS author, {_line('subject', 300)} AS subject, coalesce(ten, '') AS keywords,
CASE WHEN regexp_matches(coalesce(trim(language), ''), '{records.LANGUAGE_TAG}') THEN trim(language) ELSE '' END AS language FROM w LEFT JOIN k3 USING (doc_id)""")
def clean_metadata(spark, sf):
    text = F.col("text")
    author = F.when(F.col("doc_id") % 7 == 0, "Admin").otherwise(F.concat(F.coalesce("source", F.lit("")), F.lit(" <b>"), text))
    raw = t.documents(spark, sf).select(
        "doc_id", author.alias("author"), text.alias("subject"), F.replace(text, F.lit(" "), F.lit(", ")).alias("keywords"),
        F.when(F.col("doc_id") % 4 == 0, F.concat("lang", F.lit("?"))).otherwise(F.col("lang")).alias("language"),
    )
    return records.clean_metadata(raw).withColumn("keywords", F.array_join("keywords", "; "))


@query("share_images", t.sql("p") + f""", x AS (SELECT page_id, regexp_replace(html, '{_ANCHOR}', '<img width="' || (100 + page_id % 7 * 60) || '" src="\\1" height="200" alt="\\2">', 'g') AS html FROM p),
y AS (SELECT page_id, 100 + page_id % 7 * 60 AS w, regexp_extract(html, '<img [^>]*src="([^"]+)"', 1) AS url, regexp_extract(html, '<img [^>]*src="[^"]+"[^>]*alt="([^"]*)"', 1) AS alt FROM x)
SELECT page_id, url, w::INT AS width, 200 AS height, alt FROM y WHERE w >= 300 AND url <> ''""")
def share_images(spark, sf):
    """Anchors of the pages as images whose width follows from the page."""
    image = F.concat(F.lit('<img width="'), (100 + F.col("page_id") % 7 * 60).cast("string"), F.lit('" src="$1" height="200" alt="$2">'))
    return records.share_images(t.pages(spark, sf).withColumn("html", F.regexp_replace("html", F.lit(_ANCHOR), image)))


@query("merge_records", "SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS author, CASE WHEN n_chars > 500 THEN 'long' END AS kind FROM documents")
def merge_records(spark, sf):
    """The language and author of the base stay, and only the kind of long documents comes in."""
    docs = t.table(spark, sf, "documents")
    base = F.create_map(F.lit("language"), F.coalesce("lang", F.lit("")), F.lit("author"), F.coalesce("source", F.lit("")))
    extra = F.when(F.col("n_chars") > 500, F.create_map(F.lit("language"), F.lit("xx"), F.lit("kind"), F.lit("long"), F.lit("publisher"), F.lit("p"))).otherwise(F.create_map(F.lit("author"), F.lit("y")))
    whole = docs.select("doc_id", records.merge_records(base, extra).alias("m"))
    return whole.select("doc_id", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("language", "author", "kind")))


@query("host_page", t.sql("p", "hosts", "refs", "edges") + """, own AS (SELECT doc, min(host_id) AS own FROM edges WHERE host_id % 3 = 0 AND status = 'publish' GROUP BY doc), h AS (SELECT doc, min(host_id) AS host FROM edges WHERE status = 'publish' GROUP BY doc),
r AS (SELECT doc, coalesce(own, host, 0)::BIGINT AS page FROM refs LEFT JOIN own USING (doc) LEFT JOIN h USING (doc)) SELECT doc, page, page = 0 OR page % 4 <> 1 AS indexable FROM r""")
def host_page(spark, sf):
    edges = usage.usage_edges(t.hosts(spark, sf), t.referenced(spark, sf), t.HREF)
    posts = edges.filter("host_id % 3 = 0").withColumnRenamed("host_id", "post_id")
    return records.host_page(t.referenced(spark, sf), edges, posts, t.hosts(spark, sf).filter("host_id % 4 = 1"))


@query("publication_state", """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'post' WHEN o_orderkey % 2 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'canceled' WHEN 'P' THEN 'removed' ELSE 'scheduled' END WHEN o_orderpriority LIKE '1%' THEN 'error' ELSE 'none' END AS kind FROM orders""")
def publication_state(spark, sf):
    orders = t.table(spark, sf, "orders").withColumn("doc_id", F.col("o_orderkey"))
    action = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "canceled").when(F.col("o_orderstatus") == "P", "complete").otherwise("pending")
    posts, plan = orders.filter("doc_id % 3 = 0").withColumn("post_id", F.col("doc_id")), orders.filter("doc_id % 2 = 0").select("doc_id", F.col("o_orderdate").alias("when"), action.alias("action"))
    return records.publication_state(orders, posts, plan, orders.filter("o_orderpriority like '1%'").select("doc_id", F.col("o_orderpriority").alias("message")))


@query("valid_highlights", t.sql("d") + """, m AS (SELECT event_id AS mark_id, event_id % (SELECT count(*) FROM documents) AS doc_id, floor(value)::BIGINT AS s, floor(value)::BIGINT + json_extract_string(props, '$.k')::BIGINT % 9 AS e, (['yellow', 'green', 'blue', 'pink', 'red'])[event_id % 5 + 1] AS c FROM events)
SELECT mark_id, m.doc_id, s, e FROM m JOIN d ON d.doc_id = m.doc_id WHERE c <> 'red' AND s >= 0 AND s < e AND mark_id % 4 <> 0""")
def valid_highlights(spark, sf):
    """Marks of events whose text is what stands in the document now, but for every fourth."""
    docs = t.documents(spark, sf)
    colour = F.element_at(F.array(*map(F.lit, ("yellow", "green", "blue", "pink", "red"))), (F.col("mark_id") % 5 + 1).cast("int"))
    n = t.table(spark, sf, "documents").agg(F.count("*").alias("n"))
    marks = t.marks(spark, sf).filter("s >= 0").join(F.broadcast(n)).withColumn("doc_id", F.col("mark_id") % F.col("n")).withColumn("c", colour)  # one row
    now = F.substring("text", (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int"))
    marks = marks.join(docs.select("doc_id", "text"), "doc_id").withColumn("t", F.when(F.col("mark_id") % 4 == 0, F.concat(now, F.lit("?"))).otherwise(now)).drop("text")
    return records.valid_highlights(marks, docs, ("yellow", "green", "blue", "pink")).select("mark_id", "doc_id", "s", "e")


_REDACTED = """WITH x AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'short' ELSE 'k/' || user_id || '"abcdefg' END AS secret, user_id, event_type FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || ' short short short' ELSE left(event_type || ' •••• •••• ••••' || repeat('.', (event_id % 400)::INT), 300) || CASE WHEN length(event_type) + 15 + event_id % 400 > 300 THEN '…' ELSE '' END END AS message FROM x"""


@query("redact_messages", _REDACTED)
def redact_messages(spark, sf):
    """Messages that hold a secret plain, URL-encoded and JSON-escaped; each row knows its own."""
    return records.redact_messages(_messages(spark, sf), F.col("secret")).select("event_id", "message")


@query("redact_set", _REDACTED)
def redact_set(spark, sf):
    """The same messages, from which the secrets of all rows are taken."""
    rows = _messages(spark, sf)
    return redaction.redact_set(rows, rows.select("secret")).select("event_id", "message")


def _messages(spark, sf):
    rows = t.table(spark, sf, "events").withColumn("secret", F.when(F.col("event_id") % 3 == 0, "short").otherwise(F.concat(F.lit("k/"), "user_id", F.lit('"abcdefg'))))
    coded = F.concat(F.lit("k%2F"), F.col("user_id"), F.lit("%22abcdefg"))
    escaped = F.concat(F.lit("k\\/"), F.col("user_id"), F.lit('\\"abcdefg'))
    dots = F.repeat(F.lit("."), (F.col("event_id") % 400).cast("int"))
    message = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit(" short short short"))).otherwise(F.concat("event_type", F.lit(" "), "secret", F.lit(" "), coded, F.lit(" "), escaped, dots))
    return rows.withColumn("message", message)


@query("review_log_counts", "SELECT user_id AS doc, event_type AS origin, count(*) AS reviews, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS issues FROM events GROUP BY ALL")
def review_log_counts(spark, sf):
    part = F.struct(F.col("user_id").alias("doc"), F.col("event_type").alias("origin"), F.get_json_object("props", "$.k").alias("issues"))
    return records.review_log_counts(t.table(spark, sf, "events").select(F.to_json(part).alias("context")))


@query("trim_answers", """WITH a AS (SELECT event_id AS answer_id, user_id AS doc_id, ts AS used_at, md5(event_type) AS sig FROM events)
SELECT answer_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY used_at DESC, answer_id) AS n FROM a WHERE sig = md5((['view', 'click'])[doc_id % 2 + 1])) WHERE n <= 100""")
def trim_answers(spark, sf):
    events = t.table(spark, sf, "events")
    answers = events.select(F.col("event_id").alias("answer_id"), F.col("user_id").alias("doc_id"), F.col("ts").alias("used_at"), F.md5("event_type").alias("sig"))
    current = answers.select("doc_id").distinct().withColumn("sig", F.when(F.col("doc_id") % 2 == 0, F.md5(F.lit("view"))).otherwise(F.md5(F.lit("click"))))
    return records.trim_answers(answers, current).select("answer_id", "doc_id")


@query("allowed_terms", t.sql("d") + f""", x AS (SELECT doc_id, (['tag', 'topic'])[doc_id % 2 + 1] AS taxonomy, (['page', 'post', 'book'])[doc_id % 3 + 1] AS type, string_split(replace(text, ' ', ' , '), ',') AS ws FROM d)
SELECT DISTINCT doc_id, taxonomy, unnest(list_filter(list_transform(ws, lambda x: {_COLLAPSE.format('x')}), lambda x: x <> '')) AS term FROM x WHERE (type = 'page' AND taxonomy = 'tag') OR type = 'post'""")
def allowed_terms(spark, sf):
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    docs = t.documents(spark, sf).select("doc_id", pick(("tag", "topic")).alias("taxonomy"), pick(("page", "post", "book")).alias("type"), F.replace("text", F.lit(" "), F.lit(" , ")).alias("terms"))
    return records.allowed_terms(docs, spark.createDataFrame([("page", "tag"), ("post", "tag"), ("post", "topic")], "type string, taxonomy string"))


@query("search_page", f"SELECT * FROM (SELECT query_id, doc_id, block_no, count(*) OVER (PARTITION BY query_id, doc_id) AS total, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY block_no)::INT AS n FROM ({ORACLE_SQL['search_blocks']})) WHERE n <= 20")
def search_page(spark, sf):
    """The first page of hits of each query in each document."""
    return records.search_page(search_blocks(spark, sf), 0).select("query_id", "doc_id", "block_no", "total", "n")
