"""Logs, jobs, files, images, highlights and publication."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T

FORBIDDEN = "(?i)key|token|secret|password|authorization|content|text|html"
#: File types read, and why others are refused.
READ = ("pdf", "docx", "txt", "md", "markdown")
#: Memory that reading a PDF takes, as a multiple of its size and in bytes besides, the smallest ceiling, and bytes of a text that are looked at.
PDF_FACTOR, PDF_BASE, PDF_LEAST, HEAD = 5.5, 20 << 20, 2 << 20, 8_192
REASONS = {"doc": "old word processor", "rtf": "old word processor", "odt": "old word processor", "xls": "spreadsheet", "xlsx": "spreadsheet", "ppt": "slides", "pptx": "slides", "epub": "ebook", "html": "html", "htm": "html", "png": "image", "jpg": "image"}


def normalize_log(raw: DataFrame) -> DataFrame:
    """id, ts, level, event, message and context of raw entries: known levels, key-like events, short texts, safe keys."""
    message = T.collapse(T.no_tags(F.col("message")))
    context = F.map_filter(F.from_json("context", "map<string,string>"), lambda k, v: (k != "") & ~k.rlike(FORBIDDEN) & v.isNotNull())
    return raw.select(
        "id", "ts", F.when(F.col("level").isin("info", "warning", "error"), F.col("level")).otherwise("info").alias("level"),
        F.regexp_replace(F.lower(F.replace(F.col("event"), F.lit("."), F.lit("_"))), "[^a-z0-9_-]", "").alias("event"),
        F.when(F.length(message) > 400, F.concat(F.substring(message, 1, 399), F.lit("…"))).otherwise(message).alias("message"),
        F.transform_values(context, lambda k, v: F.substring(v, 1, 200)).alias("context"),
    )


def export_rows(log: DataFrame) -> DataFrame:
    """Text cells of a log for a CSV file; a cell that a spreadsheet would run gets an apostrophe."""
    details = F.array_join(F.transform(F.array_sort(F.map_entries("context")), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")
    safe = lambda c: F.when(c.rlike("^[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c)
    return log.select("id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time_utc"), "level", "event", safe(F.col("message")).alias("message"), safe(details).alias("details"))


def latest_log(log: DataFrame, n: int = 200) -> DataFrame:
    """The last ``n`` entries, oldest first."""
    return log.orderBy(F.desc("id")).limit(n).orderBy("id")


def log_since(log: DataFrame, last: int) -> DataFrame:
    return log.filter(F.col("id") > last)


def abandoned_jobs(events: DataFrame, now, seconds: int = 600) -> DataFrame:
    """job_id and last_page of jobs whose latest event is no end and lies ``seconds`` or more before ``now``."""
    last = events.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status", "page")).alias("x"))
    return last.filter((F.col("x.status") != "done") & (F.col("x.ts") <= now - F.expr(f"interval {seconds} seconds"))).select("job_id", F.col("x.page").alias("last_page"))


def stuck_jobs(steps: DataFrame, retries: int = 3) -> DataFrame:
    """job_id, page and retries of steps that began again and again on one page."""
    order = Window.partitionBy("job_id").orderBy("ts", "event_id")
    rows = steps.withColumn("_new", (~F.col("page").eqNullSafe(F.lag("page").over(order))).cast("int")).withColumn("_run", F.sum("_new").over(order))
    runs = rows.groupBy("job_id", "_run").agg(F.min("page").alias("page"), (F.count("*") - 1).alias("retries"))
    return runs.filter(F.col("retries") >= retries).select("job_id", "_run", "page", "retries").withColumnRenamed("_run", "run")


def pdf_ceiling(memory: int) -> int:
    """Bytes of the largest PDF that can be read in ``memory`` bytes; 0 for none."""
    return max(PDF_LEAST, int((memory - PDF_BASE) / PDF_FACTOR)) if memory > 0 else 0


def gate_files(files: DataFrame, most: int = 2_000_000, memory: int = 0, allowed: tuple[str, ...] = READ) -> DataFrame:
    """One verdict for each file (ext, size), the first that holds.

    Empty, unsupported (with a reason), too large, a PDF over what ``memory`` bytes can read (0: no ceiling), a Markdown
    file with a NUL in the first HEAD bytes of its ``head`` (where there is such a column; null: not read), a type that
    isn't among those ``allowed``, or accepted.
    """
    given = F.lower("ext")
    ext = F.when(given == "markdown", "md").otherwise(given)
    kinds = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    verdict = F.when(F.col("size") == 0, "empty").when(~ext.isin(*READ), F.concat(F.lit("unsupported: "), F.coalesce(F.try_element_at(kinds, ext), F.lit("other")))).when(F.col("size") > most, "too large")
    if ceiling := pdf_ceiling(memory):
        verdict = verdict.when((ext == "pdf") & (F.col("size") > ceiling), "too large for memory")
    if "head" in files.columns:
        verdict = verdict.when((ext == "md") & F.hex(F.substring("head", 1, HEAD)).rlike("^(?:..)*?00"), "no text")
    return files.withColumn("verdict", verdict.when(~ext.isin(*allowed), "disabled").otherwise("accepted"))


def gate_batches(files: DataFrame, most: int = 20) -> DataFrame:
    """batch_id, received and whether the batch is taken: all announced files came, ``most`` at most."""
    return files.groupBy("batch_id").agg(F.count("*").alias("received"), F.max("expected").alias("expected")).withColumn("taken", (F.col("received") >= F.col("expected")) & (F.col("received") <= most))


def decorative_filter(images: DataFrame, least: int = 32, ties: tuple[str, ...] = ("w", "h")) -> DataFrame:
    """Without images under ``least`` pixels on a side, and without those seen on an earlier place of the document; of several on one place, the first by the columns ``ties``."""
    n = F.row_number().over(Window.partitionBy("doc_id", "md5").orderBy("ord", *ties))
    return images.filter((F.col("w") >= least) & (F.col("h") >= least)).withColumn("_n", n).filter("_n = 1").drop("_n")


def fragment_images(images: DataFrame, side: int = 100, near: int = 2, least: int = 3) -> DataFrame:
    """doc_id, w and h of small image sizes with ``least`` distinct images within ``near`` pixels both ways.

    The images of a document meet once. Each count is sent to the widths around its own, where a range of heights adds
    it up, so that the band join is a window.
    """
    rows = images.filter((F.col("w") <= side) & (F.col("h") <= side)).select("doc_id", "md5", "w", "h").repartition("doc_id")
    sizes = rows.distinct().groupBy("doc_id", "w", "h").agg(F.count("*").alias("c"))
    sent = sizes.select("doc_id", "w", "h", "c", F.explode(F.sequence(F.lit(-near), F.lit(near))).alias("_off")).withColumn("w", F.col("w") + F.col("_off"))
    around = F.sum("c").over(Window.partitionBy("doc_id", "w").orderBy("h").rangeBetween(-near, near))
    return sent.withColumn("c", around).filter((F.col("_off") == 0) & (F.col("c") >= least)).select("doc_id", "w", "h", "c")


def live_highlights(marks: DataFrame, least: int = 4) -> DataFrame:
    """Marks (action 'mark') that no later action of the same reader overlaps.

    A mark lies in two cells at most of the grid whose step is the power of two that its length fits
    into; two marks that overlap share a cell of the longer one's grid. So a mark makes two rows for each
    grid in use, however long it is, and a busy reader's marks meet only their neighbours.
    """
    end = F.greatest("e", F.col("s") + 1)
    size = (end - F.col("s")).cast("long")
    rows = marks.withColumns({"_end": end.cast("long"), "_level": F.greatest(F.lit(least), F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0))})
    live = rows.filter((F.col("action") == "mark") & (F.col("s") < F.col("e")))
    grids = sorted(r[0] for r in rows.select("_level").distinct().collect())  # 64 at most
    if not grids:
        return live.select(marks.columns)

    def cells(df: DataFrame, above: int | None) -> DataFrame:
        """A row for each cell in the own grid (``above`` None), or in those that are ``above`` steps coarser or more."""
        wanted = F.array(F.col("_level")) if above is None else F.filter(F.array(*map(F.lit, grids)), lambda g: g >= F.col("_level") + above)
        df = df.withColumn("_grid", F.explode(wanted))
        step = F.expr("shiftleft(1L, _grid)")
        at = lambda x: F.floor(x / step)
        return df.withColumn("_cell", F.explode(F.sequence(at(F.col("s")), at(F.col("_end") - 1))))

    named = rows.select("reader_id", "_level", "s", "e", "_end", "ts", "mark_id")
    later = lambda df: df.select("reader_id", "_grid", "_cell", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("ts").alias("ts2"), F.col("mark_id").alias("id2"))
    over = "s2 < e and e2 > s and (ts2 > ts or (ts2 = ts and id2 > mark_id))"
    pairs = ((cells(live, 0), cells(named, None)), (cells(live, None), cells(named, 1)))
    first, second = (own.join(later(others), ["reader_id", "_grid", "_cell"]).filter(over).select("mark_id") for own, others in pairs)
    return live.join(first.unionByName(second).distinct(), "mark_id", "left_anti").select(marks.columns)


def publication_times(batch: DataFrame, hours: int) -> DataFrame:
    """Each item of a batch ``hours`` after the one before, from the batch's start."""
    n = F.row_number().over(Window.partitionBy("batch_id").orderBy("item_id")) - 1
    return batch.withColumn("at", F.col("start") + F.make_dt_interval(F.lit(0), (n * hours).cast("int")))


def image_alts(images: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Images with the description of the same content: none is missing, '' is decorative."""
    joined = images.join(descriptions.select("doc_id", "md5", "alt"), ["doc_id", "md5"], "left")
    return joined.withColumn("state", F.when(F.col("alt").isNull(), "missing").when(F.col("alt") == "", "decorative").otherwise("described"))


#: Images of a document at most, whatever is asked for.
MOST_IMAGES = 300


def _image_verdicts(most: int, total: int, biggest: int):
    """Images in order of document and place, with a verdict; between batches only the last document's counters are carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, kept, used = (), set(), 0  # no document is ()
        for batch in batches:
            verdicts = []
            for own, md5, size, valid in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if own != doc:
                    doc, kept, used = own, set(), 0
                if md5 in kept:
                    verdict = "repeat"
                elif len(kept) >= min(most, MOST_IMAGES):
                    verdict = "limit_count"
                elif used >= total:
                    verdict = "limit_total"
                elif not valid or size is None:
                    verdict = "invalid"
                elif size > biggest:
                    verdict = "too_big"
                elif used + size > total:
                    verdict = "limit_total"
                else:
                    verdict, used = "included", used + size
                    kept.add(md5)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), pa.array(verdicts, pa.string())], ["doc_id", "alt", "verdict"])

    return run


def image_report(images: DataFrame, most: int = 100, total: int = 60 << 20, biggest: int = 15 << 20) -> DataFrame:
    """doc_id, included, missing_alt, skipped and reasons (map of counts) of images (doc_id, ord, md5, bytes, valid, alt).

    A repeat of an image that was included is neither included again nor skipped. The images of a document are judged
    one after the other (those of one place by all their columns), in Spark's order, so that no document has to fit into a worker.
    """
    rows = images.select(F.col("doc_id").cast("long"), "ord", "md5", F.col("bytes").cast("long"), "valid", "alt")
    judged = rows.repartition("doc_id").sortWithinPartitions("doc_id", "ord", "md5", "bytes", "alt", "valid").mapInArrow(_image_verdicts(most, total, biggest), "doc_id long, alt string, verdict string")
    counts = judged.groupBy("doc_id", "verdict").agg(F.count("*").alias("n"), F.sum(F.col("alt").isNull().cast("int")).alias("bare"))
    new, skipped = F.col("verdict") == "included", ~F.col("verdict").isin("included", "repeat")
    total_of = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).cast("long")
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(skipped, F.struct("verdict", "n")))))  # four reasons at most
    return counts.groupBy("doc_id").agg(total_of(new, "n").alias("included"), total_of(new, "bare").alias("missing_alt"), total_of(skipped, "n").alias("skipped"), reasons.alias("reasons"))
