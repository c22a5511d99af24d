"""Reading order of pages in two columns, from the places of their pieces of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("doc_id", "page_no")
#: Fixed values. In em: the width of a glyph, and the gap that parts a line into segments.
GLYPH, GAP = 0.5, 1.0
#: Lines that a second margin needs, characters of a line, shares of letters and of aligned lines.
LINES, CHARS, LETTERS, ALIGNED = 4, 20, 0.6, 0.6
#: Fixed values, in usual spacings: the gap that ends the columns, and the one that ends a paragraph.
APART, PARAGRAPH = 2.5, 1.6
#: Fixed value: share of one-letter pieces above which a page places letters one by one.
SINGLE = 0.8
_SPACES = r"^[\s\u00A0\u200B]*$"


def placed_runs(pieces: DataFrame) -> DataFrame:
    """doc_id, page_no, ord, x, y, size and text of pieces with a text matrix (a, b, c, d, e, f) and a font size (null: 1).

    Rotated pieces and empty texts are left out; a size under 3 points means that the font is unknown, and counts as 10.
    """
    size = F.abs("d") * F.coalesce(F.col("font_size"), F.lit(1.0))
    level = (F.abs("b") <= 0.01) & (F.abs("c") <= 0.01) & (F.col("text") != "")
    return pieces.filter(level).select(*PAGE, "ord", F.col("e").alias("x"), F.col("f").alias("y"), F.when(size >= 3, size).otherwise(10.0).alias("size"), "text")


def _upright(runs: DataFrame) -> DataFrame:
    """y grows upwards: the stream of a page goes down it most of the time."""
    page = Window.partitionBy(*PAGE)
    before = F.last(F.when(~F.col("space"), F.col("y")), ignorenulls=True).over(page.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    step = F.when(F.col("space"), 0).when(F.col("y") - before > 1, 1).when(before - F.col("y") > 1, -1).otherwise(0)
    rows = runs.withColumn("step", step)
    return rows.withColumn("y", F.when(F.sum("step").over(page) > 0, -F.col("y")).otherwise(F.col("y"))).drop("step")


def _numbered(runs: DataFrame) -> DataFrame:
    """Runs with the number of their visual line: a line goes on while its first run is near enough."""
    held = F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("down"), "x", "ord", "size", "text", "space")))
    pages = runs.groupBy(*PAGE).agg(held.alias("runs"), (F.count_if(~F.col("space") & (F.length("text") == 1)) >= SINGLE * F.count_if(~F.col("space"))).alias("single"), F.count_if(~F.col("space")).alias("n"))
    start = F.struct(F.lit(None).cast("double").alias("down"), F.expr("array()").cast("array<int>").alias("lines"))

    def placed(done: Column, run: Column) -> Column:
        new = done.down.isNull() | (F.abs(done.down - run.down) > F.greatest(F.lit(1.0), 0.3 * run.size))
        last = F.coalesce(F.try_element_at(done.lines, F.lit(-1)), F.lit(0))
        return F.struct(F.when(new, run.down).otherwise(done.down).alias("down"), F.concat(done.lines, F.array(last + new.cast("int"))).alias("lines"))

    lines = F.aggregate("runs", start, placed, lambda done: done.lines)
    return pages.filter(F.col("n") >= 2 * LINES).select(*PAGE, "single", F.inline(F.zip_with("runs", lines, lambda r, k: F.struct(k.alias("line"), (-r.down).alias("y"), r.x.alias("x"), r.ord.alias("ord"), r.size.alias("size"), r.text.alias("text"), r.space.alias("space")))))


def _lines(runs: DataFrame) -> DataFrame:
    """One row per visual line: y, size, segments (x0, x1) and runs from left to right."""
    line = Window.partitionBy(*PAGE, "line")
    across = line.orderBy("x", F.desc("y"), "ord")
    rows = runs.withColumn("end", F.col("x") + F.length("text") * F.col("size") * GLYPH)
    first = F.max(F.struct("y", (-F.col("x")).alias("x"), (-F.col("ord")).alias("ord"), "size")).over(line)
    rows = rows.withColumn("most", F.greatest(first.size, F.max(F.when(~F.col("space"), F.col("size"))).over(line)))
    before = F.max(F.when(~F.col("space"), F.col("end"))).over(across.rowsBetween(Window.unboundedPreceding, -1))
    opens = ~F.col("space") & (before.isNull() | (F.col("x") - before > GAP * F.col("most")))
    rows = rows.withColumn("opens", opens.cast("int")).withColumn("segment", F.sum("opens").over(across))
    own = F.struct("x", (-F.col("y")).alias("down"), "ord", "size", "text", "space", "end")
    parts = rows.groupBy(*PAGE, "single", "line", "segment").agg(F.max("y").alias("y"), F.max("most").alias("size"), F.min(F.when(~F.col("space"), F.col("x"))).alias("x0"), F.max(F.when(~F.col("space"), F.col("end"))).alias("x1"), F.collect_list(own).alias("runs"))
    segments = F.filter(F.sort_array(F.collect_list(F.struct("x0", "x1"))), lambda s: s.x0.isNotNull())
    return parts.groupBy(*PAGE, "single", "line").agg(F.max("y").alias("y"), F.max("size").alias("size"), segments.alias("segments"), F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"))


def _most_common(values: Column) -> Column:
    """(c, back, value): values within 2 of each other count together; of equal counts the first one stands."""
    return F.array_max(F.transform(values, lambda v, i: F.struct(F.size(F.filter(values, lambda w: F.abs(w - v) <= 2)).alias("c"), (-i).alias("back"), v.alias("value"))))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _median(values: Column) -> Column:
    return F.try_element_at(F.sort_array(values), F.floor(F.size(values) / 2).cast("int") + 1)


def _rounded(x: Column) -> Column:
    return F.round(x).cast("int")


def _margins(lines: DataFrame) -> DataFrame:
    """Lines of the pages that have a second margin, with it and the usual spacing."""
    above = F.lag("y").over(Window.partitionBy(*PAGE).orderBy("line"))
    rows = lines.withColumn("gap", above - F.col("y"))
    held = F.sort_array(F.collect_list(F.struct("line", "y", "size", "segments", "runs")))
    pages = rows.groupBy(*PAGE, "single").agg(held.alias("lines"), _median(F.collect_list("gap")).alias("spacing"))
    ends = F.flatten(F.col("lines.segments"))
    bounds = F.struct(F.array_min(F.transform(ends, lambda s: s.x0)).alias("low"), F.array_max(F.transform(ends, lambda s: s.x1)).alias("high"))
    later = lambda line: F.slice(line.segments, F.lit(2), F.greatest(F.size(line.segments) - 1, F.lit(0)))

    def starts(b: Column) -> Column:
        middle = lambda x: (x > 0.75 * b.low + 0.25 * b.high) & (x < 0.25 * b.low + 0.75 * b.high)
        return F.flatten(F.transform("lines", lambda line: F.array_distinct(F.filter(F.transform(later(line), lambda s: _rounded(s.x0)), middle))))

    pages = pages.withColumn("best", _let(bounds, lambda b: _let(starts(b), _most_common)))
    good = pages.filter((F.col("best.c") >= LINES) & (F.col("spacing") > 0))
    return good.select(*PAGE, "single", "spacing", (F.col("best.value") - 2).cast("double").alias("margin"), F.inline("lines"))


def _zoned(lines: DataFrame) -> DataFrame:
    """Lines with their halves and whether they belong to the columns: the lines around those with both halves, as far as the spacing is normal."""
    page = Window.partitionBy(*PAGE)
    down = page.orderBy("line")
    half = lambda left: F.filter("runs", lambda r: (r.x < F.col("margin")) if left else (r.x >= F.col("margin")))
    text = lambda runs: F.exists(runs, lambda r: ~r.space)
    rows = lines.select("*", half(True).alias("left"), half(False).alias("right"), F.exists("segments", lambda s: (s.x0 < F.col("margin")) & (s.x1 > F.col("margin") + 2 * F.col("size"))).alias("spans"))
    rows = rows.select("*", text("left").alias("on_left"), text("right").alias("on_right"))
    both = F.when(F.col("on_left") & F.col("on_right") & ~F.col("spans"), F.col("line"))
    limit = APART * F.col("spacing")
    top = F.coalesce((F.lag("y").over(down) - F.col("y") > limit) | F.lag("spans").over(down), F.lit(True))
    end = F.coalesce((F.col("y") - F.lead("y").over(down) > limit) | F.lead("spans").over(down), F.lit(True))
    rows = rows.select("*", F.min(both).over(page).alias("first"), F.max(both).over(page).alias("last"), top.alias("top"), end.alias("end"))
    low = F.max(F.when(F.col("top") & (F.col("line") <= F.col("first")), F.col("line"))).over(page)
    high = F.min(F.when(F.col("end") & (F.col("line") >= F.col("last")), F.col("line"))).over(page)
    return rows.withColumn("low", low).withColumn("high", high).withColumn("inside", F.col("line").between(F.col("low"), F.col("high")) & ~F.col("spans"))


def _joined(runs: Column, single: Column) -> Column:
    """The text of a line's runs: words part at pieces of spaces, or where there are none at gaps."""
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end"))

    def more(done: Column, r: Column, limit: Column) -> Column:
        open_ = (done.text != "") & ~done.text.rlike(r"(?U)\s$")
        gap = open_ & F.coalesce(r.x - done.end > limit * r.size, F.lit(False)) & ~r.text.rlike(r"(?U)^\s")
        text = F.concat(done.text, F.when(F.when(r.space, open_).otherwise(gap), " ").otherwise(""), F.when(r.space, "").otherwise(r.text))
        return F.struct(text.alias("text"), F.when(r.space, r.x).otherwise(r.end).alias("end"))

    part = F.when(single | F.exists(runs, lambda r: r.space), 0.8).otherwise(0.15)
    text = _let(part, lambda limit: F.aggregate(runs, start, lambda done, r: more(done, r, limit), lambda done: done.text))
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$", "")


def _running_text(texts: Column, starts: Column) -> Column:
    """Long lines, mostly of letters, that start at one margin."""
    whole = F.array_join(texts, "")
    letters, marks = F.regexp_count(whole, F.lit(r"\p{L}")), F.regexp_count(whole, F.lit(r"(?U)\S"))
    return (_median(F.transform(texts, lambda t: F.length(t))) >= CHARS) & (letters >= LETTERS * marks) & (_most_common(starts).c >= ALIGNED * F.size(starts))


def reading_order(runs: DataFrame) -> DataFrame:
    """doc_id, page_no and text of the pages whose two columns are written across: the left one, then the right one.

    ``runs``: doc_id, page_no, ord (place in the stream), x, y, size and text. Pages in one column, tables, printed
    contents and columns that the stream already has in order give no row. Lines that go across or stand apart keep
    their place; a blank line stands where the gap is wider than usual. Rows with a null in x, y or text play no part.
    A page is what meets in one task; its lines and runs are kept in one exchange.
    """
    rows = runs.select(*PAGE, "ord", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("size").cast("double").alias("size"), "text").filter("x is not null and y is not null and text <> ''")
    rows = rows.withColumn("size", F.coalesce("size", F.lit(10.0))).withColumn("space", F.col("text").rlike(_SPACES))
    lines = _zoned(_margins(_lines(_numbered(_upright(rows)))))
    outside = F.sum((~F.col("inside")).cast("int")).over(Window.partitionBy(*PAGE).orderBy("line"))
    lines = lines.withColumn("outside", outside)
    entry = lambda part, runs: F.struct(F.col("outside").alias("stretch"), F.lit(part).alias("part"), "line", "y", _joined(F.col(runs), F.col("single")).alias("text"))
    lines = lines.withColumn("l", F.when(F.col("inside") & F.col("on_left"), entry(1, "left"))).withColumn("r", F.when(F.col("inside") & F.col("on_right"), entry(2, "right")))
    lines = lines.withColumn("a", F.when(~F.col("inside"), entry(0, "runs")))
    first = lambda runs: _rounded(F.filter(runs, lambda r: ~r.space)[0].x)
    side = lambda runs, of: F.transform(F.filter(runs, lambda r: ~r.space), lambda r: F.struct(r.ord.alias("ord"), F.lit(of).alias("side")))
    close = F.exists("segments", lambda s: (s.x0 < F.col("margin")) & (s.x0 > F.col("margin") - GAP * F.col("size")))
    pages = lines.groupBy(*PAGE).agg(
        F.bool_or(F.col("inside") & close).alias("close"), F.max("spacing").alias("spacing"), F.collect_list("l").alias("l"), F.collect_list("r").alias("r"), F.collect_list("a").alias("a"),
        *(F.collect_list(F.when(F.col(entry).isNotNull(), first(runs))).alias(f"{entry}_starts") for entry, runs in (("l", "left"), ("r", "right"))),
        F.sort_array(F.flatten(F.collect_list(F.when(F.col("inside"), F.concat(side("left", 1), side("right", 2)))))).alias("stream"),
    )
    sides = F.col("stream.side")
    jumps = F.size(F.filter(F.transform(sides, lambda s, i: (i > 0) & (s != F.try_element_at(sides, i))), lambda x: x))
    good = ~F.col("close") & (jumps >= 2 * LINES) & _running_text(F.col("l.text"), F.col("l_starts")) & _running_text(F.col("r.text"), F.col("r_starts"))
    kept = pages.filter(good).select(*PAGE, "spacing", F.sort_array(F.concat("a", "l", "r")).alias("entries"))
    # The top of the right column goes on from the bottom of the left one.
    last = lambda i: F.try_element_at(F.col("entries"), i)
    blank = lambda e, i: (i > 0) & (last(i).y - e.y > PARAGRAPH * F.col("spacing")) & ~((e.part == 2) & ((last(i).part != 2) | (last(i).stretch != e.stretch)))
    return kept.select(*PAGE, F.array_join(F.flatten(F.transform("entries", lambda e, i: F.when(F.coalesce(blank(e, i), F.lit(False)), F.array(F.lit(""), e.text)).otherwise(F.array(e.text)))), "\n").alias("text"))
