"""Removal of every byte that lies in a string of ``width`` bytes found elsewhere.

The suffixes of all texts are ordered by a depth-limited radix sort, most
significant digit first; a suffix counts only through its first ``width`` bytes,
and a group of suffixes that are still equal at that depth is exactly a repeated
window. A digit here is a content-defined piece of the window, so that a pass
moves far fewer rows than there are bytes, and every pass drops the groups that
already hold one suffix only:

1. *First digit*: the leftmost smallest hash among the window's 32-byte grams.
   Neighbouring windows share it, so a run of windows is one row.
2. *Second digit*: the text of the whole run. Equal runs are settled at once;
   a gram that stands before one run text only is settled as well.
3. *Third digit*: the core that 32 neighbouring windows share, then the text
   around it. Only one run of each text takes part.
4. *Last digit*: the remaining bytes left and right of the core, a row for each
   window, for cells whose core is shared by different texts.

No pass gathers a group in one place: all are counts with partial aggregation
and equi-joins, and a join of many rows has a written table on its other side, so
that a hot digit can be split. Only equality of digits matters for the groups, so the
buckets of a pass are dealt by hash and not put in order. Digits are 64-bit hashes (see
``RollingHash``) and are compared together with the digit before them, so that two
different runs are taken for one only if two hashes agree.

With ``narrow``, shorter repeats are measured as well: the sort first goes ``narrow``
bytes deep, and on to ``width`` only for windows whose ``narrow``-byte parts are all
repeated.

Defined results: a null or empty text has no bytes and keeps the hash of the
empty string; a text shorter than ``width`` keeps all its bytes; repeated rows
are each judged and returned, as copies of one another; other columns of the
input are ignored. Every copy of a repeated string goes, the first one too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RollingHash, Scratch, buffers, free_name, mixed, names, slices, table, texts

GRAM, CELL = 32, 32
#: Bytes of text hashed at once; it bounds the memory of a task, not the length of a text.
BLOCK = 1 << 19
_PLACE = np.uint64(24)

RUNS = "gram long, run long, start long, n int, back int"
CELLS = "gram long, run long, first int, core long, whole long, lead int, left binary, right binary"


def _runs(data: np.ndarray, ends: np.ndarray, width: int, hashes: RollingHash, allowed: np.ndarray | None):
    """(gram hash, run hash, start, windows, gram's place after start) of each run of (allowed) windows of one buffer."""
    span, windows = width - GRAM + 1, len(data) - width + 1
    if windows < 1:
        return None
    sums, grams = hashes.prefix(data), len(data) - GRAM + 1
    gram = mixed((sums[GRAM:] - sums[:grams]) * hashes.down[:grams])
    # The place in the low bits makes the smallest hash the leftmost one too.
    order = (gram >> _PLACE << _PLACE) | np.arange(grams, dtype=np.uint64)
    blocks = np.full(-(-grams // span) * span, ~np.uint64(0))
    blocks[:grams] = order
    blocks = blocks.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    inside = np.zeros(windows + 1, np.int64)
    first, last = ends[:-1], np.maximum(ends[1:] - width + 1, ends[:-1])
    some = last > first
    np.add.at(inside, first[some], 1)
    np.add.at(inside, last[some], -1)
    inside = np.cumsum(inside[:windows]) > 0
    start = np.flatnonzero(inside if allowed is None else inside & allowed[:windows])
    if not len(start):
        return None
    cut = np.flatnonzero((np.diff(place[start]) != 0) | (np.diff(start) != 1)) + 1
    lo, hi = start[np.r_[0, cut]], start[np.r_[cut - 1, len(start) - 1]]
    return gram[place[lo]], hashes.of(sums, lo, hi + width), lo, hi - lo + 1, place[lo] - lo


def _pieces(batch: pa.RecordBatch, width: int, block: int):
    """(first and last byte of a piece, ends inside it, row numbers, offset of its first byte in its text): whole short texts together, long texts in overlapping blocks."""
    _, ends = buffers(batch.column(1))
    if ends[-1] <= 2 * block:
        yield 0, int(ends[-1]), ends, np.arange(batch.num_rows), 0
        return
    for i in range(batch.num_rows):
        for at in range(int(ends[i]), max(int(ends[i]) + 1, int(ends[i + 1]) - width + 1), block):
            to = min(at + block + width - 1, int(ends[i + 1]))
            yield at, to, np.array([0, to - at]), np.array([i]), at - int(ends[i])


def _find_runs(width: int, block: int, narrow: int | None = None):
    """Rows (row, text) to runs; with ``narrow``, rows (row, text, spans of that width) to runs of windows whose narrow windows are all repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RollingHash(2 * block + width)
        for batch in slices(batches, "text", block):
            rows, allowed = batch.column(0), None
            data, ends = buffers(batch.column(1))
            if narrow:
                allowed = np.concatenate([np.zeros(0, bool), *(_deep(int(n), s, width - narrow + 1) for n, s in zip(np.diff(ends), batch.column(2)))])
            for at, to, own, numbers, shift in _pieces(batch, width, block):
                if (found := _runs(data[at:to], own, width, hashes, None if allowed is None else allowed[at:to])) is None:
                    continue
                gram, run, lo, n, back = found
                which = np.searchsorted(own, lo, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [rows.take(pa.array(numbers[which])), pa.array(gram.view(np.int64)), pa.array(run.view(np.int64)), pa.array(lo - own[which] + shift), pa.array(n.astype(np.int32)), pa.array(back.astype(np.int32))],
                    ["row", "gram", "run", "start", "n", "back"],
                )

    return run


def _deep(size: int, spans: pa.ListScalar, depth: int) -> np.ndarray:
    """Which places of a text start ``depth`` repeated windows in a row."""
    out = np.zeros(size, bool)
    if spans.is_valid and size >= depth:
        before = np.r_[0, np.cumsum(_starts(size, spans.values))]
        out[: size - depth + 1] = before[depth:] - before[: size - depth + 1] == depth
    return out


def _cut_cells(width: int, block: int):
    """Rows of (text, runs to look into) to cells of ``CELL`` window starts at fixed places before the gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RollingHash(2 * block + 4 * width)
        for batch in slices(batches, "text", block):
            data, ends = buffers(batch.column(0))
            lists = batch.column(1)
            flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
            home = np.repeat(ends[:-1], counts)
            gram, run_, start, n, back = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("gram", "run", "start", "n", "back"))
            order = np.argsort(home + start, kind="stable")
            at, gram, run_, n, back = (home + start)[order], gram[order], run_[order], n[order], back[order]
            for low in range(0, len(data), block):
                some = slice(*np.searchsorted(at, [low, low + block]))
                if some.start == some.stop:
                    continue
                lo, size, gram_at = at[some] - low, n[some], at[some] - low + back[some]
                part = data[low : low + block + 2 * width]
                sums = hashes.prefix(part)
                # Windows start at gram_at - o for offsets o of the run; cell i has o // CELL == i.
                most, least = gram_at - lo, gram_at - lo - size + 1
                cells = most // CELL - least // CELL + 1
                of = np.repeat(np.arange(len(lo)), cells)
                i = least[of] // CELL + np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
                o1, o2 = np.maximum(least[of], i * CELL), np.minimum(most[of], i * CELL + CELL - 1)
                a = gram_at[of]
                core_from, core_to = a - i * CELL, a - i * CELL - CELL + 1 + width
                text_from, text_to = a - o2, a - o1 + width
                core = hashes.of(sums, core_from, core_to)
                whole = mixed(hashes.of(sums, text_from, text_to) + ((o2 - i * CELL) * CELL + (o1 - i * CELL)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                raw = part.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram[some][of]), pa.array(run_[some][of]), pa.array((text_from - lo[of]).astype(np.int32)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array((o2 - i * CELL).astype(np.int32)),
                        pa.array([raw[x:y] for x, y in zip(text_from, core_from)], pa.binary()), pa.array([raw[x:y] for x, y in zip(core_to, text_to)], pa.binary()),
                    ],
                    ["gram", "run", "first", "core", "whole", "lead", "left", "right"],
                )

    return run


def _unsettled(scratch: Scratch, df: DataFrame, digit: str, text: str) -> DataFrame:
    """Rows whose ``digit`` stands more than once; ``open`` tells whether different values of ``text`` share it.

    Where they do not, all rows of the digit are equal, and settled. The groups are written
    first: a join whose two sides both come from a shuffle can split a hot digit.
    """
    groups = df.groupBy(digit).agg(F.count("*").alias("_n"), F.min(text).alias("_a"), F.max(text).alias("_b")).filter("_n > 1")
    return df.join(scratch.written(groups.select(digit, F.expr("_a < _b").alias("open")), "groups"), digit)


def repeated_spans(docs: DataFrame, width: int = 400, block: int = BLOCK, narrow: int | None = None) -> DataFrame:
    """(row, spans) for rows of ``docs`` (row, text) with repeated windows; a span is (start, cells (first, n, bits)).

    With ``narrow``, ``docs`` has a third column: the spans of that width. Each pass is written to
    the shared folder and its inputs are dropped, so that the disk holds about one pass at a time.
    """
    with Scratch(docs.sparkSession) as scratch:
        columns = f"row {docs.schema['row'].dataType.simpleString()}, {RUNS}"
        runs = scratch.written(docs.mapInArrow(_find_runs(width, block, narrow), columns), "runs")
        kept = scratch.written(_unsettled(scratch, runs, "gram", "run"), "kept")
        scratch.drop(runs)
        kinds = kept.filter("open").groupBy("gram", "run").agg(F.count("*").alias("copies"), F.min(F.struct("row", "start", "n", "back")).alias("one"))
        # A text has no more runs than bytes; a set, since repeated rows bring the same ones.
        todo = kinds.select("gram", "run", "one.*").groupBy("row").agg(F.collect_set(F.struct("gram", "run", "start", "n", "back")).alias("runs"))
        found = docs.select("row", "text").join(todo, "row").select("text", "runs").mapInArrow(_cut_cells(width, block), CELLS)
        every = scratch.written(found, "every")
        n = F.col("lead") + 2 - CELL + F.length("right")
        cells = scratch.written(_unsettled(scratch, every, "core", "whole").select("gram", "run", "first", n.alias("n"), "whole", "core", "lead", *(F.when(F.col("open"), F.col(c)).alias(c) for c in ("left", "right")), "open"), "cells")
        scratch.drop(every)

        wholes = cells.filter("open").groupBy("core", "whole").agg(F.count("*").alias("copies"), F.first(F.struct("lead", "left", "right")).alias("one")).select("core", "whole", "copies", "one.*")
        # A window t bytes before the core takes the last t bytes on its left and the first CELL - 1 - t on its right.
        windows = wholes.withColumn("t", F.explode(F.sequence(F.lit(CELL - 1) - F.length("right"), F.col("lead")))).select(
            "core", "whole", (F.col("lead") - F.col("t")).alias("bit"),
            F.xxhash64("t", F.expr("substring(left, length(left) - t + 1, t)"), F.expr(f"substring(right, 1, {CELL - 1} - t)")).alias("window"),
        )
        again = windows.groupBy("core", "window").agg(F.min("whole").alias("_a"), F.max("whole").alias("_b")).filter("_a < _b").select("core", "window")
        some = windows.join(again, ["core", "window"], "left_semi").groupBy("core", "whole").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        full = F.lit(-1).cast("long")
        settled = wholes.select("core", "whole", "copies").join(some, ["core", "whole"], "left").select("core", "whole", F.when(F.col("copies") > 1, full).otherwise(F.col("bits")).alias("bits")).filter("bits is not null")
        open_cells = cells.filter("open").select("gram", "run", "first", "n", "core", "whole").join(scratch.written(settled, "settled"), ["core", "whole"]).drop("core", "whole")
        hits = cells.filter("not open").select("gram", "run", "first", "n", full.alias("bits")).unionByName(open_cells)
        partly = hits.groupBy("gram", "run").agg(F.collect_set(F.struct("first", "n", "bits")).alias("cells"))
        verdict = kinds.select("gram", "run", "copies").join(partly, ["gram", "run"], "left").filter("copies > 1 or cells is not null").select("gram", "run", F.when(F.col("copies") == 1, F.col("cells")).alias("cells"))
        judged = kept.filter("open").select("row", "gram", "run", "start", "n").join(scratch.written(verdict, "verdict"), ["gram", "run"]).drop("gram", "run")
        spans = judged.unionByName(kept.filter("not open").select("row", "start", "n"), allowMissingColumns=True)
        whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n"), full.alias("bits")))
        return scratch.written(spans.groupBy("row").agg(F.collect_set(F.struct("start", F.coalesce("cells", whole).alias("cells"))).alias("spans")), "spans", keep=True)


def _starts(size: int, spans: pa.Array) -> np.ndarray:
    """True where a repeated window of a text of ``size`` bytes starts."""
    start, cells = spans.field("start").to_numpy(), spans.field("cells")
    base = np.repeat(start, np.diff(cells.offsets.to_numpy()))
    flat = cells.flatten()
    first, n, bits = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("first", "n", "bits"))
    begin, whole, step = base + first, bits == -1, np.zeros(size + 1, np.int32)
    np.add.at(step, begin[whole], 1)
    np.add.at(step, begin[whole] + n[whole], -1)
    out = np.cumsum(step[:size]) > 0
    if not whole.all():
        place = np.arange(CELL)
        row, j = np.nonzero(((bits[~whole][:, None] >> place) & 1 == 1) & (place < n[~whole][:, None]))
        out[begin[~whole][row] + j] = True
    return out


def _covered(size: int, spans: pa.ListScalar, width: int) -> np.ndarray | None:
    """True for each byte of a text of ``size`` bytes that a repeated window covers; None if there is none."""
    if not spans.is_valid:
        return None
    before = np.r_[0, np.cumsum(_starts(size, spans.values))]
    return before[1:] > before[np.maximum(np.arange(1, size + 1) - width, 0)]


def _remove(width: int, narrow: int | None):
    """Rows (doc_id, text, spans, narrow spans) to the sizes and the hash of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 * BLOCK):
            data, ends = buffers(batch.column(1))
            out = []
            for i, (text, own) in enumerate(_left(data, ends, batch.column(2), width)):
                n = int(np.count_nonzero(np.diff(np.r_[False, own].astype(np.int8)) == 1)) if own is not None else 0
                kept = text if own is None else text[~own]
                short = _covered(len(text), batch.column(3)[i], narrow) if narrow else own
                out.append((len(text), len(text) - len(kept), n, hashlib.sha256(kept.tobytes()).hexdigest(), 0 if short is None else int(np.count_nonzero(short))))
            columns = list(zip(*out)) if out else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.int64())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"],
            )

    return run


def _left(data: np.ndarray, ends: np.ndarray, spans: pa.Array, width: int):
    """(bytes, removed bytes or None) of each text."""
    for i in range(len(ends) - 1):
        text = data[ends[i] : ends[i + 1]]
        yield text, _covered(len(text), spans[i], width)


def _shorten(width: int):
    """Rows with ``text`` and, last, the spans to rows with the text that is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 * BLOCK):
            at = batch.schema.get_field_index("text")
            data, ends = buffers(batch.column(at))
            kept = [(text if own is None else text[~own]).tobytes().decode("utf-8", "ignore") for text, own in _left(data, ends, batch.column(batch.num_columns - 1), width)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return run


def row_key() -> Column:
    """What names a row: its id and a hash of id and text."""
    return F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("doc_id", "text").alias("hash"))


def remove_repeats(docs: DataFrame, width: int = 400, block: int = BLOCK, narrow: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, the SHA-256 of the bytes left, and n_repeated.

    n_repeated counts the bytes in strings of ``narrow`` bytes (``width``, if that is not given) that
    start anywhere else as well; no byte is removed for it.
    """
    keyed = texts(docs.select("doc_id", "text")).withColumn("row", row_key())
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long"
    if not narrow:
        found = repeated_spans(keyed.select("row", "text"), width, block)
        return keyed.join(found, "row", "left").select("doc_id", "text", "spans").mapInArrow(_remove(width, None), result)
    with Scratch(docs.sparkSession) as scratch:
        short = repeated_spans(keyed.select("row", "text"), narrow, block).withColumnRenamed("spans", "short")
        joined = scratch.written(keyed.join(short, "row", "left"), "joined")
        scratch.drop()
        some = joined.filter("short is not null")
        found = repeated_spans(some.select("row", "text", "short"), width, block, narrow)
        deep = some.join(found, "row", "left").select("doc_id", "text", "spans", "short")
        plain = joined.filter("short is null").select("doc_id", "text", F.lit(None).cast(found.schema["spans"].dataType).alias("spans"), "short")
        return scratch.written(plain.unionByName(deep).mapInArrow(_remove(width, narrow), result), "kept", keep=True)


def without_repeats(docs: DataFrame, width: int = 400, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, with all their columns, and the text that is left (a null text comes back empty).

    Code points that a cut breaks go with it. Nothing of a repeated string stays in the corpus.
    """
    rows, own, spans = texts(docs, *names(docs, "doc_id", "text")), free_name(docs, "row"), free_name(docs, "spans")
    keyed = rows.withColumn(own, row_key())
    found = repeated_spans(keyed.select(F.col(own).alias("row"), "text"), width, block)
    joined = keyed.join(found.select(F.col("row").alias(own), F.col("spans").alias(spans)), own, "left").select(*names(rows), spans)
    return joined.mapInArrow(_shorten(width), rows.schema).select(names(docs))


#: Bytes of the strings that ``n_repeated`` counts in op1_suffix_dedup: about 50 short words.
NARROW = 250


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document in strings of 400 that stand elsewhere too: how many go, in how many runs, and what is left."""
    return remove_repeats(table(spark, sf_dir, "documents"), 400, narrow=NARROW)


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
