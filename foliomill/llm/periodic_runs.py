"""Maximal periodic runs of words in documents, and texts without their repetitions.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and
length of at least ``times`` q and ``least``, that no neighbouring word extends. In terms of
places i with word i = word i+q, a run is a maximal interval of (times - 1) q of them or more.

Scale-tiled distribution: octave o holds the periods from 2^o to 2^(o+1) - 1. Each document
is exploded into overlapping tiles for each octave (one tile for all octaves that see it
whole), and tiles are dealt out evenly. A tile is solved on its own: boundaries stand every
(times - 1) 2^o words of its core, so that every run has one inside. The Z-function of a
boundary b gives, for each period q, how far the words from b on equal those from b+q on,
and how far they do so backwards; together they are the interval of places around b, cut off
at a reach of (times - 1) 2^(o+1). What is cut off is longer than any run has to be, so
intervals that are too short are no part of one, and a period that a proper divisor explains
isn't the smallest. Fragments meet by document and period, and touching ones are one run.

Z-values come from prefix sums of word hashes, for all boundaries of the tiles that a task
holds at once; every fragment is compared word by word before it leaves its tile.

How the work is spread: an octave costs a look at each third word and a logarithmic search
where two words are equal, whatever the period; only fragments of runs and, to cut them out,
texts are shuffled.

Defined results: a null or empty text, or one without words, has no runs and nothing left;
repeated rows have the same runs each; a null doc_id is a document like any other. An empty
table gives no rows. Other columns play no part; :func:`collapse` keeps them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import RollingHash, Scratch, buffers, free_name, mixed, names, slices, table, texts, word_hashes

#: Words of a tile's core, which is at least ``WIDE`` times its reach; words of the tiles that are solved together.
TILE, WIDE, TOGETHER = 8_192, 16, 1 << 17
TILES = "row long, low int, high int, most long, at long, first long, core_from long, core_to long, words binary"
FRAGMENTS = "row long, period long, first long, last long"


def tiles_of(n: int, times: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(lowest, highest octave, tile from, to, core from, to) of a document of ``n`` words."""
    top = (n // times).bit_length() - 1
    low = 0
    while low <= top:
        # Octaves of one tiling go together.
        core = max(TILE, WIDE * ((times - 1) << (low + 1)))
        high = low
        while high < top and (n <= core or WIDE * ((times - 1) << (high + 2)) <= core):
            high += 1
        reach = (times - 1) << (high + 1)
        for at in range(0, n, core):
            yield low, high, max(0, at - reach), min(n, at + core + reach + (2 << high)), at, min(n, at + core)
        low = high + 1


def _tiles(times: int):
    """Texts to tiles; words are numbered within their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RollingHash(1 << 20)
        for batch in slices(batches, "text", 1 << 20):
            data, ends = buffers(batch.column(1))
            words, starts, _ = word_hashes(np.insert(data, ends[1:], 32), hashes, lower=False)
            cut = np.searchsorted(starts, ends + np.arange(len(ends))).tolist()
            rows = []
            for row, low, high in zip(batch.column(0).to_pylist(), cut[:-1], cut[1:]):
                if high - low < times:
                    continue
                known, own = np.unique(words[low:high], return_inverse=True)
                own = own.astype(np.min_scalar_type(len(known)))
                most = (high - low) // times
                rows += [(row, a, b, most, own.itemsize, f, c, d, own[f:t].tobytes()) for a, b, f, t, c, d in tiles_of(high - low, times)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()])], ["row", "low", "high", "most", "at", "first", "core_from", "core_to", "words"])

    return run


class Tiles:
    """Words of tiles end to end, and how far stretches of them are equal."""

    def __init__(self, rows: list[dict], hashes: RollingHash):
        self.words = np.concatenate([np.frombuffer(r["words"], f"u{r['at']}").astype(np.int64) for r in rows])
        self.hashes = hashes
        size = np.array([len(r["words"]) // r["at"] for r in rows])
        self.stop = np.cumsum(size)
        self.start = self.stop - size
        self.first, self.core_from, self.core_to, self.most, self.low, self.high = (np.array([r[k] for r in rows], np.int64) for k in ("first", "core_from", "core_to", "most", "low", "high"))
        words = self.words
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mixed(words.view(np.uint64) + np.uint64(1)) * hashes.up[: len(words)], out=self.sums[1:])

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Whether the ``size`` words from a and from b on are equal."""
        return self.hashes.of(self.sums, a, a + size) == self.hashes.of(self.sums, b, b + size)

    def z(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from a and from b on are equal (``back``: before a and before b), ``most`` at most."""
        out, step = np.zeros(len(a), np.int64), 1
        open_ = np.flatnonzero(most > 0)
        # Double the step while words agree, then halve it.
        steps = []
        while len(open_):
            steps.append(step)
            open_ = self._step(out, a, b, most, step, open_, back)
            open_, step = open_[out[open_] < most[open_]], step * 2
        for step in reversed(steps):
            self._step(out, a, b, most, step, np.flatnonzero(out > 0), back)
        return out

    def _step(self, out: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int, some: np.ndarray, back: bool) -> np.ndarray:
        """Moves those of ``some`` on by ``step`` whose next words agree, and returns them."""
        some = some[out[some] + step <= most[some]]
        low, high = (x[some] - out[some] - step if back else x[some] + out[some] for x in (a, b))
        some = some[self.same(low, high, step)]
        out[some] += step
        return some

    def intervals(self, octave: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(period, from, to) of the fragments around the boundaries in the cores of all tiles of an octave, as places in ``words``."""
        stride, tiles = (times - 1) << octave, np.flatnonzero((self.low <= octave) & (octave <= self.high))
        mark = -(-self.core_from[tiles] // stride) * stride
        many = np.maximum(0, -(-(self.core_to[tiles] - mark) // stride))
        tile = np.repeat(tiles, many)
        marks = np.repeat(mark - self.first[tiles] + self.start[tiles] - (np.cumsum(many) - many) * stride, many) + np.arange(len(tile)) * stride
        periods = np.arange(1 << octave, min(int(self.most[tiles].max(initial=0)) + 1, 2 << octave))
        beyond = np.r_[self.words, np.full(2 << octave, -1)]
        where, which = np.nonzero(beyond[np.add.outer(marks, periods)] == beyond[marks, None])
        inside = (periods[which] <= self.most[tile[where]]) & (marks[where] + periods[which] < self.stop[tile[where]])
        at, q, tile = marks[where[inside]], periods[which[inside]], tile[where[inside]]
        ahead = self.z(at, at + q, np.minimum(2 * stride, self.stop[tile] - at - q))
        behind = self.z(at, at + q, np.minimum(2 * stride, at - self.start[tile]), back=True)
        long = np.flatnonzero(ahead + behind >= (times - 1) * q)
        q, low, high = q[long], (at - behind)[long], (at + ahead)[long]
        own = self.smallest(q, low, high)
        return q[own], low[own], high[own]

    def fragments(self, times: int) -> Iterator[tuple[int, int, int, int]]:
        """(tile, period, from, to) of all fragments, as word numbers of the documents."""
        for octave in range(int(self.low.min()), int(self.high.max()) + 1):
            for q, low, high in merged(*self.intervals(octave, times)):
                tile = int(np.searchsorted(self.stop, low, "right"))
                moved = int(self.first[tile] - self.start[tile])
                for a, b in self.compared(q, low, high):
                    yield tile, q, a + moved, b + moved

    def smallest(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether no period q / r explains the words from low to high + q, r being the primes of q."""
        out, rest, r = np.ones(len(q), bool), q.copy(), 2
        while len(q) and r * r <= rest.max():
            if (hit := np.flatnonzero(rest % r == 0)).size:
                self._explained(out, q, low, high, hit, r)
                while (hit := hit[rest[hit] % r == 0]).size:
                    rest[hit] //= r
            r += 1
        left = np.flatnonzero(rest > 1)
        self._explained(out, q, low, high, left, rest[left])
        return out

    def _explained(self, out: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, some: np.ndarray, r: np.ndarray | int) -> None:
        p = q[some] // r
        out[some] &= ~self.same(low[some], low[some] + p, high[some] + q[some] - p - low[some])

    def compared(self, q: int, low: int, high: int) -> Iterator[tuple[int, int]]:
        """The interval itself, or the parts of it in which words are equal indeed."""
        equal = self.words[low:high] == self.words[low + q : high + q]
        edge = np.flatnonzero(np.diff(np.r_[False, equal, False].astype(np.int8)))
        yield from zip((edge[::2] + low).tolist(), (edge[1::2] + low).tolist())


def merged(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Intervals of one period that touch, put together."""
    last = None
    for k in np.lexsort((low, q)).tolist():
        if last and last[0] == q[k] and low[k] <= last[2]:
            last[2] = max(last[2], int(high[k]))
        else:
            if last:
                yield tuple(last)
            last = [int(q[k]), int(low[k]), int(high[k])]
    if last:
        yield tuple(last)


def _solve(times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RollingHash(2 * TOGETHER)
        for batch in batches:
            rows, found = batch.to_pylist(), []
            ends = np.cumsum([len(r["words"]) // r["at"] for r in rows])
            for k in np.unique(ends // TOGETHER):
                some = [rows[i] for i in np.flatnonzero(ends // TOGETHER == k)]
                size = sum(len(r["words"]) // r["at"] for r in some)
                if size >= hashes.up.size:
                    hashes = RollingHash(2 * size)
                found += [(some[tile]["row"], *x) for tile, *x in Tiles(some, hashes).fragments(times)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(4)], ["row", "period", "first", "last"])

    return run


def fragments(rows: DataFrame, times: int) -> DataFrame:
    """Fragments (row, period, first, last) of the runs of ``rows`` (row, text), as intervals of places whose word is found a period on."""
    return rows.select("row", "text").mapInArrow(_tiles(times), TILES).repartition("row", "low", "first").mapInArrow(_solve(times), FRAGMENTS)


def stitched(found: DataFrame, least: int, times: int) -> DataFrame:
    """Fragments that touch put together: row, start, length and period of each run."""
    of = Window.partitionBy("row", "period").orderBy("first", "last")
    apart = F.col("first") > F.max("last").over(of.rowsBetween(Window.unboundedPreceding, -1))
    numbered = found.distinct().withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("run", F.sum("apart").over(of))
    whole = numbered.groupBy("row", "period", "run").agg(F.min("first").alias("start"), F.max("last").alias("last"))
    return whole.select("row", "start", (F.col("last") - F.col("start") + F.col("period")).alias("length"), "period").filter(F.col("length") >= F.greatest(F.lit(least), times * F.col("period")))


def find_runs(rows: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """One row per run of ``rows`` (row, text): row, start, length and period."""
    return stitched(fragments(rows, times), least, times)


def _kept(text: bytes, runs: list[dict]) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    words = text.split()
    if runs:
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, [r["start"] + r["period"] for r in runs], 1)
        np.add.at(edges, [r["start"] + r["length"] for r in runs], -1)
        words = compress(words, np.cumsum(edges[:-1]) == 0)
    return b" ".join(words)


def _collapsed(text: pa.Array, runs: pa.Array) -> pa.Array:
    return pa.array([_kept(t.as_buffer().to_pybytes() if t.is_valid else b"", r.as_py() or []).decode() for t, r in zip(text, runs)], pa.string())


def with_runs(docs: DataFrame, row: str, runs: str, least: int, times: int) -> DataFrame:
    """``docs`` with a column ``runs``: (start, period, length) of each run by start and period; null without runs."""
    keyed = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.written(fragments(texts(docs).select(F.xxhash64("doc_id", "text").alias("row"), "text"), times), "fragments")
        lists = scratch.written(stitched(found, least, times).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs")), "runs", keep=True)
    # Lists grow with the documents, so they are never sent out whole.
    return keyed.join(lists.select(F.col("row").alias(row), F.col("runs").alias(runs)).hint("merge"), row, "left")


def collapse(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """``docs`` with each run cut down to its first period; texts with runs have single spaces between their words."""
    row, runs = free_name(docs, "row"), free_name(docs, "runs")
    cut = F.arrow_udf(_collapsed, "string")(F.col("text").cast("string"), F.col(runs))
    own = with_runs(docs, row, runs, least, times)
    return own.withColumn("text", F.when(F.col(runs).isNotNull(), cut).otherwise(F.col("text"))).select(names(docs))


def run_report(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """One row per document: doc_id, n_runs, the longest run (start, length, period, exponent_milli), digests of all runs and of the collapsed text, and the runs."""
    held = with_runs(texts(docs), "row", "runs", least, times).withColumn("runs", F.coalesce("runs", F.expr("array()").cast("array<struct<start:long,period:long,length:long>>")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))))
    left = F.arrow_udf(_collapsed, "string")("text", "runs")
    return held.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(left.cast("binary"), 256).alias("collapsed_sha256"), "runs").select(
        "doc_id", "n_runs", (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"), F.expr("1000 * top.length div -top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "runs"
    )


def _repeating(doc_id: pa.Array, text: pa.Array) -> pa.Array:
    """Texts in which every tenth document, by CRC-32 of its doc_id, repeats its words from a place on with a period, both from the same CRC-32."""
    out = []
    for d, t in zip(doc_id.to_pylist(), text.to_pylist()):
        h = zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and (words := t.encode().split()):
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = b" ".join(words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]).decode()
        out.append(t)
    return pa.array(out, pa.string())


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of six words and four periods in every document, of which a tenth are made to repeat."""
    docs = texts(table(spark, sf_dir, "documents"))
    planted = docs.select("doc_id", F.arrow_udf(_repeating, "string")("doc_id", "text").alias("text"))
    return run_report(planted).drop("runs")


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
#: SQL has no Z-function; a text has too many pairs of words for a join.
ORACLE_SQL: dict[str, str] = {}
