"""Importance resampling of documents towards the distribution of a target table.

Features are all runs of 1 to ``most`` consecutive words, hashed into a fixed number of
buckets. A bucket's gain compares its share of the target's features with its share of the
documents'; a document's weight is the mean gain of its features, and a Gumbel noise that
depends on the seed and doc_id alone turns the highest scores into a draw without
replacement.

Overlapped regex scanning: bytes of a text that stand in no word become spaces and runs of
spaces one, with a space at each end. A pattern of k words that opens with the space before
them and looks ahead for the space behind them is then searched with ``overlapped=True``:
each match is one n-gram, and its bytes go to CRC-32 as they are. Every byte from 0x80 up
belongs to a word, so bytes and code points give the same words.

How the work is spread: texts are scanned once, and the buckets of their features written;
counts are summed in each task before they meet by bucket; gains (``buckets`` numbers,
whatever the input) go out to the tasks. Ranks come from one range exchange of narrow rows:
position in the partition plus the rows of earlier partitions.

Defined results: a null or empty text, or one without words, has no features and the weight
0; documents under ``least`` words count in the distribution and are never drawn; repeated
rows are documents of their own, ranked one behind the other; a row without doc_id has
neither noise nor score, counts in the distribution, and isn't among the documents drawn
from. An empty target has gains of a uniform distribution; an empty table gives no rows.
Other columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, buffers, names, table, texts

#: Letters A-Z in lower case, other ASCII characters that are no word characters as spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FEATURES = "doc_id long, n_words long, n_features long, found binary"


def runs_of(k: int) -> regex.Pattern:
    """Runs of ``k`` words in a text with single spaces around and between its words."""
    return regex.compile(rb" ([^ ]+(?: [^ ]+){%d})(?= )" % (k - 1))


def checksums(raw: bytes, patterns: list[regex.Pattern]) -> list[np.ndarray]:
    """CRC-32 of the n-grams of a text, one array for each pattern."""
    spaced = b" %b " % b" ".join(raw.translate(FOLD).split())
    return [np.fromiter((zlib.crc32(m[1]) for m in p.finditer(spaced, overlapped=True)), np.uint32) for p in patterns]


def _features(most: int, buckets: int):
    """Texts to the buckets of their features, in the fewest bytes that hold a bucket."""
    kind = np.min_scalar_type(buckets - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [runs_of(k + 1) for k in range(most)]
        for batch in batches:
            raw, ends = buffers(batch.column(1))
            found, words = [], []
            for low, high in zip(ends[:-1].tolist(), ends[1:].tolist()):
                sums = checksums(raw[low:high].tobytes(), patterns)
                words.append(len(sums[0]))
                found.append((np.concatenate(sums) % np.uint32(buckets)).astype(kind))
            sizes = pa.array([len(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), sizes, pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "n_words", "n_features", "found"])

    return run


def _counted(buckets: int):
    """Features of a task by bucket: one row for each bucket that it holds."""
    kind = np.min_scalar_type(buckets - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(buffers(batch.column(0))[0].view(kind), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "c"])

    return run


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket: ``buckets`` numbers, whatever the size of the table."""
    sums = features.select("found").mapInArrow(_counted(buckets), "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r.bucket] = r.c
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """1000 ln of the ratio of a bucket's smoothed shares, floored."""
    n, t_all, s_all = len(source), int(target.sum()), int(source.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for t, s in zip(target.tolist(), source.tolist())], np.int64)


def _weighed(gain: np.ndarray):
    kind = np.min_scalar_type(len(gain) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = buffers(batch.column(3))
            sums = np.r_[0, np.cumsum(gain[raw.view(kind)])][ends // np.dtype(kind).itemsize]
            weight = np.diff(sums) // np.maximum(batch.column(2).to_numpy(), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(seed: int) -> Column:
    """A Gumbel noise in thousandths, from the first 32 bits of SHA-256 over seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, most: int = 2, buckets: int = 10_000, percent: int = 25, least: int = 20, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score and rank.

    ``rank`` counts from 1 through the drawn documents, ``percent`` of those with ``least``
    words; it is null for the others. ``target`` has a column ``text``.
    """
    aimed = target.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        features = scratch.written(texts(docs).mapInArrow(_features(most, buckets), FEATURES), "features")
        gain = gains(bucket_counts(aimed.mapInArrow(_features(most, buckets), FEATURES), buckets), bucket_counts(features, buckets))
        scored = features.mapInArrow(_weighed(gain), "doc_id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise(seed))
        fit = (F.col("n_words") >= least) & F.col("doc_id").isNotNull()
        keyed = scored.select("*", fit.alias("fit"), F.monotonically_increasing_id().alias("at"))
        order = [F.desc("fit"), F.desc("score"), F.asc("doc_id"), F.asc("at")]
        placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("at").withColumn("place", F.monotonically_increasing_id())
        placed = scratch.written(placed, "placed", keep=True)
        # One row for each partition of the exchange.
        part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
        held = {r.part: (r.n, r.fit) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("fit").alias("fit")).collect()}
    before, rows = [], 0
    for k in sorted(held):
        before.append((k, rows))
        rows += held[k][0]
    drawn = percent * sum(n for _, n in held.values()) // 100  # of those fit
    first = docs.sparkSession.createDataFrame(before, "part long, before long")
    rank = F.col("before") + inside + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(first), "part")
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("fit") & (rank <= drawn), rank).alias("rank"))


def keep_drawn(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` draws, with all their columns; rows of one doc_id are drawn together."""
    drawn = resample(docs, target, **options).filter(F.col("rank").isNotNull()).select("doc_id").distinct()
    return docs.join(drawn, "doc_id", "left_semi").select(names(docs))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank in the draw of a quarter towards ``benchmark``."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op11_importance": op11_importance}
#: SQL of DuckDB has no CRC-32.
ORACLE_SQL: dict[str, str] = {}
