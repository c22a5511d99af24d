"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python's ``[^\x20\x09-\x0D]+``, the word pattern of the query contracts.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is missing, as in local tests, a temporary folder is made and set; on a cluster no folder
    of one machine can stand in for it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master) and not spark.sparkContext.getCheckpointDir():
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables in the shared folder for the passes of one job.

    A written table cuts lineage, and a lost executor costs nothing. ``drop`` removes a table
    that no later pass reads and lets Spark clean up the shuffle files behind it; what is left
    goes at the end, but for tables written with ``keep``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop(*list(self.paths))

    def written(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if not keep:
            self.paths[out] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(df))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()  # shuffle files stay on disk until the driver collects the plans that made them


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back."""
    return Scratch(df.sparkSession).written(df, name, keep=True)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) and the named columns, whatever else the table carries.

    Texts are long rows: Arrow batches are kept to BATCH_ROWS of them.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def names(docs: DataFrame, *but: str) -> list[str]:
    """The columns of ``docs`` without ``but``, quoted."""
    return [f"`{c.replace('`', '``')}`" for c in docs.columns if c.lower() not in but]


def free_name(docs: DataFrame, wish: str) -> str:
    """``wish``, or ``wish`` with more underscores, so that ``docs`` has no such column."""
    while wish.lower() in map(str.lower, docs.columns):
        wish += "_"
    return wish


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(ends):
        ends = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        _, ends = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def held_out(modulus: int, remainder: int):
    """crc32 of doc_id as text modulo ``modulus`` equals ``remainder``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


class RollingHash:
    """64-bit polynomial hashes of any byte range of a buffer, by prefix sums.

    Byte values pass through a table of random odd words, so that no two texts
    that differ in a few bytes can be told apart only by luck.
    """

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.words = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1, 2**61)) * 8 + 5
        self.base, self.inverse = base % 2**64, pow(base, -1, 2**64)
        self.up, self.down = self._powers(self.base, size), self._powers(self.inverse, size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.words[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit words (a finalizer with fixed odd multipliers)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


#: True at the white space of the word pattern.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, hashes: RollingHash, lower: bool = True, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of a UTF-8 buffer; long buffers go through in blocks cut at white space, however far that is."""
    found, starts, stops, at = [], [], [], 0
    while at < len(data):
        end = min(at + block, len(data))
        while end < len(data) and not SPACE[data[end - 1]]:
            gap = np.flatnonzero(SPACE[data[end : end + 4096]])
            end = min(end + (int(gap[0]) + 1 if len(gap) else 4096), len(data))
        part = data[at:end]
        edge = np.diff(np.r_[True, SPACE[part], True].astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        own = hashes if len(part) < hashes.up.size else RollingHash(len(part))
        sums = own.prefix(LOWER[part] if lower else part)
        found.append(own.of(sums, first, last))
        starts.append(first + at)
        stops.append(last + at)
        at = end
    none = np.zeros(0, np.int64)
    return np.concatenate(found or [none.astype(np.uint64)]), np.concatenate(starts or [none]), np.concatenate(stops or [none])


class IdMemory:
    """Ids of words by the words' hashes; a task that has seen ``most`` words starts anew."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def unknown(self, keys: np.ndarray) -> np.ndarray:
        """Which of the ascending ``keys`` have to be added; all of them once the memory is full."""
        if len(self.keys) > self.most:
            self.forget()
        if not len(self.keys):
            return np.ones(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """``ids`` end to end, ``size`` of them for each of the ascending new ``keys``."""
        place = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, place, len(self.ids) + np.cumsum(size) - size)
        self.keys, self.size, self.ids = np.insert(self.keys, place, keys), np.insert(self.size, place, size), np.concatenate([self.ids, ids.astype(np.int32)])

    def spell(self, names: np.ndarray, which: np.ndarray, of: np.ndarray, texts: int, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets); word i is names[which[i]] and stands in text of[i]; ``end`` closes every text."""
        if not len(which):
            closed = np.full(texts if end is not None else 0, end or 0, np.int32)
            return closed, np.arange(texts + 1) * (end is not None)
        place = np.searchsorted(self.keys, names)
        size, source = self.size[place][which], self.at[place][which]
        total = np.bincount(of, size, texts).astype(np.int64) + (end is not None)
        offsets = np.r_[0, np.cumsum(total)]
        out = np.full(offsets[-1], end or 0, np.int32)
        low = np.cumsum(size) - size
        spread = np.arange(int(size.sum())) - np.repeat(low, size)
        out[np.repeat(low + of * (end is not None), size) + spread] = self.ids[np.repeat(source, size) + spread]
        return out, offsets


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b), the component named by its smallest node.

    Large-star and small-star rounds: every step is a minimum by key and an equi-join,
    so that no neighbourhood is ever collected, and the number of rounds is logarithmic.
    """
    turned = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    stars, seen = scratch.written(turned, "stars"), None
    while True:
        state = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen or not state[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        stars = scratch.written(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "stars")
