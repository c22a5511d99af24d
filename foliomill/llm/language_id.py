"""Language identification by rank-order profiles.

A profile is the ranked list of the most frequent 1- to 3-grams of a language's letters;
a document's own ranked list is compared with each by the out-of-place distance: the sum of
rank differences, a missing n-gram costing the length of the profile.

Profiles come from at most ``sample`` labelled rows of each language (chosen by a hash of the row), so
that a rare language has one too, and of at most ``LANGUAGES`` languages, those with most labelled rows,
which is the size of the model. Every document is judged by its whole text. Ties between n-grams go by
the n-gram, ties between languages by the name.

Defined results: a null text, or one without a letter, is ``und`` with score 0; if no row can
be learned from, every document is ``und``; repeated rows each get a row, and are learned once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, names, slices, table, texts

PROFILE = 400
#: Labelled rows of a language that its profile is learned from, and the parts that a language's rows are dealt into to find them.
SAMPLE, SALTS = 2_000, 64
#: Languages whose bounds are sent to every task; more of them are joined in parts.
SENT = 50_000


@cache
def _letters() -> np.ndarray:
    """Code point to itself if it is a letter, else to a space."""
    return np.array([i if unicodedata.category(chr(i))[0] == "L" else 32 for i in range(0x110000)], np.uint32)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, count) of the lower-cased letters of a text; an n-gram is 21 bits for each code point."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not len(codes) or (codes == 32).all():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.r_[32, codes, 32].astype(np.uint64)
    keep = np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]
    c = codes[keep]
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    return np.unique(np.concatenate([c[c != 32], two, three]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties by n-gram."""
    if len(keys) > size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= floor
        keys, counts = keys[some], counts[some]
    return keys[np.lexsort((keys, -counts))[:size]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys, counts = grams(text)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])


def sampled(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang and text of the ``sample`` rows of each language with the smallest hashes; copies of a row are one.

    Each of SALTS parts of a language keeps so many of its own before the parts meet.
    """
    named = labelled.select("lang", "text", F.xxhash64("doc_id", "text").alias("row"))
    keys = named.select("lang", "row").distinct().withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("row"))
    few = keys.withColumn("place", first("lang", "salt")).filter(F.col("place") <= sample)
    last = few.withColumn("place", first("lang")).filter(F.col("place") <= sample).groupBy("lang").agg(F.max("row").alias("last"))
    # One row a language comes here and goes out, as the profiles do; texts stay where they are.
    ends = last.collect()
    rows = labelled.sparkSession.createDataFrame([tuple(r) for r in ends], "lang string, last long")
    if len(ends) <= SENT:
        picked = named.join(F.broadcast(rows), "lang")
    else:
        salted = rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        picked = named.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))).join(salted, ["lang", "salt"])
    return picked.filter("row <= last").groupBy("lang", "row").agg(F.min("text").alias("text")).select("lang", "text")


def learn_profiles(labelled: DataFrame, sample: int = SAMPLE, size: int = PROFILE) -> dict[str, list[int]]:
    """Language to ranked n-grams, from rows (doc_id, text, lang) without nulls in lang; the model grows with the languages alone."""
    counts = sampled(labelled, sample).mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Code points make an n-gram positive, so that its order is that of unsigned numbers.
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("place") <= size)
    out: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "place").collect():
        out.setdefault(row.lang, []).append(row.gram)
    return out


class Profiles:
    """Places of n-grams in the profiles of all languages, by n-gram."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.spoken, self.size = sorted(profiles), size
        n = [len(profiles[x]) for x in self.spoken]
        grams_ = np.array([g for x in self.spoken for g in profiles[x]], np.uint64)
        order = np.argsort(grams_, kind="stable")
        self.grams, self.lang = grams_[order], np.repeat(np.arange(len(n)), n)[order]
        self.place = np.concatenate([*map(np.arange, n), np.zeros(0, np.int64)])[order]

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a ranked list to each language; an n-gram that a profile lacks costs its size."""
        low, high = (np.searchsorted(self.grams, own, side) for side in ("left", "right"))
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        rank = np.repeat(np.arange(len(own)), n)
        return self.size * len(own) + np.bincount(self.lang[at], np.abs(self.place[at] - rank) - self.size, len(self.spoken))


def _judge(profiles: dict[str, list[int]], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles, size)
        for batch in slices(batches, "text", 1 << 20):
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                own = ranked(*grams(text), size)
                if not len(own) or not profiles:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                away = known.distances(own) / (size * len(own))
                best = int(np.argmin(away))
                langs.append(known.spoken[best])
                scores.append(float(max(0.0, min(1.0, 1 - away[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred and score, the likeness 1 - distance / greatest distance."""
    return texts(docs).mapInArrow(_judge(profiles, size), "doc_id long, lang_pred string, score double")


def _learned(docs: DataFrame) -> dict[str, list[int]]:
    return learn_profiles(texts(docs, "lang").filter(~held_out(3, 1) & F.col("lang").isNotNull()))


def _keep(profiles: dict[str, list[int]], least: float):
    judge = _judge(profiles, PROFILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            pair = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", "text")], ["doc_id", "text"])
            found = list(judge(iter([pair])))
            good = [lang != "und" and score >= least for b in found for lang, score in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_()))

    return run


def keep_identified(docs: DataFrame, least: float = 0.1) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose language is known and whose likeness to it is ``least`` or more."""
    rows = texts(docs, *names(docs, "doc_id", "text"))
    return rows.mapInArrow(_keep(_learned(docs), least), rows.schema).select(names(docs))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by profiles of the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, _learned(docs)).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
ORACLE_SQL: dict[str, str] = {}
