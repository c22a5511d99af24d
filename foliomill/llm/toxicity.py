"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: case, accents, look-alike letters of other scripts, and digits and
signs that stand for letters. The lexicon is learned from labelled rows: folded words whose
document frequency speaks for the label (signed log-likelihood ratio), weighted by their log
odds. Hits inside longer words, and hits inside an exception phrase, do not count. The sum of
weights and the sum for each thousand letters of text are combined by a logistic regression.

Lexicon and regression come from at most ``sample`` labelled rows (chosen by a hash of their
id); every document is scored by its whole text.

Defined results: a null or empty text gets the score of a text without hits; a document with
several label rows is learned once with the greatest; repeated rows each get a row.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, slices, table, texts

#: Labelled rows learned from, words in the lexicon, and least signed root of the ratio.
SAMPLE, TERMS, LEAST = 20_000, 2_000, 4.5
#: Letters of other scripts by the Latin letters that they look like.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ո": "n", "т": "t", "м": "m", "к": "k", "в": "b", "н": "h", "α": "a", "ο": "o", "ε": "e", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss"}
#: Digits and signs by the letters that they stand for.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "stupid mistake", "idiot proof")
_TABLE = str.maketrans(HOMOGLYPHS)
_SIGNS = re.compile(r"(?<=[a-z])[013457@$!]+(?=[a-z])|(?<![a-z0-9])[013457@$]+(?=[a-z])|(?<=[a-z]{2})[013457]+(?![a-z0-9])")
_SIGN_TABLE = str.maketrans(DIGITS)
_WORD = re.compile(r"[a-z]+")


def fold(text: str) -> str:
    """Lower case Latin letters for what looks like them; signs fold only beside letters."""
    low = text.lower()
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFKD", low.translate(_TABLE)) if not unicodedata.combining(c))
    return _SIGNS.sub(lambda m: m[0].translate(_SIGN_TABLE), low)


def automaton(lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, weight in lexicon.items():
        out.add_word(word, (len(word), weight))
    for phrase in exceptions:
        if any(w in lexicon for w in phrase.split()):
            out.add_word(phrase, (len(phrase), None))
    if len(out):
        out.make_automaton()
    return out


def features(text: str, found: ahocorasick.Automaton) -> tuple[float, float]:
    """(log of 1 + the weights of all hits, the same for each 1000 characters)."""
    if not len(found) or not text:
        return 0.0, 0.0
    low, total = fold(text), 0.0
    hits, spared = [], []
    for end, (size, weight) in found.iter(low):
        start = end - size + 1
        if (start and low[start - 1].isalpha()) or (end + 1 < len(low) and low[end + 1].isalpha()):
            continue
        (spared if weight is None else hits).append((start, end + 1, weight or 0.0))
    # The farthest end of the phrases that have begun tells whether one of them holds a hit.
    spared.sort()
    begun, reach = [a for a, _, _ in spared], [*accumulate((b for _, b, _ in spared), max)]
    for start, end, weight in hits:
        k = bisect_right(begun, start)
        if not k or reach[k - 1] < end:
            total += weight
    return float(np.log1p(total)), float(np.log1p(1000 * total / (len(low) + 200)))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = sorted({w for w in _WORD.findall(fold(text)) if 3 <= len(w) <= 40})
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(words), pa.int32()), pa.array(words, pa.string())], ["label", "word"])


def _measure(lexicon: dict[str, float], exceptions: tuple[str, ...], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(lexicon, exceptions)
        for batch in slices(batches, "text", 1 << 20):
            rows = [features(t, found) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.float64()) for i in (0, 1))], [column, "weight", "density"])

    return run


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Weights of a logistic regression with an intercept, by Newton steps."""
    x, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return w.tolist()


def learn(labelled: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> tuple[dict[str, float], list[float]]:
    """(lexicon, regression) from rows (label 0 or 1, doc_id, text)."""
    rows = labelled.select("label", "text").persist()
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        rows.unpersist()
        return {}, [0.0, 0.0, 20.0 if bad else -20.0 if good else 0.0]
    a, b, n = F.col("a"), F.col("b"), bad + good
    part = lambda c, rest: F.when(c > 0, c * F.log(c * n / rest)).otherwise(0.0)
    df = rows.mapInArrow(_words, "label int, word string").groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).filter("a > 2")
    ratio = 2 * (part(a, (a + b) * bad) + part(b, (a + b) * good) + part(bad - a, (n - a - b) * bad) + part(good - b, (n - a - b) * good))
    odds = F.log((a + 0.5) / (bad - a + 0.5)) - F.log((b + 0.5) / (good - b + 0.5))
    best = df.select("word", ratio.alias("ratio"), odds.alias("odds")).filter((F.col("odds") > 1) & (F.col("ratio") >= LEAST**2)).orderBy(F.desc("ratio"), "word").limit(TERMS)
    lexicon = {r.word: float(r.odds) for r in best.collect()}
    points = rows.mapInArrow(_measure(lexicon, exceptions, "label"), "label int, weight double, density double").collect()  # ``sample`` rows at most
    rows.unpersist()
    p = np.array([[r.label, r.weight, r.density] for r in points])
    return lexicon, _regression(p[:, 1:], p[:, 0])


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, sample: int) -> DataFrame:
    """(doc_id, label, text) of at most ``sample`` labelled documents, chosen by a hash of the id; of several texts of an id, the least."""
    ids = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    picked = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = texts(docs).join(F.broadcast(picked), "doc_id")  # ``sample`` ids at most
    return found.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))


def score(docs: DataFrame, lexicon: dict[str, float], weights: list[float], exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """doc_id, score (0 to 1) and the two measurements."""
    rows = texts(docs).mapInArrow(_measure(lexicon, exceptions, "doc_id"), "doc_id long, weight double, density double")
    return rows.withColumn("score", 1 / (1 + F.exp(-(F.col("weight") * weights[0] + F.col("density") * weights[1] + weights[2]))))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learned from the labelled ones that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon, weights = learn(labelled_sample(docs, labels.filter(~held_out(5, 0)), "toxic", SAMPLE))
    return score(docs, lexicon, weights).select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
