"""Rule ledger: every rule is evaluated once per document and stored as a failure bit beside its measurements.

Policies are versioned bit masks over the ledger, so that a new policy, or an ablation of
an old one, is bit arithmetic over stored rows and never a second pass over texts.

Defined results: a null or empty text has zero in every measurement and fails ``few_words``;
repeated rows each get a row; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, RollingHash, buffers, mixed, slices, table, texts, word_hashes

#: Rule name to failure condition over the measurements; the bit is the position. Append only.
RULES = {
    "few_words": "n_words < 10",
    "repeat_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "dup_lines": "100 * n_dup_lines > 60 * n_lines",
    "no_letters": "2 * n_letter_words < n_words",
}
#: Versioned policies: names of the rules that reject.
POLICIES = {1: ("few_words", "repeat_words"), 2: tuple(RULES)}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words")


def _repeated(words: np.ndarray, size: int = 5) -> int:
    """Words in windows of ``size`` words that stand twice or more."""
    if len(words) <= size:
        return 0
    window = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        window = mixed(window * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - size + 1 + i])
    _, which, counts = np.unique(window, return_inverse=True, return_counts=True)
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(counts[which] > 1)
    step[: len(window)][at] += 1
    step[at + size] -= 1
    return int(np.count_nonzero(np.cumsum(step[:-1])))


def _sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags)]
    return total[ends[1:]] - total[ends[:-1]]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = RollingHash(1 << 20)
    for batch in slices(batches, "text", 1 << 19):
        raw, at = buffers(batch.column(1))
        # A line end after each text keeps words and lines inside their texts.
        data, ends = np.insert(raw, at[1:], 10), at + np.arange(len(at))
        space, cut = SPACE[data], ends[1:]
        words, starts, stops = word_hashes(data, hashes, lower=False)
        of = np.searchsorted(starts, ends)
        letters = np.r_[0, np.cumsum(_LETTER[data])]
        lettered = letters[stops] > letters[starts]
        line_to = np.flatnonzero(data == 10)
        line_from = np.r_[0, line_to[:-1] + 1] if len(line_to) else line_to
        ink = np.r_[0, np.cumsum(~space)]
        full = ink[line_to] > ink[line_from] if len(line_to) else np.zeros(0, bool)
        line_from, line_to = line_from[full], line_to[full]
        if len(data) < hashes.up.size:
            lines = hashes.of(hashes.prefix(data), line_from, line_to)
        else:
            lines = np.array([hash(data[a:b].tobytes()) for a, b in zip(line_from, line_to)], np.int64)
        line_of = np.searchsorted(line_from, ends)
        codes = _sums(((data & 0xC0) != 0x80) & ~space, ends)
        out = {
            "n_words": np.diff(of), "word_chars": codes, "n_symbols": _sums(_SYMBOL[data], ends), "n_lines": np.diff(line_of),
            "n_dup_lines": [line_of[i + 1] - line_of[i] - len(np.unique(lines[line_of[i] : line_of[i + 1]])) for i in range(len(cut))],
            "n_repeat_words": [_repeated(words[of[i] : of[i + 1]]) for i in range(len(cut))],
            "n_letter_words": _sums(lettered, of),
        }
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.asarray(out[k], np.int64)) for k in MEASURES)], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measurements, and ``failures``, a bit for each rule of RULES that it fails."""
    measured = texts(docs).mapInArrow(_measure, "doc_id long, " + ", ".join(f"{k} long" for k in MEASURES))
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(0) for i, condition in enumerate(RULES.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("failures", total.cast("long"))


def mask(version: int) -> int:
    """The bits of a policy."""
    return sum(1 << i for i, name in enumerate(RULES) if name in POLICIES[version])


def apply_policy(rows: DataFrame, version: int) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failures").bitwiseAND(mask(version)) == 0)


def ablations(rows: DataFrame, version: int) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that only it rejects.

    The ledger is first counted by its bits (2 to the number of rules rows at most).
    """
    patterns = rows.groupBy(F.col("failures").bitwiseAND(mask(version)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, name in enumerate(RULES) if name in POLICIES[version]))
    each = patterns.select("bits", "n", F.inline(rules))
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    only = F.col("bits") == F.col("bit")
    return each.groupBy("rule").agg(F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(only, F.col("n")).otherwise(0)).alias("n_only"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of every document, and whether the base rules and the policy keep it."""
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")), 2)
    base = F.col("failures").bitwiseAND(mask(1)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failures")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of the policy, how many documents fail it, and how many it alone rejects."""
    return ablations(ledger(table(spark, sf_dir, "documents")), 2)


_MEASURED = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT r, i, list_aggregate(words[i:i+4], 'string_agg', ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, i + k AS p FROM rep, range(0, 5) t(k)) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\xBF]')))::BIGINT AS n_letter_words
  FROM w LEFT JOIN dup USING (r) LEFT JOIN cov USING (r)),
l AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
  + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 14 * n_words)::BIGINT + 32 * (100 * n_dup_lines > 60 * n_lines)::BIGINT + 64 * (2 * n_letter_words < n_words)::BIGINT AS failures FROM m)
"""
QUERIES = {"op4_quality_rules": op4_quality_rules, "rule_ablations": rule_ablations}
ORACLE_SQL = {
    "op4_quality_rules": _MEASURED + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM l",
    "rule_ablations": _MEASURED + """, rules AS (SELECT unnest(['few_words', 'repeat_words', 'symbols', 'short_words', 'long_words', 'dup_lines', 'no_letters']) AS rule, unnest([1, 2, 4, 8, 16, 32, 64]) AS bit)
SELECT rule, sum(CASE WHEN failures & bit <> 0 THEN 1 ELSE 0 END)::BIGINT AS n_failed, sum(CASE WHEN failures = bit THEN 1 ELSE 0 END)::BIGINT AS n_only FROM rules, l GROUP BY rule""",
}
