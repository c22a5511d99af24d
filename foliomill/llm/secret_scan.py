"""Secrets in texts: fixed patterns, and candidate strings of high entropy.

A candidate is a run of key characters with letters and digits. Over each window of it
the Shannon entropy of its character class (hexadecimal or base 64) is kept by incremental
counts: a step takes one character out and one in. Windows over the class's threshold
join to spans, unless the allow-list suppresses the candidate or a fixed pattern covers it.

Defined results: a null or empty text has no spans; repeated rows each get a row; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import buffers, names, slices, table, texts

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Window, and bits a character of that class must carry over it.
WINDOW, BITS = 20, {"hex": 3.0, "base64": 3.7}
#: Candidates that are no secrets: UUIDs, counters, and names with separators between plain words.
ALLOWED = (r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"[0-9_/=+-]+", r"([A-Za-z]+|[0-9]+)([-_/=+]+([A-Za-z]+|[0-9]+))+", r".*(EXAMPLE|example).*", r"[A-Za-z]+[0-9]{1,4}")
_NOTE = [0.0, *(n * math.log2(n) for n in range(1, WINDOW + 1))]

_IN_HEX, _IN_KEY, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_IN_HEX[list(b"0123456789abcdef")] = True
_IN_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_DIGIT[list(b"0123456789")] = True


def entropy_windows(text: str, size: int = WINDOW) -> Iterator[tuple[int, float]]:
    """(start, bits a character) of every window, by incremental counts."""
    counts: dict[str, int] = {}
    total = 0.0  # the sum of n log2 n
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _NOTE[n + 1] - _NOTE[n]
        if i >= size - 1:
            yield i - size + 1, math.log2(size) - total / size
            old = text[i - size + 1]
            n = counts[old]
            counts[old] = n - 1
            total += _NOTE[n - 1] - _NOTE[n]


def entropy_spans(text: str, allowed: re.Pattern) -> list[tuple[int, int]]:
    """Spans of high entropy among the candidates of a text."""
    out: list[tuple[int, int]] = []
    for match in _CANDIDATE.finditer(text):
        run = match[0]
        if len(run) < WINDOW or not re.search("[0-9]", run) or not re.search("[A-Za-z]", run) or allowed.fullmatch(run):
            continue
        limit = BITS["hex" if re.fullmatch("[0-9a-fA-F]+", run) else "base64"]
        for at, bits in entropy_windows(run):
            if bits >= limit:
                start, end = match.start() + at, match.start() + at + WINDOW
                if out and out[-1][1] >= start:
                    out[-1] = (out[-1][0], end)
                else:
                    out.append((start, end))
    return out


def find_secrets(text: str, hexes: bool, candidates: bool, allowed: re.Pattern) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, in order; the flags say whether such runs can be there at all."""
    low, out = text.lower(), []
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if hexes:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if len(m[0]) >= 24]
    if candidates:
        base = list(out)
        out += [(a, 3, b) for a, b in entropy_spans(text, allowed) if not any(a < e and s < b for s, _, e in base)]
    return sorted(out)


def _long_runs(data: np.ndarray, inside: np.ndarray, ends: np.ndarray, least: int, need: np.ndarray | None = None) -> np.ndarray:
    """Which texts hold a run of ``least`` bytes of a class (with one byte of ``need``)."""
    edge = np.diff(np.r_[False, inside[data], False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    good = end - start >= least
    if need is not None:
        count = np.r_[0, np.cumsum(need[data])]
        good &= count[end] > count[start]
    out = np.zeros(len(ends) - 1, bool)
    # A run may go on from one text into the next: each text that it touches is looked into.
    first, last = np.searchsorted(ends, start[good], "right") - 1, np.searchsorted(ends, end[good] - 1, "right") - 1
    for a, b in zip(first, last):
        out[a : b + 1] = True
    return out


def _scan(allowed: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = re.compile("|".join(f"(?:{x})" for x in allowed))
        for batch in slices(batches, "text", 1 << 20):
            data, ends = buffers(batch.column(1))
            hexes = _long_runs(data, _IN_HEX, ends, 24)
            keys = _long_runs(data, _IN_KEY, ends, WINDOW, _DIGIT)
            found = [find_secrets(t, h, k, allow) for t, h, k in zip(batch.column(1).to_pylist(), hexes, keys)]
            part = [pa.array([[x[i] for x in f] for f in found], pa.list_(pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *part], [*batch.schema.names, "starts", "kinds", "ends"])

    return run


def scan(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, text and the arrays starts, kinds (numbers of KINDS) and ends, in code points."""
    return texts(docs).mapInArrow(_scan(allowed), "doc_id long, text string, starts array<long>, kinds array<long>, ends array<long>")


def _redact(allowed: tuple[str, ...], mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _scan(allowed)(batches):
            out, n = [], batch.num_columns
            for text, starts, ends in zip(*(batch.column(i).to_pylist() for i in (1, n - 3, n - 1))):
                parts, at = [], 0
                for a, b in zip(starts, ends):
                    if b > at:
                        parts += [text[at : max(a, at)], mark if a >= at else ""]
                        at = b
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], pa.array(out, pa.string()), *batch.columns[2:-3]], batch.schema.names[:-3])

    return run


def redact(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED, mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with ``mark`` in the place of every span; the other columns stay, a null text comes back empty."""
    rows = texts(docs, *names(docs, "doc_id", "text"))
    return rows.mapInArrow(_redact(allowed, mark), rows.schema).select(names(docs))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _scan(ALLOWED)(batches):
        rows = []
        for starts, kinds, ends in zip(*(batch.column(k).to_pylist() for k in ("starts", "kinds", "ends"))):
            spans = [(k, f"{KINDS[k]}:{a}:{b}") for a, k, b in zip(starts, kinds, ends)]
            base = ",".join(s for k, s in spans if k < 3)
            rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, s in spans)))
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by kind and place."""
    return texts(table(spark, sf_dir, "documents")).mapInArrow(_digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLE_SQL: dict[str, str] = {}
