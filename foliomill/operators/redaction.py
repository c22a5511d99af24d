"""Messages without the secrets of a set."""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions.rows import slices

from .records import MASK

#: Bytes of the shortest secret (no form of one is shorter), and secrets whose hashes come to the driver at a time.
LEAST, PART = 8, 1_000_000
#: An odd number that spreads the first bytes of a form over the bits of a filter.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def header_secrets(headers: DataFrame) -> DataFrame:
    """The distinct secrets (secret) in values of headers (name, value), without the word for the scheme."""
    bare = F.regexp_replace(F.trim("value"), r"(?i)^(?:bearer|basic|token)\s+", "")
    return headers.select(bare.alias("secret")).filter(F.octet_length("secret") >= LEAST).distinct()


def forms(secret: str) -> set[str]:
    """A secret as it is, URL-encoded, and escaped in JSON with and without escaped slashes."""
    escaped = json.dumps(secret)[1:-1]
    return {secret, quote(secret, safe=""), escaped, escaped.replace("/", "\\/"), json.dumps(secret, ensure_ascii=False)[1:-1].replace("/", "\\/")}


def _hashes(forms_: list[bytes]) -> np.ndarray:
    """Two numbers of 64 bits for each form."""
    return np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in forms_), np.int64).reshape(-1, 2)


def _hashed_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """head (the first LEAST bytes as a number), size and hash of the forms of secrets."""
    for batch in batches:
        for part in slices(batch):
            found = [x.encode() for secret in part.column(0).to_pylist() for x in forms(secret)]
            heads = np.frombuffer(b"".join(x[:LEAST] for x in found), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array([len(x) for x in found], pa.int32()), *map(pa.array, _hashes(found).T)], ["head", "size", "a", "b"])


class _Table(NamedTuple):
    """Hashes of forms, about 40 bytes each: ``seen`` by the spread head, the sizes of a head between its ends."""

    seen: np.ndarray
    heads: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray
    a: np.ndarray
    b: np.ndarray

    @classmethod
    def of(cls, head: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> _Table:
        pairs = np.unique(np.rec.fromarrays([head.view(np.uint64), size], names="head,size"))
        heads, starts = np.unique(pairs["head"], return_index=True)
        seen = np.zeros(1 << max(16, int(len(heads) * 8).bit_length()), bool)
        order = np.lexsort((b, a))
        table = cls(seen, heads, np.append(starts, len(pairs)), pairs["size"].copy(), a[order], b[order])
        seen[table.spread(heads)] = True
        return table

    def spread(self, heads: np.ndarray) -> np.ndarray:
        return (heads * _SPREAD) >> np.uint64(65 - len(self.seen).bit_length())

    def places(self, texts: list[bytes]) -> dict[int, list[int]]:
        """(from, to, from, to, …) of the forms in those texts that have one, by the text's number."""
        whole = b"".join(texts)
        data, n = np.frombuffer(whole, np.uint8), len(whole) - LEAST + 1
        if n <= 0:
            return {}
        head = np.zeros(n, np.uint64)
        for k in range(LEAST):
            head |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        at = np.flatnonzero(self.seen[self.spread(head)])
        which = np.minimum(np.searchsorted(self.heads, head[at]), len(self.heads) - 1)
        real = self.heads[which] == head[at]
        at, which = at[real], which[real]
        # Every size of the head, as far as the text goes.
        many = self.ends[which + 1] - self.ends[which]
        start = np.repeat(at, many)
        size = self.sizes[np.repeat(self.ends[which], many) + np.arange(len(start)) - np.repeat(np.cumsum(many) - many, many)]
        close = np.cumsum([len(t) for t in texts])
        text = np.searchsorted(close, start, "right")
        inside = start + size <= close[text]
        start, size, text = start[inside], size[inside], text[inside]
        a, b = _hashes([whole[i : i + k] for i, k in zip(start.tolist(), size.tolist())]).T
        k = np.minimum(np.searchsorted(self.a, a), len(self.a) - 1)
        good = (self.a[k] == a) & (self.b[k] == b)
        start, size, text = start[good], size[good], text[good]
        start = start - np.append(0, close)[text]
        found: dict[int, list[int]] = {}
        for i, low, high in zip(text.tolist(), start.tolist(), (start + size).tolist()):
            found.setdefault(i, []).extend((low, high))
        return found


def _without(table, message: int):
    """Rows whose message has the secrets of a broadcast table masked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(message).to_pylist()
                coded = [(x or "").encode() for x in texts]
                for i, places in table.value.places(coded).items():
                    texts[i] = masked(coded[i], places).decode()
                columns = list(part.columns)
                columns[message] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return run


def masked(text: str | bytes, places: list[int]) -> str | bytes:
    """``text`` with one mask for each stretch of places that overlap."""
    none = text[:0]
    out, at, last, mask = [], 0, -1, MASK.encode() if isinstance(text, bytes) else MASK
    for low, high in sorted(zip(places[::2], places[1::2])):
        if low >= last:
            out += [text[at:low], mask]
        at = last = max(last, high)
    return none.join([*out, text[at:]])


def redact_set(messages: DataFrame, secrets: DataFrame, most: int = 300, part: int = PART) -> DataFrame:
    """``message`` with every secret of ``secrets`` (secret) masked, also URL-encoded and escaped in JSON; then cut.

    Secrets under 8 bytes and nulls are none. Of the set only hashes go out, about 40 bytes for each form, which come to
    the driver ``part`` secrets at a time: first bytes, sizes and 128 bits of the whole form. A row is searched once,
    whatever the size of the set; hashes of 128 bits are trusted. Secrets that overlap are masked together. A null
    message stays null.
    """
    known = secrets.select(F.col("secret").cast("string").alias("secret")).filter(F.octet_length("secret") >= LEAST).distinct()
    parts, rows = -(-known.count() // part), messages
    if parts:
        hashed = known.withColumn("part", F.pmod(F.xxhash64("secret"), F.lit(parts)))
        held = [hashed.filter(F.col("part") == k).select("secret").mapInArrow(_hashed_forms, "head long, size int, a long, b long").toArrow() for k in range(parts)]
        table = _Table.of(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("head", "size", "a", "b")))
        rows = rows.mapInArrow(_without(messages.sparkSession.sparkContext.broadcast(table), messages.columns.index("message")), messages.schema)
    return rows.withColumn("message", F.when(F.length("message") > most, F.concat(F.substring("message", 1, most), F.lit("…"))).otherwise(F.col("message")))
