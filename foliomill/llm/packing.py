"""Packing of token ids into sequences by minimum bin slack.

Documents are cut into full windows and one rest. Only the histogram of the rests' lengths
matters for packing, and it has ``window`` entries however large the corpus is: a bounded
subset-sum over bit sets fills each window as close to its capacity as the remaining lengths
allow, backtracking gives the counts, and a filling is repeated as often as its lengths last.
Pieces of one length are then numbered in parallel, and a piece's number names its place.

Words are tokenized once for each task and looked up by hash afterwards (a word's ids do not
depend on its neighbours in this tokenizer: white space separates and is dropped).

Defined results: a null or empty text is the end id alone; repeated rows are packed like any
others; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE, IdMemory, RollingHash, Scratch, buffers, slices, table, texts, word_hashes

#: Words remembered by a task before it starts anew.
REMEMBERED = 1_000_000
END = 1
_STOP, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Groups that pieces of one length are numbered in, at least; rows of a group, about.
SALTS, SALT_ROWS = 64, 200_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _units(data: np.ndarray, hashes: RollingHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words; stops and commas after a letter or digit are words of their own, as the tokenizer has it."""
    if len(data) >= hashes.up.size:
        return word_hashes(data, hashes, lower=False)
    edge = np.diff(np.r_[True, SPACE[data], True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    cut = end.copy()
    for _ in range(3):
        cut -= (cut > start + 1) & _STOP[data[cut - 1]]
    two = (cut < end) & _PLAIN[data[cut - 1]]
    at = np.concatenate([start, cut[two]])
    order = np.argsort(at, kind="stable")
    start, end = at[order], np.concatenate([np.where(two, cut, end), end[two]])[order]
    return hashes.of(hashes.prefix(data), start, end), start, end


def token_ids(data: np.ndarray, ends: np.ndarray, hashes: RollingHash, memory: IdMemory, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts end to end, each closed by END; the n + 1 offsets)."""
    spaced, at = np.insert(data, ends[1:], 32), ends + np.arange(len(ends))
    raw = spaced.tobytes()
    if b"<|" not in raw:  # the names of special tokens keep their case
        spaced = LOWER[spaced]
        raw = spaced.tobytes()
    keys, starts, stops = _units(spaced, hashes)
    names, first, which = np.unique(keys, return_index=True, return_inverse=True)
    new = memory.unknown(names)
    if new.any():
        words = [raw[a:b] for a, b in zip(starts[first[new]].tolist(), stops[first[new]].tolist())]
        ids, size = [], []
        for low in range(0, len(words), 2000):
            some = words[low : low + 2000]
            found = _tokenizer(path).encode(b" ".join(some).decode(), add_special_tokens=False)
            lengths = np.array([len(w.decode()) + 1 for w in some])
            owner = np.searchsorted(np.cumsum(lengths), np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0], "right")
            ids.append(np.array(found.ids, np.int32))
            size.append(np.bincount(owner, minlength=len(some)))
        memory.add(names[new], np.concatenate(ids), np.concatenate(size))
    return memory.spell(names, which, np.searchsorted(at, starts, "right") - 1, len(ends) - 1, END)


def _cut(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, memory = RollingHash(1 << 21), IdMemory(REMEMBERED)
        for batch in slices(batches, "text", 1 << 20):
            ids, offsets = token_ids(*buffers(batch.column(1)), hashes, memory, path)
            total = np.diff(offsets)
            pieces = -(-total // window)
            of = np.repeat(np.arange(len(total)), pieces)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(window, total[of] - start)
            low = offsets[of] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(low.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[of])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of remaining lengths whose sum comes closest to ``room`` without passing it."""
    mask, bits = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # (length, copies, reachable sums before)
    for length, count in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        left, copies = min(count, room // length), 1
        while left > 0:
            n = min(copies, left)
            more = bits | (bits << (length * n)) & mask
            if more != bits:
                steps.append((length, n, bits))
                bits = more
            left, copies = left - n, copies * 2
        if bits >> room & 1:
            break
    total, out = bits.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + n
            total -= length * n
    return out


def plan(counts: dict[int, int], window: int) -> np.ndarray:
    """Segments (length, first number, first sequence, copies in a sequence, first offset), by length and number."""
    left, used, segments, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        most = max(left)
        rest = left | {most: left[most] - 1}
        chosen = fill({k: v for k, v in rest.items() if v and k <= window - most}, window - most) if most < window else {}
        chosen[most] = chosen.get(most, 0) + 1
        times, offset = min(left[k] // n for k, n in chosen.items()), 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            segments.append((length, used[length], sequence, n, offset))
            offset += length * n
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    return np.array(sorted(segments), np.int64).reshape(-1, 5)


def _place(segments: np.ndarray):
    """Rows (piece columns, number) to rows with sequence_id and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (segments[:, 0] << 48) | segments[:, 1]
        for batch in batches:
            if batch.num_rows:
                length, number = batch.column(2).to_numpy(), batch.column(5).to_numpy()
                _, low, sequence, copies, offset = segments[np.searchsorted(key, (length << 48) | number, "right") - 1].T
                own = number - low
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence + own // copies), pa.array(offset + own % copies * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, window: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    with Scratch(docs.sparkSession) as scratch:
        pieces = scratch.written(texts(docs).mapInArrow(_cut(path, window), PIECES), "pieces", keep=True)
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``window`` rows at most
    salts = max(SALTS, -(-sum(counts.values()) // SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    numbered = salted.withColumn("own", own).join(before, ["length", "salt"])
    rows = numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("own")).cast("long").alias("number"))
    return rows.mapInArrow(_place(plan(counts, window)), PIECES + ", sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document's tokens in sequences of 2,048."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


QUERIES = {"op6_packing": op6_packing}
ORACLE_SQL: dict[str, str] = {}
