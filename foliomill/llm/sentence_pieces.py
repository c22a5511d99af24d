"""Encoding and decoding with a sentence-piece model, in batches with numpy.

Texts are cut into words (a run of word marks and what follows up to the next one). Words of
equal length advance together through a Viterbi pass: at each end, the hashes of all substrings
that end there probe the sorted keys of the pieces, and the piece that may stand last on the path
to that end is stored as its backpointer, for all words at once.

The models at hand merge (BPE), so there is no sum of scores to take the maximum of, which would give
other ids than the model: a piece may follow another only if merging the two texts gives back
just the two. Then one path at most reaches each end, and following its
backpointers gives the model's own encoding. Characters without a piece become byte pieces.
Models of other kinds (their scores are no merge ranks, or they have no byte pieces) are refused.
A run without spaces is one word, and its pass takes a step for each character.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows each
get a row. Decoding gives the text back but for U+2581, which the model cannot tell from a space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IdMemory, RollingHash, mixed, slices, table, texts

MARK = 0x2581
#: Words remembered by a task before it starts anew.
REMEMBERED = 1_000_000
_STEP = np.uint64(0x100000001B3)
_SLOTS = np.uint64((1 << 21) - 1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Pieces:
    """The pieces of a model file by hash, and which of them may stand side by side."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores = [model.get_score(i) for i in range(model.vocab_size())]
        if not any(model.is_byte(i) for i in range(model.vocab_size())) or any(s != int(s) for s in scores):
            raise ValueError("a merge model with byte pieces is needed")
        n = model.vocab_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)])
        self.bytes = np.array([next((i for i in range(n) if self.names[i] == f"<0x{b:02X}>"), model.unk_id()) for b in range(256)], np.int64)
        score = np.array([model.get_score(i) for i in range(n)])
        plain = np.flatnonzero(~self.special)
        codes = [np.frombuffer(self.names[i].encode("utf-32-le"), np.uint32) for i in plain]
        self.longest = max(map(len, codes))
        self.up = _powers(self.longest + 1)
        self.length = np.zeros(n, np.int64)
        self.length[plain] = [len(c) for c in codes]
        raw = np.zeros(n, np.uint64)
        raw[plain] = [self.raw(c) for c in codes]
        self.hashes = raw
        keys = mixed(raw[plain] + self.length[plain].astype(np.uint64))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], plain[order]
        # Most substrings are no pieces: a bit for each slot of keys saves them the search.
        self.maybe = np.zeros(int(_SLOTS) + 1, bool)
        self.maybe[(keys & _SLOTS).astype(np.int64)] = True
        # Rank by score, best first: merges are taken in this order, the leftmost of equal ones first.
        self.rank = np.empty(n, np.int64)
        self.rank[np.lexsort((np.arange(n), -score))] = np.arange(n)
        self.single = np.unique(np.concatenate([c for c in codes if len(c) == 1]))
        self.in_model = np.zeros(0x110000, bool)
        self.in_model[self.single] = True
        self.hasher, self.memory = RollingHash(1 << 21), IdMemory(REMEMBERED)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self._splits(codes, plain)
        self.pair_of, self.pair_fits = np.zeros(1 << 21, np.int64), np.zeros(1 << 21, bool)
        self.spelling: np.ndarray | None = None

    def raw(self, codes: np.ndarray) -> np.uint64:
        return (mixed(codes.astype(np.uint64) + np.uint64(1)) * self.up[len(codes) - 1 :: -1][: len(codes)]).sum(dtype=np.uint64)

    def find(self, raw: np.ndarray, length) -> np.ndarray:
        """Ids of substrings by hash and length; -1 where there is no such piece."""
        key = mixed(raw + np.asarray(length).astype(np.uint64))
        out = np.full(len(key), -1, np.int64)
        some = np.flatnonzero(self.maybe[(key & _SLOTS).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
        good = self.keys[place] == key[some]
        out[some[good]] = self.ids[place[good]]
        return out

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the piece that two pieces give together, -1 if none."""
        size = self.length[a] + self.length[b]
        fits = size <= self.longest
        return np.where(fits, self.find(self.hashes[a] * self.up[np.minimum(self.length[b], self.longest)] + self.hashes[b], size), -1)

    def _splits(self, codes: list[np.ndarray], plain: np.ndarray) -> None:
        """The last merge that makes each piece out of characters; pieces that merges don't reach are left out."""
        single = {int(c[0]): int(i) for c, i in zip(codes, plain) if len(c) == 1}
        names = {self.names[i]: int(i) for i in plain}
        self.reached = np.zeros(len(self.names), bool)
        for c, i in zip(codes, plain):
            parts = [single.get(int(x), -1) for x in c]
            if len(parts) == 1:
                self.reached[i] = True
                continue
            texts_ = [chr(x) for x in c]
            last = (-1, -1)
            while len(parts) > 1:
                best = min(((self.rank[k], at, k) for at in range(len(parts) - 1) if (k := names.get(texts_[at] + texts_[at + 1], -1)) >= 0 and parts[at] >= 0 and parts[at + 1] >= 0), default=None)
                if best is None:
                    break
                _, at, k = best
                last = (parts[at], parts[at + 1])
                parts[at : at + 2], texts_[at : at + 2] = [k], [texts_[at] + texts_[at + 1]]
            if len(parts) == 1:
                self.reached[i] = True
                self.left[i], self.right[i] = last

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the texts of pieces a and b gives back a and b; a table remembers the last pairs of each slot."""
        pair = a * len(self.names) + b + 1
        slot = (mixed(pair.astype(np.uint64)) & np.uint64(len(self.pair_of) - 1)).astype(np.int64)
        out = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_of[slot] != pair)
        if len(new):
            out[new] = good = self._fit(a[new], b[new])
            # Of pairs that meet in a slot one wins in both tables: the last, by position.
            where, last = np.unique(slot[new][::-1], return_index=True)
            self.pair_of[where], self.pair_fits[where] = pair[new][::-1][last], good[::-1][last]
        return out

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Takes the two pieces apart, latest merge first; a merge across the border that was open then, and came earlier, spoils the pair.

        ``until`` is the merge before which the crossing merge has to come: the one undone last.
        On equal rank the leftmost goes first, so that the crossing merge wins against one on its right only.
        """
        good, a, b = np.ones(len(a), bool), a.copy(), b.copy()
        live = np.arange(len(a))
        until = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            x, y = a[live], b[live]
            cross = self.joined(x, y)
            spoilt = (cross >= 0) & (2 * self.rank[cross] < until[live])
            good[live[spoilt]] = False
            live, x, y = live[~spoilt], x[~spoilt], y[~spoilt]
            can_x, can_y = self.left[x] >= 0, self.left[y] >= 0
            # Of two equal merges the right one came later.
            undo_y = can_y & (~can_x | (self.rank[y] >= self.rank[x]))
            undo_x = can_x & ~undo_y
            until[live[undo_x]] = 2 * self.rank[x[undo_x]]
            a[live[undo_x]] = self.right[x[undo_x]]
            until[live[undo_y]] = 2 * self.rank[y[undo_y]] + 1
            b[live[undo_y]] = self.left[y[undo_y]]
            live = live[undo_x | undo_y]
        return good

    def encode_words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids row by row, count of ids in each row) for words of one length, a row of code points each."""
        n, size = codes.shape
        scrambled = mixed(codes.astype(np.uint64) + np.uint64(1))
        last = np.full((n, size + 1), -1, np.int64)  # the piece that ends here on the path
        sums = np.zeros((n, size + 1), np.uint64)
        for i in range(size):
            sums[:, i + 1] = sums[:, i] * _STEP + scrambled[:, i]
        for end in range(1, size + 1):
            for length in range(1, min(end, self.longest) + 1):
                begin = end - length
                open_ = np.flatnonzero(((last[:, begin] >= 0) if begin else True) & (last[:, end] < 0))
                if not len(open_):
                    continue
                piece = self.find(sums[open_, end] - sums[open_, begin] * self.up[length], length)
                hit = (piece >= 0) & self.reached[piece]
                rows, piece = open_[hit], piece[hit]
                if begin and len(rows):
                    good = self.fits(last[rows, begin], piece)
                    rows, piece = rows[good], piece[good]
                last[rows, end] = piece
        out = np.full((n, size), -1, np.int64)
        at, count = np.full(n, size), np.zeros(n, np.int64)
        while (going := np.flatnonzero(at > 0)).size:
            piece = last[going, at[going]]
            count[going] += 1
            out[going, size - count[going]] = piece
            at[going] -= self.length[piece]
        return out[out >= 0], count

    def _words(self, code: np.ndarray, start: np.ndarray, size: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, count of ids) of the words at ``start``: equal lengths advance together, unknown characters are bytes."""
        order, ids, count = [], [], []
        for length in np.unique(size[known[start]]):
            some = np.flatnonzero((size == length) & known[start])
            found, each = self.encode_words(code[start[some][:, None] + np.arange(length)])
            order.append(some)
            ids.append(found)
            count.append(each)
        for w in np.flatnonzero(~known[start]).tolist():
            raw = code[start[w] : start[w] + size[w]].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            order.append(np.array([w]))
            ids.append(self.bytes[np.frombuffer(raw, np.uint8)])
            count.append(np.array([len(raw)]))
        back = np.argsort(np.concatenate(order))
        flat, each = np.concatenate(ids), np.concatenate(count)
        low = (np.cumsum(each) - each)[back]
        each = each[back]
        return flat[np.repeat(low - np.cumsum(each) + each, each) + np.arange(int(each.sum()))], each

    def encode(self, texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, the n + 1 offsets)."""
        # One mark in front of each text, and marks for spaces, as the model's normalisation has it.
        parts = [np.frombuffer(("▁" + t).encode("utf-32-le", "surrogatepass"), np.uint32) if t else np.zeros(0, np.uint32) for t in texts_]
        code, ends = np.concatenate([*parts, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, parts)])
        if not len(code):
            return np.zeros(0, np.int32), ends
        code[code == 32] = MARK
        known, mark = self.in_model[code], code == MARK
        begin = np.r_[True, (mark[1:] & ~mark[:-1]) | (known[1:] != known[:-1])]
        begin[ends[:-1][ends[:-1] < len(code)]] = True
        start = np.flatnonzero(begin)
        size = np.diff(np.r_[start, len(code)])
        hasher = self.hasher if len(code) < self.hasher.up.size else RollingHash(len(code))
        sums = np.r_[np.uint64(0), np.cumsum(mixed(code.astype(np.uint64) + np.uint64(1)) * hasher.up[: len(code)])]
        names, first, which = np.unique(hasher.of(sums, start, start + size), return_index=True, return_inverse=True)
        new = self.memory.unknown(names)
        if new.any():
            self.memory.add(names[new], *self._words(code, start[first[new]], size[first[new]], known))
        return self.memory.spell(names, which, np.searchsorted(ends, start, "right") - 1, len(texts_))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids; control ids are silent."""
        if self.spelling is None:
            value = {int(i): bytes([b]) for b, i in enumerate(self.bytes) if self.names[i].startswith("<0x")}
            shown = [value.get(i, b"" if self.special[i] else self.names[i].replace("▁", " ").encode()) for i in range(len(self.names))]
            self.width = np.array(list(map(len, shown)), np.int64)
            self.spelling, self.from_ = np.frombuffer(b"".join(shown), np.uint8), np.cumsum(self.width) - self.width
        width = self.width[ids]
        low = np.r_[0, np.cumsum(width)]
        raw = self.spelling[np.repeat(self.from_[ids], width) + np.arange(int(low[-1])) - np.repeat(low[:-1], width)].tobytes()
        cut = low[offsets].tolist()
        # The mark in front of the text is no part of it.
        return [raw[a + 1 if raw[a : a + 1] == b" " else a : b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            ids, offsets = pieces(path).encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array([i for i in x or [] if i is not None], np.int64) for x in batch.column(1).to_pylist()]
            text = pieces(path).decode(np.concatenate([*lists, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, lists)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every whole text."""
    return texts(docs).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(path), "doc_id long, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _both(path: str):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            model, given = pieces(path), batch.column(1).to_pylist()
            ids, offsets = model.encode(given)
            same = [d == t.replace("▁", " ") for d, t in zip(model.decode(ids, offsets), given)]
            raw, cut = memoryview(ids.astype("<i4").tobytes()), offsets.tolist()
            digest = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(digest, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_sha256", "round_trip"])

    return run


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (little-endian 32-bit ids) and whether decoding gives the text back."""
    return texts(table(spark, sf_dir, "documents")).mapInArrow(_both(model_path()), "doc_id long, n_ids long, ids_sha256 string, round_trip boolean")


QUERIES = {"op9_sentence_pieces": op9_sentence_pieces}
ORACLE_SQL: dict[str, str] = {}
