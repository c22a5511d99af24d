"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors is joined to its nearest neighbours, the neighbour graph is
cut into parts of equal size by recursive bisection, and a small classifier learns in which
parts the neighbours of a vector lie. The classifier puts every row into its most probable
part, routes a query to its most probable parts, and the rows there are reranked by their
exact inner product. Neighbours are by inner product throughout.

A query visits the same share of the parts at every size of the table; the share is chosen for a
recall of about 0.95 on vectors without any structure (recall at other shares is in the README).

How the work is spread: neighbouring parts form ``GROUPS`` groups. The rows of a group are dealt
into blocks of about ``BLOCK``, the queries into chunks of about ``CHUNK``, and each pair of a block
and a chunk is one piece of work that answers with at most k rows for a query. A part that holds any
share of the rows is only more blocks.

Defined results: vectors that are null, empty, all zero, or hold nulls or non-finite numbers,
or whose length is not that of most of the sample, take no part; ties go to the smaller id; a row is
no candidate for queries of its own id; rows with a null id take no part; equal queries are asked once.
Where the visited parts hold fewer than k rows, a query visits further ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Rows that the index is fitted on (chosen by a hash of their id) and neighbours in its graph.
SAMPLE, NEIGHBOURS = 12_000, 32
#: Parts (fewer where the sample has under SAMPLED rows for each), groups of them, and the share of the parts that a query visits.
PARTS, SAMPLED, GROUPS, SHARE = 128, 16, 8, 0.72
#: Rows of a block, queries of a chunk, and queries whose scores are held at once.
BLOCK, CHUNK, HELD = 16_384, 4_096, 256


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & fine)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k rows of greatest inner product with each row, itself left out."""
    out = []
    for at in range(0, len(x), 256):
        scores = x[at : at + 256] @ x.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        out.append(np.argpartition(-scores, min(k, len(x) - 1) - 1, axis=1)[:, :k].copy())
    return np.concatenate(out)


def bisect(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, parts: int, rng: np.random.Generator, out: np.ndarray, first: int = 0) -> None:
    """Writes to ``out`` the parts of ``nodes``: halves of equal size along the slowest vibration of the graph, again and again."""
    if parts == 1 or len(nodes) < 2:
        out[nodes] = first
        return
    local = np.full(len(out), -1)
    local[nodes] = np.arange(len(nodes))
    u, v = local[a], local[b]
    u, v = u[inside := (u >= 0) & (v >= 0)], v[inside]
    n, degree = len(nodes), np.bincount(u, minlength=len(nodes)) + np.bincount(v, minlength=len(nodes)) + 1.0
    y = rng.normal(size=n)
    for _ in range(60):
        y = y - (y * degree).sum() / degree.sum()
        y = 0.5 * y + 0.5 * (np.bincount(u, y[v], n) + np.bincount(v, y[u], n) + y) / degree
        y /= np.abs(y).max() + 1e-30
    half = parts // 2
    order = np.argsort(y, kind="stable")
    size = n * half // parts
    side = np.zeros(n, bool)
    side[order[size:]] = True
    for _ in range(4):  # swap the nodes that gain most, the same number each way
        pull = np.bincount(u, np.where(side[v], 1.0, -1.0), n) + np.bincount(v, np.where(side[u], 1.0, -1.0), n)
        right, left = np.flatnonzero(~side & (pull > 0)), np.flatnonzero(side & (pull < 0))
        m = min(len(right), len(left)) // 2
        if not m:
            break
        right, left = right[np.argsort(-pull[right])[:m]], left[np.argsort(pull[left])[:m]]
        side[right], side[left] = True, False
    bisect(nodes[~side], a, b, half, rng, out, first)
    bisect(nodes[side], a, b, parts - half, rng, out, first + half)


class Router:
    """One hidden layer from a vector to the probabilities of the parts."""

    def __init__(self, layers: list[np.ndarray]):
        self.layers = layers

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.layers[0] + self.layers[1], 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.hidden(x) @ self.layers[2] + self.layers[3]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    @staticmethod
    def fit(x: np.ndarray, target: np.ndarray, width: int = 128, epochs: int = 30) -> Router:
        rng = np.random.default_rng(3)
        w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], width)), np.zeros(width), rng.normal(0, (1 / width) ** 0.5, (width, target.shape[1])), np.zeros(target.shape[1])]
        out, first, second, t = Router(w), [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), 128):
                some = order[at : at + 128]
                h = out.hidden(x[some])
                error = (out.probabilities(x[some]) - target[some]) / len(some)
                back = (error @ w[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((x[some].T @ back, back.sum(0), h.T @ error, error.sum(0))):
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.001 * (g * g - second[i])
                    w[i] -= 0.003 * (1 - epoch / epochs) * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        return out


def train(sample: np.ndarray) -> tuple[Router, float, int]:
    """(classifier, scale of the vectors, number of parts) for a sample of vectors."""
    scale = float(np.sqrt((sample**2).sum(1).mean())) or 1.0
    x = np.unique(sample / scale, axis=0)  # copies would be one another's only neighbours
    k, parts = min(NEIGHBOURS, len(x) - 1), max(1, min(PARTS, len(x) // SAMPLED))
    if parts < 2:
        return Router([np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)]), scale, 1
    near = neighbour_graph(x, k)
    part = np.zeros(len(x), np.int64)
    bisect(np.arange(len(x)), np.repeat(np.arange(len(x)), k), near.ravel(), parts, np.random.default_rng(5), part)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), k), part[near].ravel()), 1 / (k + 1))
    target[np.arange(len(x)), part] += 1 / (k + 1)
    return Router.fit(x * x.shape[1] ** 0.5, target), scale / x.shape[1] ** 0.5, parts


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _assign(router: Router, scale: float):
    """Rows to their most probable part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router.probabilities(_matrix(batch.column(1)) / scale).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], ["vec_id", "embedding", "part"])

    return run


def _route(router: Router, scale: float, sizes: np.ndarray, need: int, groups: int):
    """Queries to a row for each group with parts that they visit; the parts visited hold ``need`` rows where there are so many."""
    parts = len(sizes)
    group = np.arange(parts) * groups // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = router.probabilities(_matrix(batch.column(1)) / scale)
            order = np.argsort(-p, axis=1, kind="stable")
            before = np.cumsum(sizes[order], 1) - sizes[order]
            visits = np.zeros(p.shape, bool)
            np.put_along_axis(visits, order, (np.arange(parts) < np.ceil(SHARE * parts)) | (before < need), 1)
            for g in range(groups):
                some = np.flatnonzero(visits[:, group == g].any(1))
                own = [np.flatnonzero(v) for v in visits[some] & (group == g)]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, own)]).astype(np.int32), pa.array(np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int32)))
                rows = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(some), g, np.int32)), lists], ["vec_id", "embedding", "group", "visits"])

    return run


def nearest(scores: np.ndarray, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, ids, scores) of each query's k best rows; final scores are summed alike for every pair, so that equal vectors tie."""
    scores[own[:, None] == ids[None]] = -np.inf
    scale = np.sqrt((queries**2).sum(1)) * np.sqrt((x**2).sum(1).max(initial=0)) * 1e-12
    for i, row in enumerate(scores):
        n = min(k, int(np.isfinite(row).sum()))
        if n:
            floor = np.partition(row, len(row) - n)[len(row) - n] - scale[i]
            some = np.flatnonzero(row >= floor)
            exact = (x[some] * queries[i]).sum(1)
            best = np.lexsort((ids[some], -exact))[:n]
            yield i, ids[some][best], exact[best]


def _answer(k: int):
    """One block of rows and one chunk of queries of a group to the queries' best rows; a query meets only the parts that it visits."""

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if held.num_rows and asked.num_rows:
            held, asked = held.sort_by("part").combine_chunks(), asked.combine_chunks()
            x, ids = _matrix(held["embedding"].chunk(0)), held["vec_id"].to_numpy()
            parts, first = np.unique(held["part"].to_numpy(), return_index=True)
            spans = list(zip(parts.tolist(), first.tolist(), [*first[1:].tolist(), len(ids)]))
            for at in range(0, asked.num_rows, HELD):
                some = asked.slice(at, HELD).combine_chunks()
                q, own = _matrix(some["embedding"].chunk(0)), some["vec_id"].to_numpy()
                lists = some["visits"].chunk(0)
                asks = np.c_[np.repeat(np.arange(len(own)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()]
                scores = np.full((len(own), len(ids)), -np.inf)
                for part, lo, hi in spans:
                    who = asks[asks[:, 1] == part, 0]
                    scores[who, lo:hi] = q[who] @ x[lo:hi].T
                for i, rows, exact in nearest(scores, q, own, ids, x, k):
                    out.append((np.full(len(rows), own[i]), rows, exact))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    return run


def _every(n: Column) -> Column:
    """A row for each number under ``n``."""
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each query (vec_id, embedding)."""
    rows, asked = usable(vectors), usable(queries).distinct()
    picked = rows.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    chosen = rows.join(F.broadcast(picked.distinct()), "vec_id", "left_semi").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)  # SAMPLE ids at most
    sample = [np.array(r.embedding) for r in chosen.select("embedding").toLocalIterator()]
    if not sample:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = [len(x) for x in sample]
    size = max(sorted(set(lengths)), key=lengths.count)
    rows, asked = (df.filter(F.size("embedding") == size) for df in (rows, asked))
    router, scale, parts = train(np.array([x for x in sample if len(x) == size]))
    groups = min(GROUPS, parts)
    assigned, sizes = rows.mapInArrow(_assign(router, scale), "vec_id long, embedding array<double>, part int"), np.zeros(parts, np.int64)
    for r in assigned.groupBy("part").agg(F.count("*").alias("n")).collect():  # PARTS rows at most
        sizes[r.part] = r.n
    copies = rows.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]  # a query's own rows do not count
    blocks = F.array(*(F.lit(max(1, -(-int(n) // BLOCK))).cast("long") for n in np.bincount(np.arange(parts) * groups // parts, sizes)))
    chunks = F.lit(max(1, -(-asked.count() // CHUNK))).cast("long")
    mine, place = F.get(blocks, F.col("group")), F.xxhash64("vec_id", "embedding")
    held = assigned.withColumn("group", F.floor(F.col("part") * groups / parts).cast("int")).select("group", F.pmod(place, mine).alias("block"), _every(chunks).alias("chunk"), "vec_id", "embedding", "part")
    wanted = asked.mapInArrow(_route(router, scale, sizes, k + copies, groups), "vec_id long, embedding array<double>, group int, visits array<int>")
    wanted = wanted.select("group", _every(mine).alias("block"), F.pmod(place, chunks).alias("chunk"), "vec_id", "embedding", "visits")
    work = ("group", "block", "chunk")
    found = held.groupBy(*work).cogroup(wanted.groupBy(*work)).applyInArrow(_answer(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each query, every twentieth vec_id."""
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter(F.col("vec_id") % 20 == 0), 20)


QUERIES = {"op8_ann_partitions": op8_ann_partitions}
ORACLE_SQL: dict[str, str] = {}
