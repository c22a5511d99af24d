"""Near-duplicate documents by a chosen-path similarity join of their word n-grams.

A set's signature is its smallest hash under each of ``COORDINATES`` hash functions; two sets
agree in a coordinate with a chance of their Jaccard similarity. A tree branches on
coordinates: each node selects 100 / ``percent`` of them on average, by a hash of its own
name, and a document goes on to one child for each, named by the node, the coordinate and the
document's minwise token there. Documents over the threshold stay together in one child or
more on average, others part within a few levels. Nodes with little work are compared
exhaustively; large ones branch on, down to ``DEPTH``.

Recall: a pair at a similarity of 0.8 meets in one tree with a chance of 0.84 after one level,
0.58 after four and 0.41 after eight. ``TREES`` independent trees miss it with a chance below
1e-12, 2e-6 and 3e-4; groups are joined by many pairs and lose less.

How the work is spread:

1. Equal sets are one. The trees' first level is dealt by node; nodes of one set are dropped.
2. Each set is paired with the hubs that share most nodes with it. Pairs pass the bound of
   sizes and signatures, and survivors are verified on their whole sets. What is linked is
   one component, and no pair inside a component is made from here on, so that a large group
   of near copies costs as many rows as it has members.
3. ROUNDS times, each set outside the largest component of its nodes looks at one block of
   each node, and its STARS closest sets there by counts are verified. Near copies of
   near copies come together this way, by a number of pairs that grows with their number.
4. Nodes that hold several components go on. Where the product of all sets and of those outside
   the largest component is at most LEAF squared, the node is a leaf; other nodes branch. At
   DEPTH all nodes left are compared, in blocks of bounded size. Survivors are verified.

No node is cut off and no candidate dropped but by the bounds. A signature rules out pairs
whose agreement lies SLACK standard deviations under what the threshold makes likely, which
a linked pair has a chance of about 3e-6 of. What is left is bounded by counts: the tokens
of a set fall into GROUPS groups by hash, and two sets share at most the sum of the smaller
counts. Every link is confirmed on whole sets.

Defined results: a null or empty text, or one without words, has an empty set, is linked with
nothing and is its own component; a text of fewer words is one n-gram; repeated rows are
copies of one another; rows with a null doc_id take part, and a component of such rows alone
has a null name. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RollingHash, Scratch, components, free_name, mixed, names, slices, table, texts
from .ngram_join import PAIRS, Entries, bags, dealt, head, name_of, reported, starred, verified

COORDINATES, TREES, DEPTH = 64, 16, 8
#: A node is a leaf up to the work of comparing so many sets with each other; sets of a block; standard deviations.
LEAF, BLOCK, SLACK = 2_048, 1_024, 5.0
#: Groups that tokens are counted in.
GROUPS = 512
#: Pairs that a set makes in steps 2 and 3, rounds of step 3, and pairs that a task compares at once.
STARS, ROUNDS, TOGETHER = 2, 1, 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(12).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest hash of each set under each coordinate's function; empty sets have the largest value everywhere."""
    out = np.full((len(sets), COORDINATES), 2**32 - 1, np.uint32)
    sizes = np.array([len(x) for x in sets], np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        tokens, starts = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
        for i, factor in enumerate(_FACTORS):
            out[full, i] = np.minimum.reduceat(tokens * factor, starts) >> np.uint64(32)
    return out


def branches(node: np.ndarray, percent: int) -> np.ndarray:
    """How many coordinates each node selects: 100 / ``percent`` on average."""
    rest = (100 % percent << 32) // percent
    return 100 // percent + ((mixed(node + _STEP) >> np.uint64(32)) < rest)


def children(node: np.ndarray, signature: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(which row, child) of each coordinate that the rows' nodes select; a node's coordinates differ."""
    many = branches(node, percent)
    which = np.repeat(np.arange(len(node)), many)
    place = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    first, stride = mixed(node[which]), mixed(node[which] ^ _STEP) | np.uint64(1)
    at = ((first + place.astype(np.uint64) * stride) % np.uint64(COORDINATES)).astype(np.int64)
    return which, child(node[which], at, signature[which, at])


def child(node: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(mixed(node * _STEP + coordinate.astype(np.uint64) + np.uint64(1)) + token)


def counted(bag: np.ndarray) -> bytes:
    """Tokens by group, each count in the fewest bytes that hold the greatest one."""
    counts = np.bincount((bag >> np.uint64(55)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.min_scalar_type(counts.max())).tobytes()


def _describe(n: int):
    """Texts to size, name and signature of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RollingHash(1 << 20)
        for batch in slices(batches, "text", 1 << 19):
            sets = list(bags(batch, n, hashes))
            own = np.array([name_of(b) for b in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(b) for b in sets], pa.int64()), pa.array(own), pa.array([x.tobytes() for x in signatures(sets)], pa.binary()), pa.array([counted(b) for b in sets], pa.binary())],
                ["doc_id", "row", "n", "set", "signature", "counts"],
            )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _counts(column: pa.Array) -> np.ndarray:
    rows = [np.frombuffer(x, f"u{len(x) // GROUPS}") for x in column.to_pylist()]
    return np.array(rows, np.result_type(np.uint8, *{x.dtype for x in rows})).reshape(-1, GROUPS)


def _plant(trees: int, percent: int):
    """Sets to the first level of the trees; the trees' coordinates follow one another, so that they differ while there are enough."""
    seeds = mixed(np.arange(1, trees + 1, dtype=np.uint64) * _STEP)
    many = branches(seeds, percent)
    seed, at = np.repeat(seeds, many), np.arange(many.sum()) % COORDINATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _matrix(batch.column(1))[:, at]
            nodes = child(np.broadcast_to(seed, tokens.shape), np.broadcast_to(at, tokens.shape), tokens)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), len(at)))], ["node", "set"])

    return run


def _branch(percent: int):
    """Rows (node, set, component, signature) to rows of the nodes' children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, nodes = children(batch.column(0).to_numpy().view(np.uint64), _matrix(batch.column(3)), percent)
            which = pa.array(which)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), batch.column(1).take(which), batch.column(2).take(which)], ["node", "set", "component"])

    return run


def agreeing(percent: int) -> int:
    """Coordinates in which linked sets agree, but for the chance that SLACK leaves."""
    s = percent / 100
    return max(0, math.ceil(COORDINATES * s - SLACK * math.sqrt(COORDINATES * s * (1 - s))))


def _alike(percent: int):
    """Pairs (a, b, sizes of both, signatures of both) that their sizes and signatures allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            good = (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & ((_matrix(batch.column(4)) == _matrix(batch.column(5))).sum(1) >= agreeing(percent))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good)) for i in (0, 1)], ["a", "b"])

    return run


def _compare(percent: int, closest: bool = False):
    """Blocks (node, main component, members, visitors) to pairs of different components that sizes and signatures allow.

    ``closest``: only the best one of each visitor. Columns: visitor, member and the greatest similarity that the counts allow, in millionths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            main, held, asked = batch.column(1).to_numpy(), Entries(batch.column(2)), Entries(batch.column(3))
            sizes = [x.flat.field("n").to_numpy() for x in (held, asked)]
            # The low byte of a coordinate tells nearly as much as all four.
            points = [_matrix(x.flat.field("signature")).astype(np.uint8) for x in (held, asked)]
            counts = [_counts(x.flat.field("counts")) for x in (held, asked)]
            pairs = [np.zeros((0, 3), np.int64)]
            of = np.repeat(np.arange(len(main)), asked.n)
            part = np.cumsum(held.n[of]) // TOGETHER
            for k in np.unique(part):
                some = np.flatnonzero(part == k)
                many = held.n[of[some]]
                visitor = np.repeat(some, many)
                member = np.repeat(held.first[of[some]] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                kind = held.component[member]
                # A member outside the main component is a visitor too: the pair is made once.
                fresh = (kind != asked.component[visitor]) & ((kind == main[of[visitor]]) | (asked.sets[visitor] < held.sets[member]))
                m, n = sizes[0][member], sizes[1][visitor]
                good = np.flatnonzero(fresh & (100 * np.minimum(m, n) >= percent * np.maximum(m, n)))
                good = good[(points[0][member[good]] == points[1][visitor[good]]).sum(1) >= agreeing(percent)]
                both = m[good] + n[good]
                shared = np.concatenate([np.zeros(0, np.int64), *(np.minimum(counts[0][member[x]], counts[1][visitor[x]]).sum(1, dtype=np.int64) for x in np.split(good, range(4_096, len(good), 4_096)))])
                near = 100 * shared >= percent * (both - shared)
                good, agree = good[near], (1_000_000 * shared // np.maximum(both - shared, 1))[near]
                if closest:
                    order = np.lexsort((held.sets[member[good]], -agree, visitor[good]))
                    order = order[np.r_[True, np.diff(visitor[good][order]) != 0][: len(order)]]
                    good, agree = good[order], agree[order]
                pairs.append(np.c_[asked.sets[visitor[good]], held.sets[member[good]], agree])
            found = np.concatenate(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(3)], ["visitor", "member", "agree"])

    return run


MET = "visitor long, member long, agree long"
ENTRY = ("set", "component", "n", "signature", "counts")


def _several(rows: DataFrame) -> DataFrame:
    """node, main, c and others: nodes of ``rows`` (node, set, component) that hold several components, the largest one, all sets and those outside it."""
    kinds = rows.groupBy("node", "component").agg(F.count("*").alias("c"))
    main = kinds.groupBy("node").agg(F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("c"), F.count("*").alias("kinds")).filter("kinds > 1")
    return main.select("node", F.col("main.component").alias("main"), "c", (F.col("c") - F.col("main.c")).alias("others"))


def _closest(rows: DataFrame, nodes: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of each set outside its nodes' largest components with the STARS sets closest to it, in one block of each node."""
    placed = rows.join(_several(rows), "node").select("node", "main", "set", "component", F.ceil(F.col("c") / BLOCK).alias("blocks")).join(nodes.select("set", "n", "signature", "counts"), "set")
    at = lambda *of: F.pmod(F.xxhash64("set", *of), F.col("blocks")).alias("block")
    members = placed.select("node", "main", at(), F.struct(*ENTRY).alias("member"), F.lit(None).alias("visitor"))
    visitors = placed.filter("component <> main").select("node", "main", at(F.lit(turn)), F.lit(None).alias("member"), F.struct(*ENTRY).alias("visitor"))
    blocks = members.unionByName(visitors).groupBy("node", "main", "block").agg(F.collect_list("member").alias("members"), F.collect_list("visitor").alias("visitors"))
    met = blocks.filter("size(members) > 0 and size(visitors) > 0").select("node", "main", "members", "visitors").mapInArrow(_compare(percent, True), MET).distinct()
    # A set stands in a bounded number of nodes, and has one answer in each.
    few = met.groupBy("visitor").agg(F.slice(F.sort_array(F.collect_list(F.struct("agree", "member")), False), 1, STARS).alias("best")).select("visitor", F.explode("best.member").alias("member"))
    return few.select(F.least("visitor", "member").alias("a"), F.greatest("visitor", "member").alias("b")).distinct()


def _candidates(scratch: Scratch, rows: DataFrame, nodes: DataFrame, percent: int, depth: int) -> DataFrame:
    """Pairs of different components that meet in a leaf under the nodes of ``rows`` (node, set, component)."""
    found = []
    for level in range(1, depth + 1):
        inside = scratch.written(rows.join(_several(rows), "node"), "inside")
        leaf = F.lit(True) if level == depth else F.col("c") * F.col("others") <= LEAF * LEAF
        placed = inside.filter(leaf).select("node", "main", "set", "component", F.ceil(F.col("c") / BLOCK).alias("blocks"), F.ceil(F.col("others") / BLOCK).alias("chunks"))
        placed = placed.join(nodes.select("set", "n", "signature", "counts"), "set")
        met = dealt(placed, "node", F.struct(*ENTRY)).mapInArrow(_compare(percent), MET)
        found.append(scratch.written(met.select(F.least("visitor", "member").alias("a"), F.greatest("visitor", "member").alias("b")).distinct(), "met"))
        large = inside.filter(~leaf).select("node", "set", "component")
        if level == depth or large.isEmpty():
            break
        rows = scratch.written(large.join(nodes.select("set", "signature"), "set").select("node", "set", "component", "signature").mapInArrow(_branch(percent), "node long, set long, component long"), "rows")
        scratch.drop(inside)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()


def near_groups(docs: DataFrame, n: int = 4, percent: int = 80, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    ``row`` (a hash of id and text) and ``stays`` follow: one row, or its copies, stays for each component.
    """
    rows = texts(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    with Scratch(docs.sparkSession) as scratch:
        every = scratch.written(rows.mapInArrow(_describe(n), "doc_id long, row long, n long, set long, signature binary, counts binary"), "every")
        sizes = scratch.written(every.select("doc_id", "row", "n", "set"), "sizes", keep=True)
        nodes = scratch.written(every.filter("n > 0").groupBy("set").agg(head(), F.min("n").alias("n"), F.min("signature").alias("signature"), F.min("counts").alias("counts")), "nodes")
        scratch.drop(every)
        spread = nodes.select("set", "signature").mapInArrow(_plant(trees, percent), "node long, set long")
        shared = scratch.written(spread.groupBy("node").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
        held = scratch.written(spread.join(shared, "node"), "held")
        scratch.drop(shared)
        near, stars = starred(scratch, held, "node", STARS)
        p, q = (nodes.select(F.col("set").alias(end), F.col("n").alias(size), F.col("signature").alias(name)) for end, size, name in (("a", "m", "p"), ("b", "n", "q")))
        sets = nodes.select("set", "head.row")
        alike = stars.join(p, "a").join(q, "b").select("a", "b", "m", "n", "p", "q").mapInArrow(_alike(percent), PAIRS)
        links = verified(scratch, rows, sets, alike, n, percent, "star")

        def labelled() -> DataFrame:
            found = components(scratch, links).withColumnRenamed("node", "set")
            return scratch.written(near.select("node", "set").join(found, "set", "left").select("node", "set", F.coalesce("component", "set").alias("component")), "labelled")

        own = labelled()
        for turn in range(ROUNDS):
            more = verified(scratch, rows, sets, _closest(own, nodes, percent, turn), n, percent, "close")
            if more.isEmpty():
                break
            links = links.unionByName(more)
            scratch.drop(own)
            own = labelled()
        again = scratch.written(_candidates(scratch, own, nodes, percent, depth), "candidates")
        if not again.isEmpty():
            scratch.drop()
            links = links.unionByName(verified(scratch, rows, sets, again, n, percent, "leaf"))
        found = components(scratch, links)
        return reported(scratch, sizes, nodes, found)


def drop_near_copies(docs: DataFrame, n: int = 4, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, with all their columns: one of each group of near copies, its smallest doc_id."""
    own = free_name(docs, "row")
    stays = near_groups(docs, n, percent).filter("stays").select(F.col("row").alias(own)).distinct()
    row = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumn(own, row).join(stays, own, "left_semi").dropDuplicates([own]).select(names(docs))


def op12_chosen_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, component and whether it names it: four words a shingle, similarity 0.8 or more."""
    found = near_groups(table(spark, sf_dir, "documents"), 4, 80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {"op12_chosen_paths": op12_chosen_paths}
#: A join on similarity is quadratic in SQL.
ORACLE_SQL: dict[str, str] = {}
