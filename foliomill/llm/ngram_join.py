"""Exact self-join of documents on the Jaccard similarity of their word n-grams.

Count vectors: the tokens (n-gram hashes) of a set fall into ``DIMENSIONS`` groups by
hash, and the group counts are a point. The overlap of two sets is at most the sum of
the coordinate minima of their points; an R-tree bounds it for whole boxes of points.

How the work is spread:

1. Equal sets are one node; only one of them takes part from step 3 on.
2. Two linked sets differ in at most d tokens, d known from the smaller size. Tokens of a
   large set fall into groups of a few; sets emit the contents of their first d + 1 groups
   that hold tokens, and at least one of these is the same in both (pigeonhole). Small sets
   emit d + 1 tokens, common ones last. These are the buckets, kept apart by size level;
   a set close to the lower bound of its level emits for the level below as well.
   Buckets with one set are dropped.
3. The hub of a bucket is its set whose buckets are fullest, most likely the text that the others were
   copied from. Each set is paired with the STARS hubs that share most buckets with it. Pairs pass the
   count-vector bound, survivors are verified on their tokens, and components are found.
4. Buckets that still hold several components are searched by R-trees: the sets of a
   bucket are dealt into blocks of bounded size, each block is a tree, and every set outside
   the bucket's main component is looked up in the bucket's trees; survivors are verified.
   A task packs the trees of its blocks together and searches them level by level. Pairs inside a component are
   never made, so a large group of near copies costs as many rows as it has members.
   Sets that nearly link share most of their buckets; each set carries its ``EARLY`` first
   buckets, and a pair known to meet in an earlier one is left to that one.

No bucket is cut off and no candidate is dropped: links are complete.

Defined results: a null or empty text, or one without words, has an empty set, is linked
with nothing and is its own component; repeated rows are copies of one another; rows
with a null doc_id take part, and a component of such rows alone has a null name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RollingHash, Scratch, buffers, components, free_name, mixed, names, slices, table, texts, word_hashes

DIMENSIONS = 128
#: Groups of the finer point that a pair has to pass before its tokens are fetched.
FINE = 512
#: Pairs that a set makes in step 3.
STARS = 2
#: Sets of an R-tree, entries of one of its nodes, and pairs of members and visitors in the trees that a task searches at once.
BLOCK, NODE, TOGETHER = 1024, 4, 1 << 20
#: First buckets that a set carries in step 4.
EARLY = 8
#: Sets from this size on emit groups of tokens; documents and tokens of the list of common ones.
GROUPED, SAMPLE, COMMON = 256, 2_048, 4_096
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word windows; a shorter text is one window."""
    if not len(words):
        return words
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed(out * _STEP + words[i : len(words) - size + 1 + i])
    return np.unique(out)


def bags(batch: pa.RecordBatch, n: int, hashes: RollingHash) -> Iterator[np.ndarray]:
    data, ends = buffers(batch.column(batch.schema.get_field_index("text")))
    # A space at each end keeps words inside their texts.
    spaced = np.insert(data, ends[1:], 32)
    words, starts, _ = word_hashes(spaced, hashes)
    cut = np.searchsorted(starts, ends + np.arange(len(ends)))
    for i in range(batch.num_rows):
        yield shingles(words[cut[i] : cut[i + 1]], n)


def _point(bag: np.ndarray) -> bytes:
    """Group counts, each in the fewest bytes that hold the greatest one."""
    counts = np.bincount((bag >> np.uint64(57)).astype(np.int64), minlength=DIMENSIONS)
    return counts.astype(np.min_scalar_type(counts.max())).tobytes()


def _counts(point: bytes) -> np.ndarray:
    return np.frombuffer(point, f"u{len(point) // DIMENSIONS}").astype(np.int32)


def _fine(bag: np.ndarray) -> bytes:
    """The same over FINE groups; empty where a count is too large to store, and then nothing is ruled out."""
    counts = np.bincount((bag >> np.uint64(55)).astype(np.int64), minlength=FINE)
    return counts.astype(np.uint16).tobytes() if counts.max() < 1 << 16 else b""


def differing(n: int, percent: int) -> int:
    """Most tokens that stand in one only of two linked sets, of which the smaller has ``n``."""
    return n * (100 - percent) // percent


def _buckets(bag: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    n, need, out = len(bag), differing(len(bag), percent) + 1, []
    if need == 1:
        return np.zeros(0, np.uint64)
    level = n.bit_length() - 1
    for k in (level, level - 1) if n * percent < 100 << level else (level,):
        if 1 << k < GROUPED:
            late = np.isin(bag, common, assume_unique=True)
            keys = np.concatenate([bag[~late], bag[late]])[:need]
        else:
            # 15 % more groups than could be needed: that too many of them are empty has a chance below 1e-9.
            groups = (differing(2 << k, percent) + 1) * 115 // 100
            spread = mixed(bag + _STEP)
            of = (spread % np.uint64(groups)).astype(np.int64)
            sums = np.zeros(groups, np.uint64)
            np.add.at(sums, of, mixed(spread))
            held = np.flatnonzero(np.bincount(of, minlength=groups))[:need]
            keys = sums[held] + held.astype(np.uint64) * _STEP
        out.append(mixed(keys + np.uint64(k + 1)))
    return np.concatenate(out)


def _tokens(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RollingHash(1 << 20)
        for batch in slices(batches, "text", 1 << 19):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*bags(batch, n, hashes), np.zeros(0, np.uint64)]).view(np.int64))], ["token"])

    return run


def common_tokens(rows: DataFrame, n: int) -> np.ndarray:
    """Tokens of many documents, at most COMMON, from a sample of SAMPLE documents: they only order the tokens, so any answer is right."""
    picked = rows.select("row").orderBy(F.xxhash64("row", F.lit(1)), "row").limit(SAMPLE)
    sample = rows.join(F.broadcast(picked), "row", "left_semi").select("text")  # SAMPLE keys at most
    counts = sample.mapInArrow(_tokens(n), "token long").groupBy("token").agg(F.count("*").alias("c")).filter(F.col("c") > SAMPLE // 1000)
    return np.sort(np.array([r.token for r in counts.orderBy(F.desc("c"), "token").limit(COMMON).collect()], np.int64).view(np.uint64))


def tokens_of(n: int):
    """Texts to the tokens of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RollingHash(1 << 20)
        for batch in slices(batches, "text", 1 << 19):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b in bags(batch, n, hashes)], pa.binary())], ["set", "tokens"])

    return run


def name_of(bag: np.ndarray) -> int:
    """Equal sets have equal names."""
    return xxhash.xxh3_64_intdigest(bag.tobytes())


def _describe(n: int, percent: int, common: np.ndarray):
    """Texts to size, name, points and buckets of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RollingHash(1 << 20)
        for batch in slices(batches, "text", 1 << 19):
            own = list(bags(batch, n, hashes))
            names = np.array([name_of(b) for b in own], np.uint64).view(np.int64)
            keys = [_buckets(b, percent, common) for b in own]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)]).astype(np.int32), pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(b) for b in own], pa.int64()), pa.array(names), pa.array([_point(b) for b in own], pa.binary()), pa.array([_fine(b) for b in own], pa.binary()), lists],
                ["doc_id", "row", "n", "set", "point", "fine", "buckets"],
            )

    return run


def _need(a, b, percent: int):
    """The least overlap of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def _bounded(percent: int):
    """Pairs (a, b, fine points of both) whose summed coordinate minima allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint16) for v in (x, y))
                good.append(not len(p) or not len(q) or int(np.minimum(p, q).sum(dtype=np.int64)) >= _need(int(p.sum(dtype=np.int64)), int(q.sum(dtype=np.int64)), percent))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return run


class CountForest:
    """R-trees over the count vectors of blocks, packed by size; a box keeps the greatest count of each coordinate and the least size.

    Entries of a level stand by block, so that one pass over a level serves the trees of all blocks.
    """

    def __init__(self, points: np.ndarray, block: np.ndarray):
        size = points.sum(1)
        self.order = np.lexsort((size, block))
        top, least, of = points[self.order], size[self.order], block[self.order]
        self.levels = [(top, least, None, None)]
        while (of[1:] == of[:-1]).any():
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            place = np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)]))
            first = np.flatnonzero(place % NODE == 0)
            self.levels.append((np.maximum.reduceat(top, first), np.minimum.reduceat(least, first), first, np.diff(np.r_[first, len(of)])))
            top, least, of = *self.levels[-1][:2], of[first]
        self.roots = of

    def search(self, points: np.ndarray, block: np.ndarray, percent: int, fresh=None) -> tuple[np.ndarray, np.ndarray]:
        """(visitor, member) of all pairs in a block that may be linked; ``fresh`` names those of given pairs that are asked for."""
        size, at = points.sum(1), np.searchsorted(self.roots, block)
        visitor = np.flatnonzero(at < len(self.roots))
        visitor = visitor[self.roots[at[visitor]] == block[visitor]]
        at = at[visitor]
        for depth, (top, least, first, count) in reversed(list(enumerate(self.levels))):
            if fresh and not depth:
                asked = fresh(visitor, self.order[at])
                visitor, at = visitor[asked], at[asked]
            near = [np.minimum(top[at[i : i + 4_096]], points[visitor[i : i + 4_096]]).sum(1) for i in range(0, len(at), 4_096)]
            good = np.concatenate([*near, np.zeros(0, np.int64)]) >= _need(size[visitor], least[at], percent)
            visitor, at = visitor[good], at[good]
            if depth:
                n = count[at]
                visitor, at = np.repeat(visitor, n), np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return visitor, self.order[at]


def _met_before(early: np.ndarray, own: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """For each pair, whether the early buckets of its two sets share one before ``bucket``."""
    met = np.zeros(len(bucket), bool)
    for k in range(EARLY):
        met |= (own[:, k] < bucket) & (early == own[:, k, None]).any(1)
    return met


class Entries:
    """Sets of many lists end to end, with the first and the number of each list."""

    def __init__(self, lists: pa.ListArray):
        self.flat, self.n = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.sets, self.component = self.flat.field("set").to_numpy(), self.flat.field("component").to_numpy()

    @cached_property
    def early(self) -> np.ndarray:
        lists = self.flat.field("early")
        out = np.full((len(lists), EARLY), np.iinfo(np.int64).max)
        out[np.arange(EARLY) < lists.value_lengths().to_numpy()[:, None]] = lists.flatten().to_numpy()
        return out

    def within(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of neighbouring lists, and the list of each."""
        return np.arange(self.first[blocks[0]], self.first[blocks[-1]] + self.n[blocks[-1]]), np.repeat(blocks, self.n[blocks])

    def counts(self, which: np.ndarray) -> np.ndarray:
        points = self.flat.field("point").take(pa.array(which, pa.int64())).to_pylist()
        return np.array([_counts(x) for x in points], np.int32).reshape(-1, DIMENSIONS)


def _new_pairs(held: Entries, asked: Entries, member: np.ndarray, visitor: np.ndarray, bucket: np.ndarray, main: np.ndarray) -> np.ndarray:
    """Which pairs are of different components, and made neither the other way round nor in an earlier bucket."""
    kind = held.component[member]
    # A member outside the main component is a visitor too: the pair is made once.
    good = np.flatnonzero((kind != asked.component[visitor]) & ((kind == main) | (asked.sets[visitor] < held.sets[member])))
    return good[~_met_before(held.early[member[good]], asked.early[visitor[good]], bucket[good])]


def _search(percent: int):
    """Blocks (bucket, main component, members, visitors) to candidate pairs of different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, main = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held, asked = Entries(batch.column(2)), Entries(batch.column(3))
            pairs = [np.zeros((0, 2), np.int64)]
            part = np.cumsum(held.n * asked.n) // TOGETHER
            for k in np.unique(part):
                blocks = np.flatnonzero(part == k)
                (members, tree), (visitors, of) = held.within(blocks), asked.within(blocks)

                def fresh(visitor: np.ndarray, member: np.ndarray) -> np.ndarray:
                    return _new_pairs(held, asked, members[member], visitors[visitor], bucket[of[visitor]], main[of[visitor]])

                visitor, member = CountForest(held.counts(members), tree).search(asked.counts(visitors), of, percent, fresh)
                pairs.append(np.c_[asked.sets[visitors[visitor]], held.sets[members[member]]])
            found = np.sort(np.concatenate(pairs), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def _verified(percent: int):
    """Pairs (a, b, tokens of a, tokens of b) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(t.as_buffer(), np.uint64) for t in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return run


PAIRS = "a long, b long"


def verified(scratch: Scratch, rows: DataFrame, sets: DataFrame, pairs: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """Those of the ``pairs`` (a, b) of sets that are linked by their whole sets; ``sets`` (set, row) names a text of each set."""
    pairs = scratch.written(pairs, f"{name}-pairs")
    scratch.drop()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(sets, "set")
    held = rows.join(ends, "row").select("set", "text").mapInArrow(tokens_of(n), "set long, tokens binary")
    held = scratch.written(held, f"{name}-bags")
    scratch.drop()
    p, q = held.select(F.col("set").alias("a"), F.col("tokens").alias("p")), held.select(F.col("set").alias("b"), F.col("tokens").alias("q"))
    links = scratch.written(pairs.join(p, "a").join(q, "b").select("a", "b", "p", "q").mapInArrow(_verified(percent), PAIRS), f"{name}-links")
    scratch.drop(pairs, held)
    return links


def head() -> Column:
    """The smallest doc_id of a set, with the row that it stands in."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "row")).alias("head")


def reported(scratch: Scratch, sizes: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, row and stays of each row of ``sizes``, by the components ``found`` of the sets in ``nodes``."""
    found = nodes.select("set", "head").join(found.withColumnRenamed("node", "set"), "set", "left").select("set", "head", F.coalesce("component", "set").alias("component"))
    least = found.groupBy("component").agg(F.min("head").alias("least"))
    named = scratch.written(found.join(least, "component").select("set", "least"), "named", keep=True)
    alone = F.col("n") == 0
    return sizes.join(named, "set", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        "row", (alone | (F.col("row") == F.col("least.row"))).alias("stays"),
    )


def link_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    ``row`` (a hash of id and text) and ``stays`` follow: one row, or its copies, stays for each component.
    """
    rows = texts(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    with Scratch(docs.sparkSession) as scratch:
        described = rows.mapInArrow(_describe(n, percent, common_tokens(rows, n)), "doc_id long, row long, n long, set long, point binary, fine binary, buckets array<long>")
        every = scratch.written(described, "every")
        sizes = scratch.written(every.select("doc_id", "row", "n", "set"), "sizes", keep=True)
        nodes = scratch.written(every.filter("n > 0").groupBy("set").agg(head(), F.min("point").alias("point"), F.min("fine").alias("fine")), "nodes")
        points = nodes.select("set", "head.row", "point")
        spread = every.select("set", F.explode("buckets").alias("bucket"))
        shared = scratch.written(spread.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
        scratch.drop()
        held = scratch.written(spread.join(shared, "bucket").groupBy("bucket", "set").agg(F.max("c").alias("c")), "held")
        scratch.drop(every, shared)
        near, stars = starred(scratch, held, "bucket", STARS)

        def bound(pairs: DataFrame) -> DataFrame:
            p, q = (nodes.select(F.col("set").alias(end), F.col("fine").alias(name)) for end, name in (("a", "p"), ("b", "q")))
            return pairs.join(p, "a").join(q, "b").select("a", "b", "p", "q").mapInArrow(_bounded(percent), PAIRS)

        sets = points.select("set", "row")
        links = verified(scratch, rows, sets, bound(stars), n, percent, "star")
        found = components(scratch, links)
        again = scratch.written(_crossing(near, found, points, percent), "crossing")
        if not again.isEmpty():
            scratch.drop()
            found = components(scratch, links.unionByName(verified(scratch, rows, sets, bound(again), n, percent, "tree")))
        return reported(scratch, sizes, nodes, found)


def starred(scratch: Scratch, held: DataFrame, key: str, stars: int) -> tuple[DataFrame, DataFrame]:
    """(key, set) of keys with several sets, and pairs of each set with the ``stars`` hubs that share most keys with it.

    ``held``: key, set and c, the sets of the key. A key's hub is its set whose keys are fullest.
    """
    full = held.join(held.groupBy("set").agg(F.sum("c").alias("w")), "set")
    hubs = scratch.written(full.groupBy(key).agg(F.max(F.struct("w", "set")).alias("hub"), F.count("*").alias("k")).filter("k > 1").select(key, F.col("hub.set").alias("hub")), "hubs")
    near = scratch.written(held.drop("c").join(hubs, key), "near")
    scratch.drop(held, hubs)
    # A set has a bounded number of keys, and no more hubs.
    shares = near.filter("set <> hub").groupBy("set", "hub").agg(F.count("*").alias("c")).groupBy("set").agg(F.collect_list(F.struct("c", "hub")).alias("hubs"))
    best = shares.select("set", F.explode(F.slice(F.sort_array("hubs", False), 1, stars)).alias("best"))
    return near, best.select(F.least("set", "best.hub").alias("a"), F.greatest("set", "best.hub").alias("b")).distinct()


def keep_one(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Rows of ``docs``, with all their columns: one of each group of linked documents."""
    own = free_name(docs, "row")
    stays = link_components(docs, n, percent).filter("stays").select(F.col("row").alias(own)).distinct()
    row = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumn(own, row).join(stays, own, "left_semi").dropDuplicates([own]).select(names(docs))


def _crossing(near: DataFrame, found: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components that share a bucket."""
    labelled = near.select("bucket", "set").join(found.withColumnRenamed("node", "set"), "set", "left").select("bucket", "set", F.coalesce("component", "set").alias("component"))
    mixed_ = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("bucket")
    inside = labelled.join(mixed_, "bucket")
    kinds = inside.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    main = kinds.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("c")).select("bucket", F.col("main.component").alias("main"), F.ceil(F.col("c") / BLOCK).alias("blocks"), F.ceil((F.col("c") - F.col("main.c")) / BLOCK).alias("chunks"))
    # A set has a bounded number of buckets.
    early = inside.groupBy("set").agg(F.slice(F.sort_array(F.collect_list("bucket")), 1, EARLY).alias("early"))
    placed = inside.join(main, "bucket").join(points.select("set", "point").join(early, "set"), "set")
    return dealt(placed, "bucket", F.struct("set", "component", "point", "early")).mapInArrow(_search(percent), PAIRS).distinct()


def dealt(placed: DataFrame, key: str, entry: Column) -> DataFrame:
    """Members and visitors of each key (those outside its main component) in lists: every visitor meets every member once.

    ``placed``: key, main, set, component, the number of blocks that members go to, and of chunks of visitors.
    """
    own = F.pmod(F.xxhash64("set"), F.col("blocks"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    members = placed.select(key, "main", own.alias("block"), every("chunks").alias("chunk"), entry.alias("member"), F.lit(None).alias("visitor"))
    visitors = placed.filter("component <> main").select(key, "main", every("blocks").alias("block"), F.pmod(F.xxhash64("set"), F.col("chunks")).alias("chunk"), F.lit(None).alias("member"), entry.alias("visitor"))
    blocks = members.unionByName(visitors).groupBy(key, "main", "block", "chunk").agg(F.collect_list("member").alias("members"), F.collect_list("visitor").alias("visitors"))
    return blocks.filter("size(members) > 0 and size(visitors) > 0").select(key, "main", "members", "visitors")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component: three words a shingle, similarity 0.9 or more."""
    return link_components(table(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op2_ngram_join": op2_ngram_join}
ORACLE_SQL: dict[str, str] = {}
