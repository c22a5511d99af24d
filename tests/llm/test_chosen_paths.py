import random

import numpy as np

from foliomill.llm import chosen_paths
from foliomill.llm.chosen_paths import children, drop_near_copies, near_groups, signatures
from foliomill.llm.registry import QUERIES
from tests.conftest import SF
from tests.llm.test_ngram_join import brute

DOCS = "doc_id long, text string"


def rows_of(r, groups):
    vocab = ["w%d" % i for i in range(300)]
    rows, d = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One Two"), (7, "One Two"), (8, "É é"), (9, "é é"), (None, "of it all and more"), (None, "of it all and more"), (None, "x")], 100
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.choice([4, 5, 9, 20, 60, 200, 500]))]
        rows.append((d, " ".join(base)))
        for _ in range(r.randint(0, 6)):
            d += 1
            chain = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 30))):
                chain[r.randrange(len(chain))] = r.choice(vocab)
            rows.append((d, " ".join(chain)))
        d += 1
    return rows


def same(got, rows, n=4, percent=80):
    known = [x for x in rows if x[0] is not None]
    assert sorted(tuple(x)[:3] for x in got if x[0] is not None) == brute(known, n, percent)


def test_against_brute_force(spark):
    rows = rows_of(random.Random(12), 40)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as row", "2 as node", "3 as `a.b`").repartition(3)
    got = near_groups(docs).collect()
    same(got, rows)
    assert sorted((x.n_shingles, x.component_id) for x in got if x.doc_id is None) == [(1, None), (2, None), (2, None)]
    same(near_groups(docs, 2, 60).collect(), rows, 2, 60)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} - {None} == {c for _, _, c in brute([x for x in rows if x[0] is not None], 4, 80)}


def test_groups_that_share_passages_and_copies_branch_on(spark, monkeypatch):
    monkeypatch.setattr(chosen_paths, "LEAF", 3)
    r = random.Random(4)
    words = lambda n: [r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 9) for _ in range(n)]
    common, base = words(60), words(80)
    rows = [(i, " ".join(common + words(r.randint(10, 60)))) for i in range(60)]
    for i in range(100, 200):
        copy = list(base)
        for _ in range(r.randint(0, 4)):
            copy[r.randrange(len(copy))] = "x%d" % i
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    same(near_groups(docs).collect(), rows)
    same(near_groups(docs, depth=2).collect(), rows)


def test_trees_reach_their_recall():
    """Pairs just over the threshold, followed down to eight levels in one tree after another."""
    rng = np.random.default_rng(5)
    missed, pairs = 0, 300
    for _ in range(pairs):
        tokens = rng.integers(0, 2**64, 220, dtype=np.uint64)
        point = signatures([tokens[:200], tokens[20:]])  # 180 of 220 tokens
        met = False
        for seed in range(chosen_paths.TREES):
            live = np.array([seed + 1], np.uint64) * chosen_paths._STEP
            for _ in range(chosen_paths.DEPTH):
                a, b = (set(children(live, np.repeat(point[i : i + 1], len(live), 0), 80)[1].tolist()) for i in (0, 1))
                live = np.array(sorted(a & b), np.uint64)
                if not len(live):
                    break
            met = met or len(live) > 0
        missed += not met
    assert missed <= 2


def test_a_node_selects_as_many_coordinates_as_the_threshold_asks():
    nodes = np.random.default_rng(1).integers(0, 2**64, 20_000, dtype=np.uint64)
    for percent in (40, 80, 100):
        assert abs(chosen_paths.branches(nodes, percent).mean() - 100 / percent) < 0.02
    which, found = children(nodes, np.random.default_rng(2).integers(0, 2**32, (20_000, chosen_paths.COORDINATES), dtype=np.uint64).astype(np.uint32), 40)
    assert len(set(zip(which.tolist(), found.tolist()))) == len(which)


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert near_groups(none).count() == drop_near_copies(none).count() == 0


def test_query(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op12_chosen_paths"](spark, SF).collect()
    same(got, rows)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)
