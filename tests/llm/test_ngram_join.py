import random
import re

import numpy as np
import pyarrow as pa

from foliomill.llm import ngram_join
from foliomill.llm.ngram_join import CountForest, keep_one, link_components


def brute(rows, n=3, percent=90):
    sets = []
    for _, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i in range(len(rows)):
        ids.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(ids[find(i)])) for i in range(len(rows)))


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One Two"), (7, "One Two"), (8, "É é"), (9, "é é")]
    vocab = ["w%d" % i for i in range(40)]
    d = 100
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([9, 11, 12, 20, 21, 60, 140, 200, 300]))]
        rows.append((d, " ".join(base)))
        chain = base
        for _ in range(r.randint(0, 6)):
            d += 1
            chain = list(chain if r.random() < 0.7 else base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                chain[r.choice([0, len(chain) - 1, r.randrange(len(chain))])] = r.choice(vocab)
            if r.random() < 0.3:
                chain.append(r.choice(vocab))
            rows.append((d, " ".join(chain)))
        d += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "5 as n", "6 as row", "7 as set")
    assert sorted(tuple(x)[:3] for x in link_components(df).collect()) == brute(rows)
    assert sorted(tuple(x)[:3] for x in link_components(df, 2, 60).collect()) == brute(rows, 2, 60)


def entries(sets, some):
    return [{"set": s, "component": sets[s][1], "point": sets[s][0], "early": sets[s][2]} for s in some]


def test_pairs_of_buckets(monkeypatch):
    """Blocks of one leaf and of a deep tree give all pairs that the bound allows, each in the first bucket that both sets carry."""
    entry = pa.struct([("set", pa.int64()), ("component", pa.int64()), ("point", pa.binary()), ("early", pa.list_(pa.int64()))])
    r, rng = random.Random(1), np.random.default_rng(1)
    base, sets = rng.integers(0, 2**63 - 1, (5, 120)).astype(np.uint64) * np.uint64(2), {}
    for s in range(150):
        bag = base[r.randrange(5)].copy()
        bag[: r.randrange(30)] = rng.integers(0, 2**63 - 1)
        sets[s] = (ngram_join._point(np.unique(bag)), r.randrange(6), sorted(r.sample(range(40), ngram_join.EARLY)))
    blocks, want = [], set()
    for bucket in range(40):
        some = r.sample(sorted(sets), r.randrange(2, 60))
        main = sets[some[0]][1]
        others = [s for s in some if sets[s][1] != main]
        blocks.append((bucket, main, entries(sets, some), entries(sets, others)))
        for a in others:
            for b in some:
                p, q = (ngram_join._counts(sets[x][0]) for x in (a, b))
                first = min(set(sets[a][2]) & set(sets[b][2]), default=bucket)
                if sets[a][1] != sets[b][1] and first >= bucket and np.minimum(p, q).sum() >= -(-80 * (p.sum() + q.sum()) // 180):
                    want.add((min(a, b), max(a, b), bucket))
    columns = [pa.array([b[i] for b in blocks], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.list_(entry), pa.list_(entry)))]
    batch = pa.RecordBatch.from_arrays(columns, ["bucket", "main", "members", "visitors"])
    for node, together in ((2, 1), (4, 1 << 20), (32, 500), (1000, 1 << 20)):
        monkeypatch.setattr(ngram_join, "NODE", node)
        monkeypatch.setattr(ngram_join, "TOGETHER", together)
        assert {p[:2] for out in ngram_join._search(80)(iter([batch])) for p in zip(out.column(0).to_pylist(), out.column(1).to_pylist())} == {p[:2] for p in want}
        found = [p for i in range(40) for out in ngram_join._search(80)(iter([batch.slice(i, 1)])) for p in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), [i] * out.num_rows)]
        assert len(found) == len(set(found)) and set(found) == want
    assert [x.num_rows for x in ngram_join._search(80)(iter([batch.slice(0, 0)]))] == [0]


def test_trees_find_what_the_bound_allows():
    rng = np.random.default_rng(0)
    points, block = rng.poisson(3, (500, 32)).astype(np.int32), rng.integers(0, 9, 500) ** 2
    forest = CountForest(points, block)
    assert len(forest.levels) > 3 and all(len(top) > len(below) for (top, *_), (below, *_) in zip(forest.levels, forest.levels[1:]))
    asked, of = points[:60], np.r_[block[:50], np.full(10, 7)]
    got = list(zip(*(x.tolist() for x in forest.search(asked, of, 90))))
    want = {(v, m) for v in range(60) for m in range(500) if of[v] == block[m] and np.minimum(asked[v], points[m]).sum() >= -(-90 * (asked[v].sum() + points[m].sum()) // 190)}
    assert len(got) == len(set(got)) and set(got) == want
    none = np.zeros(0, np.int64)
    assert not len(CountForest(points[:0], none).search(asked, of, 90)[0]) and not len(forest.search(points[:0], none, 90)[0])


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "A b c d"), (9, None), (10, ""), (None, "a b c d"), (None, "x"), (None, "x")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as row"))
    assert kept.columns == ["doc_id", "text", "row"]
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted([(3, "A b c d"), (9, None), (10, ""), (None, "x")], key=str)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert link_components(none).count() == keep_one(none).count() == 0
