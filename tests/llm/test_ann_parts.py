import numpy as np

from foliomill.llm import ann_partitions


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(ann_partitions, "BLOCK", 150)  # several blocks a group
    monkeypatch.setattr(ann_partitions, "CHUNK", 25)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 12))[rng.integers(0, 40, 3000)] + rng.normal(0, 0.3, (3000, 12))
    assert ann_partitions.train(x)[2] == ann_partitions.PARTS
    df = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 50 = 0")
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)

    def found(queries, k):
        out = {}
        for r in ann_partitions.search(df, queries, k).orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r.vec_id)
        return out

    got = found(asked.unionByName(asked), 20)  # equal queries are asked once
    assert set(got) == set(range(0, 3000, 50)) and all(len(set(v)) == 20 for v in got.values())
    recall = np.mean([len(set(v) & set(np.argsort(-scores[q])[:20].tolist())) / 20 for q, v in got.items()])
    assert recall > 0.9, recall
    many = found(asked, 2999)  # more than the likely parts hold
    assert all(len(set(v)) == 2999 for v in many.values()) and len(many) == 60


def test_recall_without_structure(spark):
    """Vectors without clusters are the hardest case: the share of parts visited still finds nine neighbours of ten."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 32))
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    df = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    scores = x[::40] @ x.T
    scores[np.arange(100), np.arange(0, 4000, 40)] = -np.inf
    got = {}
    for r in ann_partitions.search(df, df.filter("vec_id % 40 = 0"), 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20 for q, s in zip(range(0, 4000, 40), scores)])
    assert 0.9 < recall < 1, recall
