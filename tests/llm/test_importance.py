import hashlib
import math
import random
import re
import zlib
from collections import Counter

from foliomill.llm.importance import keep_drawn, resample
from tests.conftest import SF


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, target, most=2, buckets=10_000, percent=25, least=20, seed=7):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    count = Counter
    s, t = count([f for _, x in rows for f in features(x)]), count([f for x in target for f in features(x)])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    out = []
    for d, x in rows:
        f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = d is not None and int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    fit = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return out


key = lambda r: tuple((x is not None, x) for x in r)


def same(got, want):
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got), key=key) == sorted((tuple(r[:5]) for r in want), key=key)


def test_against_brute_force(spark):
    r = random.Random(11)
    vocab = ["Été", "naïve", "a", "B2", "the", "x_y", "日本", "1,5", "end."] + [f"w{i}" for i in range(60)]
    text = lambda n: r.choice([" ", "\n", "-", " \t "]).join(r.choice(vocab) for _ in range(n))
    rows = [(i, text(r.randint(0, 60))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " .. \n"), (503, "One"), (504, "a\x00b\x7fc"), (None, text(30)), (505, "x" * 300_000), (506, "of the " * 20_000), (1, rows[1][1]), (1, rows[1][1]), (7, text(25))]
    target = [text(30), None, "", "the naïve the naïve"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as weight", "2 as score", "3 as rank", "4 as place", "5 as `a.b`").repartition(3)
    aim = spark.createDataFrame([(x,) for x in target], "text string")
    same(resample(docs, aim, buckets=50).collect(), brute(rows, target, buckets=50))
    same(resample(docs, aim, most=3, buckets=300, percent=60, least=5, seed=9).collect(), brute(rows, target, 3, 300, 60, 5, 9))
    kept = keep_drawn(docs, aim, buckets=50)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {x[0] for x in brute(rows, target, buckets=50) if x[4]}


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resample(none, some).count() == 0
    same(resample(some, none, percent=100).collect(), brute([(1, "a b " * 20)], [], percent=100))


def test_query(spark):
    from foliomill.llm.registry import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    target = [x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    same(QUERIES["op11_importance"](spark, SF).collect(), brute([(x.doc_id, x.text) for x in docs], target))
