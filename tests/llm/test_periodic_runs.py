import hashlib
import random
import zlib

import numpy as np
import pytest

from foliomill.llm import periodic_runs
from foliomill.llm.periodic_runs import collapse, find_runs, run_report, tiles_of
from foliomill.llm.registry import QUERIES
from tests.conftest import SF


def brute(words, least=6, times=4):
    """All runs (start, length, period) by comparing words q apart."""
    found, n = [], len(words)
    x = np.unique(words, return_inverse=True)[1] if n else np.zeros(0)
    for q in range(1, n // times + 1):
        edge = np.flatnonzero(np.diff(np.r_[False, x[: n - q] == x[q:], False].astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            length = b - a + q
            w = words[a : a + length]
            if length >= max(least, times * q) and not any(q % p == 0 and w[p:] == w[: length - p] for p in range(1, q)):
                found.append((a, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def report(doc_id, words, least=6, times=4):
    runs = brute(words, least, times)
    dropped = {i for a, n, q in runs for i in range(a + q, a + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *longest, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


key = lambda r: tuple((x is not None, x) for x in r)


def texts_of(r, many, longest):
    out = []
    for _ in range(many):
        words = []
        while len(words) < r.randint(0, longest):
            piece = [r.choice("abcdef") for _ in range(r.choice([1, 1, 2, 3, 5, 8, 20, 60]))]
            piece = (piece * r.randint(1, 9))[: r.randint(1, 300)]
            words += piece + ["x%d" % r.randint(0, 99)] * r.randint(0, 1)
        out.append(words)
    return out


@pytest.mark.parametrize(("tile", "wide"), [(8_192, 16), (40, 1), (7, 2)])
def test_against_brute_force(spark, monkeypatch, tile, wide):
    # Patched numbers reach the tasks only by value, so small tiles are solved here.
    monkeypatch.setattr(periodic_runs, "TILE", tile)
    monkeypatch.setattr(periodic_runs, "WIDE", wide)
    r = random.Random(tile)
    for words in [*texts_of(r, 40, 400), ["a"] * 500, ["a", "b"] * 200 + ["a"], [], ["a"], ["a"] * 6, ["a"] * 5, list("abcabcabcabc"), list("abababab" * 3 + "b" * 20)]:
        for least, times in ((6, 4), (2, 2), (10, 3)):
            x = np.unique(words, return_inverse=True)[1].astype(np.uint16) if words else np.zeros(0, np.uint16)
            got = {}
            rows = [{"low": low, "high": high, "most": len(words) // times, "at": 2, "first": f, "core_from": a, "core_to": b, "words": x[f:t].tobytes()} for low, high, f, t, a, b in tiles_of(len(words), times)]
            for part in ([rows[:1], rows[1:]] if tile == 7 else [rows]):
                for _, q, s, e in periodic_runs.Tiles(part, periodic_runs.RollingHash(50 * len(x) + 99)).fragments(times) if part else ():
                    got.setdefault(q, []).append((s, e))
            runs = []
            for q, spans in got.items():
                low, high = zip(*sorted(spans))
                runs += [(s, e - s + q, q) for _, s, e in periodic_runs.merged(np.full(len(low), q), np.array(low), np.array(high)) if e - s + q >= max(least, times * q)]
            assert sorted(runs, key=lambda x: (x[0], x[2])) == brute(words, least, times)


def test_whole_job(spark):
    r = random.Random(13)
    rows = [(i, r.choice([" ", "\n\t ", " \x0b"]).join(w)) for i, w in enumerate(texts_of(r, 60, 300))]
    period = ["w%d" % i for i in range(700)]
    rows += [(100, None), (101, ""), (102, " \n "), (None, "é " * 9), (103, "é " * 9), (103, "é " * 9), (104, " ".join(period * 30 + ["end"])), (105, "no no no no no " + "la " * 9_000), (106, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "1 as row", "text", "2 as runs", "3 as period", "4 as `a.b`").repartition(3)
    got = [tuple(x)[:-1] for x in run_report(docs).collect()]
    want = [report(d, t.split() if t else []) for d, t in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    short = collapse(docs)
    assert short.columns == docs.columns
    left = {x.doc_id: x.text for x in short.collect()}
    assert left[104].split() == [*period, "end"] and left[105] == "no no no no no la" and left[100] is None and left[102] == " \n " and left[103] == "é"
    assert find_runs(spark.createDataFrame([], "row long, text string")).count() == run_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_an_accident_of_hashes_is_no_run():
    row = {"low": 0, "high": 0, "most": 1, "at": 1, "first": 0, "core_from": 0, "core_to": 6, "words": bytes([1, 1, 1, 2, 1, 1])}
    assert list(periodic_runs.Tiles([row], periodic_runs.RollingHash(10)).compared(1, 0, 5)) == [(0, 2), (4, 5)]


def test_query(spark):
    docs, want = spark.read.parquet(f"{SF}/documents.parquet").collect(), []
    for d, t in ((x.doc_id, x.text) for x in docs):
        w, h = (t or "").split(), zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a, w0 = g % n, list(w)
            p = 1 + (n - a) // (3 + g % 8)
            for i in range(a, n):
                w[i] = w0[a + (i - a) % p]
        want.append(report(d, w))
    got = [tuple(x) for x in QUERIES["op13_periodic_runs"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and any(x[1] for x in got)
