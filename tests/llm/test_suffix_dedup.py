import hashlib
import random
from collections import Counter

import pytest

from foliomill.llm.suffix_dedup import remove_repeats, without_repeats


def brute(rows, width):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                mark[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if mark[i] and (i == 0 or not mark[i - 1]))
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((d, len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(r.randint(60, 200)) for _ in range(5)]
    rows = [(0, None), (1, ""), (2, "ab" * 900), (3, "x" * 401), (3, "x" * 401), (4, "x" * 400), (None, text(50))]
    for d in range(10, 60):
        parts = [r.choice(shared) if r.random() < 0.5 else text(r.randint(1, 150)) for _ in range(r.randint(1, 5))]
        t = " ".join(parts)
        if r.random() < 0.5 and len(t) > 20:
            at = r.randrange(len(t))
            t = t[:at] + "#" + t[at + r.randint(0, 3) :]
        rows.append((d, t[r.randint(0, 9) :]))
        if r.random() < 0.2:
            rows.append((d + 1000, rows[-1][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as row", "2 as n", "3 as run")
    got = sorted((tuple(x)[:5] for x in remove_repeats(df).collect()), key=str)
    assert got == brute(rows, 400)
    both = remove_repeats(df, narrow=250).collect()
    assert sorted((tuple(x)[:5] for x in both), key=str) == got
    assert sorted(((x.doc_id, x.n_bytes, x.n_repeated) for x in both), key=str) == sorted(((d, n, m) for d, n, m, _, _ in brute(rows, 250)), key=str)


def test_long_text_in_blocks(spark):
    r = random.Random(5)
    a = "".join(r.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, a + a[500:1700] + "zz" + a[:450]), (2, "q" + a[2000:] + "w"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(df, block=700, narrow=250).collect()
    assert sorted(tuple(x)[:5] for x in got) == brute(rows, 400)
    assert sorted((x.doc_id, x.n_repeated) for x in got) == [(d, m) for d, _, m, _, _ in brute(rows, 250)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(none).count() == remove_repeats(none, narrow=250).count() == without_repeats(none).count() == 0


def test_text_that_is_left(spark):
    a = "0123456789" * 40
    rows = spark.createDataFrame([(1, a + "tail", "x"), (2, a, None), (3, None, "y")], "doc_id long, text string, lang string")
    out = without_repeats(rows, 400)
    assert out.columns == rows.columns
    assert sorted(tuple(x) for x in out.collect()) == [(1, "tail", "x"), (2, "", None), (3, "", "y")]


def test_clashing_columns(spark):
    a = "0123456789" * 40
    rows = spark.createDataFrame([(1, a, 1, 2, 3), (2, a + "b", 4, 5, 6)], "doc_id long, text string, row int, spans int, _row int")
    out = without_repeats(rows, 400)
    assert out.columns == rows.columns and sorted(tuple(x) for x in out.collect()) == [(1, "", 1, 2, 3), (2, "b", 4, 5, 6)]
