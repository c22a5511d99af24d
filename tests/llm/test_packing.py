import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from foliomill.llm.packing import fill, pack, plan, tokenizer_path


def check(rows, texts, window=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    ids = defaultdict(list)
    for d, x in texts:
        ids[d].append(np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4"))
    seqs, docs = defaultdict(list), defaultdict(int)
    for r in rows:
        assert any(len(i) == r.doc_tokens and zlib.crc32(i[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for i in ids[r.doc_id])
        docs[r.doc_id] += r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    for d, i in ids.items():
        assert docs[d] == sum(map(len, i)), (d, want)
    slack = 0
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= window
        slack += 0 if at & (at - 1) == 0 else window - at
    assert sorted(seqs) == list(range(len(seqs)))
    return slack


def test_round_trip(spark):
    r = random.Random(1)
    words = ["Hello", "don't", "naïve", "x1y2", "é", "日本語", "A,b;c", "<|endoftext|>", "it's.", "ΣΑΣ", "́a", "##", "ﬁn", "a b"]
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "a" * 3000), (5, "x y"), (5, "x y"), (5, "z")]
    texts += [(10 + i, " ".join(r.choice(words) for _ in range(r.randint(0, 3000)))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", "0 as start", "1 as length", "2 as salt")
    slack = check(pack(df, tokenizer_path()).collect(), texts)
    assert slack < 4 * 2048


def test_fill_is_the_best_sum():
    r = random.Random(2)
    for _ in range(50):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(5)}
        room = r.randint(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        got = fill(counts, room)
        assert all(counts[k] >= n for k, n in got.items())
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)


def test_plan_uses_every_piece_once():
    r = random.Random(3)
    counts = {k: r.randint(1, 50) for k in r.sample(range(1, 2049), 300)}
    used = plan(counts, 2048)
    assert set(used[:, 0]) == set(counts)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
