import re
from collections import Counter

import numpy as np
import pytest

from foliomill.llm.common import RollingHash, word_hashes
from foliomill.llm.ngram_join import link_components
from foliomill.llm.packing import pack, tokenizer_path
from foliomill.llm.quality_rules import ledger
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check

MIB = 1 << 20


def long_text(first):
    """2.5 MiB of words, one of them across each MiB."""
    text = first + " ".join(("%05dLong" % (i % 36_000)) * 8 for i in range(36_500))
    assert len(text) > 5 * MIB // 2 and all(" " not in text[at - 2 : at + 2] for at in (MIB, 2 * MIB))
    return text


@pytest.mark.parametrize("table", [100, MIB, 2 * MIB])
def test_words_are_whole_whatever_the_table_holds(table):
    data = np.frombuffer((long_text("") + " " + "x" * (3 * MIB) + " y").encode(), np.uint8)
    keys, starts, stops = word_hashes(data, RollingHash(table), lower=False)
    words = list(re.finditer(rb"\S+", data.tobytes()))
    assert list(zip(starts.tolist(), stops.tolist())) == [w.span() for w in words]
    assert len(np.unique(keys)) == len({w[0] for w in words})
    alone = word_hashes(np.frombuffer(b"y " + words[7][0], np.uint8), RollingHash(100), lower=False)[0]
    assert alone.tolist() == [keys[-1], keys[7]]


def test_ledger_of_a_long_text(spark):
    texts = [long_text(""), "x" * (MIB + 9) + " one\ntwo"]
    got = {r.doc_id: r for r in ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
        many = Counter(windows)
        repeated = {j + k for j, w in enumerate(windows) if many[w] > 1 for k in range(5)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].n_letter_words) == (len(words), sum(map(len, words)), len(repeated), len(words))


def test_links_of_long_texts(spark):
    # The words in front move every cut of a block to another place.
    rows = [(1, long_text("")), (2, long_text("some 3 words ")), (3, "x" * (MIB + 9) + " one two"), (4, "x" * (MIB + 9) + " one two three")]
    got = link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:3] for r in got) == brute(rows)


@pytest.mark.parametrize("text", ["日本語の文章はとても長い" * (3 * MIB // 36 + 1), "Zm9vYmFy,QmF6" * (3 * MIB // 13 + 1)], ids=["cjk", "ascii"])
def test_ids_of_a_text_without_white_space(spark, text):
    assert len(text.encode()) >= 3 * MIB
    texts = [(1, text), (2, "a b"), (3, "some words, " + text + " and more")]
    check(pack(spark.createDataFrame(texts, "doc_id long, text string"), tokenizer_path()).collect(), texts)
