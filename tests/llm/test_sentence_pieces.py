import random

import numpy as np
import sentencepiece

from foliomill.llm.sentence_pieces import decode, encode, model_path, pieces


def texts():
    r = random.Random(4)
    parts = ["the", "Haus", "été", "日本", "\U0001f600", "1234", "  ", "\n", "\t", "don't", "####", "x" * 40, "ing", "<s>", "<0x41>", "Ω", "\x00", "aaaa", "==="]
    return ["", " ", "  a  b ", "a" * 500, *("".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(1, 200))) for _ in range(80))]


def test_ids_are_those_of_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=model_path())
    given = texts()
    ids, offsets = pieces(model_path()).encode(given)
    for i, want in enumerate(model.encode(given)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want, given[i][:60]


def test_round_trip(spark):
    rows = [*enumerate(texts()), (1000, None), (1000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as ids")
    ids = encode(df, model_path())
    back = decode(ids, model_path()).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((d, t or "") for d, t in rows)


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), model_path()).count() == 0
    assert np.diff(pieces(model_path()).encode([])[1]).size == 0
