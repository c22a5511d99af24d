import random

import pytest

from foliomill.llm import language_id
from foliomill.llm.language_id import PROFILE, Profiles, grams, identify, learn_profiles, ranked, sampled

LABELLED = "doc_id long, text string, lang string"


def test_distances_to_all_profiles():
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 4))) for _ in range(n))
    profiles = {f"l{i}": ranked(*grams(text(60))).tolist() for i in range(7)}
    known = Profiles(profiles, PROFILE)
    for n in (1, 5, 300):
        own = ranked(*grams(text(n)))
        for lang, away in zip(known.spoken, known.distances(own)):
            place = {g: i for i, g in enumerate(profiles[lang])}
            assert away == sum(abs(place[g] - i) if g in place else PROFILE for i, g in enumerate(own.tolist()))
    assert len(Profiles({}, PROFILE).distances(own)) == 0


def test_any_number_of_languages(spark):
    letters = [chr(0x4E00 + 3 * i) for i in range(301)]
    rows = [(i, " ".join([c * 2] * 5), f"x{i:03}") for i, c in enumerate(letters)]
    profiles = learn_profiles(spark.createDataFrame(rows, LABELLED))
    assert len(profiles) == 301
    got = {x.doc_id: x.lang_pred for x in identify(spark.createDataFrame([(i, c) for i, c in enumerate(letters)], "doc_id long, text string"), profiles).collect()}
    assert got == {i: f"x{i:03}" for i in range(301)}


@pytest.mark.parametrize("sent", [50_000, 0])
def test_a_hot_language_is_sampled_in_parts(spark, monkeypatch, sent):
    monkeypatch.setattr(language_id, "SENT", sent)
    rows = [(i // 2, f"t{i // 2}", "en") for i in range(4_000)] + [(9_000 + i, f"u{i}", "de") for i in range(5)]
    got = sampled(spark.createDataFrame(rows, LABELLED).repartition(4), 100).collect()
    by_hash = spark.createDataFrame(rows, LABELLED).selectExpr("lang", "text", "xxhash64(doc_id, text) as row").distinct().collect()
    want = {x.text for x in sorted((x for x in by_hash if x.lang == "en"), key=lambda x: x.row)[:100]} | {f"u{i}" for i in range(5)}
    assert len(got) == 105 and {x.text for x in got} == want
    assert learn_profiles(spark.createDataFrame([], LABELLED)) == {}
