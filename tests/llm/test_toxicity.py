import random
import time

from foliomill.llm import toxicity


def test_exceptions_against_all_pairs():
    r, words = random.Random(4), ["bad", "evil", "sin", "ok"]
    lexicon, phrases = {"bad": 1.0, "evil": 2.0, "sin": 4.0}, ("bad ok", "ok evil ok", "sin ok bad")
    found = toxicity.automaton(lexicon, phrases)
    for _ in range(100):
        text = " ".join(r.choice(words) for _ in range(r.randint(1, 30)))
        spans = lambda what: [(i, i + len(w), w) for w in what for i in range(len(text)) if text.startswith(w, i) and f" {text} "[i] == " " and f" {text} "[i + len(w) + 1] == " "]  # noqa: E731, B023
        spared = spans(phrases)
        total = sum(lexicon[w] for a, b, w in spans(lexicon) if not any(c <= a and b <= d for c, d, _ in spared))
        assert abs(toxicity.features(text, found)[0] - toxicity.np.log1p(total)) < 1e-12


def test_many_exceptions_in_one_text():
    found, text = toxicity.automaton({"trash": 1.0}), "a trash can and trash " * 40_000
    began = time.time()
    assert toxicity.features(text, found)[0] == toxicity.np.log1p(40_000)
    assert time.time() - began < 5
