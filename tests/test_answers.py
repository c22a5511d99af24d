"""Reuse of saved answers by exact cosines, against all pairs."""

import math
import random
import re
from collections import Counter

from foliomill.operators import answers

ASKED, SAVED = "question_id long, doc_id long, text string, sig string", "answer_id long, doc_id long, question string, sig string"


def vector(text):
    stems = Counter(w[:6] for w in re.findall(r"[^\W_]{3,}", (text or "").lower()) if w not in answers.COMMON)
    size = math.sqrt(sum(c * c for c in stems.values()))
    return {s: c / size for s, c in stems.items()}


def brute(questions, saved, sig):
    out = []
    for q, d, text, s in questions:
        found = []
        for a, e, other, t in saved:
            v, u = vector(text), vector(other)
            cosine = round(sum(v[x] * u[x] for x in v.keys() & u.keys()), 6)
            if d is not None and d == e and (not sig or s == t) and cosine >= 0.85:
                found.append((-cosine, a))
        if found:
            out.append((q, min(found)[1], -min(found)[0]))
    return sorted(out)


def test_same_answers_as_all_pairs(spark):
    r = random.Random(8)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliett", "kilo", "what", "the", "ab"]
    text = lambda: r.choice([" ".join(r.choice(words) for _ in range(r.randint(0, 12))), None, "", "what is the"])
    questions = [(i, r.choice([1, 1, 1, 2, None]), text(), r.choice("xy")) for i in range(150)]
    saved = []
    for i in range(150):
        d, near = r.choice([1, 1, 2, None]), questions[r.randrange(150)][2] or ""
        saved.append((1000 + i, d, r.choice([text(), near, near + " " + r.choice(words), near]), r.choice("xy")))
    q, a = spark.createDataFrame(questions, ASKED), spark.createDataFrame(saved, SAVED)
    got = lambda q, a: sorted((x.question_id, x.answer_id, x.cosine) for x in answers.reuse_answers(q, a).collect())
    assert got(q, a) == brute(questions, saved, True)
    assert got(q.drop("sig"), a.drop("sig")) == brute(questions, saved, False)
    assert answers.reuse_answers(q, a.filter("false")).count() == answers.reuse_answers(q.filter("false"), a).count() == 0


def test_many_questions_on_one_document_make_few_pairs(spark):
    r, n = random.Random(9), 10_000
    word = lambda: "".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiou") for _ in range(3))
    vocabulary = [word() for _ in range(4_000)]
    rows = [(i, 1, " ".join(["chapter", "book", *r.sample(vocabulary, 6)])) for i in range(n)]
    q = spark.createDataFrame(rows, "id long, doc_id long, text string").repartition(4)
    vectors = answers.question_vectors(q.withColumnRenamed("id", "question_id")).withColumnRenamed("question_id", "id").join(q.select("id", "doc_id"), "id")
    made = answers.answer_candidates(vectors, vectors, ["doc_id"], 0.85).count()
    # All pairs of a document that share a stem would be all: everyone names the book.
    assert n <= made < 40 * n
