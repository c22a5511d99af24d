"""Passages, contexts and parts against plain versions."""

from foliomill.operators import answers
from foliomill.operators import passages as P


def packed(text, size):
    out = []
    for line in (" ".join(x.split()) for x in (text or "").split("\n")):
        if not line:
            continue
        if out and len(out[-1]) + len(line) <= size:
            out[-1] += "\n" + line
        else:
            out.append(line)
    return out


TEXTS = [None, "", " \n\t\n", "one", "a\nb\nc", "x" * 50, "\n".join(["word " * (i % 7 + 1) for i in range(60)]), "\n".join(["", "é" * 19, "y" * 20, "z"]), "one"]


def test_passages(spark):
    docs = spark.createDataFrame([(i, x, "extra") for i, x in enumerate(TEXTS)], "doc_id long, text string, passages string")
    got = {}
    for r in P.passages(docs, 40).orderBy("doc_id", "passage_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
        assert r.passage_no == len(got[r.doc_id])
    assert got == {i: p for i, x in enumerate(TEXTS) if (p := packed(x, 40))}
    assert P.passages(docs.limit(0), 40).count() == 0


def test_build_context(spark):
    long = "\n".join(f"line number {i} about " + ("granite cliffs" if i in (3, 17, 18) else "nothing at all") for i in range(30))
    docs = spark.createDataFrame([(1, long), (2, "short text"), (3, None)], "doc_id long, text string")
    asked = [(1, 1, "granite cliffs?"), (2, 2, "granite"), (3, 3, "granite"), (4, 1, "a ?"), (5, 1, "zebra"), (6, 1, None), (7, 9, "granite")]
    questions = spark.createDataFrame(asked, "question_id long, doc_id long, text string")
    got = {r.question_id: r.context for r in P.build_context(questions, docs, 120, 40).collect()}
    lines = long.split("\n")
    assert got == {1: "\n".join([lines[3], "[…]", lines[17], lines[18]]), 2: "short text", 3: "", 4: long[:120], 5: lines[0], 6: long[:120]}
    assert sum(map(len, (lines[3], lines[17], lines[18]))) <= 120
    assert answers.passage_terms(P.passages(docs, 40)).filter("term = 'granite'").count() == 3


def test_split_parts(spark):
    block = "<p>some <b>bold</b> té<br>xt</p>"
    html = block * 3 + "<h2>A</h2>" + block + "<div><h2>inner</h2>" + block * 4 + "</div>" + "</section>" + block * 2 + "<h3>B</h3>" + block
    docs = spark.createDataFrame([(1, html), (2, "<p>small</p>"), (3, None), (4, "no tags " * 40)], "doc_id long, html string")
    rows = P.part_titles(P.split_parts(docs, 60, 120)).orderBy("doc_id", "part_no").collect()
    parts = {d: [r.html for r in rows if r.doc_id == d] for d in (1, 2, 3, 4)}
    assert parts[1] == [block * 3, "<h2>A</h2>" + block + "<div><h2>inner</h2>" + block * 4 + "</div></section>", block * 2, "<h3>B</h3>" + block]
    assert "".join(parts[1]) == html and all(r.bytes == len(r.html.encode()) for r in rows)
    assert (parts[2], parts[3], parts[4]) == (["<p>small</p>"], [""], ["no tags " * 40])
    assert [r.title for r in rows if r.doc_id == 1][:2] == ["", "A"]
