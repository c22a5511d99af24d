"""Steps whose time or memory grew faster than their input."""

import random
import re

import pyarrow as pa
import pytest
import regex

from foliomill.functions import lines, rows
from foliomill.functions import text as T
from foliomill.operators import answers, operations, records, structure, tree
from foliomill.plans.registry import QUERIES
from tests.conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_slices_hold_few_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 300)], ["text"])
    parts = list(rows.slices(batch, 10_000))
    assert sum(p.num_rows for p in parts) == 300 and max(p.num_rows for p in parts) <= 10
    assert [p.num_rows for p in rows.slices(batch, 1)] == [1] * 300
    assert rows.mapped(lambda x: x, pa.array(["a", None])).to_pylist() == ["a", None] and rows.mapped(len, pa.array([], pa.string())).to_pylist() == []


@pytest.mark.parametrize("name", ["stitch_pages", "rebuild_paragraphs", "markdown_table_cells", "spoken_elements", "speech_pieces", "passage_terms"])
def test_lists_are_made_in_slices(spark, name):
    """All lists of a batch of 10,000 rows stood in a worker."""
    found = plan(QUERIES[name](spark, SF))
    assert "MapInArrow" in found and "ArrowEvalPython [_rebuilt" not in found and "pandas" not in found.lower()


def test_join_cut_words_in_slices(spark):
    """F16: a function of Arrow arrays, not of pandas series."""
    from pyspark.util import PythonEvalType

    from foliomill.functions.lines import join_cut_words, join_lines

    assert join_cut_words.evalType == join_lines.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    df = spark.createDataFrame([("uma biblio- teca", "pt"), (None, "pt"), ("a- b", None)], "a string, b string")
    assert [r[0] for r in df.select(join_cut_words("a", "b")).collect()] == ["uma biblioteca", None, "a- b"]


def test_frequent_words_in_one_search(spark):
    """five searches and an array of all letters for each stretch."""
    listed = sorted(set().union(*T.LANGUAGE_WORDS.values()))
    own = re.compile(T.trie(listed))
    assert all(own.fullmatch(w) for w in listed) and not any(own.fullmatch(w) for w in ("", "th", "thee", "viel"))
    r = random.Random(3)
    texts = [" ".join(r.choice([*r.choice(list(T.LANGUAGE_WORDS.values())), "Wort", "12", "Ωμέγα"]) for _ in range(r.randint(0, 12))) for _ in range(200)]

    def best(text):
        words = re.split(r"[\W\d_]+", text.lower())
        ranked = sorted(((sum(w in own for w in words), tag) for tag, own in T.LANGUAGE_WORDS.items()), reverse=True)
        return ranked[0][1] if ranked[0][0] >= 3 and ranked[0][0] > ranked[1][0] else ""

    df = T.with_language(spark.createDataFrame([(t,) for t in texts], "text string"), T.F.col("text"))
    got = df.collect()
    assert [r.tag for r in got] == [best(r.text) for r in got] and len({r.tag for r in got}) == 6


def test_ten_keywords_are_cleaned(spark):
    """every word of a text was cleaned for the first ten."""
    words = "a;A;b,<b>c</b>;&amp;\n ;" + ";".join(f"w{i}" for i in range(3000))
    df = records.clean_metadata(spark.createDataFrame([("Admin", None, words, "en")], "author string, subject string, keywords string, language string"))
    assert df.first().asDict() == {"author": "", "subject": "", "keywords": ["a", "b", "c", "&amp", *(f"w{i}" for i in range(6))], "language": "en"}
    assert "filter(transform(split" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_cut_where_documents_meet(spark):
    """all terms stood in a table of each task."""
    docs = spark.createDataFrame([(1, "tag", "page", "a, b b ,a,"), (1, "tag", "page", "b b,c"), (1, "tag", "book", "d"), (2, "tag", "page", None)], "doc_id long, taxonomy string, type string, terms string")
    found = records.allowed_terms(docs, spark.createDataFrame([("page", "tag")], "type string, taxonomy string"))
    assert sorted(map(tuple, found.collect())) == [(1, "tag", "a"), (1, "tag", "b b"), (1, "tag", "c")]
    assert "keys=[doc_id" in plan(found) and not re.search(r"keys=\[[^]]*term", plan(found))


def test_passage_terms_of_documents(spark):
    """passages of one number count together, and those without words count."""
    df = spark.createDataFrame([(1, 0, "one two One"), (1, 0, "two"), (1, 1, "two ab"), (1, 2, None), (2, 0, "")], "doc_id long, passage_no long, text string")
    found = answers.passage_terms(df)
    assert sorted(map(tuple, found.select("passage_no", "term", "tf", "df", "n").collect())) == [(0, "one", 2, 1, 4), (0, "two", 2, 2, 4), (1, "two", 1, 2, 4)]
    assert "HashAggregate(keys=[doc_id#" not in plan(found).replace("ObjectHashAggregate", "")


def test_near_sizes_by_a_window(spark):
    """counts were sent to 25 sizes and added in a table; now to five widths."""
    r = random.Random(4)
    given = [(r.randint(1, 2), str(r.randint(1, 9)), r.randint(1, 12), r.randint(1, 12)) for _ in range(150)]
    found = operations.fragment_images(spark.createDataFrame(given, "doc_id long, md5 string, w long, h long"))
    assert plan(found).count("explode") == 1 and "Join" not in plan(found)
    once = set(given)
    near = {(d, w, h): sum(a == d and abs(x - w) <= 2 and abs(y - h) <= 2 for a, _, x, y in once) for d, _, w, h in once}
    assert sorted(map(tuple, found.collect())) == sorted((*k, c) for k, c in near.items() if c >= 3)


def test_tree_moves_tags_once(spark):
    """tokens with their text were put in order again for every step, all of it four times for the parents."""
    r = random.Random(5)
    kinds = "div p b ul li i br section".split()
    pages = [(d, "".join(r.choice([f"<{(t := r.choice(kinds))}>", f"</{t}>", "text", f"<{t}/>", "<!-- x -->"]) for _ in range(60))) for d in range(40)]
    found = tree.document_tree(spark.createDataFrame(pages, "doc_id long, html string"))
    assert plan(found).count("Exchange hashpartitioning") == 1 and "Join" not in plan(found) and "REPARTITION_BY_NUM" in plan(found)
    nodes = {}
    for x in found.collect():
        nodes.setdefault(x.doc_id, []).append(x)
    assert sum(map(len, nodes.values())) > 300
    for rows_ in nodes.values():
        depth = {a.node: sum(o.node < a.node <= o.last for o in rows_) for a in rows_}
        for a in rows_:
            around = [o.node for o in rows_ if o.node < a.node <= o.last and depth[o.node] == depth[a.node] - 1]
            assert (a.depth, a.parent) == (depth[a.node], max(around, default=None))
    alone = tree.document_tree(spark.createDataFrame([(1, "<div>a<div/>b</div><b>c</b>")], "doc_id long, html string"))
    assert sorted((x.tag, x.node, x.last) for x in alone.collect()) == [("b", 5, 7), ("div", 0, 4)]


def test_leaders_are_searched_where_they_may_be(spark):
    """every text was searched twice for dot leaders, at each of its places."""
    r = random.Random(6)
    texts = ["".join(r.choice([". ", ".", ".\t", "…", "_", "\n", " ", "12", "7", "a", "é", "\t"]) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    texts += [x + n for x in ("....", ". . . .", ".\t.\t.\t.", "……", "____", "...", "…", "___") for n in ("\n12", " 12 Next", "\n 12\nNext")] + ["", None]
    up = lambda x: regex.sub(rf"({T.LEADER})[ \t]*\n[ \t]*(\d{{1,4}})(?=[ \t]*(?:\n|$))", r"\1 \2", x)
    want = {x: None if x is None else regex.sub(rf"({T.LEADER}[ \t]*\d{{1,4}})[ \t]+(?=\p{{L}})", "\\1\n", up(x)) for x in texts}
    found = structure.rejoin_toc_breaks(spark.createDataFrame([(x, x) for x in texts], "given string, text string"))
    assert {x.given: x.text for x in found.collect()} == want and sum(a != b for a, b in want.items()) > 10
    assert "CASE WHEN" in plan(found) and plan(found).count("Contains(") == len(structure.LEADS)


def test_mended_texts_go_back_in_slices(spark):
    """F16: a batch of 10,000 texts, its results and their copy stood in a worker."""
    found = plan(QUERIES["join_cut_words"](spark, SF))
    assert "MapInArrow" in found and "ArrowEvalPython" not in found
    df = spark.createDataFrame([(1, "uma biblio- teca", "pt", 1.5), (2, None, "pt", None), (3, "a- b", None, 2.0), (4, "vendê- lo " * 200_000, "pt", 3.0)], "n long, text string, lang string, x double")
    got = lines.with_cut_words_joined(df)
    assert got.schema == df.schema and sorted(map(tuple, got.collect())) == [(1, "uma biblioteca", "pt", 1.5), (2, None, "pt", None), (3, "a- b", None, 2.0), (4, "vendê-lo " * 200_000, "pt", 3.0)]
    assert lines.with_cut_words_joined(df.filter("false")).count() == 0
