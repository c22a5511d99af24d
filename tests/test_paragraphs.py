"""Goldens of line joining, paragraphs, page breaks, lists and languages by page."""

import time

import pytest

from foliomill.functions.lines import join_two, mend
from foliomill.operators import enrich, paragraphs, structure


@pytest.mark.parametrize(
    ("before", "after", "lang", "want"),
    [
        ("uma casa", "e um rio", "pt", "uma casa e um rio"), ("a biblio-", "teca nova", "pt", "a biblioteca nova"), ("vendê-", "lo hoje", "pt", "vendê-lo hoje"), ("contar-", "lhe", "pt", "contar-lhe"),
        ("os títu-", "los", "pt", "os títulos"), ("tu me-", "te", "pt", "tu mete"), ("cantando-", "as.", "pt", "cantando-as."), ("os mai-", "as", "pt", "os maias"), ("cantando-", "ostra", "pt", "cantandoostra"),
        ("um vice-", "campeão", "pt", "um vice-campeão"), ("anti-", "herói", "pt", "anti-herói"), ("anti-", "corpo", "pt", "anticorpo"), ("auto-", "ônibus", "pt", "autoônibus"), ("auto-", "organiza", "pt", "auto-organiza"),
        ("ho-", "me", "en", "home"), ("an e-", "reader", "", "an e-reader"), ("Baden-", "Baden", "de", "Baden-Baden"), ("1990-", "1999", "de", "1990- 1999"), ("sie ging —", "dann", "de", "sie ging — dann"),
        ("кому-", "то", "ru", "кому-то"), ("мес-", "то", "ru", "место"), ("пойди-", "ка", "ru", "пойди-ка"), ("по-", "немецки", "ru", "по-немецки"), ("по-", "года", "ru", "погода"), ("из-", "за", "ru", "из-за"), ("кому-", "то", "pt", "комуто"),
        ("天气很", "好。", "zh", "天气很好。"), ("これは", "本です", "ja", "これは本です"), ("", "x", "", " x"),
    ],
)
def test_two_lines(before, after, lang, want):
    assert join_two(before, after, lang) == want


@pytest.mark.parametrize(
    ("line", "lang", "want"),
    [
        ("uma biblio- teca e um dicio- nário", "pt", "uma biblioteca e um dicionário"), ("para vendê- lo", "pt", "para vendê-lo"), ("cantando- a bem", "pt", "cantando-a bem"), ("pré- a vida", "pt", "pré- a vida"),
        ("micro- e macro", "pt", "micro- e macro"), ("short- and long-term", "en", "short- and long-term"), ("Ost- und West", "de", "Ost- und West"), ("Baden- Baden", "de", "Baden- Baden"), ("1990- 1999", "de", "1990- 1999"), ("a - b", "en", "a - b"),
    ],
)
def test_words_cut_within_a_line(line, lang, want):
    assert mend(line, lang) == want


PAGES = "doc_id long, page_no long, text string, lang string"


def rebuilt(spark, text, lang="en"):
    rows = paragraphs.rebuild_paragraphs(spark.createDataFrame([(1, 0, text, lang)], PAGES)).orderBy("block_no").collect()
    assert [r.block_no for r in rows] == list(range(1, len(rows) + 1))
    return [r.text for r in rows]


def test_paragraphs(spark):
    assert rebuilt(spark, None) == rebuilt(spark, "") == rebuilt(spark, " \n\t\n") == []
    assert rebuilt(spark, "One line\nand the  next.\nA second\n\nthird") == ["One line and the next.", "A second", "third"]
    assert rebuilt(spark, "A long book-\ncase here\r\nends.") == ["A long bookcase here ends."]
    assert rebuilt(spark, "You need:\n• bread\nand butter\n• milk\nThen go on") == ["You need:", "• bread and butter", "• milk", "Then go on"]
    assert rebuilt(spark, "Steps\n1. open\n2. shut") == ["Steps", "1. open", "2. shut"]
    long = "a line of running text that is far longer than sixty characters, see part"
    assert rebuilt(spark, f"{long}\n2. Then") == [f"{long} 2. Then"]
    assert rebuilt(spark, "Part one ........\n12\nPart two ........ 30 Part three ..... 44") == ["Part one ........ 12", "Part two ........ 30", "Part three ..... 44"]
    assert rebuilt(spark, "今天天气\n很好。\n明天", "zh") == ["今天天气很好。", "明天"]


def test_page_breaks(spark):
    blocks = [
        (1, 0, 1, "p", "Whole."), (1, 0, 2, "p", "This sen-"), (1, 1, 1, "p", "tence ends."), (1, 1, 2, "p", "Open at the end"), (1, 2, 1, "h2", "Title"), (1, 2, 2, "p", "also open"),
        (1, 4, 1, "p", "after a page without blocks"), (2, 0, 1, "p", "one"), (2, 1, 1, "p", "two"), (2, 2, 1, "p", "three"), (2, 3, 1, "toc", "four"), (3, 0, 1, "p", None),
    ]
    df = spark.createDataFrame([(*b, "en") for b in blocks], "doc_id long, page_no long, block_no long, kind string, text string, lang string")
    got = [(r.doc_id, r.page_no, r.kind, r.text) for r in paragraphs.stitch_pages(df).orderBy("doc_id", "page_no", "block_no").collect()]
    assert got == [
        (1, 0, "p", "Whole."), (1, 0, "p", "This sentence ends."), (1, 1, "p", "Open at the end"), (1, 2, "h2", "Title"), (1, 2, "p", "also open"), (1, 4, "p", "after a page without blocks"),
        (2, 0, "p", "one two"), (2, 2, "p", "three four"), (3, 0, "p", None),
    ]


BLOCKS = "doc_id long, page_no long, block_no long, kind string, text string, target int, lang string"


def stitched(spark, blocks, **options):
    df = spark.createDataFrame([(1, *b, "en") for b in blocks], BLOCKS)
    return [(r.page_no, r.block_no, r.kind, r.text, r.target) for r in paragraphs.stitch_pages(df, **options).orderBy("page_no", "block_no").collect()]


def test_blocks_of_pages(spark):
    """every paragraph was a 'p' to the page breaks, contents entries and lists too."""
    texts = [
        ["A booklet Contents Part one ..... 3", "Part two ..... 4", "Text.", "Contents Again ..... 5", "Contents of it", "....... 6"], ["1. alone", "Text.", "1. a", "2. b", "x) no", "• c", "• d"],
        ["1. a", "2. b", "a) sub", "3. c", "Text.", "3. d", "5. e"], ["• a", "Text 12", "• b"], ["Contents ..... 7", None],
    ]
    rows = [(1, p, n, x, "en") for p, page in enumerate(texts) for n, x in enumerate(page, 1)]
    found = paragraphs.page_blocks(spark.createDataFrame(rows, "doc_id long, page_no long, block_no long, text string, lang string").repartition(3)).orderBy("page_no", "block_no").collect()
    got = [[] for _ in texts]
    for r in found:
        got[r.page_no].append((r.kind, r.text) if r.target is None else (r.kind, r.text, r.target))
        assert r.block_no == len(got[r.page_no]) and r.lang == "en"
    assert got == [
        [("p", "A booklet"), ("toc-heading", "Contents"), ("toc", "Part one", 3), ("toc", "Part two", 4), ("p", "Text."), ("toc-heading", "Contents"), ("toc", "Again", 5), ("p", "Contents of it"), ("toc", "", 6)],
        [("p", "1. alone"), ("p", "Text."), ("ol", "1. a"), ("ol", "2. b"), ("p", "x) no"), ("ul", "c"), ("ul", "d")],
        [("ol", "1. a"), ("ol", "2. b"), ("ol", "a) sub"), ("ol", "3. c"), ("p", "Text."), ("p", "3. d"), ("p", "5. e")], [("p", "• a"), ("p", "Text 12"), ("p", "• b")], [("toc", "Contents", 7), ("p", None)],
    ]


def test_contents_over_page_breaks(spark):
    """a title on one page and its number on the next one stayed a paragraph, and a null text emptied the paragraph before it."""
    blocks = [
        (0, 1, "p", "Above.", None), (0, 2, "p", "Between", None), (0, 3, "p", "A title that", None), (1, 1, "toc", "goes on", 12), (1, 2, "toc", "Whole", 13), (2, 1, "p", "after contents", None), (2, 2, "ol", "1. a", None),
        (3, 1, "p", "after a list", None), (4, 1, "toc", "", 14), (5, 1, "p", "Open", None), (6, 1, "p", None, None), (6, 2, "p", "Ends.\n", None), (7, 1, "p", "closed", None),
    ]
    assert stitched(spark, blocks) == [
        (0, 1, "p", "Above.", None), (0, 2, "p", "Between", None), (0, 3, "toc", "A title that goes on", 12), (1, 2, "toc", "Whole", 13), (2, 1, "p", "after contents", None), (2, 2, "ol", "1. a", None),
        (3, 1, "toc", "after a list", 14), (5, 1, "p", "Open", None), (6, 2, "p", "Ends.\n", None), (7, 1, "p", "closed", None),
    ]
    marked = stitched(spark, blocks, markers=True)
    assert marked == [b for b in blocks if b[:2] not in ((3, 1), (4, 1))][:7] + [(3, 1, "toc", "after a list", 14)] + blocks[9:]


def test_edges_alone_meet_by_document(spark):
    """all blocks of a document went through its window, and the texts of all to Python."""
    import re

    blocks = [(1, p, n, "p", f"text {p} {n}", None, "en") for p in range(6) for n in range(5)]
    found = paragraphs.stitch_pages(spark.createDataFrame(blocks, BLOCKS))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"windowspecdefinition\(doc_id#\w+, _inner#\w+, page_no#\w+ ASC", plan) and not re.search(r"windowspecdefinition\(doc_id#\w+, page_no#\w+ ASC", plan)
    rows = found.orderBy("page_no", "block_no").collect()
    assert [r.text for r in rows if r.block_no in (0, 4)] == ["text 0 0", *(f"text {p} 4 text {p + 1} 0" for p in range(5)), "text 5 4"] and len(rows) == 25


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["Things:", "• a", "• b", "After."], ["• a", "• b"]), (["1. Introduction", "Text."], []), (["1. A", "2. B", "a) x", "b) y", "3. C"], ["1. A", "2. B", "a) x", "b) y", "3. C"]),
        (["1. A", "2. B", "a) x", "End."], ["1. A", "2. B", "a) x"]), (["• A", "• B", "a) x"], ["• A", "• B"]), (["1. A", "2. B", "b) x"], ["1. A", "2. B"]), (["1. A", "3. C"], []), (["4. D", "5. E"], ["4. D", "5. E"]),
        (["- a", "- b"], []), ([], []),
    ],
)
def test_lists(spark, lines, want):
    rows = spark.createDataFrame([(1, 0, i, x) for i, x in enumerate(lines)], "doc_id long, page_no long, block_no long, text string")
    found = structure.list_markers(rows)
    good = {r.block_no for r in paragraphs.confirm_lists(found.select("doc_id", "page_no", "block_no", "kind", "family", "value")).collect()}
    assert [x for i, x in enumerate(lines) if i in good] == want


def test_language_by_page(spark):
    english, german = "the cat and the dog have been with you for this is not that. ", "der hund und die katze sind nicht bei mir, aber ich war auch da und sie wie wir. "
    pages = [(1, 0, "XII"), (1, 1, english), (1, 2, german * 100), (2, 0, english * 60), (2, 1, german * 200), (3, 0, None), (3, 1, "zzz " * 6000), (3, 2, english * 9), (4, 0, "qqq " * 1000), (4, 1, german * 3), (4, 2, english * 500)]
    got = {(r.doc_id, r.page_no): r.language for r in enrich.learn_language_by_page(spark.createDataFrame(pages, "doc_id long, page_no long, text string")).collect()}
    assert got == {(1, 0): "", (1, 1): "en", (1, 2): "de", (2, 0): "en", (2, 1): "en", (3, 0): "", (3, 1): "", (3, 2): "", (4, 0): "", (4, 1): "de", (4, 2): "de"}


def test_rejoined_contents(spark):
    text = "One ......\n 12\nTwo ........ 30 Three …… 4"
    assert structure.rejoin_toc_breaks(spark.createDataFrame([(text,)], "text string")).first().text == "One ...... 12\nTwo ........ 30\nThree …… 4"


def test_outline(spark):
    blocks = [(1, 0, 1, "p", "Intro"), (1, 0, 2, "p", "the  BIG plan starts here."), (1, 0, 3, "toc", "Last"), (1, 0, 4, "p", "Last"), (2, 0, 1, "p", None)]
    outline = [(1, 0, 1, "The big Plan", 2), (1, 0, 2, "Missing", 3), (1, 0, 3, "last", 2), (3, 5, 1, "Alone", 1)]
    df = spark.createDataFrame(blocks, "doc_id long, page_no long, block_no long, kind string, text string")
    entries = spark.createDataFrame(outline, "doc_id long, page_no long, entry_no long, title string, level int")
    got = [tuple(r) for r in paragraphs.merge_outline(df, entries).orderBy("doc_id", "page_no", "block_no").collect()]
    assert got == [
        (1, 0, 1, "p", None, "Intro"), (1, 0, 2, "h", 2, "The big Plan"), (1, 0, 3, "h", 3, "Missing"), (1, 0, 4, "p", None, "starts here."), (1, 0, 5, "toc", None, "Last"), (1, 0, 6, "h", 2, "last"),
        (2, 0, 1, "p", None, ""), (3, 5, 1, "h", 1, "Alone"),
    ]


def test_highlights_of_any_length(spark):
    import random

    from foliomill.operators import operations

    r = random.Random(3)
    rows = []
    for i in range(400):
        s = r.choice([r.randrange(-50, 400), r.randrange(1 << 40)])
        rows.append((i, i % 3, s, s + r.choice([0, 1, 2, 15, 16, 17, 100, 1 << 20, 1 << 41]), r.choice(["mark", "mark", "remove"]), r.randrange(60)))
    df = spark.createDataFrame(rows, "mark_id long, reader_id long, s long, e long, action string, ts long")
    want = {a[0] for a in rows if a[4] == "mark" and a[2] < a[3] and not any(b[1] == a[1] and b[2] < a[3] and b[3] > a[2] and (b[5], b[0]) > (a[5], a[0]) for b in rows)}
    assert {x.mark_id for x in operations.live_highlights(df).collect()} == want
    assert operations.live_highlights(df.filter("false")).count() == 0


def test_merge_outline_streams_pages(spark):
    """pages pass one after the other in the order of a sort; a group of its own for each page took minutes."""
    blocks = spark.createDataFrame([(d, p, n, "p", f"Title {n} of words and more") for d in range(60) for p in range(4) for n in range(1, 40)], "doc_id long, page_no long, block_no long, kind string, text string")
    outline = spark.createDataFrame([(d, p, n, f"title  {n} OF" if n % 2 else "Nowhere", 2) for d in range(1, 61) for p in range(4) for n in range(1, 40, 3)], "doc_id long, page_no long, entry_no long, title string, level int")
    found = paragraphs.merge_outline(blocks, outline)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan
    rows = {}
    for r in found.collect():
        rows.setdefault((r.doc_id, r.page_no), []).append((r.block_no, r.kind, r.level, r.text))
    assert len(rows) == 61 * 4 and all(sorted(x[0] for x in page) == list(range(1, len(page) + 1)) for page in rows.values())
    assert {len(page) for key, page in rows.items() if key[0] == 0} == {39} and {len(page) for key, page in rows.items() if key[0] == 60} == {13}
    assert {tuple(sorted(page)[:3]) for key, page in rows.items() if 0 < key[0] < 60} == {((1, "h", 2, "title  1 OF"), (2, "h", 2, "Nowhere"), (3, "p", None, "words and more"))}


def test_mend_reads_the_next_word_alone():
    """a long line took the square of its length, for each hyphen copied what was left of it."""
    began = time.process_time()
    assert mend("vendo- se bem- feito, " * 40_000, "pt") == "vendo-se bemfeito, " * 40_000
    assert time.process_time() - began < 20


def test_decorative_filter_has_one_answer_for_ties(spark):
    """of images of one content on one place the row depended on the order of the input."""
    from foliomill.operators import operations

    rows = [(1, 3, "a", 40, 33), (1, 3, "a", 52, 33), (1, 4, "a", 32, 32), (2, 3, "b", 44, 33), (2, 3, "b", 44, 32)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "doc_id long, ord long, md5 string, w long, h long").coalesce(1)
        assert sorted(map(tuple, operations.decorative_filter(df).collect())) == [(1, 3, "a", 40, 33), (2, 3, "b", 44, 32)]


def test_decorative_filter_keeps_the_first_of_the_table(spark, tmp_path):
    """of images on one place the narrowest was kept, where the SQL keeps the one that stands first."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from foliomill.plans.registry import ORACLE_SQL, QUERIES

    lines = [(1, 3, 7, 40.0), (1, 3, 7, 15.0), (1, 2, 8, 3.0), (1, 4, 8, 30.0), (2, 4, 9, 20.0), (2, 4, 9, 20.0), (2, 4, 9, 13.0), (1, 3, 7, 50.0)] + [(3, 5, n % 11, 49.0 - n % 37) for n in range(400)]
    for folder, given in (("down", lines), ("up", lines[::-1])):
        file = tmp_path / folder / "lineitem.parquet"
        file.parent.mkdir()
        columns = dict(zip(("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), map(list, zip(*given))))
        pq.write_table(pa.table(columns, pa.schema([("l_orderkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_partkey", pa.int64()), ("l_quantity", pa.float64())])), file, row_group_size=50)
        con = duckdb.connect(config={"threads": 1})
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{file}'")
        got = QUERIES["decorative_filter"](spark, str(file.parent))
        assert got.columns == ["doc_id", "ord", "md5", "w", "h"]
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLE_SQL["decorative_filter"]).fetchall())

    files = tmp_path / "two" / "lineitem.parquet"
    for name, quantity in (("b", 14.0), ("a", 40.0)):
        files.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({"l_orderkey": [1] * 9, "l_linenumber": [4] * 9, "l_partkey": [5] * 9, "l_quantity": [quantity] * 9}), files / f"{name}.parquet")
    assert [r.w for r in QUERIES["decorative_filter"](spark, str(files.parent)).collect()] == [60]
