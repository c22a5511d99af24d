"""Goldens of what is read aloud, of Markdown and of image reports."""

import random

from foliomill.operators import markdown, operations, speech


def test_elements():
    html = '<h1>Title &amp; more</h1><style>p{}</style><div>loose</div><p>One <b>bold</b>\n line<p>Two<ul><li>a<ul><li>b</li></ul></li><li>c</ul><blockquote><p>q</p></blockquote><img src="x" alt="A cat"><img src="y" alt=""><img src="z" alt="n" data-alt-missing="1"><p> </p><h2>open'
    assert speech.elements(html) == [
        ("h1", "Title & more"), ("p", "One bold line"), ("p", "Two"), ("li", "ab"), ("li", "b"), ("li", "c"), ("blockquote", "q"), ("p", "q"), ("img", "Image: A cat"), ("h2", "open"),
    ]
    assert speech.elements("") == speech.elements("only text") == []


def test_sentences_and_pieces():
    assert speech.pieces('It costs 1.250,00 now. "Really?" he said... Yes!', 24) == ["It costs 1.250,00 now.", '"Really?" he said...', "Yes!"]
    assert speech.joined("今天。 明天！”好. 今  x") == ("今天。明天！”好.今 x", [3, 7, 9, 12])
    assert speech.pieces("今天。明天！”好", 4) == ["今天。", "明天！”", "好"]
    assert speech.pieces("", 220) == speech.pieces(" \n ", 220) == []
    assert speech.pieces("One. Two. Three.", 10) == ["One. Two.", "Three."]
    assert speech.pieces("今天。明天。", 20) == ["今天。明天。"]
    assert speech.pieces("aaaa bbbb, cccc dddd", 12) == ["aaaa bbbb,", "cccc dddd"]
    assert speech.pieces("aaaa bbbb cccc", 12) == ["aaaa bbbb", "cccc"]
    assert speech.pieces("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    r = random.Random(2)
    for _ in range(50):
        text = "".join(r.choice(["a", "bc ", ", ", ". ", "。", "，", "1.5", "!) "]) for _ in range(400))
        cut = speech.pieces(text, 30)
        assert all(0 < len(p) <= 30 for p in cut) and "".join("".join(cut).split()) == "".join(text.split())


def test_pieces_of_rows(spark):
    rows = spark.createDataFrame([(1, "One. Two."), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in speech.speech_pieces(rows, 5).orderBy("piece_no").collect()] == [(1, "One.", 1), (1, "Two.", 2)]


def test_markdown():
    text = "---\ntitle: x\n---\n# One #\ntext\nmore\nUnder\n---\n- a\n- b\n  lazy\n\n  - c\n1. n\n\n> q\n> - z\n\n***\n~~~py\n# no heading\n~~~\n2. two\n  \nend\n2. no list inside\n"
    assert markdown.blocks(text) == [
        ("heading", 1, 0, "One"), ("heading", 2, 0, "text\nmore\nUnder"), ("bullet", 0, 0, "a"), ("bullet", 0, 0, "b\nlazy"), ("bullet", 0, 1, "c"), ("number", 0, 0, "n"), ("quote", 0, 1, "q"), ("bullet", 0, 1, "z"),
        ("rule", 0, 0, ""), ("code", 0, 0, "# no heading"), ("number", 0, 0, "two"), ("paragraph", 0, 0, "end\n2. no list inside"),
    ]
    assert markdown.blocks("") == markdown.blocks("\r\n \r") == []
    more = "| a | b |\n|--|--|\n| 1 | 2 |\nText\n===\n1. one\n2. two\n   > in\n\n   ## Sub\n   ```\n   x\n   ```\n\t- deep\n* * *\n> a\nb"
    assert markdown.blocks(more) == [
        ("table", 0, 0, "| a | b |\n|--|--|\n| 1 | 2 |"), ("heading", 1, 0, "Text"), ("number", 0, 0, "one"), ("number", 0, 0, "two"), ("quote", 0, 2, "in"), ("heading", 2, 1, "Sub"), ("code", 0, 1, " x"),
        ("bullet", 0, 1, "deep"), ("rule", 0, 0, ""), ("quote", 0, 1, "a"), ("paragraph", 0, 0, "b"),
    ]
    deep = markdown.blocks(">" * 40 + " x")
    assert deep[-1][2] == markdown.DEEPEST + 1 and deep[-1][3].endswith("x")
    assert markdown.blocks("```\nopen") == [("code", 0, 0, "open")]


def test_table_cells(spark):
    rows = spark.createDataFrame([(1, "| A | b \\| c |\n|:--|:--:|\n| 1 | 2 | 3 |\nx\n\nno | table"), (2, None)], "doc_id long, text string")
    cells = markdown.markdown_table_cells(markdown.markdown_blocks(rows)).orderBy("row_no", "col_no").collect()
    assert [(r.row_no, r.col_no, r.is_header, r.align, r.text) for r in cells] == [
        (0, 0, True, "left", "A"), (0, 1, True, "center", "b \\| c"), (1, 0, False, "left", "1"), (1, 1, False, "center", "2"), (1, 2, False, "", "3"),
    ]


def test_images_over_batches(spark):
    rows = [(d, i, f"m{i % 4}", 10 + i, i != 2, "a" if i % 2 else None) for d in (1, 2) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, ord int, md5 string, bytes long, valid boolean, alt string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 5)
    try:
        got = [(r.included, r.missing_alt, r.skipped, r.reasons) for r in operations.image_report(df, most=3).collect()]
        tight = [(r.included, r.skipped, r.reasons) for r in operations.image_report(df, total=25, biggest=20).collect()]
    finally:
        spark.conf.set(key, before)
    # m0, m1 and m3 are kept; m2 is invalid at first, and later there are three already.
    assert got == [(3, 1, 3, {"invalid": 1, "limit_count": 2})] * 2
    # 10 and 11 bytes fit; what follows is invalid, too big for the rest, or a repeat.
    assert [x[:2] for x in tight] == [(2, 6)] * 2 and sum(tight[0][2].values()) == 6
    assert operations.image_report(df.filter("false")).count() == 0
