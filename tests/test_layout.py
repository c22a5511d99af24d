"""Pages of positioned text: columns written across are read one after the other, other pages are left alone."""

import pytest

from foliomill.operators.layout import placed_runs, reading_order

LEFT = ["A leitura em voz alta depende da ordem", "do texto, e quando a ordem se perde a", "frase deixa de fazer sentido para quem", "escuta o documento inteiro com calma.", "Artigos usam duas colunas para poupar", "papel, mas na tela as colunas viram um"]
RIGHT = ["desafio, porque o arquivo guarda cada", "linha em uma posição e não diz qual", "coluna vem primeiro nem onde termina.", "Alguns programas gravam a esquerda e", "depois a direita; outros gravam linha", "por linha, como se fosse uma coluna."]
BOTH = "\n".join(LEFT + RIGHT)


def columns(flip=1):
    return [(x, flip * (700 - 13 * i), t) for i in range(6) for x, t in ((50, LEFT[i]), (310, RIGHT[i]))]


def letters():
    out, wide = [], {"m": 8.3, "i": 2.2, " ": 2.8}
    for x, y, text in columns():
        for c in text:
            out.append((x, y, c))
            x += wide.get(c, 5.5)
    return out


NAMES = ["Ana Souza", "Davi Lima", "Clara Nunes", "Bruno Alves", "Rita Gomes", "Pedro Rocha"]
TITLES = ["Capítulo um: a ordem do texto", "Capítulo dois: as colunas", "Capítulo três: as tabelas", "Capítulo quatro: as listas", "Capítulo cinco: o rodapé", "Capítulo seis: a revisão"]
TITLE = "Leitura em duas colunas: um teste"
PAGES = {
    "across": (columns(), BOTH),
    "one after the other": ([*columns()[::2], *columns()[1::2]], None),
    "upside down": (columns(-1), BOTH),
    "one column": ([(50, 700 - 13 * i, f"{t} {t}") for i, t in enumerate(LEFT + RIGHT)], None),
    "table": ([p for i, n in enumerate(NAMES) for p in ((50, 700 - 16 * i, n), (250, 700 - 16 * i, "Recife"), (420, 700 - 16 * i, str(10 + i)))], None),
    "contents": ([p for i, n in enumerate(TITLES) for p in ((50, 700 - 14 * i, n), (300, 700 - 14 * i, "." * 40 + f" {3 + 4 * i}"))], None),
    "title and number": ([(50, 760, TITLE, 16), *columns(), (295, 40, "7")], f"{TITLE}\n\n{BOTH}\n\n7"),
    "letter by letter": (letters(), BOTH),
    "a line across between": ([*columns(), (50, 622, "This line goes from the left column far over to the right one, as a heading does."), *((x, y - 91, t) for x, y, t in columns())], f"{BOTH}\nThis line goes from the left column far over to the right one, as a heading does.\n{BOTH}"),
    "few words": (columns()[:6], None),
    "a gap inside": ([(x, y - 26 * (y < 660), t) for x, y, t in columns()], "\n".join([*LEFT[:4], "", *LEFT[4:], *RIGHT[:4], "", *RIGHT[4:]])),
}


@pytest.fixture(scope="module")
def read(spark):
    runs = [(k % 3, k, i, float(p[0]), float(p[1]), float(p[3] if len(p) > 3 else 10), p[2]) for k, (pieces, _) in enumerate(PAGES.values()) for i, p in enumerate(pieces)]
    runs += [(9, 9, 0, None, 1.0, 10.0, "x"), (9, 9, 1, 1.0, 1.0, None, None), (None, None, 0, 1.0, 1.0, 10.0, "x")]
    df = spark.createDataFrame(runs, "doc_id long, page_no long, ord long, x double, y double, size double, text string").selectExpr("*", "1 as line", "2 as `left`").repartition(3)
    return {r.page_no: r.text for r in reading_order(df).collect()}


@pytest.mark.parametrize("name", PAGES)
def test_page(read, name):
    assert read.get(list(PAGES).index(name)) == PAGES[name][1]


def test_pieces_to_runs(spark):
    pieces = [(1.0, 0.0, 0.0, 1.0, 72.0, 700.0, "Texto", 12.0), (1.0, 0.0, 0.0, 1.0, 110.0, 700.0, " ", 12.0), (0.0, 1.0, -1.0, 0.0, 20.0, 400.0, "Rotated", 12.0), (2.0, 0.0, 0.0, 2.0, 72.0, 650.0, "Scaled", 9.0), (1.0, 0.0, 0.0, 1.0, 5.0, 6.0, "small", None), (1.0, 0.0, 0.0, 1.0, 5.0, 6.0, "", 9.0)]
    df = spark.createDataFrame([(1, 1, i, *p) for i, p in enumerate(pieces)], "doc_id long, page_no long, ord long, a double, b double, c double, d double, e double, f double, text string, font_size double")
    assert [(r.ord, r.x, r.y, r.size, r.text) for r in placed_runs(df).orderBy("ord").collect()] == [(0, 72.0, 700.0, 12.0, "Texto"), (1, 110.0, 700.0, 12.0, " "), (3, 72.0, 650.0, 18.0, "Scaled"), (4, 5.0, 6.0, 10.0, "small")]


def test_one_exchange(spark):
    df = spark.createDataFrame([], "doc_id long, page_no long, ord long, x double, y double, size double, text string")
    out = reading_order(df)
    assert out.count() == 0
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
