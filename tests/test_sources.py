"""Text corpora in, document tables and logs out."""

import csv
import datetime

from foliomill.sources import files


def test_texts_of_any_encoding(spark, tmp_path):
    given = {"a.txt": "﻿one\r\ntwo\rthree".encode(), "b.txt": "café – fin".encode("cp1252"), "c.txt": "café".encode()}
    for name, raw in given.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_text_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "one\ntwo\nthree", "b.txt": "café – fin", "c.txt": "café"}


def test_documents_by_language(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "en"), (2, "b", "de"), (3, "c", None)], "doc_id long, text string, language string")
    for _ in range(2):  # writing again replaces
        files.write_documents(rows, str(tmp_path / "docs"))
    back = spark.read.parquet(str(tmp_path / "docs"))
    assert sorted((r.doc_id, r.text, r.language) for r in back.collect()) == [(1, "a", "en"), (2, "b", "de"), (3, "c", None)]
    assert {p.name for p in (tmp_path / "docs").glob("language=*")} == {"language=en", "language=de", "language=__HIVE_DEFAULT_PARTITION__"}


def test_log_as_csv(spark, tmp_path):
    log = spark.createDataFrame([(1, datetime.datetime(2026, 1, 2, 3, 4, 5), "error", "x_y", '=sum("a", 1)', {"k": "v", "b": "w"})], "id long, ts timestamp, level string, event string, message string, context map<string,string>")
    files.export_log_csv(log, str(tmp_path / "log"))
    lines = [x for part in (tmp_path / "log").glob("*.csv") for x in list(csv.reader(part.open(), escapechar="\\"))[1:]]
    assert lines[0] == ["1", "2026-01-02 03:04:05", "error", "x_y", '\'=sum("a", 1)', "b=w; k=v"]


def test_documents_without_words(spark):
    rows = spark.createDataFrame([(1, 5), (2, 0), (3, None)], "doc_id long, words long")
    full, empty = files.refuse_empty(rows)
    assert [r.doc_id for r in full.collect()] == [1] and sorted(r.doc_id for r in empty.collect()) == [2, 3]
