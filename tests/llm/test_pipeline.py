import random

import corpus_pipeline
from tests.llm.test_packing import check


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(9)
    words = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()  # noqa: SIM905
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = text(150)
    rows = [(i, text(r.randint(20, 200)), "en", "s", 0) for i in range(30)]
    rows += [(100, "12345 !!! 678", "en", "s", 0), (101, None, "en", "s", 0), (102, rows[0][1], "en", "s", 0), (103, rows[1][1] + " end", None, "s", 0)]
    rows += [(104, text(30) + " " + passage + " " + text(30), "en", "s", 0), (105, text(40) + " " + passage + " " + text(20), "en", "s", 0)]
    rows += [(106, text(30) + ' password = "hunter2hunter2" ' + text(30), "en", "s", 0)]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(path))
    docs, seen = spark.read.parquet(str(path)), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    ids = {name: {x.doc_id for x in got} for name, got in seen.items()}
    assert ids["language_id"] == {x[0] for x in rows} - {100, 101}
    assert ids["ngram_join"] == ids["language_id"] - {102, 103} or ids["ngram_join"] == ids["language_id"] - {102}
    assert ids["suffix_dedup"] == ids["secret_scan"] == ids["packing"] == ids["ngram_join"]
    left = {x.doc_id: x.text for x in seen["secret_scan"]}
    assert passage not in left[104] and passage not in left[105]
    assert "hunter2" not in left[106] and "[secret]" in left[106]
    assert all(left[i] == rows[i][1] for i in range(30))
    assert check(seen["packing"], list(left.items())) <= 2048
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda x: (x.doc_id, x.start, x.length, x.ids_crc32)
    assert sorted(map(key, whole.collect())) == sorted(map(key, seen["packing"]))
