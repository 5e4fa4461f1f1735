import corpus_pipeline

from data import ENGLISH, ODD, documents


def test_odd_rows_go_through(spark, tmp_path):
    rows = [*ODD, *[(100 + i, f"number {i} of some plain words that say very little about anything {i} at all", "en", "s" if i % 3 else "t", 0, 0.5, 1) for i in range(30)]]
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns
            made.write.parquet(str(tmp_path / f"stage{k}"))
            docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
    assert made.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == made.count()


def test_decisions(spark):
    rows = [(1, "the cat sat on the mat all day long", "en", "s", 0, 0.5, 1), (2, "The cat sat on the mat all day long", "en", "s", 0, 0.5, 1), (2, "The cat sat on the mat all day long", "en", "s", 0, 0.5, 1), (3, "12 34", "en", "s", 0, 0.5, 1), (4, "a wholly different text of another kind", None, "s", 0, 0.5, 1), (None, "one more row that has no id at all", "en", "s", 0, 0.5, 1)]
    docs = documents(spark, rows)
    known = corpus_pipeline.known_language(spark, docs, "")
    assert sorted((r.doc_id or 0) for r in known.collect()) == [0, 1, 2, 2, 4] and known.where("lang is null").count() == 0
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()) == [0, 1, 3, 4]
    twice = documents(spark, [rows[1], rows[2], rows[4]])
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, twice, "").collect()) == [2, 4]


def test_empty(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars int, weight double, passes int, block string, mix_tokens int, kept_id int, kept_rows int, SCORE double, known string, lang_pred string, `a.b` int"
    rows = [(i, f"some plain words number {i} that say very little about anything {i % 7} at all", "en", "s" if i % 3 else "t", 9, 0.5, 1, "b", 2, 3, 4, 0.1, "k", "l", 5) for i in range(20)]
    docs = spark.createDataFrame([*rows, rows[0], (None, *rows[1][1:])], names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, "")
        assert made.schema.names == docs.schema.names, name
        assert {tuple(r)[5:] for r in made.collect()} == {rows[0][5:]}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 20


def test_unknown_languages_go(spark):
    rows = [(i, f"{ENGLISH} {i}", "en", "s", 0, 0.5, 1) for i in range(20)] + [(50, "漢字仮名交じり文で書かれた文章です", None, "s", 0, 0.5, 1), (51, "the lazy dog walks", None, "s", 0, 0.5, 1)]
    kept = {r.doc_id: r.lang for r in corpus_pipeline.known_language(spark, documents(spark, rows), "").collect()}
    assert 50 not in kept and kept[51] == "en" and len(kept) == 21
