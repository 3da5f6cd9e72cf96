"""Pipeline stages on tables whose extra columns are called like an operator's own."""

import pytest

import corpus_pipeline

OWN = ["quality", "again", "alone", "__id", "__t1", "__row", "__rate", "__source", "__copy", "__every", "__live", "column_1", "owner"]
TEXT = " ".join(f"word{i} other{i * 7}" for i in range(60))


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_all_columns(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    rows = [(1, TEXT, "en", "a", 5, *OWN), (2, TEXT, "en", "a", 5, *OWN), (3, TEXT + " password = hunter2222", None, None, None, *OWN),
            (3, TEXT + " password = hunter2222", None, None, None, *OWN), (4, None, "en", "b", 0, *OWN), (None, "", "", "", None, *OWN)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in OWN)
    docs = spark.createDataFrame(rows, columns)
    out = run(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(tuple(r)[5:] == tuple(OWN) for r in got)
    assert run(spark, docs.filter("false"), "").count() == 0


def test_packing_stage_takes_them_too(spark):
    rows = [(1, "some words", *OWN), (None, None, *OWN)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in OWN))
    out = dict(corpus_pipeline.STAGES)["best-fit packing"](spark, docs, "")
    assert sorted((r["doc_id"], r["length"] > 0) for r in out.collect() if r["doc_id"]) == [(1, True)] and out.count() == 2
