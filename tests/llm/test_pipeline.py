"""The pipeline's stages on the smallest tables and on odd rows."""

import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_stages_follow_one_another(spark):
    docs = corpus_pipeline.read_table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        assert docs.count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.where("n_tokens = 0 and size(ids) > 0").count() == 0


def test_stages_take_odd_and_no_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "call +1 555 123 4567 89", "en", "a", 23), (2, "call +1 555 123 4567 89", "en", "a", 23)]
    for data in (rows, []):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, spark.createDataFrame(data, kind), SF)
            assert got.count() <= 3 * len(data), name
