"""Corpus queries next to their SQL, and the pipeline's stages, on the smallest tables."""

import pytest
from compare import compare, load

import corpus_pipeline
from usetrail.llm.queries import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return load(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], CHECKS.get(name), SF)
    assert ok, note


def test_stages_keep_the_columns_and_only_rows_of_their_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        out.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.sql.warehouse.dir')}/stage-{name}")
        docs = spark.read.parquet(path)
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after and after <= before, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == after
