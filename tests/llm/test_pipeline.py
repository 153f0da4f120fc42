"""The registered queries against DuckDB, and the pipeline's stages against what they promise."""

import re

import pytest

import corpus_pipeline
from compare import assert_same, connect
from test_dedup import components
from timeloom.llm import queries, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(queries.queries()[name](spark, DATA), connect(DATA), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql()) - {"op3_decontamination"}))
def test_query_covers_every_document(spark, name):
    got = queries.queries()[name](spark, DATA)
    assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before, seen = docs.columns, {r.doc_id for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before
        seen[name], before = before - after, after
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "exact_dedup":
            texts = [re.sub(r"\s", "", r.text) for r in docs.collect()]
            assert len(texts) == len(set(texts))
        if name == "near_dedup":
            assert after == {i for i, c in components(rows).items() if i == c}
    assert seen["exact_dedup"] and seen["decontamination"] and not seen["byte_bpe"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    said = toxicity.score_toxicity(spark.read.parquet(f"{DATA}/documents.parquet"), labels).where("predicted = 1")
    assert {r.doc_id for r in said.collect()} == seen["toxicity"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == before


def test_stages_on_an_empty_table(spark):
    none = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0
