"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline
from conftest import SCHEMA

from trailframe.llm import common as C

BASE = "/root/testdata/sf0.001"


def test_stages(spark, odd_docs):
    docs = C.read(spark, BASE, "documents")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = C.checkpoint(stage(spark, docs, BASE))
        assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0, name
        assert 0 < out.count() <= n
        n, docs = out.count(), out
    assert docs.columns[:5] == C.DOCUMENT_COLUMNS and docs.where("taken = 0").count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd_docs, BASE).columns == C.DOCUMENT_COLUMNS


def test_no_rows(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), BASE).collect() == []


def test_queries():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and {f"op{k}" for k in range(1, 11)} <= {n.split("_")[0] for n in names} and set(e.oracle_sql()) <= names
