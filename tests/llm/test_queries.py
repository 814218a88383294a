"""The registered queries of the training-data operators and the pipeline on the smallest tables."""

import os

import pytest

import corpus_pipeline
from lapforge.llm import queries as llm

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_rows(spark, name):
    df = llm.QUERIES[name](spark, SF)
    n, docs = df.count(), spark.read.parquet(f"{SF}/documents.parquet").count()
    if name.split("_")[0] in ("op1", "op2", "op3", "op5", "op7", "op9", "op10", "op11", "op12", "op13"):
        assert n == docs
    else:
        assert n > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
        assert docs.count() > 0
