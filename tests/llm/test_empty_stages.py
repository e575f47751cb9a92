"""Every stage of the pipeline on a table without rows."""

import pytest

import corpus_pipeline

SCALE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[name for name, _ in corpus_pipeline.STAGES])
def test_a_stage_without_documents(spark, name, stage):
    docs = spark.read.parquet(f"{SCALE}/documents.parquet")
    after = stage(spark, docs.limit(0), SCALE)
    assert after.count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert sorted(after.columns) == sorted(docs.columns)
