"""What the pipeline's Python steps hold at once does not follow the length of rows, nor Spark's 10,000 rows a batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tributary.llm import flat, jaccard_join, quality_rules
from tributary.llm.columns import BATCH_BYTES, small_batches

SCALE = "/root/testdata/sf0.001"
BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def batch_bytes(df):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    return df.mapInArrow(run, "bytes bigint")


@pytest.fixture
def own_bound(spark):
    before = spark.conf.get(BOUND, None)
    spark.conf.unset(BOUND)
    yield
    spark.conf.unset(BOUND)
    if before is not None:
        spark.conf.set(BOUND, before)


@pytest.fixture
def long_rows(spark):
    return spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 1000).alias("text"))


def test_long_rows_come_in_small_batches(spark, long_rows, own_bound):
    with small_batches(spark):
        sizes = [r["bytes"] for r in batch_bytes(long_rows).collect()]
    assert sum(sizes) > 20e6 and max(sizes) < 1.5 * BATCH_BYTES
    assert spark.conf.get(BOUND, None) is None


def test_jaccard_jobs_run_with_small_batches(monkeypatch, spark, long_rows, own_bound):
    write, bounds = jaccard_join.written, []

    def noted(df, purpose):
        bounds.append(spark.conf.get(BOUND, None))
        return write(df, purpose)

    monkeypatch.setattr(jaccard_join, "written", noted)
    assert jaccard_join.linked_classes(long_rows.limit(5)).count() == 5
    assert len(bounds) > 3 and set(bounds) == {str(BATCH_BYTES)}
    assert spark.conf.get(BOUND, None) is None


@pytest.mark.parametrize("stage", [corpus_pipeline.good_texts, corpus_pipeline.token_ids])
def test_stages_that_run_when_read_keep_batches_small(spark, own_bound, stage):
    docs = spark.read.parquet(f"{SCALE}/documents.parquet")
    stage(spark, docs, SCALE)
    assert spark.conf.get(BOUND) == str(BATCH_BYTES)
    spark.conf.set(BOUND, "1000000")
    stage(spark, docs, SCALE)
    assert spark.conf.get(BOUND) == "1000000"


class Taken:
    """Stands for a table; hands out the function that it would be mapped by."""

    columns, schema = ["text"], "text string"

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


@pytest.mark.parametrize("step", [quality_rules.keep_good, lambda docs: jaccard_join._measured(docs, 5, "bigint")], ids=["quality rules", "shingle sets"])
def test_a_slice_takes_little_memory(monkeypatch, step):
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    monkeypatch.setattr(flat, "_powers", {})
    texts = pa.array([" ".join(f"word{(7 * i + k * k) % 997}" for k in range(300)) for i in range(1500)])
    batch = pa.record_batch([texts, texts], names=["text", "again"])
    run = step(Taken())
    list(run([batch.slice(0, 2)]))  # tables that stay
    tracemalloc.start()
    try:
        for _ in run([batch]):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert texts.nbytes > 3e6
    assert peak < 30e6


def test_sketches_in_the_join_tell_the_same(spark):
    """Marks are of one size, however long the sketches, and tell what these tell when folded; never more."""
    drawn = np.unique(np.random.default_rng(3).integers(0, 2**64, 3000, dtype=np.uint64))
    pairs = [(drawn[:a], drawn[skip : skip + b]) for a in (1, 90, 250, 700) for b in (1, 99, 260, 800) for skip in (0, 20) if a < 2 * b and b < 2 * a]
    sketches = [tuple(jaccard_join.parity_sketch(s) for s in pair) for pair in pairs]
    assert len({len(x) for x, _ in sketches}) > 1
    table = spark.createDataFrame([(k, *[jaccard_join.mark(s).tolist() for s in pair]) for k, pair in enumerate(sketches)], "k int, x array<bigint>, y array<bigint>")
    found = {r["k"]: r["d"] for r in table.select("k", jaccard_join._differing(F.col("x"), F.col("y")).alias("d")).collect()}
    short = jaccard_join.SKETCH_BITS // 8
    folded = [[np.bitwise_xor.reduce(s.reshape(-1, short), axis=0) for s in pair] for pair in sketches]
    assert found == {k: jaccard_join.least_difference(x, y) for k, (x, y) in enumerate(folded)}
    assert all(found[k] <= jaccard_join.least_difference(x, y) for k, (x, y) in enumerate(sketches))


def test_a_group_below_the_threshold_makes_few_rows(monkeypatch, spark):
    """Texts that share too little of a common part stay apart, and the last join has the sketches' bound in its own condition."""
    shared = [f"common{k}" for k in range(60)]
    texts = [" ".join(shared[(7 * i) % 20 :][:40] + [f"own{i}x{k}" for k in range(60)]) for i in range(90)]
    texts += [texts[0] + " end", texts[1] + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    plans, write = [], jaccard_join.written

    def noted(df, purpose):
        if purpose == "pairs":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, purpose)

    monkeypatch.setattr(jaccard_join, "written", noted)
    classes = {r["doc_id"]: r["component_id"] for r in jaccard_join.linked_classes(docs).collect()}
    assert classes == {i: {90: 0, 91: 1}.get(i, i) for i in range(92)}
    assert any("Join Inner" in line and "bit_count" in line for line in plans[-1].splitlines())
