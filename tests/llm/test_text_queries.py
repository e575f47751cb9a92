"""Every registered query of the package against its SQL or a plain version, and the pipeline stage by stage."""

import hashlib
import re

import duckdb
import pytest
import sentencepiece

import __spark_entry__ as driver
import corpus_pipeline
from tributary.llm import quality_rules, sentencepiece_codec
from tributary.llm.oracle import ORACLE_SQL
from tributary.llm.queries import QUERIES

SCALE = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SCALE}/{table}.parquet'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([row[i] for i in order]) for row in rows)


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())
    assert set(ORACLE_SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_matches_its_sql(spark, oracle, name):
    df = QUERIES[name](spark, SCALE)
    answer = oracle.execute(ORACLE_SQL[name])
    columns = [column[0] for column in answer.description]
    assert comparable(df.columns, map(tuple, df.collect())) == comparable(columns, answer.fetchall())


def test_encoding_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SCALE}/documents.parquet").collect()}
    found = {tuple(r) for r in QUERIES["op4_sentencepiece"](spark, SCALE).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = {i: library.encode(t, add_eos=True) for i, t in texts.items()}
    assert found == {(i, len(x), digest(" ".join(map(str, x))), digest(library.decode(x))) for i, x in ids.items()}


def test_passage_and_score_queries(spark):
    ids = {r["doc_id"] for r in spark.read.parquet(f"{SCALE}/documents.parquet").collect()}
    passages = QUERIES["op10_substring_dedup"](spark, SCALE).collect()
    scores = QUERIES["op9_quality_classifier"](spark, SCALE).collect()
    assert {r["doc_id"] for r in passages} == {r["doc_id"] for r in scores} == ids
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scores)


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{SCALE}/documents.parquet")
    extra = docs.limit(1).selectExpr("cast(null as bigint) doc_id", "cast(null as string) text", "lang", "source", "n_chars")
    held = docs.union(extra)
    kept = {r["doc_id"] for r in quality_rules.quality(docs).filter("kept").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, held, SCALE)
        after.write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        if k == 0:
            assert {r["doc_id"] for r in after.collect()} == kept
        if k < len(corpus_pipeline.STAGES) - 1:
            assert sorted(after.columns) == sorted(docs.columns)
            held = after
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    texts = {r["doc_id"]: r["text"] for r in held.collect()}
    assert 100 < len(texts) < len(kept)
    rows = {r["doc_id"]: (list(r["ids"]), r["decoded_sha256"]) for r in after.collect()}
    assert rows == {i: (library.encode(t, add_eos=True), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}
    benchmark = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r["text"].lower()) for r in spark.read.parquet(f"{SCALE}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in benchmark for k in range(max(len(w) - 9, 1))}
    for text in texts.values():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        assert not any(tuple(w[k : k + 10]) in windows for k in range(len(w)))


def test_pipeline_runs_as_a_query(spark):
    assert corpus_pipeline.run(spark, SCALE).count() > 100


def test_pipeline_keeps_one_document_of_each_group(spark):
    """Rows without an id, and rows of one id, are told apart by their texts."""
    def text(name, n=60, own=""):
        return " ".join(f"{name}{k}" for k in range(n)) + own

    rows = [
        (1, text("a")), (None, text("a", own=" end")), (None, text("b")), (None, text("c")),  # one null id is linked
        (5, text("d")), (5, text("e")), (4, text("e", own=" end")),  # one text of id 5 is a copy
        (2, text("f")), (2, text("g")), (0, text("f", own=" end")), (3, text("g", own=" end")),  # 2 goes from one group, is least in the other
        (None, text("h")), (None, text("h", own=" end")), (None, text("h")),
        (9, text("i")), (9, text("i")), (7, None), (8, ""),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, "en", str(k), len(t or "")) for k, (i, t) in enumerate(rows)], schema).repartition(4)
    after = corpus_pipeline.one_of_each_group(spark, docs, SCALE)
    assert after.columns == docs.columns
    kept = [(r["doc_id"], (r["text"] or "")[:2]) for r in after.collect()]
    assert sorted(kept, key=str) == sorted(
        [(1, "a0"), (None, "b0"), (None, "c0"), (5, "d0"), (4, "e0"), (0, "f0"), (2, "g0"), (None, "h0"), (9, "i0"), (7, ""), (8, "")], key=str
    )
    assert {r["source"] for r in after.filter("doc_id = 9").collect()} == {"14"}
