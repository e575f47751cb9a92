"""From raw documents to token ids: the stages of the corpus, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import decontamination, jaccard_join, line_dedup, quality_rules, sentencepiece_codec
from tributary.llm.columns import keep_batches_small, text_digest, text_or_empty, written


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    keep_batches_small(spark)
    return quality_rules.keep_good(docs)


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share, but in one of them; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs, lines_column="__n_lines", dropped_column="__n_dropped")
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents the one with the smallest id, and the smallest digest of its text among rows of that id.

    Rows that share an id, or have none, are told apart by their texts; a null id
    comes after all others. Rows alike in both are one document, and of them the
    one that is least in its other columns stays.
    """
    digest = text_digest(text_or_empty(F.col("text")))
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest.alias("digest")).alias("document"), "text")
    classes = jaccard_join.linked_classes(named, id_column="document")
    gone = classes.filter(~F.col("document").eqNullSafe(F.col("component_id"))).select(F.col("document.id").alias("__id"), F.col("document.digest").alias("__of")).distinct()
    stay = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (text_digest(text_or_empty(docs["text"])) == gone["__of"]), "left_anti")
    others = [name for name in docs.columns if name not in ("doc_id", "text")]
    if not others:
        return stay.distinct()
    return stay.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("__others")).select(*[F.col(f"__others.{name}") if name in others else F.col(name) for name in docs.columns])


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    found = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    held = found.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__of"))
    same = docs["doc_id"].eqNullSafe(held["__id"]) & (text_digest(text_or_empty(docs["text"])) == held["__of"])
    return docs.join(held, same, "left_anti")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and the digest of what they decode to."""
    keep_batches_small(spark)
    return sentencepiece_codec.encode_with_digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good_texts),
    ("line dedup", first_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", clean_of_benchmark),
    ("SentencePiece encoding and decoding", token_ids),
]

#: SQL cannot express the encoding; the tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
