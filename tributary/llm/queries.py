"""The operators of this package on the documents' tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import (
    byte_bpe,
    centroid_clustering,
    decontamination,
    jaccard_join,
    license_scans,
    line_dedup,
    periodic_runs,
    quality_classifier,
    quality_rules,
    secret_scans,
    sentencepiece_codec,
    substring_dedup,
    url_filters,
)
from tributary.llm.columns import cut_words, text_digest, text_or_empty, with_matches, word_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(_documents(spark, sf_dir))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scans.scan(_documents(spark, sf_dir))
    return found.withColumns({name: F.array_join(name, ",") for name in ("base_labels", "labels")})


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty(F.col("text")), 256).alias("kept_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip_digests(_documents(spark, sf_dir))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.scan(_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scans.BASE_RULES))
    counts = {f"n_{rule.kind}": F.size(secret_scans.of_kind(F.col("spans"), rule.kind)).cast("bigint") for rule in secret_scans.BASE_RULES}
    digests = {"base_sha256": F.sha2(secret_scans.listed(base), 256), "spans": secret_scans.listed(F.col("spans"))}
    return found.select("doc_id", *[c.alias(name) for name, c in (counts | digests).items()])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = decontamination.contaminated(docs, _table(spark, sf_dir, "benchmark"))
    text = text_or_empty(F.col("text"))
    rows = docs.select("doc_id", text_digest(text).alias("digest"), word_count(cut_words(text)).alias("n_words"))
    both = with_matches(rows, found, "doc_id", "digest")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]), F.lit(0).cast("bigint"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return both.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_classes(_documents(spark, sf_dir), width=3, percent=90)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filters.rule_table(spark, url_filters.RULES)
    return url_filters.filter_pages(_table(spark, sf_dir, "pages"), rules)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    network = quality_classifier.train(docs, _table(spark, sf_dir, "labels"))
    held_out = quality_classifier.held_out(F.col("doc_id"))
    scored = quality_classifier.score(docs, network)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_passages(_documents(spark, sf_dir))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.withColumn("spans", spans)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clustering.lloyd(_table(spark, sf_dir, "embeddings"), n_clusters=40, rounds=5, dimensions=64)
    return centroid_clustering.with_inertia(found).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The texts with one of ten, told by its id, repeating a stretch of its words up to its end; an id that is null plants nothing."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.col("n")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    cut = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words").cast("bigint"))
    cut = cut.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))  # sizes of nulls are negative
    a, p = F.col("a").cast("int"), F.col("p").cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), a), tail), " ")
    return cut.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(_documents(spark, sf_dir)))
    best = periodic_runs.strongest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_quality_rules,
        op2_license_scans,
        op3_line_dedup,
        op4_sentencepiece,
        op5_secret_scans,
        op6_decontamination,
        op7_jaccard_join,
        op8_url_filters,
        op9_quality_classifier,
        op10_substring_dedup,
        op11_centroid_clustering,
        op12_periodic_runs,
        op13_byte_bpe,
    )
}
