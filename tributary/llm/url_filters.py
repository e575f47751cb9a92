"""URL filters: rules on host suffixes and path prefixes, found by hashed expressions.

Each URL gives the expressions a rule could be written as: every suffix of its
host, at dots, with every prefix of its path, at slashes. A rule and an
expression meet on the first digits of their digests, in an equi-join; the full
digest confirms it. Of the rules that fit, the longest wins, then the one with
the longer host, then a block.

Only suffixes of as many labels, and prefixes of as many segments, as some rule
has are made, so the number of expressions of a URL is bounded by the rules.
No broadcast is asked for: a short list is broadcast by its size, a long one
shuffled.

Defined results: a null url, or one without ``://``, has an empty host and path
and fits no rule. Repeated rows are judged one by one. A URL that no rule fits
gets the default verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.columns import ascii_lower, with_matches

PREFIX_DIGITS = 8

#: verdict, host, path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The rules as a table: verdict, host, path; a path is empty or ends in a slash."""
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not host or (path and not (path.startswith("/") and path.endswith("/"))):
            raise ValueError(f"not a rule: {verdict} {host} {path}")
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _digested(expressions: DataFrame) -> DataFrame:
    digest = F.sha2(F.concat(F.length("rule_host").cast("string"), F.lit(":"), "rule_host", "rule_path"), 256)
    return expressions.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))


def judge(urls: DataFrame, rules: DataFrame, url_column: str = "url", default: str = "allow") -> DataFrame:
    """Each distinct url with host, path, the rule that holds and the verdict."""
    distinct = urls.select(F.col(url_column).cast("string").alias("url")).distinct()
    parsed = distinct.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    listed = _digested(
        rules.dropDuplicates(["verdict", "host", "path"]).select("verdict", ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"))
    )
    depth = listed.agg(
        F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(1)).alias("labels"),
        F.coalesce(F.max(F.size(F.split("rule_path", "/")) - 1), F.lit(0)).alias("segments"),
    ).first()
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    last = F.least(F.size(labels), F.lit(depth["labels"]))
    suffixes = F.transform(F.sequence(F.lit(1), last), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    slashes = F.least(F.size(segments) - 1, F.lit(depth["segments"]))
    # n slashes: "" for none, else the first n parts with a slash after each.
    prefixes = F.transform(
        F.sequence(F.lit(0), slashes), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(segments, F.lit(1), n), "/"), F.lit("/")))
    )
    expressions = (
        parsed.filter(F.col("host") != "")
        .select("url", F.explode(suffixes).alias("rule_host"), prefixes.alias("prefixes"))
        .select("url", "rule_host", F.explode("prefixes").alias("rule_path"))
    )
    expressions = _digested(expressions).select("url", "digest", "short")
    fits = expressions.join(listed.withColumnRenamed("digest", "rule_digest"), "short").filter(F.col("digest") == F.col("rule_digest"))
    rule = F.concat("rule_host", "rule_path")
    best = F.max_by(
        F.struct(rule.alias("rule"), "verdict"), F.struct(F.length(rule), F.length("rule_host"), F.col("verdict") == "block")
    )
    chosen = fits.groupBy("url").agg(best.alias("best"))
    return parsed.join(chosen, "url", "left").select(
        "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def filter_pages(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """The id of every row with its url's host, path, rule and verdict."""
    rows = pages.select(F.col(id_column), F.col(url_column).cast("string").alias("url"))
    judged = judge(rows, rules)
    return with_matches(rows, judged, "url").select(id_column, "host", "path", "rule", "verdict")
