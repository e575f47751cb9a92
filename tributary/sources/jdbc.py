"""Snapshot scans of relational tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JdbcSource:
    """A database to read from.  Credentials come from the job's configuration."""

    url: str
    database: str
    driver: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    fetch_size: int = 10_000

    def options(self) -> dict[str, str]:
        chosen = {
            "url": self.url,
            "driver": self.driver,
            "user": self.user,
            "password": self.password,
            "fetchsize": str(self.fetch_size),
            # The sources' DATETIME has no zone.
            "preferTimestampNTZ": "true",
        }
        return {name: value for name, value in chosen.items() if value is not None}

    def relation(self, table: str) -> str:
        """The table as an aliased sub-query; filters and columns are pushed into it."""
        return f"(select * from {self.database}.{table}) as src"

    def bounds_query(self, table: str, column: str) -> str:
        return f"select min({column}) as low, max({column}) as high from {self.database}.{table}"


def partition_options(column: str, low: int, high: int, partitions: int) -> dict[str, str]:
    """Split the scan into ranges of ``column``.  The outer ranges are open and the first
    takes the nulls, so rows outside the bounds are read too."""
    return {
        "partitionColumn": column,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(partitions),
    }


def read_table(
    spark: SparkSession,
    source: JdbcSource,
    table: str,
    partition_column: str | None = None,
    partitions: int = 1,
) -> DataFrame:
    """Read ``table`` lazily, in ``partitions`` parallel ranges of an integer column.

    The ranges' bounds are the column's own, asked of the database with one
    aggregate that its key index answers.  Where ids are bunched and equal
    ranges would be uneven, use :func:`read_evenly`.
    """
    reader = spark.read.format("jdbc").options(**source.options())
    if partition_column is not None and partitions > 1:
        bounds = reader.option("query", source.bounds_query(table, partition_column)).load().first()
        if bounds["low"] is not None and bounds["low"] < bounds["high"]:
            split = partition_options(partition_column, bounds["low"], bounds["high"], partitions)
            reader = spark.read.format("jdbc").options(**source.options()).options(**split)
        else:
            reader = spark.read.format("jdbc").options(**source.options())
    return reader.option("dbtable", source.relation(table)).load()


def read_where(spark: SparkSession, source: JdbcSource, table: str, conditions: list[str]) -> DataFrame:
    """Read ``table`` with one task per condition.  Together the conditions must hold for each row once."""
    properties = source.options()
    url = properties.pop("url")
    return spark.read.jdbc(url, source.relation(table), predicates=conditions, properties=properties)


def even_conditions(keys: DataFrame, column: str, parts: int) -> list[str]:
    """At most ``parts`` conditions on an integer column, each for about as many rows; together they hold for each row once.

    The bounds are quantiles of ``keys``, found in one pass with one small sketch per task; a range is off by at most a
    hundredth of an even share at either end. The first range takes the nulls. A value is never split: one that holds
    more than a share has a range of its own, and there are fewer ranges.
    """
    if parts < 1:
        raise ValueError("parts must be at least 1")
    shares = [k / parts for k in range(1, parts)]
    found = keys.agg(F.percentile_approx(column, shares, 100 * parts).alias("bounds")).first()["bounds"] if shares else None
    least = keys.agg(F.min(column).alias("low")).first()["low"] if found else None
    bounds = sorted({int(bound) for bound in found or [] if bound > least})
    # A bound ends one range and begins the next: a value of more than a share is cut off on both sides.
    bounds = sorted({*bounds, *(int(b) + 1 for b in found or [] if found.count(b) > 1)})
    if not bounds:
        return ["1 = 1"]
    between = [f"{column} >= {low} and {column} < {high}" for low, high in zip(bounds, bounds[1:], strict=False)]
    return [f"{column} < {bounds[0]} or {column} is null", *between, f"{column} >= {bounds[-1]}"]


def read_evenly(spark: SparkSession, source: JdbcSource, table: str, column: str, parts: int) -> DataFrame:
    """Read ``table`` in ranges of an integer column that hold about as many rows each, one task per range.

    The column alone is read first, in equal widths, for the bounds: on bunched ids that scan is uneven, but narrow.
    """
    keys = read_table(spark, source, table, column, parts).select(column)
    return read_where(spark, source, table, even_conditions(keys, column, parts))
