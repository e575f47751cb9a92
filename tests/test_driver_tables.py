from datetime import datetime
from decimal import Decimal

from conftest import plan_of, rows_of
from pyspark.sql import functions as F
from tributary.plans.driver_tables import RAW_VIEWS, campaigns_of

SCHEMA = "l_orderkey BIGINT, l_returnflag STRING, l_linestatus STRING, l_extendedprice DOUBLE, l_shipdate TIMESTAMP_NTZ"


def _as_worded(spark, lines):
    _, columns, group = RAW_VIEWS["campaigns"]
    return spark.sql(f"SELECT {columns} FROM {{lines}} GROUP BY {group}", lines=lines)


def test_campaigns_are_those_of_the_view_on_odd_lines(spark):
    prices = [1.005, 2.675, -1.005, 0.125, 0.1 + 0.2, -0.0, 1e-9, 0.005, 12345678.9, 1234567890123.45, 9999999999999.99, 1e13, 1e15 + 0.125, 9.9e15, None]
    statuses = ["O", "F", None, "", "Ünfilled and rather long", "o", "Ofen", "a\u0000b"]
    lines = [
        (key, flag, statuses[(i + (key or 0)) % len(statuses)], price, datetime(1995, 1, 1 + i, 23, 59))
        for key in (1, 2, None) for flag in ("A", "R", None) for i, price in enumerate(prices)
    ]
    lines += [(3, "N", None, None, None), (4, "N", "O", 9.9e15, None), (5, "N", "zz", 0.015, None)]
    lines += [(6, "N", "b", 9.9e15, None)] * 20  # as cents, these are more than a long holds
    lines = spark.createDataFrame(lines, SCHEMA)
    found, expected = campaigns_of(lines), _as_worded(spark, lines)
    assert found.dtypes == expected.dtypes
    assert rows_of(found) == rows_of(expected)
    (largest,) = rows_of(found.filter("campaign_id = 6"), "budget")
    assert largest == (Decimal("198000000000000000.000000000"),)


def test_campaigns_of_random_prices(spark):
    lines = spark.range(20_000).select(
        (F.col("id") % 700).alias("l_orderkey"), F.lit("A").alias("l_returnflag"), F.col("id").cast("string").alias("l_linestatus"),
        (F.round(F.rand(3) * F.pow(F.lit(10), F.col("id") % 14), 2) + F.when(F.col("id") % 5 == 0, F.rand(4)).otherwise(0)).alias("l_extendedprice"),
        F.lit(datetime(1995, 1, 1)).cast("timestamp_ntz").alias("l_shipdate"),
    )
    assert rows_of(campaigns_of(lines)) == rows_of(_as_worded(spark, lines))


def test_campaigns_are_hashed_and_not_sorted(spark):
    lines = spark.createDataFrame([(1, "A", "O", 1.5, datetime(1995, 1, 1))], SCHEMA)
    assert "SortAggregate" in plan_of(_as_worded(spark, lines))
    assert "SortAggregate" not in plan_of(campaigns_of(lines))


def test_campaigns_of_no_lines(spark):
    assert campaigns_of(spark.createDataFrame([], SCHEMA)).collect() == []
