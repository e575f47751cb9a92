from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import plan_of, rows_of
from tributary.operators.latest import latest_by_key
from tributary.operators.quality import key_violations, load_key_violations, not_negative, positive, require_key

import pytest


def versions(spark, rows):
    return spark.createDataFrame(rows, "k INT, t INT, v STRING")


def test_null_order_value_loses(spark):
    df = versions(spark, [(1, None, "none"), (1, 3, "three"), (2, None, "only")])
    assert rows_of(latest_by_key(df, ["k"], ["t"])) == [(1, 3, "three"), (2, None, "only")]


def test_null_keys_are_one_group(spark):
    df = versions(spark, [(None, 1, "a"), (None, 2, "b"), (1, 1, "c")])
    assert rows_of(latest_by_key(df, ["k"], ["t"])) == [(None, 2, "b"), (1, 1, "c")]


def test_ties_go_to_the_tie_break(spark):
    df = versions(spark, [(1, 5, "a"), (1, 5, "c"), (1, 5, "b")])
    assert rows_of(latest_by_key(df, ["k"], ["t"], ["v"])) == [(1, 5, "c")]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(
        st.tuples(st.integers(0, 5) | st.none(), st.integers(0, 99)), min_size=1, max_size=40, unique_by=lambda r: r
    )
)
def test_equals_max_by_when_order_values_are_unique(spark, rows):
    df = spark.createDataFrame(rows, "k INT, t INT")
    newest = latest_by_key(df, ["k"], ["t"])
    expected = df.groupBy("k").agg(F.max("t").alias("t"))
    assert rows_of(newest) == rows_of(expected)


def test_a_hot_key_is_cut_down_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    plan = plan_of(latest_by_key(df, ["k"], ["t"]))
    partial, exchange, final = plan.index("1, Partial"), plan.index("Exchange"), plan.index("1, Final")
    assert final < exchange < partial  # printed top down
    assert plan.count("Exchange") == 1


def test_columns_and_key_filters_reach_the_scan(spark):
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    newest = latest_by_key(lineitem, ["l_orderkey"], ["l_shipdate"]).filter("l_orderkey = 7").select("l_orderkey", "l_tax")
    plan = plan_of(newest)
    assert "EqualTo(l_orderkey,7)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_tax:double,l_shipdate:timestamp_ntz>" in plan


def test_range_filters_drop_nulls(spark):
    df = spark.createDataFrame([(0,), (-1,), (None,), (2,)], "v INT")
    assert rows_of(df.filter(not_negative("v"))) == [(0,), (2,)]
    assert rows_of(df.filter(positive("v"))) == [(2,)]


def test_key_violations(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 3)], "a INT, b INT")
    assert rows_of(key_violations(df, ["a", "b"])) == [(None, 3, 1), (1, 1, 2)]
    with pytest.raises(ValueError, match="no key"):
        require_key(df, ["a", "b"])
    good = df.filter("b > 1 AND a IS NOT NULL")
    assert require_key(good, ["a", "b"]) is good


def test_timestamps_order_by_instant(spark):
    df = spark.createDataFrame(
        [(1, datetime(2026, 1, 1), "old"), (1, datetime(2026, 1, 1, 0, 0, 0, 1), "new")], "k INT, t TIMESTAMP_NTZ, v STRING"
    )
    assert latest_by_key(df, ["k"], ["t"]).first()["v"] == "new"


def test_key_violations_of_a_load(spark):
    columns = "a int, b int, c string"
    table = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (5, 5, "x"), (5, 5, "y"), (None, 3, "x")], columns)
    load = spark.createDataFrame([(1, 1, "z"), (2, 1, "z"), (3, 3, "z"), (3, 3, "w"), (None, 3, "z")], columns)
    # (5, 5) is no key of the load; what a null stands for is not looked up.
    assert rows_of(load_key_violations(load, table, ["a", "b"])) == [(None, 3, 1), (1, 1, 2), (3, 3, 2)]
    assert load_key_violations(load.limit(0), table, ["a", "b"]).count() == 0
    assert rows_of(load_key_violations(load, table.limit(0), ["a", "b"])) == [(None, 3, 1), (3, 3, 2)]
