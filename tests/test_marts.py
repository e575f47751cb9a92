from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import plan_of, rows_of
from raw_samples import ROWS, T
from tributary import schemas
from tributary.operators import marts
from tributary.operators.clean import SPECS, clean

CUSTOMER = "customer_id INT, first_name STRING, last_name STRING"
PAID = "transaction_id INT, customer_id INT, amount DECIMAL(10,2)"
VISIT = "session_id INT, customer_id INT"
CAMPAIGN = "campaign_id INT, campaign_name STRING, channel STRING"
SALE = "transaction_id INT, payment_method_id INT, amount DECIMAL(10,2)"


def cleaned(spark, entity, extra=()):
    raw = spark.createDataFrame([*ROWS[entity], *extra], schemas.SOURCE[entity])
    return clean(raw, SPECS[entity])


def result(df):
    return rows_of(df.drop("ingestion_time"))


@pytest.mark.parametrize("keyed", [False, True])
def test_customer_summary(spark, keyed):
    inputs = [cleaned(spark, t) for t in ("customers", "transactions", "user_sessions")]
    expected = [
        (1, "Lena", "Bergqvist", 2, Decimal("80"), 1),
        (2, "Tomas", "Okafor", 1, Decimal("915.1"), 1),
        (3, "Wei", "Lindholm", 0, None, 0),
    ]
    summary = marts.customer_summary(*inputs, keyed=keyed)
    assert summary.schema.simpleString() == schemas.struct(schemas.CURATED["customer_summary"]).simpleString()
    assert result(summary) == expected
    assert result(marts.customer_summary_exact(*inputs, keyed=keyed)) == expected


@pytest.mark.parametrize("keyed", [False, True])
def test_sessions_multiply_spending_only_as_defined(spark, keyed):
    second = [(3, 1, T, T, "web", "2.0")]
    inputs = [cleaned(spark, "customers"), cleaned(spark, "transactions"), cleaned(spark, "user_sessions", second)]
    assert result(marts.customer_summary(*inputs, keyed=keyed))[0] == (1, "Lena", "Bergqvist", 2, Decimal("160"), 2)
    assert result(marts.customer_summary_exact(*inputs, keyed=keyed))[0] == (1, "Lena", "Bergqvist", 2, Decimal("80"), 2)


@pytest.mark.parametrize("keyed", [False, True])
def test_campaign_summary(spark, keyed):
    campaigns = cleaned(spark, "campaigns")
    assert result(marts.campaign_summary(campaigns, cleaned(spark, "transactions"), keyed=keyed)) == [
        (1, "Spring Bulbs", "RADIO", Decimal("80")),
        (2, "Choir Week", "STREET POSTERS", Decimal("915.1")),
        (3, "Moving Out", "LETTER", None),
    ]
    by_conversion = marts.campaign_summary_by_conversion(campaigns, cleaned(spark, "conversions"), keyed=keyed)
    assert by_conversion.schema.simpleString() == schemas.struct(schemas.CURATED["campaign_summary"]).simpleString()
    assert result(by_conversion) == [
        (1, "Spring Bulbs", "RADIO", Decimal("49.95")),
        (2, "Choir Week", "STREET POSTERS", Decimal("130")),
        (3, "Moving Out", "LETTER", Decimal("61.25")),
    ]


def joined_customers(customers, paid, visits):
    """The mart's definition, word for word: two joins, then one grouping."""
    return (
        customers.join(paid, "customer_id", "left")
        .join(visits, "customer_id", "left")
        .groupBy("customer_id", "first_name", "last_name")
        .agg(
            F.count_distinct("transaction_id").alias("total_transactions"),
            F.sum("amount").cast("decimal(38,9)").alias("total_spent"),
            F.count_distinct("session_id").alias("total_sessions"),
        )
    )


ids = st.integers(1, 3) | st.none()
money = st.decimals(min_value=-50, max_value=50, places=2) | st.none()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    customers=st.lists(st.tuples(ids, st.sampled_from("ab"), st.sampled_from("xy") | st.none()), max_size=8),
    paid=st.lists(st.tuples(ids, ids, money), max_size=10),
    visits=st.lists(st.tuples(ids, ids), max_size=10),
)
def test_customer_summary_equals_its_joins(spark, customers, paid, visits):
    """Also with repeated customers, ids that are no keys, and nulls anywhere."""
    c, p, v = (
        spark.createDataFrame(customers, CUSTOMER),
        spark.createDataFrame(paid, PAID),
        spark.createDataFrame(visits, VISIT),
    )
    assert result(marts.customer_summary(c, p, v)) == rows_of(joined_customers(c, p, v))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    campaigns=st.lists(st.tuples(ids, st.sampled_from("ab"), st.sampled_from("xy")), max_size=8),
    sales=st.lists(st.tuples(ids, ids, money), max_size=10),
)
def test_campaign_summary_equals_its_join(spark, campaigns, sales):
    c, s = spark.createDataFrame(campaigns, CAMPAIGN), spark.createDataFrame(sales, SALE)
    joined = c.join(s, c["campaign_id"] == s["payment_method_id"], "left")
    grouped = joined.groupBy("campaign_id", "campaign_name", "channel")
    expected = grouped.agg(F.sum("amount").cast("decimal(38,9)").alias("total_revenue"))
    assert result(marts.campaign_summary(c, s)) == rows_of(expected)


def test_fan_out_is_never_made(spark):
    """A million pairs for one customer, and not one of them becomes a row."""
    c = spark.createDataFrame([(1, "a", "x")], CUSTOMER)
    p = spark.range(1000).selectExpr("CAST(id AS INT) transaction_id", "CAST(id % 1 + 1 AS INT) customer_id", "CAST(0.01 AS DECIMAL(10,2)) amount")
    v = spark.range(1000).selectExpr("CAST(id AS INT) session_id", "CAST(id % 1 + 1 AS INT) customer_id")
    summary = marts.customer_summary(c, p, v)
    assert result(summary) == [(1, "a", "x", 1000, Decimal("10000"), 1000)]
    plan = plan_of(summary)
    assert "Expand" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_keyed_children_are_combined_before_their_only_shuffle(spark):
    d = "/root/testdata/sf0.001"
    p = spark.read.parquet(f"{d}/orders.parquet").selectExpr(
        "o_orderkey transaction_id", "o_custkey customer_id", "CAST(o_totalprice AS DECIMAL(18,2)) amount"
    )
    v = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id session_id", "user_id customer_id")
    c = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey customer_id", "c_name first_name", "c_name last_name")
    plan = plan_of(marts.customer_summary(c, p, v, keyed=True))
    # Two for the children; the joins broadcast here, where the tables are small enough for it.
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("partial_count") >= 2 and "partial_sum" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_campaigns_join_only_on_what_they_are_grouped_by(spark):
    c, s = spark.createDataFrame([], CAMPAIGN), spark.createDataFrame([], SALE)
    with pytest.raises(ValueError, match="cannot join"):
        marts.campaign_summary(c, s, left_key="status")


def test_campaign_keys_are_parameters(spark):
    c = spark.createDataFrame([(1, "a", "7"), (2, "b", None)], CAMPAIGN)
    s = spark.createDataFrame([("7", Decimal("2.50")), (None, Decimal("9"))], "shop STRING, amount DECIMAL(10,2)")
    summary = marts.campaign_summary(c, s, left_key="channel", right_key="shop", keyed=True)
    assert result(summary) == [(1, "a", "7", Decimal("2.5")), (2, "b", None, None)]
