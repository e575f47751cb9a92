"""The curated marts.

Both are parents left-joined to their children and grouped by the parent.  The
children are reduced to one row per join key *before* the join, with partial
aggregation ahead of the shuffle, so neither the joins' fan-out nor a key that
holds much of a child table ever becomes rows.  Where the mart's definition
counts that fan-out in, it enters as a factor.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary import schemas
from tributary.functions.scalars import times
from tributary.functions.stamps import ingestion_clock
from tributary.operators.clean import conform


def _how_many(ids: str, keyed: bool) -> Column:
    """Distinct ids.  A key's values need no shuffle of their own to be told apart."""
    return F.count(ids) if keyed else F.count_distinct(F.col(ids))


def _copies(parents: DataFrame, columns: Sequence[str], keyed: bool) -> DataFrame:
    """One row per group of the mart, with the number of parent rows in it."""
    if keyed:
        return parents.select(*columns, F.lit(1).alias("copies"))
    return parents.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))


def _total(amount: str) -> Column:
    return F.sum(amount).cast(schemas.NUMERIC)


def _attach(parents: DataFrame, key: str, keyed: bool, *children: DataFrame) -> DataFrame:
    """Left-join children with one row per key.

    Parents without a key match nothing, and in the join they would all meet in
    one task.  So they stay out of it, unless ``key`` is the parents' key and at
    most one of them can lack it.
    """
    if keyed:
        return reduce(lambda rows, child: rows.join(child, key, "left"), children, parents)
    known = parents.filter(F.col(key).isNotNull())
    for child in children:
        known = known.join(child, key, "left")
    return known.unionByName(parents.filter(F.col(key).isNull()), allowMissingColumns=True)


def _customers_with_activity(
    customers: DataFrame, transactions: DataFrame, sessions: DataFrame, keyed: bool
) -> DataFrame:
    spending = transactions.groupBy("customer_id").agg(
        _how_many("transaction_id", keyed).alias("transactions"), _total("amount").alias("spent")
    )
    visits = sessions.groupBy("customer_id").agg(
        _how_many("session_id", keyed).alias("sessions"), F.count(F.lit(1)).alias("session_rows")
    )
    people = _copies(customers, ["customer_id", "first_name", "last_name"], keyed)
    return _attach(people, "customer_id", keyed, spending, visits)


def _customer_columns(people: DataFrame, spent: Column, run_time: datetime | None) -> DataFrame:
    columns = people.select(
        "customer_id",
        "first_name",
        "last_name",
        F.coalesce("transactions", F.lit(0)).alias("total_transactions"),
        spent.alias("total_spent"),
        F.coalesce("sessions", F.lit(0)).alias("total_sessions"),
        ingestion_clock(run_time),
    )
    return conform(columns, schemas.CURATED["customer_summary"])


def customer_rows(people: DataFrame, spent: Column, by_session: bool, run_time: datetime | None = None) -> DataFrame:
    """The mart's rows of customers with their sums; ``by_session`` counts what was spent once per session, as ``customer_summary`` does."""
    pairs = F.greatest(F.coalesce("session_rows", F.lit(0)), F.lit(1)) * F.col("copies")
    return _customer_columns(people, times(spent, pairs) if by_session else spent, run_time)


def campaign_rows(campaigns: DataFrame, spent: Column, run_time: datetime | None = None) -> DataFrame:
    """The mart's rows of campaigns with their sums."""
    return _campaign_columns(campaigns, spent, run_time)


def customer_summary(
    customers: DataFrame,
    transactions: DataFrame,
    sessions: DataFrame,
    keyed: bool = False,
    run_time: datetime | None = None,
) -> DataFrame:
    """Transactions, spending and sessions per customer, as the mart defines them.

    Joining both children to the customer pairs every transaction with every
    session, so ``total_spent`` counts each transaction once per session (once
    where there is none) and per copy of the customer row.  Counts are distinct
    and unaffected; spending is null without transactions.

    ``keyed`` says that customer, transaction and session ids are keys of their
    tables, as after cleaning.  The result is the same with four shuffles less.
    """
    people = _customers_with_activity(customers, transactions, sessions, keyed)
    pairs = F.greatest(F.coalesce("session_rows", F.lit(0)), F.lit(1)) * F.col("copies")
    return _customer_columns(people, times(F.col("spent"), pairs), run_time)


def customer_summary_exact(
    customers: DataFrame,
    transactions: DataFrame,
    sessions: DataFrame,
    keyed: bool = False,
    run_time: datetime | None = None,
) -> DataFrame:
    """Like :func:`customer_summary`, but every transaction counts once in ``total_spent``."""
    people = _customers_with_activity(customers, transactions, sessions, keyed)
    return _customer_columns(people, F.col("spent"), run_time)


def _campaign_columns(campaigns: DataFrame, revenue: Column, run_time: datetime | None) -> DataFrame:
    columns = campaigns.select(
        "campaign_id", "campaign_name", "channel", revenue.alias("total_revenue"), ingestion_clock(run_time)
    )
    return conform(columns, schemas.CURATED["campaign_summary"])


def _campaigns_with_revenue(campaigns: DataFrame, left_key: str, revenue: DataFrame, keyed: bool) -> DataFrame:
    groups = _copies(campaigns, ["campaign_id", "campaign_name", "channel"], keyed)
    return _attach(groups, left_key, keyed and left_key == "campaign_id", revenue)


def campaign_summary(
    campaigns: DataFrame,
    transactions: DataFrame,
    left_key: str = "campaign_id",
    right_key: str = "payment_method_id",
    keyed: bool = False,
    run_time: datetime | None = None,
) -> DataFrame:
    """Revenue per campaign, as the mart defines it.

    The default keys are the mart's own, although a campaign's id and a payment
    method's id are unrelated; see :func:`campaign_summary_by_conversion`.
    Revenue counts once per copy of the campaign row, and is null without a match.
    ``keyed`` says that ``campaign_id`` is the campaigns' key.
    """
    if left_key not in ("campaign_id", "campaign_name", "channel"):
        raise ValueError(f"campaigns are grouped by id, name and channel, so {left_key!r} cannot join them")
    revenue = transactions.groupBy(F.col(right_key).alias(left_key)).agg(_total("amount").alias("revenue"))
    joined = _campaigns_with_revenue(campaigns, left_key, revenue, keyed)
    return _campaign_columns(joined, times(F.col("revenue"), F.col("copies")), run_time)


def campaign_summary_by_conversion(
    campaigns: DataFrame, conversions: DataFrame, keyed: bool = False, run_time: datetime | None = None
) -> DataFrame:
    """Revenue per campaign from its own conversions, each counted once."""
    revenue = conversions.groupBy("campaign_id").agg(_total("revenue").alias("revenue"))
    joined = _campaigns_with_revenue(campaigns, "campaign_id", revenue, keyed)
    return _campaign_columns(joined, F.col("revenue"), run_time)
