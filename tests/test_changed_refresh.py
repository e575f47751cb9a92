"""Marts that follow loads equal those computed anew, and only touched buckets are rewritten."""

import os
import random
from datetime import datetime, timedelta
from decimal import Decimal
from functools import reduce

import pytest

from conftest import rows_of
from tributary import schemas
from tributary.operators import marts
from tributary.operators.clean import SPECS, clean
from tributary.plans import changes
from tributary.plans.changes import MARTS, ChangedRefresh

START = datetime(2026, 1, 1)
TIES = {entity: ("version",) for entity in ("customers", "transactions", "user_sessions", "campaigns", "conversions")}


def load(spark, rng, number, keys=12, n=25):
    """New versions of some rows of each entity; a version that comes later may be older."""
    day = lambda: START + timedelta(days=rng.randrange(30))
    maybe = lambda value, share=0.1: None if rng.random() < share else value
    made = {entity: [] for entity in TIES}
    for k in range(n):
        version = number * 1000 + k
        a, b, c = rng.randrange(keys), maybe(rng.randrange(keys)), Decimal(rng.randrange(-500, 9000)) / 100
        made["customers"].append((a, f"first {rng.randrange(4)}", "last", "e@x.com", "1", None, "F", day(), day(), "A", version))
        made["transactions"].append((rng.randrange(40), b, maybe(c, 0.2), "eur", day(), "ok", maybe(rng.randrange(keys)), version))
        made["user_sessions"].append((rng.randrange(30), b, day(), maybe(day(), 0.3), "web", "1", version))
        made["campaigns"].append((maybe(a, 0.05), f"sale {rng.randrange(3)}", "mail", "2026-01-01", str(day().date()), c, "on", version))
        made["conversions"].append((rng.randrange(40), a, b, str(day()), "order", c, version))
    chosen = rng.sample(sorted(made), rng.randint(1, len(made)))
    return {e: spark.createDataFrame(made[e], f"{schemas.SOURCE[e]}, version INT") for e in chosen}


def recomputed(spark, loads, mart):
    def read(entity):
        parts = [batch[entity] for batch in loads if entity in batch]
        if not parts:
            return spark.createDataFrame([], schemas.TRANSFORMED[entity])
        return clean(reduce(lambda a, b: a.unionByName(b), parts), SPECS[entity], TIES[entity])

    people = (read("customers"), read("transactions"), read("user_sessions"))
    return {
        "customer_summary": lambda: marts.customer_summary(*people, keyed=True),
        "customer_summary_exact": lambda: marts.customer_summary_exact(*people, keyed=True),
        "campaign_summary": lambda: marts.campaign_summary(read("campaigns"), read("transactions"), keyed=True),
        "campaign_summary_by_conversion": lambda: marts.campaign_summary_by_conversion(read("campaigns"), read("conversions"), keyed=True),
    }[mart]()


@pytest.mark.parametrize("chosen", [("customer_summary", "customer_summary_exact"), ("campaign_summary", "campaign_summary_by_conversion")])
def test_marts_that_follow_random_loads_equal_those_computed_anew(spark, folder, chosen):
    rng = random.Random(len(chosen[0]))
    following, loads = ChangedRefresh(folder, chosen, TIES, buckets=2), []
    used = {e for mart in chosen for e in (MARTS[mart].entity, *(child.entity for child in MARTS[mart].children))}
    for number in range(3):
        loads.append({e: rows for e, rows in load(spark, rng, number).items() if e in used})
        following.apply(loads[-1], number)
    following.apply(loads[-1], number)  # again
    for mart in chosen:
        if not os.path.exists(f"{folder}/changes/sums/{mart}"):
            continue
        expected = recomputed(spark, loads, mart).drop("ingestion_time")
        assert rows_of(following.read(spark, mart).drop("ingestion_time")) == rows_of(expected)


def files(folder):
    """The files of all tables, without what loads wrote aside."""
    return {f"{path}/{name}" for path, _, names in os.walk(f"{folder}/changes") if "/loads/" not in path for name in names if name.endswith(".parquet")}


def customers(spark, ids, version=0):
    rows = [(i, f"n{version}", "l", "e", "1", None, "F", START, START + timedelta(days=version), "A", version) for i in ids]
    return spark.createDataFrame(rows, f"{schemas.SOURCE['customers']}, version INT")


def test_only_buckets_of_changed_keys_are_rewritten(spark, folder):
    following = ChangedRefresh(folder, ("customer_summary",), TIES, buckets=16)
    following.apply({"customers": customers(spark, range(200))}, 0)
    before = files(folder)
    following.apply({"customers": customers(spark, [7], 1)}, 1)
    after = files(folder)
    assert len(before) == 32 and len(before - after) == len(after - before) == 2  # a bucket of customers and one of sums
    assert rows_of(following.read(spark, "customer_summary").filter("first_name = 'N1'"), "customer_id") == [(7,)]


def transactions(spark, rng, version):
    rows = [(rng.randrange(12), rng.randrange(9), Decimal(rng.randrange(900)), "eur", START + timedelta(days=rng.randrange(9)), "ok", 1, version * 100 + k) for k in range(15)]
    return spark.createDataFrame(rows, f"{schemas.SOURCE['transactions']}, version INT")


@pytest.mark.parametrize("where", ["merge", "rows_of"])
def test_a_load_that_broke_off_is_repeated(spark, folder, monkeypatch, where):
    following = ChangedRefresh(folder, ("customer_summary",), TIES, buckets=2)
    rng = random.Random(4)
    first, second = ({"transactions": transactions(spark, rng, k), "customers": customers(spark, range(9), k)} for k in range(2))
    following.apply(first, 0)
    method, left = getattr(changes.CurrentTable, where), [2]

    def breaks(table, *args):
        left[0] -= 1
        if left[0] < 0:
            raise ConnectionError("lost")
        return method(table, *args)

    for allowed in (0, 1, 2):  # the first table, the second, and the sums
        left[0] = allowed
        with monkeypatch.context() as broken:
            broken.setattr(changes.CurrentTable, where, breaks)
            with pytest.raises(ConnectionError):
                following.apply(second, 1)
    following.apply(second, 1)
    for mart in following.marts:
        assert rows_of(following.read(spark, mart).drop("ingestion_time")) == rows_of(recomputed(spark, [first, second], mart).drop("ingestion_time"))


def test_deleted_keys_leave_the_marts(spark, folder):
    following = ChangedRefresh(folder, ("customer_summary",), {}, buckets=4)
    rows = customers(spark, range(4)).drop("version").selectExpr("*", "'U' AS change_op")
    following.apply({"customers": rows}, 0)
    gone = customers(spark, [2], 1).drop("version").selectExpr("*", "'D' AS change_op")
    following.apply({"customers": gone}, 1)
    assert rows_of(following.read(spark, "customer_summary"), "customer_id") == [(0,), (1,), (3,)]


def test_a_batch_is_computed_once(spark, folder):
    """The keys and the merge of a load read what one job has written."""
    computed = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    rows = spark.range(20).selectExpr(
        "id AS campaign_id", "'n' AS campaign_name", "'c' AS channel", "'2024-01-01' AS start_date", "'2024-01-02' AS end_date",
        "CAST(1 AS DECIMAL(38,9)) AS budget", "'s' AS status",
    )
    following = ChangedRefresh(folder, ("campaign_summary",), {}, buckets=2)
    for number in range(2):
        following.apply({"campaigns": rows.mapInArrow(noted, rows.schema)}, number)
        assert computed.value == 20 * (number + 1)
    assert following.read(spark, "campaign_summary").count() == 20
