from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows_of
from raw_samples import D, ROWS, T
from tributary import names, schemas
from tributary.operators.clean import SPECS, clean, conform

EXPECTED = {
    "customers": [
        (1, "Lena", "Bergqvist", "lena.b@example.org", "555-0101", date(1984, 5, 17), "F", "active", T, T),
        (2, "Tomas", "Okafor", "tomas@example.net", "555-0102", date(1979, 11, 30), "M", "active", T, T),
        (3, "Wei", "Lindholm", None, "555-0103", date(2001, 8, 8), "F", "dormant", T, T),
    ],
    "addresses": [(1, 1, "GOTHENBURG", "VG", "SWEDEN", "41103", "home", T)],
    "customer_preferences": [(1, "Swedish", True, "GARDEN", T), (2, "Finnish", False, "MUSIC", T)],
    "payment_methods": [(1, 2, "TRANSFER", "Nordbank", T), (2, 1, "WALLET", "Coinpurse", T)],
    "transactions": [
        (1, 1, Decimal("62.4"), "EUR", T, "SUCCESS", 1),
        (2, 2, Decimal("915.1"), "EUR", T, "SUCCESS", 2),
        (3, 1, Decimal("17.6"), "EUR", T, "FAILED", 1),
    ],
    "refunds": [(1, 3, Decimal("17.6"), "Parcel Lost", "SETTLED", T)],
    "user_sessions": [(1, 1, T, T, 0, "TABLET", "4.2"), (2, 2, T, T, 0, "DESKTOP", "4.3")],
    "user_events": [(1, 1, 1, "SCROLL", T, "Price-List End"), (2, 2, 2, "SEARCH", T, "Basket")],
    "category_engagement": [(1, 2, "Garden", 45, D)],
    "campaigns": [
        (1, "Spring Bulbs", "RADIO", date(2025, 2, 10), date(2025, 2, 24), 14, Decimal("800"), "CLOSED"),
        (2, "Choir Week", "STREET POSTERS", date(2025, 12, 28), date(2026, 1, 8), 11, Decimal("1250"), "DRAFT"),
        (3, "Moving Out", "LETTER", date(2025, 6, 1), date(2025, 6, 30), 29, Decimal("400"), "RUNNING"),
    ],
    "ads": [
        (71, 1, "POSTER", "Bulbs At Half Price", datetime(2025, 2, 8, 6, 15)),
        (72, 3, "LEAFLET", "Pack Lightly", datetime(2025, 5, 20, 18)),
    ],
    "impressions": [
        (501, 71, 9, datetime(2025, 2, 11, 8), "KIOSK"),
        (502, 72, 8, datetime(2025, 6, 2, 19, 20), "TABLET"),
    ],
    "clicks": [
        (601, 71, 9, datetime(2025, 2, 11, 8, 1, 30), "KIOSK"),
        (602, 72, 8, datetime(2025, 6, 2, 19, 25, 10), "TABLET"),
    ],
    "conversions": [
        (701, 9, 1, datetime(2025, 2, 12, 12), "ORDER", Decimal("49.95")),
        (702, 8, 1, datetime(2025, 2, 13, 13, 30), "NEWSLETTER", Decimal("0")),
        (703, 7, 2, datetime(2026, 1, 2, 16, 45), "ORDER", Decimal("130")),
        (704, 6, 3, datetime(2025, 6, 15, 9, 10), "ORDER", Decimal("61.25")),
    ],
}


def raw(spark, entity, rows=None):
    return spark.createDataFrame(ROWS[entity] if rows is None else rows, schemas.SOURCE[entity])


def test_every_entity_has_a_cleaner_and_schemas():
    assert set(SPECS) == set(names.ENTITIES) == set(schemas.SOURCE) == set(schemas.TRANSFORMED) == set(EXPECTED)
    assert len(SPECS) == 14


@pytest.mark.parametrize("entity", EXPECTED)
def test_cleaner(spark, entity):
    cleaned = clean(raw(spark, entity), SPECS[entity])
    assert cleaned.schema.simpleString() == schemas.struct(schemas.TRANSFORMED[entity]).simpleString()
    assert rows_of(cleaned.drop("ingestion_time")) == EXPECTED[entity]


@pytest.mark.parametrize("entity", EXPECTED)
def test_the_newest_version_wins(spark, entity):
    """An older copy of every row, made with the column the cleaner orders by, changes nothing."""
    spec = SPECS[entity]
    df = raw(spark, entity)
    kind = df.schema[spec.newest].dataType
    older = F.to_timestamp_ntz(F.col(spec.newest).cast("string")) - F.expr("INTERVAL 1 DAY")
    older = F.date_format(older, "yyyy-MM-dd HH:mm:ss") if kind.simpleString() == "string" else older.cast(kind)
    both = df.unionByName(df.withColumn(spec.newest, older))
    assert rows_of(clean(both, spec).drop("ingestion_time")) == EXPECTED[entity]


@pytest.mark.parametrize("entity", EXPECTED)
def test_a_cleaner_shuffles_once_and_cuts_hot_keys_before(spark, entity):
    plan = plan_of(clean(raw(spark, entity), SPECS[entity]))
    assert plan.count("Exchange") == 1
    assert plan.index("1, Final") < plan.index("Exchange") < plan.index("1, Partial")


@pytest.mark.parametrize("entity", EXPECTED)
def test_cleaning_a_keyed_table_shuffles_nothing(spark, entity):
    cleaned = clean(raw(spark, entity), SPECS[entity], keyed=True)
    assert "Exchange" not in plan_of(cleaned) and "Window" not in plan_of(cleaned)
    assert rows_of(cleaned.drop("ingestion_time")) == EXPECTED[entity]


def test_a_failing_newest_version_removes_the_key(spark):
    rows = [
        (9, 1, Decimal("10.00"), "INR", T, "success", 1),
        (9, 1, None, "INR", T + timedelta(hours=1), "success", 1),
    ]
    assert clean(raw(spark, "transactions", rows), SPECS["transactions"]).count() == 0


def test_preferences_keep_one_row_per_customer(spark):
    rows = [(1, 7, "Swedish", True, "Garden", T), (2, 7, "Finnish", False, "Music", T + timedelta(days=1))]
    cleaned = clean(raw(spark, "customer_preferences", rows), SPECS["customer_preferences"])
    assert rows_of(cleaned.drop("ingestion_time")) == [(7, "Finnish", False, "MUSIC", T + timedelta(days=1))]


def test_a_later_upload_with_an_earlier_end_date_loses(spark):
    rows = [
        (1, "first", "tv", "2026-01-01", "2026-03-01", Decimal(1), "a"),
        (1, "second", "tv", "2026-01-01", "2026-02-01", Decimal(1), "a"),
    ]
    assert clean(raw(spark, "campaigns", rows), SPECS["campaigns"]).first()["campaign_name"] == "First"


def test_failed_transactions_stay(spark):
    cleaned = clean(raw(spark, "transactions"), SPECS["transactions"])
    assert cleaned.filter("status = 'FAILED'").count() == 1


def test_session_seconds_are_complete(spark):
    start, end = datetime(2026, 1, 1, 0, 0, 0, 900_000), datetime(2026, 1, 1, 0, 0, 2, 100_000)
    rows = [(1, 1, start, end, "x", "1"), (2, 1, end, start, "x", "1"), (3, 1, start, None, "x", "1")]
    cleaned = clean(raw(spark, "user_sessions", rows), SPECS["user_sessions"])
    assert rows_of(cleaned, "session_id", "session_duration_seconds") == [(1, 1), (2, -1)]


def test_ingestion_time_is_one_time(spark):
    assert clean(raw(spark, "customers"), SPECS["customers"]).select("ingestion_time").distinct().count() == 1


def test_conform_orders_columns_and_rejects_what_does_not_fit(spark):
    df = spark.createDataFrame([("7", 1, "x")], "b STRING, a INT, extra STRING")
    assert rows_of(conform(df, "a BIGINT, b DECIMAL(38,9)")) == [(1, Decimal("7"))]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        conform(df.withColumn("b", F.lit("seven")), "a BIGINT, b DECIMAL(38,9)").collect()
