from datetime import datetime, timezone
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows_of
from tributary.functions.scalars import WORD_BREAKS, days_between, seconds_between, table_of_file, times, title_case
from tributary.functions.stamps import rename_present, stamp_instant, stamp_shifted


def apply_to(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [row[1] for row in df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("mary-jane o_neil a.b", "Mary-Jane O_Neil A.B"),
        ("", ""),
        (None, None),
        ("élan ÉCLAIR", "Élan Éclair"),
        ("GPay", "Gpay"),
        ("o'neil d'arc", "O'neil D'arc"),
        ("a  b\tc\nd", "A  B\tC\nD"),
        ("x- y -z", "X- Y -Z"),
        ("4-not specified", "4-Not Specified"),
        ("  lead and trail  ", "  Lead And Trail  "),
    ],
)
def test_title_case(spark, text, expected):
    assert apply_to(spark, title_case, [text]) == [expected]


def test_title_case_starts_a_word_after_every_break(spark):
    breaks = list(""" []{}()/|\\<>!?@"^#$&~_,.:;*%+-\t\n""")
    assert apply_to(spark, title_case, [f"ab{b}cD" for b in breaks]) == [f"Ab{b}Cd" for b in breaks]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="abZ9' -_.\t(/", max_size=12), min_size=1, max_size=20))
def test_title_case_is_upper_after_breaks_and_lower_elsewhere(spark, texts):
    import re

    def expected(text):
        return re.sub(f"[^{WORD_BREAKS}]+", lambda word: word[0][:1].upper() + word[0][1:].lower(), text)

    assert apply_to(spark, title_case, texts) == [expected(t) for t in texts]


def test_complete_seconds_in_both_directions(spark):
    df = spark.sql("SELECT timestamp_ntz'2026-01-01 00:00:00.9' a, timestamp_ntz'2026-01-01 00:00:02.1' b")
    assert rows_of(df.select(seconds_between(F.col("a"), F.col("b")), seconds_between(F.col("b"), F.col("a")))) == [(1, -1)]


def test_seconds_do_not_depend_on_the_session_zone(spark):
    # The clocks of Berlin skip 02:00 to 03:00 on this day.
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        df = spark.sql("SELECT timestamp_ntz'2026-03-29 01:30:00' a, timestamp_ntz'2026-03-29 03:30:00' b")
        assert df.select(seconds_between(F.col("a"), F.col("b"))).first()[0] == 7200
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_calendar_days(spark):
    df = spark.sql("SELECT '2026-10-01' a, '2026-10-31' b, timestamp_ntz'2026-10-01 23:59:59' c, timestamp_ntz'2026-10-02 00:00:00' d")
    assert rows_of(df.select(days_between(F.col("a"), F.col("b")), days_between(F.col("c"), F.col("d")))) == [(30, 1)]


@pytest.mark.parametrize(
    ("total", "count"),
    [
        ("500.000000001", 3),
        ("-1.999999999", 7),
        ("0.000000001", 10**18),
        ("1234567890123456789.123456789", 123456789),
        ("0", 5),
    ],
)
def test_times_keeps_nine_decimals(spark, total, count):
    df = spark.createDataFrame([(Decimal(total), count)], "t DECIMAL(38,9), n BIGINT")
    import decimal

    with decimal.localcontext(prec=60):
        assert df.select(times(F.col("t"), F.col("n"))).first()[0] == Decimal(total) * count


def test_times_of_null_is_null(spark):
    df = spark.createDataFrame([(None, 2)], "t DECIMAL(38,9), n BIGINT")
    assert df.select(times(F.col("t"), F.col("n"))).first()[0] is None


def test_table_of_file(spark):
    paths = ["Ads.2.csv", " Clicks.CSV", "gs://drop/v1.0/Impressions.csv", "file:/a b/ conversions .x", "campaigns"]
    assert apply_to(spark, table_of_file, paths) == ["ads", "clicks", "impressions", "conversions", "campaigns"]


def test_stamp_replaces_source_columns_whatever_their_case(spark):
    start = datetime(2026, 1, 1, 12, tzinfo=timezone.utc)
    df = spark.createDataFrame([(1, "old")], "id INT, CREATED_AT STRING")
    stamped = stamp_instant(df, start)
    assert [c.lower() for c in stamped.columns] == ["id", "created_at", "modified_at"]
    row = stamped.select(F.unix_timestamp("created_at"), F.unix_timestamp("modified_at")).first()
    assert set(row) == {int(start.timestamp())}


def test_stamp_can_preserve_source_columns(spark):
    df = spark.createDataFrame([(1, "old")], "id INT, CREATED_AT STRING")
    stamped = stamp_instant(df, preserve_source=True)
    assert stamped.columns == ["id", "source_created_at", "created_at", "modified_at"]
    assert stamped.first()["source_created_at"] == "old"


def test_shifted_stamp_is_five_and_a_half_hours_ahead(spark):
    ahead = F.timestamp_diff("MINUTE", F.current_timestamp(), F.col("created_at"))
    df = spark.range(1)
    assert stamp_shifted(df).select(ahead).first()[0] == 330
    assert stamp_instant(df).select(ahead).first()[0] == 0


def test_rename_only_what_is_there(spark):
    with_column = spark.createDataFrame([(1, 2)], "`Application Id/Proposer number` INT, x INT")
    without = spark.createDataFrame([(1, 2)], "y INT, x INT")
    assert rename_present(with_column).columns == ["Application Id", "x"]
    assert rename_present(without).columns == ["y", "x"]
