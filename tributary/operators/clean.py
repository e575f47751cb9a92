"""The cleaners: latest row per key, quality filter, normalised columns, fixed schema."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary import schemas
from tributary.functions.scalars import days_between, seconds_between, title_case
from tributary.functions.stamps import ingestion_clock
from tributary.operators.latest import latest_by_key
from tributary.operators.quality import not_negative, positive, present


@dataclass(frozen=True)
class CleanSpec:
    """What sets one entity's cleaner apart; its columns come from the target schema."""

    table: str
    key: str
    newest: str
    title: tuple[str, ...] = ()
    upper: tuple[str, ...] = ()
    lower: tuple[str, ...] = ()
    derived: dict[str, Callable[[], Column]] = field(default_factory=dict)
    keep: Callable[[], Column] | None = None

    def column(self, name: str) -> Column:
        if name in self.derived:
            return self.derived[name]()
        source = F.col(name)
        if name in self.title:
            return title_case(source)
        if name in self.upper:
            return F.upper(source)
        if name in self.lower:
            return F.lower(source)
        return source


def _session_seconds() -> Column:
    return seconds_between(F.col("session_start"), F.col("session_end"))


def _campaign_days() -> Column:
    return days_between(F.col("start_date"), F.col("end_date"))


SPECS = {
    spec.table: spec
    for spec in (
        CleanSpec("customers", "customer_id", "updated_at", title=("first_name", "last_name"), lower=("email",)),
        CleanSpec(
            "addresses", "address_id", "created_at",
            upper=("city", "state", "country"), keep=lambda: present("pincode"),
        ),
        # One row per customer, not per preference.
        CleanSpec("customer_preferences", "customer_id", "updated_at", upper=("favorite_category",)),
        CleanSpec(
            "transactions", "transaction_id", "transaction_date",
            upper=("currency", "status"), keep=lambda: present("amount"),
        ),
        CleanSpec("payment_methods", "payment_method_id", "created_at", title=("provider",), upper=("method_type",)),
        CleanSpec(
            "refunds", "refund_id", "created_at",
            title=("refund_reason",), upper=("refund_status",), keep=lambda: positive("refund_amount"),
        ),
        CleanSpec(
            "user_sessions", "session_id", "session_start",
            upper=("device_type",),
            derived={"session_duration_seconds": _session_seconds},
            keep=lambda: present("session_end"),
        ),
        CleanSpec("user_events", "event_id", "event_timestamp", title=("screen_name",), upper=("event_type",)),
        CleanSpec(
            "category_engagement", "engagement_id", "date",
            title=("category_name",),
            derived={"engagement_date": lambda: F.col("date")},
            keep=lambda: positive("time_spent_seconds"),
        ),
        # The latest *end date* wins, so a later upload that ends earlier loses.
        CleanSpec(
            "campaigns", "campaign_id", "end_date",
            title=("campaign_name",), upper=("channel", "status"),
            derived={"campaign_duration_days": _campaign_days},
        ),
        CleanSpec("ads", "ad_id", "created_at", title=("headline",), upper=("creative_type",)),
        CleanSpec("impressions", "impression_id", "impression_time", upper=("platform",)),
        CleanSpec("clicks", "click_id", "click_time", upper=("device_type",)),
        CleanSpec(
            "conversions", "conversion_id", "conversion_time",
            upper=("conversion_type",), keep=lambda: not_negative("revenue"),
        ),
    )
}


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Exactly the target's columns, in its order, with its types.

    A value that does not fit its type is an error under ANSI.
    """
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.struct(ddl)])


def clean(
    raw: DataFrame,
    spec: CleanSpec,
    tie_break: Sequence[str] = (),
    run_time: datetime | None = None,
    keyed: bool = False,
) -> DataFrame:
    """Clean one entity.

    The quality filter looks at the newest version only: when that one fails,
    the key is gone, and an older version does not step in.  Normalising comes
    last, for the rows that remain.

    ``keyed`` says that ``raw`` has one row per key already; then nothing is shuffled.
    """
    newest = raw if keyed else latest_by_key(raw, [spec.key], [spec.newest], tie_break)
    if spec.keep is not None:
        newest = newest.filter(spec.keep())
    target = schemas.TRANSFORMED[spec.table]
    names = [c for c in schemas.columns(target) if c != "ingestion_time"]
    shaped = newest.select(*[spec.column(c).alias(c) for c in names], ingestion_clock(run_time))
    return conform(shaped, target)
