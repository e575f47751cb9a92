"""Load stamps, conditional renames and the ingestion clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMPS = ("created_at", "modified_at")

# A feed column that is renamed when present.
RENAMES = {"Application Id/Proposer number": "Application Id"}

LOCAL_ZONE = "Asia/Kolkata"


def _keep_source_columns(df: DataFrame) -> DataFrame:
    clashes = [c for c in df.columns if c.lower() in STAMPS]
    return df.withColumnsRenamed({c: f"source_{c.lower()}" for c in clashes})


def _stamp(df: DataFrame, clock: Column, preserve_source: bool) -> DataFrame:
    if preserve_source:
        df = _keep_source_columns(df)
    return df.withColumns({name: clock for name in STAMPS})


def stamp_instant(df: DataFrame, run_start: datetime | None = None, preserve_source: bool = False) -> DataFrame:
    """Set ``created_at`` and ``modified_at`` to the run's start as a true instant.

    Same-named source columns are replaced, whatever their case; with
    ``preserve_source`` they are kept as ``source_created_at`` and so on.
    """
    clock = F.current_timestamp() if run_start is None else F.lit(run_start)
    return _stamp(df, clock, preserve_source)


def stamp_shifted(df: DataFrame, zone: str = LOCAL_ZONE, preserve_source: bool = False) -> DataFrame:
    """Like :func:`stamp_instant`, but with the wall clock of ``zone`` shown as if it were UTC."""
    return _stamp(df, F.from_utc_timestamp(F.current_timestamp(), zone), preserve_source)


def rename_present(df: DataFrame, renames: dict[str, str] = RENAMES) -> DataFrame:
    """Rename the columns that exist; leave the frame alone otherwise."""
    return df.withColumnsRenamed(renames)


def ingestion_clock(run_time: datetime | None = None) -> Column:
    """The statement's one time, or the given run's."""
    clock = F.current_timestamp() if run_time is None else F.lit(run_time)
    return clock.alias("ingestion_time")
