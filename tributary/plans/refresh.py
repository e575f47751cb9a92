"""Recompute the transformed layer from raw, then the curated layer from it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tributary import names, schemas
from tributary.operators import marts
from tributary.operators.clean import SPECS, clean
from tributary.plans.ingest import run_all
from tributary.sinks.audit import logged, now
from tributary.sinks.layers import publish, replace_snapshot, snapshot_date
from tributary.sources.tables import INGESTION_DATE, is_current, read_raw, read_snapshot
from tributary.storage import Folder


SERVICE = "SPARK"


def read_transformed(spark: SparkSession, root: str, table: str) -> DataFrame:
    return read_snapshot(spark, names.transformed_path(root, table), schemas.TRANSFORMED[table])


def read_curated(spark: SparkSession, root: str, table: str) -> DataFrame:
    return read_snapshot(spark, names.curated_path(root, table), schemas.CURATED[table])


def arrived(spark: SparkSession, root: str) -> list[str]:
    """The entities that have a raw table."""
    return [table for table in names.ENTITIES if Folder(spark, names.raw_path(root, table)).exists()]


def refresh(
    spark: SparkSession,
    root: str,
    tables: Sequence[str] | None = None,
    tie_breaks: dict[str, Sequence[str]] | None = None,
    exact: bool = False,
    run_time: datetime | None = None,
    keep_history: bool = False,
    parallel: int = 4,
) -> dict[str, int]:
    """Clean ``tables`` (by default all that have raw data), then build both marts.

    Each target is replaced as a snapshot, so running it again gives the same
    tables.  ``exact`` builds the marts that count every amount once.  Each
    target is logged; failures are raised once all of a layer has been tried,
    and the marts are not built from a layer that failed.

    Returns row counts by target.
    """
    run_time = run_time or now()
    tie_breaks = tie_breaks or {}

    def replace(build: Callable[[], DataFrame], source: str, schema: str, table: str, path: str) -> int:
        def snapshot(_started: datetime) -> int:
            rows = replace_snapshot(build(), path, run_time, keep_history)
            publish(spark, schema, table, path, (INGESTION_DATE, snapshot_date(run_time)))
            return rows

        return logged(spark, root, source, schema, table, SERVICE, snapshot)

    def clean_table(table: str) -> int:
        domain, spec, path = names.DOMAIN_OF[table], SPECS[table], names.raw_path(root, table)

        def cleaned() -> DataFrame:
            # A replica has one row per key of its source.
            keyed = is_current(spark, path) and names.SOURCE_KEYS[table] == spec.key
            return clean(read_raw(spark, path), spec, tie_breaks.get(table, ()), run_time, keyed)

        return replace(
            cleaned,
            names.raw_schema(domain),
            names.transformed_schema(domain),
            table,
            names.transformed_path(root, table),
        )

    def build_mart(mart: str, build: Callable[[], DataFrame]) -> int:
        return replace(build, "transformed", names.CURATED, mart, names.curated_path(root, mart))

    def read(table: str) -> DataFrame:
        return read_transformed(spark, root, table)

    def customer_mart() -> DataFrame:
        summary = marts.customer_summary_exact if exact else marts.customer_summary
        return summary(
            read("customers"), read("transactions"), read("user_sessions"), keyed=True, run_time=run_time
        )

    def campaign_mart() -> DataFrame:
        if exact:
            return marts.campaign_summary_by_conversion(read("campaigns"), read("conversions"), keyed=True, run_time=run_time)
        return marts.campaign_summary(read("campaigns"), read("transactions"), keyed=True, run_time=run_time)

    chosen = arrived(spark, root) if tables is None else tables
    counts = run_all({table: lambda table=table: clean_table(table) for table in chosen}, parallel)
    builders = {"customer_summary": customer_mart, "campaign_summary": campaign_mart}
    counts |= run_all(
        {mart: lambda mart=mart, build=build: build_mart(mart, build) for mart, build in builders.items()}, parallel
    )
    return counts
