"""Load a list of tables into the raw layer."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tributary import names
from tributary.functions.stamps import stamp_instant
from tributary.sinks.audit import logged
from tributary.sinks.layers import publish, replace_snapshot, snapshot_date
from tributary.sources.jdbc import JdbcSource, read_table
from tributary.sources.tables import INGESTION_DATE


@dataclass(frozen=True)
class TableLoad:
    """One table to snapshot: where it comes from and how to read it."""

    table: str
    read: Callable[[SparkSession], DataFrame]
    source: str
    domain: str = "customer"

    @property
    def dataset(self) -> str:
        return names.raw_schema(self.domain)

    def path(self, root: str) -> str:
        return f"{root}/{self.dataset}/{self.table}"


def database_loads(source: JdbcSource, domain: str, name: str, partitions: int = 16) -> list[TableLoad]:
    """Loads of all the domain's tables from ``source``, each read in ranges of its primary key."""

    def reader(table: str) -> Callable[[SparkSession], DataFrame]:
        return lambda spark: read_table(spark, source, table, names.SOURCE_KEYS[table], partitions)

    return [TableLoad(table, reader(table), name, domain) for table in names.DOMAINS[domain]]


class LoadError(RuntimeError):
    """Some loads failed; the others are done, and all are in the log."""

    def __init__(self, failures: dict[str, Exception]):
        super().__init__("; ".join(f"{name}: {error}" for name, error in failures.items()))
        self.failures = failures


def run_all(jobs: dict[str, Callable[[], object]], parallel: int) -> dict[str, object]:
    """Run independent Spark jobs, some at a time, and return their results by name.

    All of them are tried.  If any failed, raise LoadError once the rest are done.
    """
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        pending = {name: pool.submit(job) for name, job in jobs.items()}
    failures = {name: job.exception() for name, job in pending.items() if job.exception() is not None}
    if failures:
        raise LoadError(failures) from next(iter(failures.values()))
    return {name: job.result() for name, job in pending.items()}


def ingest_tables(
    spark: SparkSession,
    root: str,
    loads: Iterable[TableLoad],
    stamp: Callable[[DataFrame], DataFrame] | None = None,
    service: str = "SPARK",
    keep_history: bool = False,
    parallel: int = 4,
) -> dict[str, int]:
    """Snapshot every table into the raw layer and log each load; return row counts by table.

    ``stamp`` adds the load stamps; by default the run's true instant.  A table
    that fails is logged with its error and does not stop the others; LoadError
    is raised at the end.
    """

    def load(spec: TableLoad) -> int:
        def snapshot(started: datetime) -> int:
            rows = spec.read(spark)
            stamped = stamp_instant(rows, started) if stamp is None else stamp(rows)
            inserted = replace_snapshot(stamped, spec.path(root), started, keep_history)
            publish(spark, spec.dataset, spec.table, spec.path(root), (INGESTION_DATE, snapshot_date(started)))
            return inserted

        return logged(spark, root, spec.source, spec.dataset, spec.table, service, snapshot)

    return run_all({spec.table: lambda spec=spec: load(spec) for spec in loads}, parallel)
