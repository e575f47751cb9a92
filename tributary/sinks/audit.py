"""The load log: one row per load, whether it worked or not."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import names, schemas
from tributary.operators.latest import latest_by_key
from tributary.storage import Folder

SUCCEEDED = "succeeded"
FAILED = "failed"

LOG_DATE = "log_date"
LOG_BATCH = "log_batch"
_LOG_KEYS = f"{LOG_DATE} DATE, {LOG_BATCH} STRING"


def now() -> datetime:
    return datetime.now(timezone.utc)


@dataclass(frozen=True)
class LoadRecord:
    """One load's log entry."""

    source: str
    dataset: str
    table: str
    started: datetime
    ended: datetime
    service: str
    inserted: int | None = None
    updated: int | None = None
    deleted: int | None = None
    error: str | None = None
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def status(self) -> str:
        return SUCCEEDED if self.error is None else FAILED

    def values(self, logged_at: datetime) -> tuple:
        """The entry in the log's column order."""
        return (
            self.source, self.dataset, self.table, self.started, self.ended, self.service,
            self.inserted, self.updated, self.deleted, logged_at, self.run_id, self.status, self.error,
        )


@dataclass(frozen=True)
class FileRecord:
    """What became of one arrived file."""

    path: str
    table: str
    rows: int | None = None
    error: str | None = None
    moved_to: str | None = None

    @property
    def status(self) -> str:
        return SUCCEEDED if self.error is None else FAILED


def write_log(spark: SparkSession, root: str, record: LoadRecord) -> None:
    """Append one entry; logging its run id again replaces it."""
    write_logs(spark, root, record.run_id, [record])


def write_logs(spark: SparkSession, root: str, batch: str, records: Sequence[LoadRecord]) -> None:
    """Append the entries of one batch in one job.

    They are a partition of their own: jobs that log at the same time do not
    meet in one output folder, and logging a batch again replaces its entries.
    """
    logged_at = now()
    rows = [(*record.values(logged_at), logged_at.date(), batch) for record in records]
    entries = spark.createDataFrame(rows, f"{schemas.AUDIT}, {_LOG_KEYS}")
    _append_log(entries, names.audit_path(root))


def _append_log(entries: DataFrame, path: str) -> None:
    (
        entries.coalesce(1)  # at most as many as a batch has loads
        .write.partitionBy(LOG_DATE, LOG_BATCH)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def write_files(spark: SparkSession, root: str, batch: str, files: Sequence[FileRecord]) -> None:
    """Enter the outcome of a batch's files, all at once; entering the batch again replaces it."""
    logged_at = now()
    rows = [(f.path, f.table, f.status, f.rows, f.error, f.moved_to, logged_at, logged_at.date(), batch) for f in files]
    _append_log(spark.createDataFrame(rows, f"{schemas.FILES}, {_LOG_KEYS}"), names.files_path(root))


def read_files_ledger(spark: SparkSession, root: str, batch: str | None = None) -> DataFrame:
    """The outcome of every arrived file, or of one batch's; of a batch entered twice the last."""
    if not Folder(spark, names.files_path(root)).exists():
        return spark.createDataFrame([], schemas.struct(schemas.FILES))
    entries = spark.read.schema(f"{schemas.FILES}, {_LOG_KEYS}").parquet(names.files_path(root))
    chosen = entries if batch is None else entries.filter(F.col(LOG_BATCH) == batch)
    return latest_by_key(chosen, ["PATH", LOG_BATCH], ["LOGGED_AT"]).select(*schemas.columns(schemas.FILES))


def rejected_files(spark: SparkSession, root: str) -> DataFrame:
    """The arrived files that could not be loaded, and why."""
    return read_files_ledger(spark, root).filter(F.col("STATUS") == FAILED)


def logged(
    spark: SparkSession,
    root: str,
    source: str,
    dataset: str,
    table: str,
    service: str,
    load: Callable[[datetime], int],
    run_id: str | None = None,
) -> int:
    """Run ``load`` with its start time, log its row count or its error, and pass either on."""
    started, inserted, error = now(), None, None
    try:
        inserted = load(started)
        return inserted
    except Exception as failure:
        error = str(failure)
        raise
    finally:
        record = LoadRecord(source, dataset, table, started, now(), service, inserted=inserted, error=error)
        write_log(spark, root, record if run_id is None else replace(record, run_id=run_id))


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """The log with one entry per load; a load that was retried under its run id shows its last outcome."""
    entries = spark.read.schema(f"{schemas.AUDIT}, {_LOG_KEYS}").parquet(names.audit_path(root))
    latest = latest_by_key(entries, ["RUN_ID"], ["INGESTION_TIME"])
    return latest.select(*schemas.columns(schemas.AUDIT))
