"""Scans of layer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary import schemas
from tributary.operators.changes import CHANGE_OP, DELETE_OPS, without_deletions
from tributary.storage import Folder

INGESTION_DATE = "ingestion_date"
LOAD_ID = "load_id"
# Folders of a current-state table: how many buckets it has, and which one this is.
KEY_BUCKETS = "key_buckets"
KEY_BUCKET = "key_bucket"


def read_snapshot(
    spark: SparkSession,
    path: str,
    ddl: str | None = None,
    date: str | None = None,
    file_format: str = "parquet",
) -> DataFrame:
    """The table's latest snapshot, or that of ``date``, without the partition column.

    The latest date is read from folder names, so only its files are listed and
    opened, and a reader never mixes two snapshots.  With the schema given, a
    table that has no rows yet is readable too.
    """
    if date is None:
        date = max(Folder(spark, path).partition_values(INGESTION_DATE), default=None)
    if date is None:
        if ddl is None:
            raise FileNotFoundError(f"no snapshot in {path}")
        return spark.createDataFrame([], schemas.struct(ddl))
    reader = spark.read if ddl is None else spark.read.schema(ddl)
    return reader.format(file_format).load(f"{path}/{INGESTION_DATE}={date}")


def read_appended(
    spark: SparkSession, path: str, merge_schema: bool = True, file_format: str = "parquet"
) -> DataFrame:
    """All rows ever appended to the table, without the column that tells the loads apart.

    Merging schemas finds columns that only some loads have, and opens every file
    to do so.  For a table whose loads all have the same columns, one will do.
    """
    return spark.read.option("mergeSchema", merge_schema).format(file_format).load(path).drop(LOAD_ID)


def read_raw(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    """A raw table, be it a replaced snapshot, a replica kept by its change log, or an append table."""
    if Folder(spark, path).partition_values(INGESTION_DATE):
        return read_snapshot(spark, path)
    if is_current(spark, path):
        return read_current(spark, path)
    return read_appended(spark, path, merge_schema)


def is_current(spark: SparkSession, path: str) -> bool:
    """Whether the table holds each key's latest row only."""
    return bool(Folder(spark, path).partition_values(KEY_BUCKETS))


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a current-state table; of a replica, those that were not deleted last."""
    rows = spark.read.parquet(path).drop(KEY_BUCKETS, KEY_BUCKET)
    return without_deletions(rows, CHANGE_OP, DELETE_OPS) if CHANGE_OP in rows.columns else rows
