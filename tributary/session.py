"""Session settings the library's results and plans count on."""

from __future__ import annotations

from math import ceil

from pyspark.sql import SparkSession

SETTINGS = {
    # TIMESTAMP columns become DATETIME columns and dates in this zone.
    "spark.sql.session.timeZone": "UTC",
    # Overflow and unfit values are errors, as they are in the warehouse.
    "spark.sql.ansi.enabled": "true",
    # Shuffle partitions are merged, and skewed ones split, by their real size.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Put the settings on a session builder."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the settings on a running session; all of them can be changed there."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


_TASK_BYTES = 256 * 1024 * 1024


def sized_for(shuffled_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job whose largest shuffle moves about ``shuffled_bytes`` on ``cores`` cores.

    The number of partitions is an upper bound: adaptive execution merges small
    ones up to the advisory size, but never makes more of them.
    """
    partitions = max(ceil(shuffled_bytes / _TASK_BYTES), 2 * cores)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(_TASK_BYTES),
        "spark.sql.files.maxPartitionBytes": str(_TASK_BYTES),
    }
