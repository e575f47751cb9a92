"""Latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__newest_first"


def newest_first(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def latest_by_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], tie_break: Sequence[str] = ()
) -> DataFrame:
    """Keep one row per key: the one whose ``order_by`` columns are largest, nulls last.

    Rows with a null key form one group.  Rows equal in ``order_by`` are told
    apart by ``tie_break``; without it any one of them may be kept.

    ``row_number() = 1`` is planned with a group limit on both sides of the
    shuffle, so a map task sends at most one row per key however often the key
    occurs: a hot key costs one row per task, not its whole group.
    """
    newest = Window.partitionBy(*keys).orderBy(*newest_first([*order_by, *tie_break]))
    return df.withColumn(_RANK, F.row_number().over(newest)).filter(F.col(_RANK) == 1).drop(_RANK)
