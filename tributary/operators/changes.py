"""Apply a change log to a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.latest import latest_by_key

# What a change log says was done to a row, and the value for a deletion.
CHANGE_OP = "change_op"
DELETE_OPS = ("D",)

_IS_CHANGE = "__is_change"


def latest_changes(
    base: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    op_column: str,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Newest version of every key of both inputs, with ``op_column``; null there means a base row.

    Deletions are still in, as a state table needs them: without the mark, an
    older change arriving after its key's deletion would bring the key back.
    """
    if op_column not in base.columns:
        op_type = changes.schema[op_column].dataType
        base = base.withColumn(op_column, F.lit(None).cast(op_type))
    versions = base.withColumn(_IS_CHANGE, F.lit(0)).unionByName(changes.withColumn(_IS_CHANGE, F.lit(1)))
    return latest_by_key(versions, keys, [*order_by, _IS_CHANGE], tie_break).drop(_IS_CHANGE)


def without_deletions(df: DataFrame, op_column: str, delete_ops: Sequence[str]) -> DataFrame:
    deleted = F.col(op_column).isin(list(delete_ops))
    return df.filter(F.coalesce(~deleted, F.lit(True))).drop(op_column)


def apply_changes(
    base: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    op_column: str = CHANGE_OP,
    delete_ops: Sequence[str] = DELETE_OPS,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """The table after all changes: per key the newest version, unless that deletes it.

    A change beats a base row of the same age.
    """
    newest = latest_changes(base, changes, keys, order_by, op_column, tie_break)
    return without_deletions(newest, op_column, delete_ops)
