"""Row filters and key checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(column: str) -> Column:
    return F.col(column).isNotNull()


def positive(column: str) -> Column:
    """``> 0``; a null is not."""
    return F.col(column) > 0


def not_negative(column: str) -> Column:
    """``>= 0``; a null is not."""
    return F.col(column) >= 0


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break a primary key: seen more than once, or null in part.

    Counts are combined before the shuffle, so a hot key sends one row per task.
    """
    some_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter(
        (F.col("occurrences") > 1) | some_null
    )


def load_key_violations(load: DataFrame, table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of a load that are null, come twice in it or stand in the table already, with their ``occurrences`` in both.

    For a table whose own key holds, these are the offenders of both together. Of the table only rows with a key of the
    load are counted, and only key columns are read: the load's keys, once each, are broadcast where they are few, and
    the table is not shuffled then; else its keys are.
    """
    names = [f"__{name}" for name in key]
    new = load.groupBy(*key).agg(F.count(F.lit(1)).alias("__new"))
    wanted = new.select(*[F.col(name).alias(other) for name, other in zip(key, names, strict=True)])
    same = [table[name] == wanted[other] for name, other in zip(key, names, strict=True)]
    old = table.select(*key).join(wanted, same, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("__old"))
    occurrences = F.col("__new") + F.coalesce("__old", F.lit(0))
    some_null = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in key])
    return new.join(old, list(key), "left").filter((occurrences > 1) | some_null).select(*key, occurrences.alias("occurrences"))


def require_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return ``df`` if ``keys`` identify its rows, else raise ValueError naming one offender."""
    offender = key_violations(df, keys).take(1)
    if offender:
        raise ValueError(f"{list(keys)} is no key: {offender[0].asDict()}")
    return df
