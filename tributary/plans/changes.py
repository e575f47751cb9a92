"""Refresh the marts by what changed: signed rows of the changed keys, carried through the cleaners into sums.

Each source entity is kept as a current table, each mart as a table of sums by
its key; both are partitioned by a hash of their key.  A load names the keys
that it touches.  Their rows as they were and as they are after it are cleaned,
the former counted with a minus, the latter with a plus; what a mart adds up of
them is added to the sums of the keys that are hit.  So a load reads and
rewrites the buckets of its own keys alone, and nothing is computed anew from
all rows.

Amounts are decimals and counts are whole, so sums that go up and down stay
exact.  Ids are keys of their cleaned tables: distinct counts are plain counts.

A load has a number.  What it is about to replace is written aside first, under
that number; running the load again, whatever it died in, starts from there and
ends in the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import schemas
from tributary.operators import marts
from tributary.operators.changes import CHANGE_OP, DELETE_OPS, without_deletions
from tributary.operators.clean import SPECS, clean
from tributary.storage import Folder
from tributary.streaming.current import CurrentTable

_SIGN, _LOAD, _COPIES = "__sign", "load_number", "copies"


@dataclass(frozen=True)
class Child:
    """What a mart adds up of one entity's rows, by the column that joins it to the mart's key."""

    entity: str
    key: str
    sums: dict[str, Callable[[], Column]]


@dataclass(frozen=True)
class MartSums:
    """A mart as sums: its key and columns from one entity, its sums from others, and its rows made of both."""

    entity: str
    key: str
    columns: tuple[str, ...]
    children: tuple[Child, ...]
    rows: Callable[[DataFrame, datetime | None], DataFrame]

    @property
    def sums(self) -> list[str]:
        return [_COPIES, *(name for child in self.children for name in child.sums)]


def _one(column: str) -> Column:
    return F.col(column).isNotNull().cast("bigint")


def _spent() -> Column:
    """Null where no row was added up, as a sum of none is."""
    return F.when(F.col("spent_rows") > 0, F.col("spent"))


_ACTIVITY = (
    Child("transactions", "customer_id", {
        "transactions": lambda: _one("transaction_id"), "spent_rows": lambda: F.lit(1), "spent": lambda: F.col("amount"),
    }),
    Child("user_sessions", "customer_id", {"sessions": lambda: _one("session_id"), "session_rows": lambda: F.lit(1)}),
)
_PERSON = ("customers", "customer_id", ("first_name", "last_name"), _ACTIVITY)
_CAMPAIGN = ("campaigns", "campaign_id", ("campaign_name", "channel"))


def _sales(entity: str, key: str, amount: str) -> tuple[Child, ...]:
    return (Child(entity, key, {"spent_rows": lambda: F.lit(1), "spent": lambda: F.col(amount)}),)


MARTS = {
    "customer_summary": MartSums(*_PERSON, lambda rows, at: marts.customer_rows(rows, _spent(), True, at)),
    "customer_summary_exact": MartSums(*_PERSON, lambda rows, at: marts.customer_rows(rows, _spent(), False, at)),
    "campaign_summary": MartSums(
        *_CAMPAIGN, _sales("transactions", "payment_method_id", "amount"), lambda rows, at: marts.campaign_rows(rows, _spent(), at)
    ),
    "campaign_summary_by_conversion": MartSums(
        *_CAMPAIGN, _sales("conversions", "campaign_id", "revenue"), lambda rows, at: marts.campaign_rows(rows, _spent(), at)
    ),
}


@dataclass(frozen=True)
class ChangedRefresh:
    """Marts under ``root`` that follow loads.  ``buckets`` is the number of parts of every table, and cannot change later."""

    root: str
    marts: tuple[str, ...] = ("customer_summary", "campaign_summary")
    tie_breaks: dict[str, Sequence[str]] = field(default_factory=dict)
    buckets: int = 64

    def _entity(self, entity: str) -> CurrentTable:
        spec = SPECS[entity]
        path = f"{self.root}/changes/entities/{entity}"
        return CurrentTable(path, (spec.key,), (spec.newest,), tuple(self.tie_breaks.get(entity, ())), self.buckets)

    def _sums(self, mart: str) -> CurrentTable:
        return CurrentTable(f"{self.root}/changes/sums/{mart}", (MARTS[mart].key,), (_LOAD,), (), self.buckets)

    def _before(self, table: CurrentTable, keys: DataFrame, number: int, name: str) -> DataFrame | None:
        """The rows of the keys as they were when this load was first tried."""
        spark, path = keys.sparkSession, f"{self.root}/changes/loads/{number}/{name}"
        if not Folder(spark, f"{path}/_SUCCESS").exists():
            rows = table.rows_of(keys)
            if rows is None:
                rows = spark.createDataFrame([], "none INT")
            rows.write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
        return None if rows.columns == ["none"] else rows

    def _kept(self, rows: DataFrame, number: int, name: str) -> DataFrame:
        """The rows, written once among the load's files: several jobs read them."""
        path = f"{self.root}/changes/loads/{number}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def apply(self, batches: dict[str, DataFrame], number: int) -> None:
        """Bring one load in: new versions of rows, by entity.  Numbers rise from load to load; the same one again repeats its load."""
        changed = {entity: self._changed(entity, batch, number) for entity, batch in batches.items()}
        for mart in self.marts:
            self._add(mart, changed, number)

    def _changed(self, entity: str, batch: DataFrame, number: int) -> DataFrame:
        """The cleaned rows of the load's keys, those before it with a minus."""
        table, path = self._entity(entity), f"{self.root}/changes/loads/{number}/{entity}-batch"
        # A batch may be a costly query: one job computes it, the others read its newest row per key.
        rows = table.arranged(batch, path)
        keys = rows.select(SPECS[entity].key)
        before = self._before(table, keys, number, entity)
        table.merge(rows, number, path)
        signed = [(table.rows_of(keys), 1), *([] if before is None else [(before, -1)])]
        return reduce(DataFrame.unionByName, [_cleaned(rows, entity).withColumn(_SIGN, F.lit(sign)) for rows, sign in signed])

    def _add(self, mart: str, changed: dict[str, DataFrame], number: int) -> None:
        parts = _contributions(MARTS[mart], changed)
        if not parts:
            return
        spec, table = MARTS[mart], self._sums(mart)
        delta = self._kept(_summed(spec, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), number), number, f"{mart}-delta")
        before = self._before(table, delta.select(spec.key), number, mart)
        after = delta if before is None else _summed(spec, before.unionByName(delta, allowMissingColumns=True), number)
        table.merge(after)

    def read(self, spark: SparkSession, mart: str, run_time: datetime | None = None) -> DataFrame:
        """The mart's rows after the loads so far."""
        spec, rows = MARTS[mart], self._sums(mart).read(spark)
        return spec.rows(rows.filter(F.col(_COPIES) > 0), run_time)


def _cleaned(rows: DataFrame, entity: str) -> DataFrame:
    """Rows of a current table, one per key, cleaned; a key that was deleted last has none."""
    live = without_deletions(rows, CHANGE_OP, DELETE_OPS) if CHANGE_OP in rows.columns else rows
    return clean(live, SPECS[entity], keyed=True).drop("ingestion_time")


def _contributions(spec: MartSums, changed: dict[str, DataFrame]) -> list[DataFrame]:
    """What the changed rows add to the mart's sums, and its own columns where its entity's row is new."""
    sign, parts = F.col(_SIGN), []
    if spec.entity in changed:
        new = [F.when(sign > 0, F.col(name)).alias(name) for name in spec.columns]
        parts.append(changed[spec.entity].select(spec.key, *new, sign.alias(_COPIES), F.when(sign > 0, F.lit(True)).alias("told")))
    for child in spec.children:
        if child.entity in changed:
            # Rows without a key belong to nobody.
            rows = changed[child.entity].filter(F.col(child.key).isNotNull())
            parts.append(rows.select(F.col(child.key).alias(spec.key), *[(value() * sign).alias(name) for name, value in child.sums.items()]))
    return parts


def _summed(spec: MartSums, rows: DataFrame, number: int) -> DataFrame:
    """One row per key: all sums, and the mart's own columns as they were told last."""
    kinds = {name: "bigint" for name in spec.sums} | {"spent": schemas.NUMERIC}
    told = schemas.struct(schemas.TRANSFORMED[spec.entity])
    missing = {name: F.lit(0).cast(kind) for name, kind in kinds.items() if name in spec.sums and name not in rows.columns}
    missing |= {name: F.lit(None).cast(told[name].dataType) for name in spec.columns if name not in rows.columns}
    missing |= {name: F.lit(None).cast(kind) for name, kind in (("told", "boolean"), (_LOAD, "bigint")) if name not in rows.columns}
    rows = rows.withColumns(missing)
    # What this load tells comes without a number, and is newer than what is stored.
    age = F.when(F.col("told"), F.coalesce(F.col(_LOAD), F.lit(number)))
    last = [F.max_by(F.struct(*spec.columns), age).alias("own"), F.max("told").alias("told")]
    sums = [F.coalesce(F.sum(name), F.lit(0)).cast(kinds[name]).alias(name) for name in spec.sums]
    return rows.groupBy(spec.key).agg(*last, *sums).select(
        spec.key, *[F.col(f"own.{name}").alias(name) for name in spec.columns], "told", *spec.sums, F.lit(number).cast("bigint").alias(_LOAD)
    )
