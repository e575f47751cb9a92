"""Keep a table of each key's latest row up to date from a stream.

The table is partitioned by a hash of the key, so a micro-batch rewrites only
the buckets its keys fall into.  A batch is first written aside in full and then
put in place; whatever dies in between, running the batch again finishes it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tributary import names
from tributary.operators.changes import CHANGE_OP
from tributary.operators.latest import latest_by_key
from tributary.sources.tables import KEY_BUCKET, KEY_BUCKETS, is_current, read_current
from tributary.storage import Folder


_INCOMING, _IS_CHANGE, _PART = "__incoming", "__is_change", "__part"


@dataclass(frozen=True)
class CurrentTable:
    """A current-state table: where it is and which of a key's rows is newest.

    ``buckets`` is what a batch can leave untouched; it cannot change later, and
    merging with another number is an error.  A bucket is written by as many
    tasks as its size asks for.  If the rows carry a change operation, deleted keys stay in the
    files, marked, and are left out when read, so a late, older change cannot
    revive them.
    """

    path: str
    keys: tuple[str, ...]
    order_by: tuple[str, ...]
    tie_break: tuple[str, ...] = ()
    buckets: int = 64

    @property
    def _staging(self) -> str:
        return f"{self.path}__staging"

    @property
    def _incoming(self) -> str:
        return f"{self.path}__incoming"

    @property
    def _content(self) -> str:
        return f"{self.path}/{KEY_BUCKETS}={self.buckets}"

    def read(self, spark: SparkSession) -> DataFrame:
        return read_current(spark, self.path)

    def rows_of(self, keys: DataFrame) -> DataFrame | None:
        """The stored rows of the keys in ``keys``, deletions too; only buckets that they fall into are read.  None before the first merge."""
        spark = keys.sparkSession
        if not is_current(spark, self.path):
            return None
        stored = spark.read.parquet(self._content)
        wanted = self._with_bucket(keys.select(*[F.col(key).cast(stored.schema[key].dataType) for key in self.keys]))
        numbers = [row[0] for row in wanted.select(KEY_BUCKET).distinct().collect()]  # at most ``buckets``
        wanted = wanted.select(*[F.col(key).alias(f"__{key}") for key in self.keys])
        same = F.lit(True)
        for key in self.keys:
            same = same & stored[key].eqNullSafe(wanted[f"__{key}"])
        return stored.filter(F.col(KEY_BUCKET).isin(numbers)).join(wanted, same, "left_semi").drop(KEY_BUCKET)

    def _with_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn(KEY_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _incoming_rows(self, batch: DataFrame) -> DataFrame:
        spark = batch.sparkSession
        if is_current(spark, self.path):
            # Equal keys of different types would fall into different buckets.
            stored = spark.read.parquet(self._content).schema
            batch = batch.withColumns({key: F.col(key).cast(stored[key].dataType) for key in self.keys})
        # One row per key before anything else: a hot key in the batch ends here.
        return self._with_bucket(self._newest(batch.withColumn(_INCOMING, F.lit(1)), self.keys))

    def arranged(self, batch: DataFrame, path: str) -> DataFrame:
        """The newest row of each key in ``batch``, written by bucket to ``path`` for ``merge``: so it is computed once, whatever reads it."""
        rows = self._incoming_rows(batch)
        rows.write.partitionBy(KEY_BUCKET).mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def _merged(self, rows: DataFrame, path: str) -> DataFrame:
        """The new content of the buckets that arranged ``rows`` at ``path`` touch; their folders name these."""
        spark = rows.sparkSession
        if is_current(spark, self.path):
            # At most ``buckets`` small numbers; as literals they prune the scan.
            numbers = [int(value) for value in Folder(spark, path).partition_values(KEY_BUCKET)]
            stored = spark.read.parquet(self._content)
            rows = stored.filter(F.col(KEY_BUCKET).isin(numbers)).withColumn(_INCOMING, F.lit(0)).unionByName(rows)
        # One shuffle serves both the choice of the newest of a key's two rows and
        # the write.  Few buckets are cut by further bits of the hash, so that all
        # cores have work; small parts are merged by their real size.
        parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        cut = F.pmod(F.shiftright(F.xxhash64(*self.keys), 32), F.lit(parts)).cast("int")
        rows = rows.withColumn(_PART, cut).repartition(KEY_BUCKET, _PART)
        return self._newest(rows, [KEY_BUCKET, _PART, *self.keys]).drop(_INCOMING, _PART)

    def _newest(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """The rule of ``latest_changes``: of the same age, a change beats a base row.

        Then the tie-break decides, and at last the batch beats what is stored.
        """
        if CHANGE_OP not in rows.columns:
            return latest_by_key(rows, keys, self.order_by, [*self.tie_break, _INCOMING])
        marked = rows.withColumn(_IS_CHANGE, F.col(CHANGE_OP).isNotNull().cast("int"))
        return latest_by_key(marked, keys, [*self.order_by, _IS_CHANGE], [*self.tie_break, _INCOMING]).drop(_IS_CHANGE)

    def merge(self, batch: DataFrame, batch_id: int | None = None, arranged_at: str | None = None) -> None:
        """Bring the rows of ``batch`` in, which ``arranged`` may have written.  The same batch again changes nothing."""
        spark = batch.sparkSession
        self._prepare(spark)
        if arranged_at is not None:
            self._replace(batch, arranged_at)
            return
        rows = self.arranged(batch, self._incoming) if is_current(spark, self.path) else self._incoming_rows(batch)
        self._replace(rows, self._incoming)
        Folder(spark, self._incoming).remove()

    def _prepare(self, spark: SparkSession) -> None:
        there = Folder(spark, self.path).partition_values(KEY_BUCKETS)
        if there not in ([], [str(self.buckets)]):
            raise ValueError(f"{self.path} has {there[0]} buckets, not {self.buckets}")
        self._put_in_place(spark)

    def _replace(self, rows: DataFrame, path: str) -> None:
        self._merged(rows, path).write.partitionBy(KEY_BUCKET).mode("overwrite").parquet(self._staging)
        self._put_in_place(rows.sparkSession)

    def _put_in_place(self, spark: SparkSession) -> None:
        """Replace the buckets that are written aside in full, if there are any.

        A run that died while replacing left them there, and the next run starts
        by doing it again: buckets that are in place already are not there any
        more.  The mark of completeness goes first, so that a half-removed folder
        is never taken for a full one.
        """
        staged, complete = Folder(spark, self._staging), Folder(spark, f"{self._staging}/_SUCCESS")
        if not complete.exists():
            return
        numbers = staged.partition_values(KEY_BUCKET)
        if numbers:
            Folder(spark, self._content).make()
        for number in numbers:
            Folder(spark, f"{self._content}/{KEY_BUCKET}={number}").remove()
            Folder(spark, f"{self._staging}/{KEY_BUCKET}={number}").move_to(f"{self._content}/{KEY_BUCKET}={number}")
        complete.remove()
        staged.remove()


def replica(
    root: str, table: str, order_by: tuple[str, ...], tie_break: tuple[str, ...] = (), buckets: int = 64
) -> CurrentTable:
    """The raw table of ``table`` as its change log keeps it, newest by ``order_by``.

    The stream merged into it has the source's columns and the operation in
    ``change_op``; the refresh reads the table like any other raw table.
    """
    return CurrentTable(names.raw_path(root, table), (names.SOURCE_KEYS[table],), order_by, tie_break, buckets)


def keep_current(
    stream: DataFrame, table: CurrentTable, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Start merging ``stream`` into ``table``; by default what is there now, then end."""
    writer = stream.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()
