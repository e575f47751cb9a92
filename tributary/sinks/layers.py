"""Writing layer tables, and setting the layers up."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timezone
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from tributary import names, schemas
from tributary.sources.tables import INGESTION_DATE, LOAD_ID
from tributary.storage import Folder, count_rows, qualified_path


def _replace_partition(df: DataFrame, path: str, column: str, value: object, file_format: str) -> int:
    """Make ``df`` the content of one partition, unless it is empty; return how many rows were written.

    Spark stages the files and moves them in when all tasks are done, so a lost
    executor or a failing source leaves the old partition as it was.  The
    partition column comes after the count: there the optimizer sees that it is
    one constant, and does not sort the rows by it.
    """
    if column.lower() in (name.lower() for name in df.columns):
        raise ValueError(f"{column} is the name of the partition column; rename the data's own first")
    written = Observation()
    (
        count_rows(df, written)
        .withColumn(column, F.lit(value))
        .write.format(file_format)
        .partitionBy(column)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .save(path)
    )
    return written.get["rows"]


def snapshot_date(run_time: datetime) -> date:
    """The date that a run's snapshots go by: that of its start, in UTC."""
    return run_time.astimezone(timezone.utc).date()


def replace_snapshot(
    df: DataFrame, path: str, run_time: datetime, keep_history: bool = False, file_format: str = "parquet"
) -> int:
    """Make ``df`` the table's whole content as of ``run_time``; return its row count.

    The snapshot is the partition of the run's date.  A second run on that date
    replaces it; snapshots of other dates are removed once the new one stands,
    unless ``keep_history``.  Rows are counted in the write itself, so the count
    is of the rows written and the source is read once.
    """
    day = snapshot_date(run_time)
    rows = _replace_partition(df, path, INGESTION_DATE, day, file_format)
    if rows == 0:
        # No row, no partition: leave an empty one, or an older snapshot would pass for the latest.
        df.limit(0).write.format(file_format).mode("overwrite").save(f"{path}/{INGESTION_DATE}={day}")
    if not keep_history:
        for other in Folder(df.sparkSession, path).partition_values(INGESTION_DATE):
            if other != str(day):
                Folder(df.sparkSession, f"{path}/{INGESTION_DATE}={other}").remove()
    return rows


def append_load(df: DataFrame, path: str, load_id: int | str, file_format: str = "parquet") -> int:
    """Append ``df`` to the table under ``load_id``; return its row count.

    Repeating a load replaces its own rows, so a retried batch adds nothing twice.
    """
    return _replace_partition(df, path, LOAD_ID, load_id, file_format)


def _quoted(value: object) -> str:
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def _create_database(spark: SparkSession, root: str, schema: str) -> None:
    path = f"{root}/{schema}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema} LOCATION {_quoted(path)}")
    if qualified_path(spark, spark.catalog.getDatabase(schema).locationUri) != qualified_path(spark, path):
        spark.sql(f"ALTER DATABASE {schema} SET LOCATION {_quoted(path)}")


def _create_table(spark: SparkSession, name: str, path: str, ddl: str, column: str, kind: str) -> None:
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({ddl}, `{column}` {kind}) "
        f"USING parquet PARTITIONED BY (`{column}`) LOCATION {_quoted(path)}"
    )


def _ddl(fields: Iterable[StructField]) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)


def _location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").collect()
    return rows[-1]["data_type"]


class _Partitions:
    """The partitions of one catalog table over one column, and what is at a path."""

    def __init__(self, spark: SparkSession, name: str, path: str, column: str):
        self._spark, self._name, self._path, self._column = spark, name, path, column

    def known(self) -> set[str]:
        rows = self._spark.sql(f"SHOW PARTITIONS {self._name}").collect()
        return {unquote(row[0].partition("=")[2]) for row in rows}

    def there(self) -> set[str]:
        return set(Folder(self._spark, self._path).partition_values(self._column))

    def add(self, values: Iterable[object]) -> None:
        specs = " ".join(f"PARTITION (`{self._column}`={_quoted(value)})" for value in values)
        if specs:
            self._spark.sql(f"ALTER TABLE {self._name} ADD IF NOT EXISTS {specs}")

    def drop(self, values: Iterable[object]) -> None:
        """The tables are external: their files stay."""
        specs = ", ".join(f"PARTITION (`{self._column}`={_quoted(value)})" for value in values)
        if specs:
            self._spark.sql(f"ALTER TABLE {self._name} DROP IF EXISTS {specs}")


def _move_table(spark: SparkSession, name: str, path: str, column: str) -> None:
    """Let the table and its partitions be those at ``path``."""
    partitions = _Partitions(spark, name, path, column)
    partitions.drop(partitions.known())  # each has a location of its own, under the old one
    spark.sql(f"ALTER TABLE {name} SET LOCATION {_quoted(path)}")
    partitions.add(sorted(partitions.there()))


def _partition_column(spark: SparkSession, name: str) -> str | None:
    found = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    return found[0] if len(found) == 1 else None


def set_up_layers(spark: SparkSession, root: str) -> None:
    """Create the databases and the transformed and curated tables that are missing, and let all show ``root``.

    Raw tables take the columns of what is loaded into them, so the loads make
    those.  Tables that show another root so far, raw ones among them, show this
    one from now on, whatever has been loaded here; files are left where they are.
    """
    schemas_of = {names.CURATED: names.MARTS, names.AUDIT: ()}
    for domain, tables in names.DOMAINS.items():
        schemas_of |= {names.raw_schema(domain): (), names.transformed_schema(domain): tables}
    ddl_of = schemas.TRANSFORMED | schemas.CURATED
    for schema, tables in schemas_of.items():
        _create_database(spark, root, schema)
        for table in tables:
            _create_table(spark, f"{schema}.{table}", f"{root}/{schema}/{table}", ddl_of[table], INGESTION_DATE, "DATE")
        for table in spark.catalog.listTables(schema):
            name, path = f"{schema}.`{table.name}`", f"{root}/{schema}/{table.name}"
            column = None if table.isTemporary else _partition_column(spark, name)
            if column and qualified_path(spark, _location(spark, name)) != qualified_path(spark, path):
                _move_table(spark, name, path, column)


def _loaded_fields(spark: SparkSession, path: str, column: str, value: object | None) -> list[StructField]:
    """The columns of the load that was just made, or of the whole table, without the partition column."""
    folder = Folder(spark, path).partition(column, value)
    fields = spark.read.parquet(path if folder is None else folder.path).schema
    return [f for f in fields if f.name.lower() != column.lower()]


def publish(spark: SparkSession, schema: str, table: str, path: str, partition: tuple[str, object] | None = None) -> None:
    """Let the catalog's table see what is at ``path`` now.

    ``partition``, a column and a value, is the one that a load has just
    replaced or added; then no other is looked at, but for those of a snapshot
    that are gone.  Without it all folders' names are compared with the
    catalog's.

    A table that shows another place is moved here.  Columns that the load
    brings are added; columns that it lacks stay and are null.  Only if a
    column's type changed is the table made anew, as no catalog can alter that.
    Without the layers' databases there is no table to keep.
    """
    if not spark.catalog.databaseExists(schema):
        return
    name = f"{schema}.`{table}`"
    column, value = partition or (INGESTION_DATE if Folder(spark, path).partition_values(INGESTION_DATE) else LOAD_ID, None)
    fields = _loaded_fields(spark, path, column, value)
    made = not spark.catalog.tableExists(name)
    if not made:
        kinds = {f.name.lower(): f.dataType for f in spark.table(name).schema}
        if any(kinds.get(f.name.lower(), f.dataType) != f.dataType for f in fields):
            spark.sql(f"DROP TABLE {name}")  # external: its files stay
            made = True
    if made:
        _create_table(spark, name, path, _ddl(fields), column, "DATE" if column == INGESTION_DATE else "STRING")
    else:
        new = [f for f in fields if f.name.lower() not in kinds]
        if new:
            spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({_ddl(new)})")
    partitions = _Partitions(spark, name, path, column)
    if not made and qualified_path(spark, _location(spark, name)) != qualified_path(spark, path):
        _move_table(spark, name, path, column)
    elif made or value is None:
        known, there = partitions.known(), partitions.there()
        partitions.add(sorted(there - known))
        partitions.drop(sorted(known - there))
    else:
        partitions.add([value])
        if column == INGESTION_DATE:  # a snapshot has one, or its history
            partitions.drop(sorted(partitions.known() - partitions.there()))
    spark.catalog.refreshTable(name)
