"""Load delimited files into the raw layer as they arrive, file by file.

A stream discovers new files; its checkpoint remembers which were seen.  Only
file names travel through it (the source does not open a file whose content is
not selected).  Each micro-batch then looks at all records of its files in one
parallel job, loads the files that are good, feed by feed, and enters in a
ledger what became of each; after that files move to the archive or to the
quarantine.  Parsing and writing run on the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from datetime import datetime
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from tributary import names, schemas
from tributary.functions.scalars import table_of_file
from tributary.functions.stamps import rename_present, stamp_instant
from tributary.plans.ingest import LoadError, run_all
from tributary.sinks.audit import FAILED, SUCCEEDED, FileRecord, LoadRecord, now, read_files_ledger, write_files, write_logs
from tributary.sinks.layers import append_load, publish
from tributary.sources.delimited import file_headers, files_with_cut_records, parsed_files, problem, records_of, typed
from tributary.sources.quoted import irregular_files, parsed, records
from tributary.sources.tables import LOAD_ID
from tributary.storage import Folder, literal_path, path_of_url

SOURCE_NAME = "FILE_DROP"
SERVICE = "SPARK_STREAMING"
RAW_SCHEMA = names.raw_schema("marketing")

_FILE_COLUMNS = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def discover(spark: SparkSession, inbox: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the paths and lengths of files that arrive in ``inbox``, each path once."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(_FILE_COLUMNS)
        .option("maxFilesPerTrigger", files_per_batch)
    )
    return reader.load(inbox).select("path", "length")


def files_by_table(files: DataFrame) -> dict[str, list[str]]:
    """Paths of a batch's files by target table, at most ``files_per_batch`` in all; what no table name may hold becomes ``_``."""
    routed = files.select(F.regexp_replace(table_of_file(F.col("path")), r"[^a-z0-9_]", "_").alias("table"), "path")
    groups = routed.groupBy("table").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return {row["table"]: list(row["paths"]) for row in groups.collect()}


def _in_file_order(table: str, header: tuple[str, ...]) -> StructType:
    """The types of a file's columns; strings for a table that is not declared."""
    if table not in names.FEEDS:
        return StructType([StructField(name, StringType()) for name in header])
    declared = schemas.struct(schemas.SOURCE[table])
    unknown = [name for name in header if name not in declared.names]
    if unknown:
        raise ValueError(f"{table} has no columns {unknown}")
    return StructType([declared[name] for name in header])


@dataclass(frozen=True)
class _Group:
    """Files that are read alike: one header, and one way to find the records."""

    schema: StructType
    how: str  # by "lines", by "ranges", or each from its "start"
    files: tuple[str, ...]

    def cells(self, spark: SparkSession) -> DataFrame:
        """The files' cells as strings, each record whose cells are not as many as the columns, and the file's URL."""
        if self.how == "ranges":
            return parsed(records(spark, self.files), self.schema.names)
        paths = [literal_path(path) for path in self.files]
        return parsed_files(spark, paths, self.schema.names, multi_line=self.how == "start")


def _header_schema(spark: SparkSession, table: str, path: str) -> StructType | Exception:
    """The schema by a file's header, or what is wrong with it."""
    try:
        (header,) = file_headers(spark, [path])
        if len(set(map(str.lower, header))) < len(header):
            raise ValueError(f"{path} names a column twice: {list(header)}")
        return _in_file_order(table, header)
    except Exception as failure:  # noqa: BLE001  any failure of one file is that file's own
        return failure


def _grouped(spark: SparkSession, table: str, files: list[str]) -> tuple[list[_Group], dict[str, str]]:
    """The files by how they are read, and those whose headers are wrong, with the reason."""
    with ThreadPoolExecutor(max_workers=16) as pool:
        found = dict(zip(files, pool.map(lambda path: _header_schema(spark, table, path), files), strict=True))
    wrong = {path: str(schema) for path, schema in found.items() if isinstance(schema, Exception)}
    good = [path for path in files if path not in wrong]
    cut = files_with_cut_records(spark, [literal_path(path) for path in good]) if good else set()
    odd = irregular_files(spark, sorted(cut)) if cut else set()
    groups: dict[tuple[str, str], list[str]] = {}
    for path in good:
        how = "start" if path in odd else "ranges" if path in cut else "lines"
        groups.setdefault((found[path].json(), how), []).append(path)
    return [_Group(found[paths[0]], how, tuple(paths)) for (_, how), paths in groups.items()], wrong


def _checked(spark: SparkSession, groups: list[_Group]) -> dict[str, tuple[int, str | None]]:
    """Of each file with records how many there are, and what is wrong with one of them, if anything; one job for all."""
    rows = [
        records_of(group.cells(spark), group.schema.names).select(
            "__file", F.col(f"`{group.schema.names[0]}`").alias("cell"), problem(group.schema.names, group.schema).alias("problem")
        )
        for group in groups
    ]
    if not rows:
        return {}
    # The reader wants a cell to be asked for beside the record itself.
    sums = F.count(F.lit(1)).alias("n"), F.min("problem").alias("problem"), F.count("cell").alias("cells")
    each = reduce(DataFrame.unionAll, rows).groupBy("__file").agg(*sums)
    return {path_of_url(spark, row["__file"]): (row["n"], row["problem"]) for row in each.collect()}


def _read(spark: SparkSession, table: str, groups: list[_Group]) -> DataFrame:
    """All records of the groups; columns are matched by name, and those that a file lacks are null."""
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [typed(group.cells(spark), group.schema) for group in groups],
    )
    if table not in names.FEEDS:
        return rows
    declared = schemas.struct(schemas.SOURCE[table])
    missing = {field.name: F.lit(None).cast(field.dataType) for field in declared if field.name not in rows.columns}
    return rows.withColumns(missing).select(*declared.names)


def load_files(
    spark: SparkSession, root: str, table: str, files: list[str], load_id: str, run_start: datetime
) -> list[FileRecord]:
    """Append the good ones of a table's files, stamped and renamed; return what became of each.

    One job looks at all records of all files first.  A file with a wrong
    header, or with a record that does not fit, is left out as a whole.
    """
    if not table:
        return [FileRecord(path, table, error=f"no table name in {path}") for path in files]
    groups, wrong = _grouped(spark, table, files)
    checked = _checked(spark, groups)
    wrong |= {path: what for path, (_, what) in checked.items() if what is not None}
    good = [replace(group, files=tuple(path for path in group.files if path not in wrong)) for group in groups]
    good = [group for group in good if group.files]
    counts = {path: checked.get(path, (0, None))[0] for group in good for path in group.files}
    path = names.file_drop_path(root, table)
    if good:
        inserted = append_load(rename_present(stamp_instant(_read(spark, table, good), run_start)), path, load_id)
        if inserted != sum(counts.values()):
            raise RuntimeError(f"{table}: {sum(counts.values())} records were counted and {inserted} loaded; files changed meanwhile")
    elif earlier := Folder(spark, path).partition(LOAD_ID, load_id):  # of an attempt that found good ones
        earlier.remove()
    if good:
        publish(spark, RAW_SCHEMA, table, path, (LOAD_ID, load_id))
    elif Folder(spark, path).exists():
        publish(spark, RAW_SCHEMA, table, path)
    return [FileRecord(file, table, counts.get(file), wrong.get(file)) for file in files]


def _move(spark: SparkSession, files: list[FileRecord]) -> None:
    """Move files that are still where they arrived; one that is not was moved by an earlier attempt."""

    def move(file: FileRecord) -> None:
        here, there = Folder(spark, file.path), Folder(spark, file.moved_to)
        if here.exists() and not there.exists():
            Folder(spark, file.moved_to.rpartition("/")[0]).make()
            here.move_to(file.moved_to)

    with ThreadPoolExecutor(max_workers=16) as pool:
        list(pool.map(move, [file for file in files if file.moved_to]))


def batch_loader(
    spark: SparkSession,
    root: str,
    stream_name: str,
    on_failure: str = "raise",
    parallel: int = 4,
    archive: str | None = None,
    quarantine: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """What to do with each micro-batch of arrived files.

    The unit is the file: each has its own log entry, and one that cannot be
    loaded does not keep others of its feed out.  With ``on_failure="raise"`` a
    bad file stops the stream once the rest is loaded and logged; the batch is
    tried again when the stream is started again, and nothing is moved before.
    With ``"log"`` the stream goes on: the outcome of all files is entered in
    the ledger, which settles the batch, and then loaded files move to
    ``archive`` and rejected ones to ``quarantine``, each under the batch's id.

    Load ids come from the batch, so a retry replaces what the first attempt
    wrote.  A batch that is in the ledger is not loaded again: only moves that
    are still to be made are made.
    """

    def settled(files: list[FileRecord], load_id: str) -> list[FileRecord]:
        folder = {SUCCEEDED: archive, FAILED: quarantine}
        return [
            replace(f, moved_to=f"{folder[f.status]}/{load_id}/{f.path.rpartition('/')[2]}") if folder[f.status] else f
            for f in files
        ]

    def load_batch(files: DataFrame, batch_id: int) -> None:
        load_id = f"{stream_name}-{batch_id}"
        done = read_files_ledger(spark, root, load_id).collect()  # files_per_batch rows at most
        if done:
            _move(spark, [FileRecord(r["PATH"], r["TABLE_NAME"], r["RECORDS_INSERTED"], r["ERROR"], r["MOVED_TO"]) for r in done])
            return
        feeds = files_by_table(files)
        started, ended = now(), {}

        def load_feed(table: str, found: list[str]) -> list[FileRecord]:
            try:
                return load_files(spark, root, table, found, load_id, started)
            except Exception as failure:  # noqa: BLE001  logged, and raised below if wanted
                return [FileRecord(path, table, error=str(failure)) for path in found]
            finally:
                ended[table] = now()

        outcomes = run_all({table: partial(load_feed, table, found) for table, found in feeds.items()}, parallel)
        each = [file for found in outcomes.values() for file in found]
        if not each:
            return
        entries = [
            LoadRecord(
                SOURCE_NAME, RAW_SCHEMA, file.table, started, ended[file.table], SERVICE,
                inserted=file.rows, error=file.error, run_id=f"{load_id}-{file.path.rpartition('/')[2]}",
            )
            for file in each
        ]
        write_logs(spark, root, load_id, entries)
        failures = {file.path: RuntimeError(file.error) for file in each if file.error is not None}
        if failures and on_failure == "raise":
            raise LoadError(failures)
        each = settled(each, load_id)
        write_files(spark, root, load_id, each)
        _move(spark, each)

    return load_batch


def ingest_arrivals(
    spark: SparkSession,
    inbox: str,
    root: str,
    checkpoint: str,
    archive: str | None = None,
    stream_name: str = "arrivals",
    files_per_batch: int = 1000,
    on_failure: str = "raise",
    every: str | None = None,
    quarantine: str | None = None,
) -> StreamingQuery:
    """Start loading ``inbox`` into the raw layer under ``root``.

    By default it loads what is there and ends; with ``every`` (such as
    ``"30 minutes"``) it keeps going.  ``stream_name`` must stay the same for
    the life of the checkpoint, and differ between streams on one root.
    ``archive`` and ``quarantine`` must not lie in ``inbox``; without them files
    stay where they are.  A name is taken once: a later file needs another.
    """
    files = discover(spark, inbox, files_per_batch)
    load = batch_loader(spark, root, stream_name, on_failure, archive=archive, quarantine=quarantine)
    writer = files.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()
