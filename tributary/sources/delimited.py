"""Delimited files with a header row."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tributary.storage import first_line, path_of_url

ENCODING = "ISO-8859-1"

# Cells that stand for a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# One line that is a whole record: cells without quotes, or quoted cells with
# their quotes doubled.
_CELL = r'(?:"(?:[^"\r]++|"")*+"|[^",\r]*+)'
_WHOLE_RECORD = rf"^{_CELL}(?:,{_CELL})*+\r?$"


_AS_IS, _BEYOND = "__record", "__beyond"


def _present(name: str) -> Column:
    cell = F.col(f"`{name}`")
    return F.when(~cell.isin(*MISSING), cell)


def strings_and_record(columns: Sequence[str]) -> StructType:
    """The columns as strings, then the record as it is, which is null where its cells are as many as the columns."""
    return StructType([StructField(name, StringType()) for name in [*columns, _AS_IS]])


def _too_long(columns: Sequence[str]) -> Column:
    """What is wrong with a record that has more cells than there are columns, else null.

    The reader hands over as they are the records whose number of cells is not
    that of the columns; only those are looked at again.
    """
    record = F.col(_AS_IS)
    wider = ", ".join(f"c{i} STRING" for i in range(len(columns))) + f", {_BEYOND} STRING"
    beyond = F.from_csv(record, F.lit(wider), {"escape": '"'})[_BEYOND]
    return F.when(record.isNotNull() & beyond.isNotNull(), F.concat(F.lit(f"more than {len(columns)} cells: "), record))


def _not_too_long(columns: Sequence[str]) -> Column:
    """True, or an error."""
    problem = _too_long(columns)
    return F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(True)


def problem(columns: Sequence[str], schema: StructType | None) -> Column:
    """What would make a record an error: too many cells, or one that does not fit its type; else null."""
    misfits = [
        F.when(
            # Most cells fit; whether one stands for a missing value is asked of the others only.
            F.col(f"`{field.name}`").try_cast(field.dataType).isNull() & _present(field.name).isNotNull(),
            F.concat(F.lit(f"{field.name} is no {field.dataType.simpleString()}: "), F.col(f"`{field.name}`")),
        )
        for field in schema or ()
        if not isinstance(field.dataType, StringType)
    ]
    return F.coalesce(_too_long(columns), *misfits)


def _blank(columns: Sequence[str]) -> Column:
    """A line of white space is no record, however the file is read."""
    line = F.col(_AS_IS) if len(columns) > 1 else F.coalesce(F.col(_AS_IS), F.col(f"`{columns[0]}`"))
    return F.coalesce(line.rlike(r"^\s*$"), F.lit(False))


def records_of(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without the lines that are no records."""
    return records.filter(~_blank(columns))


def typed(records: DataFrame, schema: StructType) -> DataFrame:
    """The records' cells in their types; what does not fit is an error."""
    columns = schema.names
    rows = records_of(records, columns).filter(_not_too_long(columns)).select(*[_present(name).alias(name) for name in columns])
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def _reader(spark: SparkSession, encoding: str, multi_line: bool) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("enforceSchema", False)
        # All cells are counted, whichever are wanted.
        .option("columnPruning", False)
        # Empty cells are told from missing ones by the list above, not by the parser.
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("columnNameOfCorruptRecord", _AS_IS)
    )


def parsed_files(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], encoding: str = ENCODING, multi_line: bool = True) -> DataFrame:
    """The files' cells as strings, each record itself if its cells are not as many as the columns, and ``__file``."""
    records = _reader(spark, encoding, multi_line).schema(strings_and_record(columns)).csv(list(paths))
    return records.select("*", F.col("_metadata.file_path").alias("__file"))


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: StructType | None = None,
    encoding: str = ENCODING,
    multi_line: bool = True,
) -> DataFrame:
    """Read comma-separated files with a header.

    Cells that mean "missing" become null, then each column is cast to its type
    in ``schema``; a cell that does not fit is an error, never a silent null.
    The header must carry the schema's columns in its order, or reading fails.
    Without a schema the header names the columns and all are strings.  A record
    with too few cells is filled up with nulls; one with too many is an error.

    Quoted cells may hold line ends, so a file is read by one task.  A file that
    has none there, see :func:`files_with_cut_records`, can be split among many with
    ``multi_line=False``; one that has, with :func:`tributary.sources.quoted.read_quoted`.
    """
    chosen = paths if isinstance(paths, str) else list(paths)
    reader = _reader(spark, encoding, multi_line)
    columns = reader.csv(chosen).columns if schema is None else schema.names
    records = reader.schema(strings_and_record(columns)).csv(chosen)
    return typed(records, schema or StructType([StructField(name, StringType()) for name in columns]))


def file_headers(spark: SparkSession, paths: Sequence[str], encoding: str = ENCODING) -> list[tuple[str, ...]]:
    """The column names in each file's first line; nothing else of the files is read."""

    def header(path: str) -> tuple[str, ...]:
        line = first_line(spark, path, encoding)
        if not line:
            raise ValueError(f"{path} has no header")
        return tuple(next(csv.reader([line])))

    with ThreadPoolExecutor(max_workers=16) as pool:
        return list(pool.map(header, paths))


def _cut(line: Column) -> Column:
    """Whether a line is not a whole record.  Only a quote or a carriage return can make it so: the pattern is for lines that hold one."""
    return (line.contains('"') | line.contains("\r")) & ~line.rlike(_WHOLE_RECORD)


def files_with_cut_records(spark: SparkSession, paths: Sequence[str]) -> set[str]:
    """The files in which some line is not a whole record, as qualified paths; one parallel job for all.

    In every other file each line starts a record and ends it, so reading line
    by line, in parallel, gives what reading from the start gives.
    """
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select("value", "_metadata.file_path")
    cut = lines.filter(_cut(F.col("value"))).select("file_path").distinct()
    return {path_of_url(spark, row["file_path"]) for row in cut.collect()}
