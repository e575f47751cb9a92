"""Delimited files with line ends inside quoted cells, read by byte ranges.

Only from a file's start can be told whether a line begins a record: a line end
inside quotes does not end one.  But that takes the parity of the quotes before
it, and parities add up.  So one parallel scan counts the quotes of each byte
range; a running sum over the ranges of a file, one row each, tells which of
them begin inside quotes; and in a second scan each range joins its own lines to
records.  Only the first and the last piece of a range can belong to a record
that goes on in another; those few are put together by a grouped concatenation.

This holds where quotes stand around cells, and are doubled inside them.  A
file with other quotes, or one whose last quote is left open, shows in its
records; such a file is read from its start by one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tributary.sources.delimited import ENCODING, file_headers, read_delimited, strings_and_record, typed
from tributary.storage import literal_path, path_of_url, qualified_path

# What a range hands on: a whole record, the end of one that began before, the begin of one that goes on.
_WHOLE, _END, _BEGIN = 0, 1, 2
_PIECES = "file string, at bigint, part int, first boolean, piece binary"

_CELL = r'(?:"(?:[^"]++|"")*+"|[^",\r\n]*+)'
_RECORD = rf"^{_CELL}(?:,{_CELL})*+\z"


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The lines of the files as bytes, in order within each byte range (``file``, ``at``)."""
    lines = spark.read.option("lineSep", "\n").text([literal_path(path) for path in paths])
    return lines.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary")).toDF("file", "at", "line")


@dataclass(frozen=True)
class Layout:
    """What has to be known of the files before their ranges can be read alone."""

    inside: frozenset[tuple[str, int]]  # ranges that begin inside quotes
    two_signs: frozenset[str]  # files whose first line ends with carriage return and line feed


def layout(lines: DataFrame) -> Layout:
    """One scan and a running sum; at most a row per range, megabytes of text each, reaches the driver."""
    quotes = F.octet_length("line") - F.octet_length(F.replace(F.col("line").cast("string"), F.lit('"'), F.lit("")))
    returns = F.endswith(F.hex(F.substring("line", -1, 1)), F.lit("0D"))
    # All lines of a range are one task's, in order, so the first is its first.
    counts = lines.groupBy("file", "at").agg(F.pmod(F.sum(quotes), F.lit(2)).alias("odd"), F.first(returns).alias("returns"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.withColumn("inside", F.coalesce(F.sum("odd").over(before) % 2 == 1, F.lit(False)))
    told = ranges.filter("inside OR (at = 0 AND returns)").select("file", "at", "inside").collect()
    return Layout(frozenset((r["file"], r["at"]) for r in told if r["inside"]), frozenset(r["file"] for r in told if not r["inside"]))


class _Range:
    """The lines of one byte range, joined to records as they come."""

    def __init__(self, file: str, at: int, inside: bool, two_signs: bool):
        self.file, self.at, self._two_signs = file, at, two_signs
        self._inside = inside  # quotes are open
        self._began = not inside  # the record that is open began in this range
        self._open: list[bytes] = []
        self._none_yet = True

    def take(self, lines: pa.Array) -> pa.RecordBatch:
        """Records, and the end of an earlier one, that these lines complete."""
        odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64) & 1
        after = (np.cumsum(odd) + self._inside) & 1
        ends = np.flatnonzero(after == 0)
        begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        pieces, parts = [], []
        alone = begins == ends
        if len(alone) and (self._open or not self._began):
            alone[0] = False
        for k in range(len(ends)):
            if alone[k]:
                pieces.append(lines[int(ends[k])].as_py())
                parts.append(_WHOLE)
                continue
            held = lines.slice(int(begins[k]), int(ends[k] - begins[k] + 1)).to_pylist()
            pieces.append(b"\n".join([*self._open, *held]))
            parts.append(_WHOLE if self._began else _END)
            self._open, self._began = [], True
        rest = int(ends[-1]) + 1 if len(ends) else 0
        self._open += lines.slice(rest).to_pylist()
        if len(lines):
            self._inside = bool(after[-1])
        return self._rows(pieces, parts)

    def close(self) -> pa.RecordBatch:
        """What is still open: the begin of a record, or all of a range within one."""
        if not self._open:
            return self._rows([], [])
        return self._rows([b"\n".join(self._open)], [_BEGIN if self._began else -1])

    def _rows(self, pieces: list[bytes], parts: list[int]) -> pa.RecordBatch:
        if self._two_signs:  # then they are one line end, in cells too, as for the reader from the start
            pieces = [piece.replace(b"\r\n", b"\n").removesuffix(b"\r") for piece in pieces]
        first = [False] * len(pieces)
        if pieces and self._none_yet:
            first[0], self._none_yet = self.at == 0, False
        columns = [pa.array([self.file] * len(pieces), pa.string()), pa.array([self.at] * len(pieces), pa.int64()), pa.array(parts, pa.int32()), pa.array(first, pa.bool_()), pa.array(pieces, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["file", "at", "part", "first", "piece"])


def _pieces(lines: DataFrame, known: Layout) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            files, starts = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((np.diff(starts) != 0) | (np.diff(codes) != 0)) + 1
            for begin, end in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows], strict=True):
                if begin == end:
                    continue
                key = (files[begin].as_py(), int(starts[begin]))
                if now is None or (now.file, now.at) != key:
                    if now is not None:
                        yield now.close()
                    now = _Range(*key, inside=key in known.inside, two_signs=key[0] in known.two_signs)
                yield now.take(batch.column(2).slice(begin, end - begin))
        if now is not None:
            yield now.close()

    return lines.mapInArrow(run, _PIECES)


def _all_records(spark: SparkSession, paths: Sequence[str], encoding: str) -> DataFrame:
    """The records (``file``, ``first``, ``record``), of which the first of a file is its header, in no order.

    A record whose quotes are never closed has a null for its text, as has the
    end of one that never began.
    """
    lines = _lines(spark, paths)
    pieces = _pieces(lines, layout(lines)).withColumn("piece", F.decode("piece", encoding))
    whole = pieces.filter(F.col("part") == _WHOLE).select("file", "first", F.col("piece").alias("record"))
    # Of a range the end of an earlier record comes before the begin of the next; a range within a record is its middle.
    cut = pieces.filter(F.col("part") != _WHOLE)
    place = F.struct("at", F.when(F.col("part") == _BEGIN, 1).otherwise(0).alias("late"))
    in_order = Window.partitionBy("file").orderBy(place)
    numbered = cut.withColumns({"number": F.sum((F.col("part") == _BEGIN).cast("int")).over(in_order), "place": place})
    joined = numbered.groupBy("file", "number").agg(
        F.max("first").alias("first"),
        F.sort_array(F.collect_list(F.struct("place", "part", "piece"))).alias("pieces"),
    )
    closed = (F.element_at("pieces", 1)["part"] == _BEGIN) & (F.element_at("pieces", -1)["part"] == _END)
    text = F.array_join(F.transform("pieces", lambda p: p["piece"]), "\n")
    joined = joined.select("file", "first", F.when(closed, text).alias("record"))
    return whole.unionByName(joined)


def records(spark: SparkSession, paths: Sequence[str], encoding: str = ENCODING) -> DataFrame:
    """The records of the files (``file``, ``record``), their headers left out, in no order."""
    return _all_records(spark, paths, encoding).filter(~F.col("first")).select("file", "record")


def irregular_files(spark: SparkSession, paths: Sequence[str], encoding: str = ENCODING) -> set[str]:
    """The files that have quotes elsewhere than around cells and doubled inside them, as qualified paths; one job for all."""
    odd = _all_records(spark, paths, encoding).filter(F.col("record").isNull() | ~F.col("record").rlike(_RECORD))
    return {path_of_url(spark, row["file"]) for row in odd.select("file").distinct().collect()}


def parsed(found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The records' cells as strings, the record itself if its cells are not as many as the columns, and ``file``."""
    options = {"escape": '"', "nullValue": "", "emptyValue": "", "multiLine": "true", "columnNameOfCorruptRecord": "__record"}
    wanted = strings_and_record(columns)
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` STRING" for f in wanted)
    record = F.coalesce("record", F.raise_error(F.lit("a record has no end: the file's ranges changed, or its quotes are odd")))
    found = found.filter(F.col("record").isNull() | ~F.col("record").rlike(r"^\s*\z"))
    return found.select(F.from_csv(record, F.lit(ddl), options).alias("__cells"), F.col("file").alias("__file")).select("__cells.*", "__file")


def read_quoted(spark: SparkSession, paths: str | Sequence[str], schema: StructType, encoding: str = ENCODING) -> DataFrame:
    """Read comma-separated files as ``read_delimited`` does, each by many tasks, though cells may hold line ends.

    Files with irregular quotes are read by one task each.  The encoding has to
    have line ends and quotes as single bytes, as all but UTF-16 and UTF-32 do.
    """
    if encoding.lower().replace("-", "").replace("_", "").startswith(("utf16", "utf32")):
        return read_delimited(spark, paths, schema, encoding)
    chosen = [paths] if isinstance(paths, str) else list(paths)
    found = irregular_files(spark, chosen, encoding)
    odd = [path for path in chosen if qualified_path(spark, path) in found]
    regular = [path for path in chosen if path not in odd]
    for path, header in zip(regular, file_headers(spark, regular, encoding), strict=True):
        if list(header) != schema.names:
            raise ValueError(f"the header of {path} is {list(header)}, not {schema.names}")
    parts = []
    if regular:
        parts.append(typed(parsed(records(spark, regular, encoding), schema.names), schema))
    if odd:
        parts.append(read_delimited(spark, [literal_path(path) for path in odd], schema, encoding))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
