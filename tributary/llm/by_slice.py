"""Operators on whole texts, a slice of a partition at a time: rows in, rows out, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from tributary.llm import flat


def over_texts(
    df: DataFrame, id_column: str, text_column: str, columns: dict[str, str], arrays: Callable[[flat.Texts], Sequence[pa.Array]]
) -> DataFrame:
    """The id of each row and what ``arrays`` makes of its text: ``columns`` gives the names and SQL types.

    ``arrays`` gets some whole texts, nulls as empty ones, and returns one Arrow
    array per column, a value per text. Other columns of the table are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in flat.slices(batch.column(1)):
                ids = batch.column(0).slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, *arrays(texts)], names=["__id", *columns])

    kind = df.schema[id_column].dataType.simpleString()
    schema = ", ".join([f"__id {kind}", *(f"{name} {sql}" for name, sql in columns.items())])
    picked = df.select(df[id_column].alias("__id"), df[text_column].cast("string").alias("__text"))
    return picked.mapInArrow(run, schema).withColumnRenamed("__id", id_column)
