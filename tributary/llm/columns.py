"""Column expressions that the native operators share, and written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.storage import Folder, work_folder

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between words, as the operators on phrases see it: all ASCII but figures and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: What words are made of.
IN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BLANKS = " \t\n\x0b\x0c\r"
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch of rows on its way to Python, or one row. Spark's own bound is 10,000 rows, of which each task holds several copies.
BATCH_BYTES = 4 * 2**20


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and no other letter: ``lower`` where all is ASCII, as it is much the faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _CAPITALS, _CAPITALS.lower()))


def cut_words(text: Column) -> Column:
    """The text cut between its words; the first and last of them may be empty (see ``leads``, ``word_count``)."""
    return F.split(ascii_lower(text), BETWEEN + "+")


def leads(cut: Column) -> Column:
    """1 if the cut text starts with an empty word, else 0."""
    return (F.get(cut, F.lit(0)) == "").cast("int")


def word_count(cut: Column) -> Column:
    trails = (F.element_at(cut, -1) == "").cast("int")
    return F.greatest(F.size(cut) - leads(cut) - trails, F.lit(0)).cast("bigint")


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def text_digest(text: Column) -> Column:
    """With the id, tells rows apart that share it; rows alike in both are alike in all results."""
    return F.xxhash64(text)


def with_matches(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """All rows of ``left`` with the other columns of the ``right`` row of equal keys, if any; null equals null."""
    renamed = right.withColumnsRenamed({key: f"__{key}" for key in keys})
    same = F.lit(True)
    for key in keys:
        same = same & left[key].eqNullSafe(renamed[f"__{key}"])
    return left.join(renamed, same, "left").drop(*[f"__{key}" for key in keys])


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The table, written to the shared folder and read from there: lost executors cost no more than its reading."""
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(df: DataFrame, purpose: str) -> Iterator[DataFrame]:
    """Like ``written``, for a table that only jobs within read: its folder goes when these have written their results."""
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        Folder(spark, path).remove()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, the files of a job's shuffles go when the job has ended: for work that writes what it needs later."""
    with _setting(spark, _REMOVE_SHUFFLES, "true"):
        yield


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, rows go to Python in batches of ``BATCH_BYTES`` at most: for jobs that end within."""
    with _setting(spark, _BATCH, str(BATCH_BYTES)):
        yield


def keep_batches_small(spark: SparkSession) -> None:
    """From now on the same, unless the session has a bound of its own: for rows that are computed when they are read."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
