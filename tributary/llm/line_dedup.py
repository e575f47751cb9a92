"""Line de-duplication across documents, answered in bitmaps of the lines to keep.

Lines become hashes; no text is shuffled for the search. The hashes are
partitioned by range, document and position included, and sorted, so that a
line which stands in a third of all documents is spread over tasks, and the
lines of one document that are alike lie together. From each range comes one
count and one document per hash. Lines that are frequent then mark bits of
their documents: 64 lines to a word, and only words with a bit cleared are kept.

Defined results: a null text is one empty line, as an empty one is. Rows that
share an id count as one document; a null id counts as a document lower than
all others. Copies of a row get the same answer, and rows of one id with
different texts are answered by their own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.columns import BLANKS, ascii_lower, text_digest, text_or_empty, written

MIN_CHARS = 20
MIN_DOCUMENTS = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def keep_bitmaps(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Bitmaps of documents that lose lines: id, digest of the text, and ``keep``, an array of (word, bits).

    Bit ``p % 64`` of word ``p // 64`` is 1 if line ``p`` (from 0) stays; a word
    that is not listed is all ones.
    """
    text = text_or_empty(F.col(text_column))
    lines = docs.select(F.col(id_column).alias("doc_id"), text_digest(text).alias("digest"), F.posexplode(lines_of(text)).alias("pos", "line"))
    key = ascii_lower(F.btrim(F.col("line"), F.lit(BLANKS)))
    hashed = (
        lines.withColumn("key", key)
        .filter(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "digest", "pos")
    )
    ranged = hashed.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", F.desc("doc_id"), "pos")
    # All lines of one hash and document are in one range: no further shuffle.
    held = ranged.groupBy("h1", "h2", "doc_id", "digest", (F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")
    )
    held = written(held, "line-hashes")
    frequent = (
        held.groupBy("h1", "h2", "doc_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        .filter(F.col("n_docs") >= min_documents)
    )
    lost = held.join(frequent, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    words = lost.groupBy("doc_id", "digest", "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy("doc_id", "digest").agg(
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep")
    )


def kept_lines(
    docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text", lines_column: str = "n_lines", dropped_column: str = "n_dropped"
) -> DataFrame:
    """All rows and columns, the text without the lines that its bitmap clears, and two columns: its lines before, and those dropped.

    Columns of ``docs`` that have the names of these two are replaced.
    """
    text = text_or_empty(F.col(text_column))
    keyed = docs.withColumn("__digest", text_digest(text)).alias("docs")
    marks = bitmaps.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__of"), F.map_from_entries("keep").alias("__keep"))
    joined = keyed.join(marks, F.col(f"docs.{id_column}").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__of")), "left")
    lines = lines_of(text)
    stays = F.filter(lines, lambda _, p: _bit(p))
    gone = F.aggregate(F.map_values("__keep"), F.lit(0).cast("bigint"), lambda n, bits: n + 64 - F.bit_count(bits))
    return joined.withColumns(
        {
            lines_column: F.size(lines).cast("bigint"),
            dropped_column: F.when(F.col("__keep").isNull(), F.lit(0).cast("bigint")).otherwise(gone),
            text_column: F.when(F.col("__keep").isNull(), F.col(text_column).cast("string")).otherwise(F.array_join(stays, "\n")),
        }
    ).drop("__digest", "__id", "__of", "__keep")


def _bit(position: Column) -> Column:
    word = F.coalesce(F.try_element_at(F.col("__keep"), (position / 64).cast("int")), F.lit(-1).cast("bigint"))
    return F.getbit(word, position % 64) == 1


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, id_column: str = "doc_id", text_column: str = "text", **names: str) -> DataFrame:
    """``kept_lines`` by the rows' own bitmaps."""
    return kept_lines(docs, keep_bitmaps(docs, min_chars, min_documents, id_column, text_column), id_column, text_column, **names)
