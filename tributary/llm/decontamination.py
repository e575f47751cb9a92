"""Benchmark decontamination: where windows of benchmark items stand in documents.

A window is ``WINDOW`` consecutive words of an item (the whole item, if it is
shorter). Its tokens are its shingles of three words. Documents' shingles meet
those of the benchmark in one pass; the hits that remain are few, and are
written. They tell how rare each shingle is. As a window must be held whole,
its prefix is its one rarest shingle: only documents with that shingle are
candidates, at the place it fixes; places that reach over either end of the
document fall away. Each shingle that a candidate window has to have, at its
place, is then looked for among the hits, and windows that have them all stand.

The benchmark's shingles are broadcast if they are few enough (counted first),
and joined by shuffle otherwise, with a row per word. Texts are not shuffled,
and no row holds more than one window: a document that is nothing but benchmark
costs in proportion to its length.

Defined results: a null text, or one without words, is never hit; an item
without words has no window. Items with equal windows all count. Copies of a
row get the same answer; rows of one id with different texts are answered by
their own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.columns import cut_words, leads, text_digest, text_or_empty, with_matches, word_count, written

WINDOW = 10
SHINGLE = 3
#: Broadcast at most so many distinct shingles: under 16 MB, as a shingle is a hash.
MOST_BROADCAST = 500_000


def _words(text: Column) -> Column:
    """The words alone, without empty ones at the ends."""
    return F.filter(cut_words(text), lambda w: w != "")


def windows_of(benchmark: DataFrame, size: int = WINDOW, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Each distinct window: ``window`` (its words) and ``width`` (the words of its shingles); with the ids of its items."""
    words = benchmark.select(F.col(id_column).alias("item_id"), _words(text_or_empty(F.col(text_column))).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    each = words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, F.lit(size)))).alias("window"))
    return each.withColumn("width", F.least(F.size("window"), F.lit(SHINGLE)))


def _shingle_texts(window: str, width: str) -> Column:
    starts = F.sequence(F.lit(1), F.size(window) - F.col(width) + 1)
    return F.transform(starts, lambda s: F.array_join(F.slice(window, s, F.col(width)), " "))


def _hits(docs: DataFrame, shingles: DataFrame, width: int, small: bool) -> DataFrame:
    """Places in documents of the benchmark's shingles of one width."""
    following = [F.get("cut", F.col("at") + k) for k in range(1, width)]
    wanted = shingles.filter(F.col("width") == width).select(F.xxhash64(*[F.get(F.split("shingle", " "), F.lit(k)) for k in range(width)]).alias("hash")).distinct()
    places = docs.select("doc_id", "digest", "cut", F.posexplode("cut").alias("at", "word")).withColumn("hash", F.xxhash64("word", *following))
    shown = [
        F.col("doc_id"), F.col("digest"), (F.col("at") - leads(F.col("cut"))).alias("at"), F.lit(width).alias("width"),
        word_count(F.col("cut")).cast("int").alias("n_words"), F.concat_ws(" ", F.col("word"), *following).alias("shingle"),
    ]
    if small:  # the array of words stays where it is: hits are made of it in the same step
        return places.join(F.broadcast(wanted), "hash").select(*shown)
    return places.select("hash", *shown).join(wanted, "hash").drop("hash")


def occurrences(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Where windows stand: (id, digest of the text, start, the window's number and size), and the items of each window."""
    windows = written(windows_of(benchmark, size, item_column, item_text_column), "benchmark-windows")
    distinct = written(windows.select("window", "width").distinct().withColumn("number", F.monotonically_increasing_id()), "benchmark-windows")
    items = windows.join(distinct, ["window", "width"]).select("number", "item_id").distinct()
    shingles = distinct.select("width", F.explode(_shingle_texts("window", "width")).alias("shingle")).distinct()
    per_width = {row["width"]: row["count"] for row in shingles.groupBy("width").count().collect()}  # at most three rows
    text = text_or_empty(F.col(text_column))
    cut = docs.select(F.col(id_column).alias("doc_id"), text_digest(text).alias("digest"), cut_words(text).alias("cut"))
    hits = None
    for width, n in sorted(per_width.items()):
        some = _hits(cut, shingles, width, n <= MOST_BROADCAST)
        hits = some if hits is None else hits.union(some)
    if hits is None:
        hits = cut.limit(0).select("doc_id", "digest", F.lit(0).alias("at"), F.lit(0).alias("width"), F.lit(0).alias("n_words"), F.lit("").alias("shingle"))
    hits = written(hits.distinct(), "benchmark-hits")
    # Rarity over all documents decides which shingle stands for a window.
    rarity = hits.groupBy("shingle").agg(F.count("at").alias("n"))
    places = distinct.select("number", F.posexplode(_shingle_texts("window", "width")).alias("offset", "shingle"))
    ranked = places.join(rarity, "shingle", "left")
    prefix = ranked.groupBy("number").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle")).alias("rarest"))
    whole = distinct.select("number", F.size("window").alias("size"), _shingle_texts("window", "width").alias("expected"))
    prefix = prefix.filter(F.col("rarest.n") > 0).join(whole, "number").select("number", "size", "expected", "rarest.offset", "rarest.shingle")
    candidates = (
        hits.join(prefix, "shingle")
        .withColumn("start", F.col("at") - F.col("offset"))
        .filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
        .select("doc_id", "digest", "start", "number", "size", F.size("expected").alias("needed"), F.posexplode("expected").alias("k", "shingle"))
        .withColumn("at", F.col("start") + F.col("k"))
    )
    there = hits.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("at").alias("__at"), F.col("shingle").alias("__shingle"))
    same = (
        candidates["doc_id"].eqNullSafe(there["__id"]) & (candidates["digest"] == there["__digest"])
        & (candidates["at"] == there["__at"]) & (candidates["shingle"] == there["__shingle"])
    )
    matched = candidates.join(there, same).groupBy("doc_id", "digest", "start", "number", "size", "needed").agg(F.count("at").alias("n"))
    return matched.filter("n = needed").select("doc_id", "digest", "start", "number", "size"), items


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """Documents that hold a window: id, digest of the text, ``spans`` (start and end in words, merged), and ``items`` (ids as sorted strings)."""
    found, items = occurrences(docs, benchmark, size, id_column, text_column, item_column, item_text_column)
    spans = found.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def merge(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when(F.size(done) == 0, F.array(span)).when(last["end"] >= span["start"], grown).otherwise(F.concat(done, F.array(span)))

    spans = spans.withColumn("spans", F.aggregate("spans", none, merge))
    held = (
        found.select("doc_id", "digest", "number").distinct().join(items, "number").groupBy("doc_id", "digest")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    return with_matches(spans, held, "doc_id", "digest")
