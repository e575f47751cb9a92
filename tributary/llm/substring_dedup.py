"""Near-duplicate passages inside documents, by compact windows of min-hashes.

The tokens of a document are its shingles of five words. Under one hash, all
windows whose least token is the same one, at place m, form a compact window:
the span between the nearest smaller tokens on either side of m, a node of the
Cartesian tree over the hashes. Around m, a run of tokens on one side or the
other goes into the signature; signatures that one document alone has are
dropped by a bitmap.

Two windows of a passage's length are similar if they share, in order and in one
or two runs, all tokens but those that may differ. If these are fewer than two
changed words leave (``percent`` 80 of 50 words: five, and one changed word is
in five shingles), the longer run has at least half of the tokens that must be
shared, its least token is at the same place of both, and a signature of compact
windows of that length finds it, whatever the text. So nothing is left to chance:

* Runs of half the shared tokens, around places of live signatures, are hashed.
  Of those that several documents hold it is known where they branch: where the
  tokens before or after them are not all the same.
* Windows all of whose runs are held by several documents are compared by hash.
* Windows that differ at their ends, or in the midst, begin or break off a run
  where it branches. The shared tokens are one hash of one or of two runs, for
  each place where the change may lie in the window; equal hashes are similar
  windows. Of windows that stand in several documents only one is taken along,
  and of breaks only those with a next token behind the gap that others have.

All of that is grouping by hashes: documents that share a passage are not paired,
but linked with the least of them, and the rows grow with the text.

With a lower ``percent`` windows may differ in two places and more. Then the
surroundings of a place, the tokens less than a passage away, are laid one upon
the other under several hashes. One is the centre, and each other one is compared
with it, first by four bits of each token, then by 16 others. Those not similar
to the centre are open, and the next centre is one of them. What is open after
``ROUNDS`` centres, and not known to repeat by another signature or as a whole,
is compared with all that share the signature and two more runs of tokens. There
near repeats are candidates with a chance that grows with the number of hashes
and their length; exact ones are all found.

Equal texts are one node. A signature counts at all its places in a document;
of places with the same surroundings one is compared, and the other places of
windows found there are added at the end. What the driver handles is bitmaps of
8 MB; a task holds a few MB of tokens at a time, or one document.

Defined results: documents are told apart by id; rows that share an id count as
one document and get their own texts' spans. Null or short texts have none. A
passage that repeats only inside one document is not reported. Windows with more
than one stretch of three and more equal words that are not as long in the other
window may differ by that in two places; they are no similar windows here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm import bitmaps, flat
from tributary.llm.columns import passing, shuffles_removed, written
from tributary.llm.components import components

WIDTH = 5
WORDS = 50
PERCENT = 80
HASHES = 3
CONTEXT = 10
ROUNDS = 2
_NAME = np.uint64(0x8CB92BA72F3D8DD7)


def _window(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``size`` consecutive values."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values, have = pick(values[:-step], values[step:]), have + step
    return values


def anchors(values: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Places of tokens that are the least of some ``size`` tokens of their document: the roots of compact windows."""
    if len(values) < size:
        return np.zeros(0, np.int64)
    owner = flat.segment_ids(bounds)
    least = _window(values, size, np.minimum)
    least[owner[: len(least)] != owner[size - 1 :]] = 0  # reaches into the next document
    around = np.zeros(size - 1, np.uint64)
    highest = _window(np.concatenate([around, least, around]), size, np.maximum)
    # No window's least is above a token in it: equality means that the token is the least of one.
    return np.flatnonzero(highest == values)


def signatures(tokens: np.ndarray, bounds: np.ndarray, size: int, hashes: int, context: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of compact windows, and the place of each one's least token."""
    owner = flat.segment_ids(bounds)
    n, keys, places = len(tokens), [], []
    if n < context:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    run = np.zeros(n - context + 1, np.uint64)
    for k in range(0, context, WIDTH):
        run = run * np.uint64(0x2545F4914F6CDD1D) + tokens[k : k + len(run)]
    run = flat.mixed(run + tokens[context - 1 :])
    for seed in range(hashes):
        at = anchors(flat.mixed(tokens ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)), bounds, size)
        for side, first in ((0, at), (1, at - context + 1)):
            inside = (first >= bounds[owner[at]]) & (first + context <= bounds[owner[at] + 1])
            keys.append(flat.mixed(run[first[inside]] + np.uint64(2 * seed + side)))
            places.append(at[inside])
    return np.concatenate(keys), np.concatenate(places)


def _tokens(texts: flat.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, words = texts.words()
    tokens, bounds = flat.shingles(texts.hashes(starts, ends, fold=True), words, WIDTH)
    return tokens, bounds, np.diff(words)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _names(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128-bit names, a row of bytes each, from sums over tokens and their places: equal texts have equal names."""
    place = (np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))).astype(np.uint64)
    pair = np.stack([_sums(flat.mixed(tokens + place * _NAME), bounds), _sums(flat.mixed(tokens ^ flat.mixed(place + np.uint64(1))), bounds)], axis=1)
    return flat.mixed(pair).view(np.uint8)


def _live(rows: DataFrame, size: int, hashes: int, context: int) -> np.ndarray:
    """A bitmap of signatures that more than one node has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in flat.slices(batch.column(1)):
                tokens, bounds, _ = _tokens(texts)
                keys, places = _firsts(*signatures(tokens, bounds, size, hashes, context), bounds)
                names = _names(tokens, bounds)[:, :8].copy().view(np.int64)[:, 0][flat.segment_ids(bounds)[places]]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(names)], names=["sig", "name"])

    found = rows.mapInArrow(run, "sig bigint, name bigint")
    several = found.groupBy("sig").agg(F.min("name").alias("low"), F.max("name").alias("high")).filter("low != high")
    return bitmaps.collected(several, bitmaps.bit_of_long(F.col("sig")))


def _firsts(keys: np.ndarray, places: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each signature of a document at its first place, by place."""
    order = np.argsort(places, kind="stable")
    keys, places = keys[order], places[order]
    owner = flat.segment_ids(bounds)[places]
    first = np.sort(np.unique(np.stack([keys, owner.astype(np.uint64)], axis=1), axis=0, return_index=True)[1])
    return keys[first], places[first]


def _together(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of both: with ``_window``, of all tokens of a window in their order."""
    return flat.mixed(left * np.uint64(0x2545F4914F6CDD1D) + right)


def _apart(keys: np.ndarray, places: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All places of a document's signatures, by place; of places with the same ``size`` - 1 tokens on both sides the first.

    These lie in the same windows, so that what is found at one of them holds for all.
    """
    order = np.argsort(places, kind="stable")
    keys, places = keys[order], places[order]
    owner = flat.segment_ids(bounds)[places]
    around = flat.mixed(places.astype(np.uint64))
    whole = (places - size + 1 >= bounds[owner]) & (places + size <= bounds[owner + 1])
    if whole.any():
        around[whole] = _window(tokens, 2 * size - 1, _together)[places[whole] - size + 1]
    first = np.sort(np.unique(np.stack([keys, owner.astype(np.uint64), around], axis=1), axis=0, return_index=True)[1])
    return keys[first], places[first]


def _measured(rows: DataFrame, id_type: str, size: int, run_size: int, hashes: int, context: int, live) -> DataFrame:
    """Each row's id, number of words, name of the text, and a number of its own.

    Rows with live signatures also have these with their places, the tokens (32
    bits each), and whether places were left out because they are like others.
    """
    names = ["id", "n_words", "name", "row", "sigs", "places", "tokens", "again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for texts in flat.slices(batch.column(1)):
                tokens, bounds, n_words = _tokens(texts)
                keys, places = signatures(tokens, bounds, run_size, hashes, context)
                held = bitmaps.holds(live.value, keys)
                all_, (keys, places) = places[held], _apart(keys[held], places[held], tokens, bounds, size)
                cuts, total = np.searchsorted(places, bounds), np.searchsorted(np.sort(all_), bounds)
                short, parts = (tokens >> np.uint64(32)).astype(np.uint32), list(zip(bounds[:-1], bounds[1:], cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, len(texts)),
                        pa.array(n_words),
                        bitmaps.as_binary(_names(tokens, bounds)),
                        pa.array(np.arange(row, row + len(texts))),
                        pa.array([keys[c:d].view(np.int64) for _, _, c, d in parts], pa.list_(pa.int64())),
                        pa.array([places[c:d] - a for a, _, c, d in parts], pa.list_(pa.int32())),
                        pa.array([short[a:b].tobytes() if d > c else None for a, b, c, d in parts], pa.binary()),
                        pa.array(np.diff(total) > np.diff(cuts)),
                    ],
                    names=names,
                )
                row += len(texts)

    schema = f"id {id_type}, n_words bigint, name binary, row bigint, sigs array<bigint>, places array<int>, tokens binary, again boolean"
    return rows.mapInArrow(run, schema)


def _repeats_inside(spans: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """The spans (node, start, end) of nodes that repeat themselves, with all places of each window in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, held, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = np.frombuffer(tokens.as_buffer(), np.uint32).astype(np.uint64)
                windows = np.zeros(len(own) - size + 1, np.uint64)
                for k in range(size):
                    windows = windows * np.uint64(0x2545F4914F6CDD1D) + own[k : k + len(windows)] + np.uint64(1)
                covered = np.zeros(len(windows) + 1, np.int64)
                for span in held:
                    covered[min(span["start"], len(windows))] += 1
                    covered[max(0, min(span["end"] - size - WIDTH + 2, len(windows)))] -= 1
                marked = np.flatnonzero(np.isin(windows, windows[np.cumsum(covered)[:-1] > 0]))
                if len(marked):
                    gaps = np.flatnonzero(np.diff(marked) > 1)
                    out += [(node, int(marked[a]), int(marked[b]) + size + WIDTH - 1) for a, b in zip(np.append(0, gaps + 1), np.append(gaps, len(marked) - 1), strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["node", "start", "end"])

    held = spans.groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("held"))
    return held.join(sets, "node").select("node", "held", "tokens").mapInArrow(run, "node bigint, start int, end int")


def _slices(batch: pa.RecordBatch, column: int, limit: int = 2**21) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``limit`` bytes of tokens, or of one row."""
    ends, first = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)), 0
    while first < len(batch):
        after = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, side="right")))
        yield batch.slice(first, after - first)
        first = after


def _laid(tokens: pa.Array, places: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens with ``size`` - 1 zeros between documents and around them, where each place's surroundings begin, and its document.

    Surroundings are the 2 ``size`` - 1 tokens about a place: all windows that hold it lie in them.
    """
    own = [np.frombuffer(x.as_buffer(), np.uint32) for x in tokens]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
    owner = np.arange(len(own)).repeat(np.diff(bounds))
    laid = np.zeros(bounds[-1] + (size - 1) * (len(own) + 1), np.uint32)
    laid[np.arange(bounds[-1]) + (size - 1) * (owner + 1)] = np.maximum(np.concatenate(own), 1)
    document = np.arange(len(own)).repeat(np.diff(places.offsets.to_numpy()))
    return laid, places.flatten().to_numpy() + bounds[document] + (size - 1) * document, document


def _named(laid: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """A name of each place's surroundings."""
    return _window(flat.mixed(laid.astype(np.uint64)), 2 * size - 1, _together)[begins]


def _postings(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 3):
                laid, begins, document = _laid(part.column(3), part.column(2), size)
                names = _named(laid, begins, size).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1).flatten(), pa.array(names), pa.array(part.column(0).to_numpy()[document]), part.column(2).flatten()],
                    names=["sig", "around", "node", "place"],
                )

    return run


def _bit(around: Column, node: Column) -> Column:
    return (around.bitwiseAND(F.lit(bitmaps.BITS - 1)) + bitmaps.bit_of_row(node)).bitwiseAND(F.lit(bitmaps.BITS - 1))


def _contents(held: DataFrame, wanted: DataFrame, size: int, sketched: bool) -> DataFrame:
    """The tokens of wanted surroundings (``around``, and ``node``, one document that has them).

    Of each token 16 bits, or four bits of all 32 if ``sketched``; zero only where there is none.

    A bitmap tells which of a document's surroundings are wanted from it: others do not leave their task.
    """
    spark = held.sparkSession
    bits = spark.sparkContext.broadcast(bitmaps.collected(wanted, _bit(F.col("around"), F.col("node"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 3):
                laid, begins, document = _laid(part.column(3), part.column(2), size)
                names = _named(laid, begins, size).view(np.int64)
                keep = np.flatnonzero(bitmaps.holds_pairs(bits.value, names, part.column(0).to_numpy()[document]))
                keep = keep[np.unique(names[keep], return_index=True)[1]]
                for first in range(0, len(keep), 5000):
                    some = keep[first : first + 5000]
                    rows = np.lib.stride_tricks.sliding_window_view(laid, 2 * size - 1)[begins[some]]
                    if sketched:
                        low = np.pad(np.where(rows == 0, 0, rows % 15 + 1).astype(np.uint8), ((0, 0), (0, 1)))
                        rows = low[:, ::2] | (low[:, 1::2] << 4)
                    else:
                        rows = np.where(rows == 0, 0, np.maximum(rows >> 16, 1)).astype(np.uint16)
                    width = rows.shape[1] * rows.itemsize
                    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(some), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(names[some]), data.cast(pa.binary())], names=["around", "content"])

    return held.select("node", "sigs", "places", "tokens").mapInArrow(run, "around bigint, content binary").dropDuplicates(["around"])


def similar_windows(left: np.ndarray, right: np.ndarray, size: int, percent: int) -> np.ndarray:
    """For each row of ``left`` and the row of ``right``, which of the windows at the same place are similar.

    Windows of ``size`` tokens are similar if 100 * shared >= percent * union. A token is shared if the other window
    holds it at its place, or so few places beside it that the words put in or left out between do not already make the
    windows differ. Zeros are no tokens: windows that hold one are not similar.
    """

    def counted(marks: np.ndarray, width: int) -> np.ndarray:
        sums = np.zeros((marks.shape[0], marks.shape[1] + 1), np.int32)
        np.cumsum(marks, axis=1, out=sums[:, 1:])
        return sums[:, width:] - sums[:, :-width]

    needed = -(-2 * size * percent // (100 + percent))
    taken = left == right
    shared = counted(taken, size)
    for shift in range(1, max(1, size - needed - WIDTH + 1) + 1):
        for there, here in ((slice(shift, None), slice(None, -shift)), (slice(None, -shift), slice(shift, None))):
            beside = (left[:, here] == right[:, there]) & ~taken[:, here]
            shared += counted(beside, size - shift)
            taken[:, here] |= beside
    similar = 100 * shared >= percent * (2 * size - shared)
    return similar & (counted((left == 0) | (right == 0), size) == 0)


def _similar(pairs: DataFrame, contents: DataFrame, size: int, percent: int, *, sketched: bool) -> DataFrame:
    """The pairs (a, b) of surroundings with similar windows, with the first and last start of these, seen from the place.

    Each such window holds the place, so the windows from ``low`` to ``high`` cover one span.
    """

    def rows(column: pa.Array) -> np.ndarray:
        data = np.frombuffer(b"".join(column.to_pylist()), np.uint8 if sketched else np.uint16).reshape(len(column), -1)
        return np.stack([data & 15, data >> 4], axis=2).reshape(len(column), -1)[:, : 2 * size - 1] if sketched else data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 2000):
                part = batch.slice(first, 2000)
                similar = similar_windows(rows(part.column(2)), rows(part.column(3)), size, percent)
                some = np.flatnonzero(similar.any(axis=1))
                low = similar[some].argmax(axis=1) - size + 1
                high = -similar[some][:, ::-1].argmax(axis=1)
                kept = part.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["a", "b", "low", "high"])

    left = contents.select(F.col("around").alias("a"), F.col("content").alias("left"))
    right = contents.select(F.col("around").alias("b"), F.col("content").alias("right"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a bigint, b bigint, low int, high int")


def _pairs(against: DataFrame) -> DataFrame:
    """Each pair of surroundings once, but for those that one document alone has, with a document of each."""
    one = (F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low"))
    x, y = F.struct("x.around", "x.low"), F.struct("y.around", "y.low")
    both = against.filter(~one).select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    return both.select(F.col("x.around").alias("a"), F.col("x.low").alias("a_node"), F.col("y.around").alias("b"), F.col("y.low").alias("b_node")).dropDuplicates(["a", "b"])


def _mixed(groups: DataFrame, *also: str) -> DataFrame:
    """Keys with several surroundings, in several documents, and (``also`` "some") with an open one."""
    some = [F.max("open").alias("some")] if also else []
    kept = groups.groupBy("key").agg(*some, (F.min("around") != F.max("around")).alias("several"), (F.min("low") != F.max("high")).alias("nodes"))
    return kept.filter(" and ".join([*also, "several", "nodes"])).select("key")


def _rounds(groups: DataFrame, verified, rounds: int) -> tuple[list[DataFrame], DataFrame]:
    """Similar pairs of surroundings (key, around, low, high, open) of one key, and what stays open after some rounds of centres.

    A round compares all surroundings of a key with one that is open, the centre. Those similar to it are resolved; they
    stay while others of the key are open, as these may be similar to them without being similar to the centre.
    ``verified`` gives similar pairs as a written table, as what it is given goes.
    """
    found, left = [], groups
    for _ in range(rounds):
        centre = left.filter("open").groupBy("key").agg(F.min(F.struct("around", "low", "high")).alias("y"))
        against = left.join(centre, "key").filter(F.col("around") != F.col("y.around")).select("key", F.struct("around", "low", "high").alias("x"), "y", "open")
        with passing(against, "passage-against") as against:
            similar = verified(_pairs(against))
            found.append(similar)
            either = similar.select("a", "b").union(similar.select("b", "a")).toDF("around", "centre").withColumn("similar", F.lit(True))
            marked = against.select("key", "x.*", F.col("y.around").alias("centre"), "open").join(either, ["around", "centre"], "left")
            marked = written(marked.select("key", "around", "low", "high", (F.col("open") & F.col("similar").isNull()).alias("open")), "passage-marked")
        left = marked.join(_mixed(marked, "some"), "key", "left_semi")
        if left.isEmpty():
            break
    return found, left


def _untouched(left: DataFrame, found: DataFrame, exact: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """Open surroundings of which no window is known to repeat: in no similar pair, and in no ``exact`` span about their place."""
    known = found.select(F.col("a").alias("around")).union(found.select("b"))
    some = left.filter("open").select("around", F.col("low").alias("node")).distinct().join(known, "around", "left_anti")
    # A passage is found at its tokens: spans are in words, and end some words after the last token begins.
    spans = exact.select("node", "start", (F.col("end") - WIDTH).alias("last"))
    spans = spans.withColumn("block", F.explode(F.sequence((F.col("start") / size).cast("int"), (F.col("last") / size).cast("int"))))
    at = some.join(places.select("around", "node", "place").distinct(), ["around", "node"]).withColumn("block", (F.col("place") / size).cast("int"))
    covered = at.join(spans, ["node", "block"]).filter("start <= place and place <= last").select("around")
    return some.select("around").join(covered, "around", "left_anti").distinct()


def _near(held: DataFrame, places: DataFrame, exact: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of surroundings with similar windows from ``low`` to ``high``.

    What is open under a signature after ``ROUNDS`` centres, and not known to repeat by any other signature or as a
    whole, is compared with all surroundings that share the signature and two more runs of tokens, some way off the place.
    """
    groups = places.groupBy(F.col("sig").alias("key"), "around").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    with passing(groups, "passage-groups") as groups:
        groups = written(groups.join(_mixed(groups), "key", "left_semi"), "passage-groups")
    sketches = written(_contents(held, groups.select("around", F.col("low").alias("node")), size, True), "passage-sketches")

    def verified(pairs: DataFrame) -> DataFrame:
        with passing(pairs, "passage-pairs") as pairs:
            likely = _similar(pairs, sketches, size, percent, sketched=True).select("a", "b").join(pairs, ["a", "b"])
            with passing(likely, "passage-likely") as likely:
                ends = likely.select(F.col("a").alias("around"), F.col("a_node").alias("node")).union(likely.select("b", "b_node"))
                with passing(_contents(held, ends, size, False), "passage-contents") as contents:
                    return written(_similar(likely, contents, size, percent, sketched=False), "passage-similar")

    found, left = _rounds(groups.withColumn("open", F.lit(True)), verified, ROUNDS)
    if left.isEmpty():
        return reduce(DataFrame.union, found)
    some = _untouched(left, reduce(DataFrame.union, found), exact, places, size).withColumn("untouched", F.lit(True))
    left = left.join(some, "around", "left").withColumn("open", F.col("open") & F.col("untouched").isNotNull()).drop("untouched")
    # Ten tokens are five bytes of a sketch, with the place at its middle: two runs on either side, next to what the signature holds.
    middle = size // 2
    runs = [F.substring("content", at + 1, 5) for at in (middle - 15, middle - 10, middle + 5, middle + 10) if at >= 0]
    # Runs further apart are in no common window.
    keys = F.explode(F.array(*[F.xxhash64("key", F.lit(k), *runs[k : k + 2]) for k in range(len(runs) - 1)]))
    with passing(left.join(sketches, "around").select(keys.alias("key"), "around", "low", "high", "open"), "passage-refined") as refined:
        left = written(refined.join(_mixed(refined, "some"), "key", "left_semi"), "passage-left")
    x = left.filter("open").select("key", F.struct("around", "low", "high").alias("x"))
    y = left.select("key", F.struct("around", "low", "high").alias("y"), "open")
    rest = x.join(y, "key").filter((F.col("x.around") < F.col("y.around")) | (~F.col("open") & (F.col("x.around") != F.col("y.around"))))
    return reduce(DataFrame.union, [*found, verified(_pairs(rest))])


def _exact(held: DataFrame, nodes: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Spans (node, start, end) of windows that several nodes hold token by token, and links (a, b) of these nodes.

    A window that two nodes hold has its least token at the same place of both,
    with a live signature: only windows around places of these are compared.
    """
    spark = held.sparkSession
    wanted = spark.sparkContext.broadcast(bitmaps.collected(nodes, bitmaps.bit_of_row(F.col("node"))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bitmaps.holds_rows(wanted.value, batch.column(0).to_numpy())))  # copies are left out
            for part in _slices(batch, 2):
                own = [np.frombuffer(x.as_buffer(), np.uint32) for x in part.column(2)]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])])
                tokens = np.concatenate(own).astype(np.uint64)
                owner = flat.segment_ids(bounds)
                places = part.column(3).flatten().to_numpy() + np.repeat(bounds[:-1], np.diff(part.column(3).offsets.to_numpy()))
                document = owner[places]
                low, high = np.maximum(places - size + 1, bounds[document]), np.minimum(places, bounds[document + 1] - size)
                near = np.cumsum(np.bincount(low, minlength=len(tokens) + 1) - np.bincount(high + 1, minlength=len(tokens) + 1))
                starts = np.flatnonzero(near > 0)
                names = part.column(1).to_numpy()
                at = (starts - bounds[owner[starts]]).astype(np.int32)
                windows = _window(flat.mixed(tokens), size, _together)[starts].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(windows), pa.array(names[owner[starts]]), pa.array(at)], names=["window", "short", "place"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for short, starts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                starts = np.unique(starts.values.to_numpy())
                gaps = np.flatnonzero(np.diff(starts) > 1)
                out += [(short, int(starts[a]), int(starts[b]) + size + WIDTH - 1) for a, b in zip(np.append(0, gaps + 1), np.append(gaps, len(starts) - 1), strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["short", "start", "end"])

    found = held.select("row", F.xxhash64("name"), "tokens", "places").mapInArrow(cut, "window bigint, short bigint, place int")
    several = found.groupBy("window").agg(F.min("short").alias("low"), F.max("short").alias("high")).filter("low != high").select("window", "low")
    hits = written(found.join(several, "window").select("short", "place", "low"), "passage-windows")
    spans = hits.groupBy("short").agg(F.collect_list("place").alias("starts")).mapInArrow(merge, "short bigint, start int, end int")
    links = hits.select("short", "low").filter("short != low").distinct()
    short = nodes.select("node", "short")
    low = short.select(F.col("node").alias("b"), F.col("short").alias("low"))
    return spans.join(short, "short").select("node", "start", "end"), links.join(short, "short").join(low, "low").select(F.col("node").alias("a"), "b")


class _Runs:
    """Some nodes' tokens, one after another, and their runs of ``run`` tokens that hold a place of a live signature."""

    def __init__(self, part: pa.RecordBatch, run: int):
        own = [np.frombuffer(x.as_buffer(), np.uint32) for x in part.column(2)]
        self.run, self.short, self.tokens = run, part.column(1).to_numpy(), np.concatenate(own)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        self.owner, self._bounds = flat.segment_ids(bounds), bounds
        self._sums = flat.run_sums(self.tokens)
        places = part.column(3).flatten().to_numpy() + np.repeat(bounds[:-1], np.diff(part.column(3).offsets.to_numpy()))
        low, high = np.maximum(places - run + 1, self.begin(places)), np.minimum(places, self.end(places) - run)
        near = np.bincount(low, minlength=len(self.tokens) + 1) - np.bincount(high + 1, minlength=len(self.tokens) + 1)
        self.starts = np.flatnonzero(np.cumsum(near) > 0)

    def begin(self, at: np.ndarray) -> np.ndarray:
        return self._bounds[self.owner[at]]

    def end(self, at: np.ndarray) -> np.ndarray:
        return self._bounds[self.owner[at] + 1]

    def hashes(self, first: np.ndarray, length: int) -> np.ndarray:
        return flat.run_hashes(self._sums, first, length)

    def token(self, at: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The token at a place, zero where the place is not inside its document."""
        return np.where(inside, np.maximum(self.tokens[np.where(inside, at, 0)], 1), 0)

    def mark(self, repeated: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Tell from bitmaps which runs several nodes hold, and which of these branch on which side."""
        keys, n = self.hashes(self.starts, self.run), len(self.tokens)
        again = bitmaps.holds(repeated, keys)
        marked = np.zeros(n + 1, np.int64)
        marked[1:][self.starts[again]] = 1
        self._counts = np.cumsum(marked)
        self.left, self.right = self.starts[again & bitmaps.holds(left, keys)], self.starts[again & bitmaps.holds(right, keys)]

    def several(self, first: np.ndarray, length: int) -> np.ndarray:
        """Where all of a run of ``length`` tokens, each with its neighbours, is held by several nodes; runs never cross documents."""
        after = first + length - self.run + 1
        inside = (first >= 0) & (after <= len(self.tokens))
        return inside & (self._counts[np.where(inside, after, 0)] - self._counts[np.where(inside, first, 0)] == length - self.run + 1)

    def weigh(self, size: int, known: np.ndarray, speaks: np.ndarray) -> None:
        """Tell from bitmaps which windows of ``size`` tokens several nodes hold, and for which of these this node speaks."""
        self.size, n = size, len(self.tokens)
        new, self._speaks = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        at = np.arange(max(0, n - size + 1))
        hashes = self.hashes(at, size)
        new[1:][at] = ~bitmaps.holds(known, hashes)
        self._speaks[1:][at] = bitmaps.holds(speaks, hashes + self.short[self.owner[at]].view(np.uint64))
        self._new, self._speaks = np.cumsum(new), np.cumsum(self._speaks)

    def taken(self, low: np.ndarray, high: np.ndarray, all_: bool = False) -> np.ndarray:
        """Where windows that begin from ``low`` to ``high`` are to be compared in parts.

        Those that several nodes hold are found as wholes, and two of these nodes speak for all, by the last of such
        windows: one may be the node that holds the other window, too. ``all_``: where any may speak.
        """
        some = low <= high
        low, high = np.where(some, low, 0), np.where(some, high, 0)
        spoken = self._speaks[high + 1] - self._speaks[low if all_ else high]
        return some & ((self._new[high + 1] > self._new[low]) | (spoken > 0))

    def around(self, at: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows that hold ``length`` tokens from ``first`` begin, first and last."""
        return np.maximum(first + length - self.size, self.begin(at)), np.minimum(first, self.end(at) - self.size)

    def behind(self, at: np.ndarray, side: int, gap: int) -> np.ndarray:
        """A hash of the run at a branch and of the token behind the gap."""
        token = self.tokens[at - gap - 1 if side else at + self.run + gap].astype(np.uint64)
        return flat.mixed(self.hashes(at, self.run) + flat.mixed(token * np.uint64(2) + np.uint64(side)))


def _run_parts(batches: Iterator[pa.RecordBatch], wanted, run: int) -> Iterator[_Runs]:
    for batch in batches:
        batch = batch.filter(pa.array(bitmaps.holds_rows(wanted.value, batch.column(0).to_numpy())))  # copies are left out
        for part in _slices(batch, 2):
            yield _Runs(part, run)


def _repeated_runs(rows: DataFrame, wanted, run: int) -> DataFrame:
    """The runs that several nodes hold (``key``), and whether the tokens before and after them differ (``left``, ``right``)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _run_parts(batches, wanted, run):
            at = runs.starts
            before, after = runs.token(at - 1, at > runs.begin(at)), runs.token(at + run, at + run < runs.end(at))
            columns = [runs.hashes(at, run).view(np.int64), runs.short[runs.owner[at]], before.astype(np.uint32).view(np.int32), after.astype(np.uint32).view(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "short", "before", "after"])

    found = rows.mapInArrow(emit, "key bigint, short bigint, before int, after int")
    differ = [(F.min(c) != F.max(c)).alias(name) for c, name in (("short", "several"), ("before", "left"), ("after", "right"))]
    return found.groupBy("key").agg(*differ).filter("several").drop("several")


def _with_several(found: DataFrame, purpose: str) -> DataFrame:
    """The rows (window, short, ...) of windows that several nodes hold, with the least and the greatest of these."""
    several = found.groupBy("window").agg(F.min("short").alias("low"), F.max("short").alias("high")).filter("low != high")
    return written(found.join(several, "window"), purpose)


def _ends(runs: _Runs, needed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of ``needed`` tokens that begin or end at a branch, with the branching run."""
    for at, first in ((runs.left, runs.left), (runs.right, runs.right + runs.run - needed)):
        some = runs.several(first, needed) & (first >= runs.begin(at))
        at, first = at[some], first[some]
        keep = runs.taken(*runs.around(at, first, needed))
        yield at[keep], first[keep]


def _gaps(runs: _Runs, needed: int, behind: np.ndarray | None = None) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Two runs of ``needed`` tokens together, with a gap, of which the longer one ends (side 0) or begins (1) at a branch.

    Gives side, gap, length of the first run, the branching runs, and where the first one begins; ``behind`` is a bitmap
    of hashes of branching runs and tokens behind the gap.
    """
    for side, every in ((0, runs.right), (1, runs.left)):
        low = np.maximum(every + runs.run - runs.size if side == 0 else every - runs.size, runs.begin(every))
        every = every[runs.taken(low, np.minimum(every, runs.end(every) - runs.size), True)]
        for gap in range(min(runs.size - needed, WIDTH) + 1):
            inside = every - gap - 1 >= runs.begin(every) if side else every + runs.run + gap < runs.end(every)
            near = every[inside]
            if behind is not None:
                near = near[bitmaps.holds(behind, runs.behind(near, side, gap))]
            for shared in range(runs.run, needed):
                left = needed - shared if side else shared
                first = near - gap - left if side else near + runs.run - left
                some = runs.several(near if side else first, shared)
                some &= (first >= runs.begin(near)) & (first + needed + gap <= runs.end(near))
                at, first = near[some], first[some]
                keep = runs.taken(*runs.around(at, first, needed + gap))
                yield side, gap, left, at[keep], first[keep]
                near = near[runs.several(near if side else near + runs.run - left, shared)]  # no longer one is a run, either


def _shared_windows(held: DataFrame, nodes: DataFrame, size: int, needed: int, run: int) -> tuple[DataFrame, DataFrame]:
    """Spans (node, start, end) of windows that are similar to windows of other nodes, and links (a, b) of these nodes."""
    context = held.sparkSession.sparkContext
    wanted = context.broadcast(bitmaps.collected(nodes, bitmaps.bit_of_row(F.col("node"))))
    rows = held.select("row", F.xxhash64("name").alias("short"), "tokens", "places")
    with passing(_repeated_runs(rows, wanted, run), "passage-runs") as repeated:
        bits = [bitmaps.collected(some, bitmaps.bit_of_long(F.col("key"))) for some in (repeated, repeated.filter("left"), repeated.filter("right"))]
    marks = context.broadcast(bits)

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _run_parts(batches, wanted, run):
            runs.mark(*marks.value)
            at = runs.starts[runs.several(runs.starts, size)]
            start = (at - runs.begin(at)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(runs.hashes(at, size).view(np.int64)), pa.array(runs.short[runs.owner[at]]), pa.array(start), pa.array(start)], names=names)

    names, kinds = ["window", "short", "first", "last"], "window bigint, short bigint, first int, last int"
    whole = _with_several(rows.mapInArrow(wholes, kinds), "passage-windows")
    two = whole.filter("short = low or short = high")
    known = context.broadcast([bitmaps.collected(whole, bitmaps.bit_of_long(F.col("window"))), bitmaps.collected(two, _sum_bit("window", "short"))])

    def seconds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _run_parts(batches, wanted, run):
            runs.mark(*marks.value)
            runs.weigh(size, *known.value)
            for (side, gap), breaks in groupby(_gaps(runs, needed), lambda found: found[:2]):
                at = np.unique(np.concatenate([found[3] for found in breaks]))
                follows = runs.tokens[at - 1 if side else at + run].view(np.int32)
                columns = [runs.behind(at, side, gap).view(np.int64), runs.short[runs.owner[at]], follows]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "short", "follows"])

    second = rows.mapInArrow(seconds, "key bigint, short bigint, follows int").groupBy("key")
    second = second.agg((F.min("short") != F.max("short")).alias("several"), (F.min("follows") != F.max("follows")).alias("differ")).filter("several and differ")
    gaps = context.broadcast(bitmaps.collected(second, bitmaps.bit_of_long(F.col("key"))))

    def broken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(runs: _Runs, at: np.ndarray, first: np.ndarray, length: int, keys: np.ndarray) -> pa.RecordBatch:
            starts = [(place - runs.begin(at)).astype(np.int32) for place in runs.around(at, first, length)]
            columns = [keys.view(np.int64), runs.short[runs.owner[at]], *starts]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for runs in _run_parts(batches, wanted, run):
            runs.mark(*marks.value)
            runs.weigh(size, *known.value)
            for at, first in _ends(runs, needed):
                yield row(runs, at, first, needed, runs.hashes(first, needed))
            for _, gap, left, at, first in _gaps(runs, needed, gaps.value):
                if len(at):
                    after = runs.hashes(first + left + gap, needed - left)
                    yield row(runs, at, first, needed + gap, flat.mixed(runs.hashes(first, left) + flat.mixed(after + np.uint64(left))))

    part = _with_several(rows.mapInArrow(broken, kinds), "passage-breaks")
    hits = whole.union(part)
    spans = hits.groupBy("short").agg(F.collect_list(F.struct("first", "last")).alias("starts")).mapInArrow(_merged(size), "short bigint, start int, end int")
    links = hits.select("short", "low").filter("short != low").distinct()
    short = nodes.select("node", "short")
    low = short.select(F.col("node").alias("b"), F.col("short").alias("low"))
    return spans.join(short, "short").select("node", "start", "end"), links.join(short, "short").join(low, "low").select(F.col("node").alias("a"), "b")


def _sum_bit(a: str, b: str) -> Column:
    """The bit of the sum of two 64-bit hashes."""
    low = F.lit(bitmaps.BITS - 1)
    return (F.col(a).bitwiseAND(low) + F.col(b).bitwiseAND(low)).bitwiseAND(low)


def _merged(size: int):
    """Spans in words of windows that begin from ``first`` to ``last``, given by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for short, starts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                first, last = (starts.values.field(k).to_numpy() for k in range(2))
                order = np.argsort(first)
                first, reach = first[order], np.maximum.accumulate(last[order])
                cuts = np.flatnonzero(first[1:] > reach[:-1] + 1)
                out += [(short, int(first[a]), int(reach[b]) + size + WIDTH - 1) for a, b in zip(np.append(0, cuts + 1), np.append(cuts, len(first) - 1), strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["short", "start", "end"])

    return run


def repeated_passages(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, hashes: int = HASHES, context: int = CONTEXT,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Every row's id with ``n_words``, ``spans`` (start and end in words, merged) that near-repeat in other documents, and the class of the document.

    ``n_repeated`` counts the words in spans; ``class_id`` is the smallest id
    that the document is linked with by passages, over any number of links.
    """
    with shuffles_removed(docs.sparkSession):
        return _repeated_passages(docs, words, percent, hashes, context, id_column, text_column)


def _laid_windows(held: DataFrame, nodes: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Spans (node, start, end) and links (a, b) by surroundings laid one upon the other, and by exact windows."""
    each = held.withColumnRenamed("row", "node").join(nodes.select("node"), "node", "left_semi").select("node", "sigs", "places", "tokens")
    places = written(each.mapInArrow(_postings(size), "sig bigint, around bigint, node bigint, place int"), "passage-places")
    same, exact = _exact(held, nodes, size)
    same = written(same, "passage-exact")
    found = _near(each, places, same, size, percent)
    ends = written(places.groupBy("around").agg(F.min("node").alias("node")), "passage-ends")
    links = found.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # All spans of one surroundings hold its place: together they are one span.
    reach = found.select("a", "low", "high").union(found.select("b", "low", "high")).groupBy(F.col("a").alias("around")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    mine = places.select("around", "node", "place").distinct().join(reach, "around")
    mine = mine.select("node", (F.col("place") + F.col("low")).alias("start"), (F.col("place") + F.col("high") + size + WIDTH - 1).alias("end"))
    return mine.union(same).distinct(), links.union(exact)


def _repeated_passages(docs: DataFrame, words: int, percent: int, hashes: int, context: int, id_column: str, text_column: str) -> DataFrame:
    size = words - WIDTH + 1
    if size < 2 * context - 2:
        raise ValueError("context must be at most half a passage")
    needed = -(-2 * size * percent // (100 + percent))
    # A word put in is in WIDTH shingles and parts one less: where a window cannot differ by both, one run has half of what is shared.
    once = size - needed < 2 * WIDTH - 1
    run_size, hashes = (-(-needed // 2), 1) if once else (size, hashes)
    context = min(context, run_size // 2 + 1)
    context_ = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    live = context_.broadcast(_live(rows, run_size, hashes, context))
    measured = written(_measured(rows, docs.schema[id_column].dataType.simpleString(), size, run_size, hashes, context, live), "passages")
    # Of equal texts one row is the node.
    held = measured.filter(F.size("sigs") > 0)
    nodes = written(held.groupBy("name").agg(F.min("row").alias("node")).withColumn("short", F.xxhash64("name")), "passage-nodes")
    mine, links = _shared_windows(held, nodes, size, needed, run_size) if once else _laid_windows(held, nodes, size, percent)
    mine = written(mine, "passage-spans")
    roots = components(links)
    selves = held.filter("again").select(F.col("row").alias("node"), "tokens")
    by_node = mine.union(_repeats_inside(mine, selves, size)).groupBy("node").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    long_ = measured.select("id", "n_words", "name").filter(F.col("n_words") >= words)
    # Equal texts in several documents repeat as a whole.
    copies = long_.groupBy("name").agg((F.min("id") != F.max("id")).alias("copied"))
    linked = nodes.join(by_node, "node", "left").join(roots, "node", "left").select("name", "spans", F.coalesce("root", "node").alias("root"))
    joined = long_.join(copies, "name").join(linked, "name", "left")
    # A text without live signatures is alone with its copies.
    joined = joined.withColumn("root", F.coalesce(F.col("root").cast("string"), F.hex("name")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))

    def grow(done, span):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))))
        return F.when(F.size(done) == 0, F.array(span)).when(span["start"] <= last["end"], joined).otherwise(F.concat(done, F.array(span)))

    spans = F.when(F.coalesce("copied", F.lit(False)), whole).otherwise(F.aggregate(F.coalesce("spans", none), none, grow))
    least = joined.groupBy("root").agg(F.min("id").alias("least"))
    answered = joined.join(least, "root").select("id", "n_words", spans.alias("spans"), F.col("least").alias("class_id"))
    short = measured.filter(F.col("n_words") < words).select("id", "n_words", none.alias("spans"), F.col("id").alias("class_id"))
    n_repeated = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return answered.union(short).select(F.col("id").alias(id_column), "n_words", n_repeated.alias("n_repeated"), "spans", "class_id")
