"""Exact Jaccard join on word n-grams, by prefixes of token combinations.

A document is the set of its shingles. All sets are ordered alike, rare tokens
first, by hash among themselves, then frequent ones by rising frequency. Two
sets that are similar enough share a signature in their prefixes: one rare
token, or two frequent tokens of one class. A prefix is therefore extended,
beyond the usual length, until

    rare tokens + sum over classes of (frequent tokens of the class - 1)

exceeds the number of tokens that may differ. There are more classes for
longer documents, so the combinations of a document stay in proportion to its
length; documents near the edge of two length ranges have signatures in both.

How frequent a token is comes from tables of counters over all documents: of
shingles, and of words, whose frequencies tell how often a shingle of them
comes by chance. A token is frequent if either is high. The tables' sizes are
fixed, tokens share counters: any counts give a right join, since all documents
see the same; better ones only give fewer candidates.

Equal sets become one node first. Of the nodes under a signature, one with
least rare tokens is compared with all others; the links so found give
components, and only nodes in different components are then compared with each
other, a pair once if it shares one of the first signatures of both. Length and position bounds come before every comparison, and a bound by
parity sketches: the bits in which two sketches differ are at most as many as
the tokens that only one set has. Comparisons are exact, on 64-bit hashes of
shingles.

What the driver handles is of fixed size: the counters (5 MB) and bitmaps of
signatures that more than one document has and of nodes in pairs (8 MB each).
None decides a result. Sets are read from the texts again, for nodes in pairs.
Texts and pairs of sets reach Python in batches of some MB, however long they are.

Defined results: rows are the documents, so rows that share an id are linked
only if their texts are. A null or wordless text has an empty set, is linked
with nothing, and is its own component. A component's id is the smallest
non-null id in it, else null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm import bitmaps, flat
from tributary.llm.columns import shuffles_removed, small_batches, written
from tributary.llm.components import components

WIDTH = 5
PERCENT = 80
COUNTERS = 2**20
WORD_COUNTERS = 2**18
#: A shingle that chance alone makes more often than this counts as frequent.
BY_CHANCE = 0.05
_CHUNK = 2**10
#: Fewest bits of a parity sketch; larger sets have more, at least one for each token.
SKETCH_BITS = 256
#: Signatures that each posting carries, so that a pair which shares some of them comes out once.
FIRSTS = 8
_CLASS_OF = np.uint64(0x8CB92BA72F3D8DD7)


def _hashes(texts: flat.Texts) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, words = texts.words()
    return texts.hashes(starts, ends, fold=True), words


def shingle_sets(texts: flat.Texts, width: int, logs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct shingles of each document, by hash, and the bounds of each set; short texts are one shingle.

    With ``logs``, of the words' shares by counter, also the sum over each shingle's words.
    """
    hashes, words = _hashes(texts)
    grams, bounds = flat.shingles(hashes, words, width)
    owner = flat.segment_ids(bounds)
    chance = None
    if logs is not None:
        sums = np.concatenate([[0], np.cumsum(logs[_word_counter(hashes)], dtype=np.float64)])
        begin = np.arange(len(grams)) - bounds[owner] + words[owner] if len(grams) else np.zeros(0, np.int64)
        # Rounded, so that the order of summing does not show.
        chance = np.round(sums[begin + width] - sums[begin], 3)
    counts = np.diff(words)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = []
        for i in short:
            h = np.zeros(1, np.uint64)
            for word in hashes[words[i] : words[i + 1]]:
                h = flat.mixed(h * np.uint64(3) + word)
            whole.append(h + np.uint64(counts[i]))
        grams, owner = np.concatenate([grams, *whole]), np.concatenate([owner, short])
        chance = None if chance is None else np.concatenate([chance, np.full(len(short), -np.inf)])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(texts) + 1)), None if chance is None else chance[order][new]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def node_names(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128-bit names of sets, a row of bytes each: equal sets have equal names."""
    pair = np.stack([_sums(flat.mixed(grams * np.uint64(5)), bounds), _sums(flat.mixed(grams ^ _CLASS_OF), bounds)], axis=1)
    return flat.mixed(pair).view(np.uint8)


def parity_sketch(grams: np.ndarray) -> np.ndarray:
    """A bit for each residue of the tokens, set if an odd number of them has it, packed into bytes."""
    size = max(SKETCH_BITS, 1 << len(grams).bit_length())
    odd = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def mark(sketch: np.ndarray) -> np.ndarray:
    """A sketch folded to the fewest bits, as 64-bit values: of one size for all sets, so that postings of long documents stay short."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, SKETCH_BITS // 8), axis=0).view(np.int64)


def least_difference(left: np.ndarray, right: np.ndarray) -> int:
    """A lower bound of the tokens that two sets do not share, by their sketches: each such token turns one bit."""
    size = min(len(left), len(right))
    folded = [np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0) for sketch in (left, right)]
    return int(np.bitwise_count(folded[0] ^ folded[1]).sum())


def _counter(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(44)).astype(np.int64)  # 20 bits: COUNTERS


def _word_counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)  # 18 bits: WORD_COUNTERS


def frequent_from(counters: np.ndarray) -> float:
    """Counts above this stand out from what chance puts into one counter."""
    mean = counters.mean()
    return mean + 4 * np.sqrt(mean) + 2


class Signer:
    """Signatures of sets under one table of counters: of shingles, then of words."""

    def __init__(self, counters: np.ndarray, percent: int):
        self._counters, self._percent = counters[:COUNTERS], percent
        self._frequent = frequent_from(self._counters)
        words = np.maximum(counters[COUNTERS:].astype(np.float64), 1)
        self._logs = np.log(words / words.sum())
        self._most = np.log(BY_CHANCE / words.sum())

    def sets(self, texts: flat.Texts, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sets, their bounds, and which tokens chance makes frequent."""
        grams, bounds, chance = shingle_sets(texts, width, self._logs)
        return grams, bounds, chance > self._most

    def _needed(self, n: int) -> int:
        """Tokens of a set of n that must be looked at: one more than may be missing."""
        return n - (self._percent * n + 99) // 100 + 1

    def of(self, grams: np.ndarray, by_chance: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Signatures of one set, a place for each that bounds the overlap, and the number of rare tokens."""
        n = len(grams)
        if not n:
            return grams, np.zeros(0, np.int64), 0
        counts = self._counters[_counter(grams)]
        common = (counts > self._frequent) | by_chance
        rare = grams[~common]
        needed = self._needed(n)
        singles = rare[:needed]
        places = np.arange(len(singles))
        if len(rare) >= needed:
            return singles, places, len(rare)
        order = np.argsort(counts[common], kind="stable")
        frequent = grams[common][order]
        signatures = [singles]
        low, high = (self._percent * n + 99) // 100, 100 * n // self._percent
        for length in range(int(low).bit_length() - 1, int(high).bit_length()):
            signatures.append(self._pairs(frequent, length, needed - len(rare)))
        pairs = np.concatenate(signatures[1:])
        return np.concatenate([singles, pairs]), np.concatenate([places, np.full(len(pairs), len(rare))]), len(rare)

    @staticmethod
    def _pairs(frequent: np.ndarray, length: int, excess: int) -> np.ndarray:
        """Combinations of two frequent tokens of one class, in as long a prefix as has ``excess`` tokens beyond the first of their class."""
        classes = max(1, 2**length // 64)
        group = (flat.mixed(frequent ^ np.uint64(length)) % np.uint64(classes)).astype(np.int64)
        later = np.ones(len(frequent), bool)
        later[np.unique(group, return_index=True)[1]] = False
        enough = np.flatnonzero(np.cumsum(later) >= excess)
        size = int(enough[0]) + 1 if len(enough) else len(frequent)
        frequent, group = frequent[:size], group[:size]
        order = np.lexsort((frequent, group))
        frequent, group = frequent[order], group[order]
        found, distance = [np.zeros(0, np.uint64)], 1
        while distance < size:
            same = group[distance:] == group[:-distance]
            if not same.any():
                break
            first, second = frequent[:-distance][same], frequent[distance:][same]
            found.append(flat.mixed(flat.mixed(first + np.uint64(length)) * np.uint64(7) + second))
            distance += 1
        return np.concatenate(found)


def _id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _measured(rows: DataFrame, width: int, id_type: str) -> DataFrame:
    """One row for each document (its id, set size and node), and chunks of each task's counters."""
    schema = f"id {id_type}, n bigint, node binary, chunk int, counts binary, task int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counters, any_rows, id_kind = np.zeros(COUNTERS + WORD_COUNTERS, np.uint32), False, None
        for batch in batches:
            any_rows, id_kind = True, batch.schema.field(0).type
            for texts in flat.slices(batch.column(1), flat.SMALL_SLICE_BYTES):
                grams, bounds, _ = shingle_sets(texts, width)
                counters[:COUNTERS] += np.bincount(_counter(grams), minlength=COUNTERS).astype(np.uint32)
                counters[COUNTERS:] += np.bincount(_word_counter(_hashes(texts)[0]), minlength=WORD_COUNTERS).astype(np.uint32)
                k = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, k), pa.array(np.diff(bounds)), bitmaps.as_binary(node_names(grams, bounds)),
                        pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32()),
                    ],
                    names=["id", "n", "node", "chunk", "counts", "task"],
                )
        if any_rows:
            chunks = counters.reshape(-1, _CHUNK)
            k, task = len(chunks), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(k, id_kind), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()),
                    pa.array(np.arange(k), pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary()), pa.array([task] * k, pa.int32()),
                ],
                names=["id", "n", "node", "chunk", "counts", "task"],
            )

    return rows.mapInArrow(run, schema)


def _counters(measured: DataFrame) -> np.ndarray:
    """The sum of all tasks' counters: a few hundred tasks' chunks are summed at a time."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_CHUNK, np.uint64)
        for counts in pdf["counts"]:
            total += np.frombuffer(counts, np.uint32)
        most = np.iinfo(np.uint32).max
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "part": [pdf["part"].iloc[0]], "counts": [np.minimum(total, most).astype(np.uint32).tobytes()]})

    schema = "chunk int, part int, counts binary"
    chunks = measured.filter(F.col("chunk").isNotNull())
    some = chunks.select("chunk", (F.col("task") / 256).cast("int").alias("part"), "counts").groupBy("chunk", "part").applyInPandas(add, schema)
    whole = some.select("chunk", F.lit(0).alias("part"), "counts").groupBy("chunk").applyInPandas(add, schema)
    total = np.zeros(COUNTERS + WORD_COUNTERS, np.uint32)
    for row in whole.collect():  # as many in all, whatever the input
        total[row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = np.frombuffer(row["counts"], np.uint32)
    return total


def _live(rows: DataFrame, width: int, percent: int, counters) -> np.ndarray:
    """A bitmap of the signatures that more than one node has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(counters.value, percent)
        for batch in batches:
            for texts in flat.slices(batch.column(1), flat.SMALL_SLICE_BYTES):
                grams, bounds, by_chance = signer.sets(texts, width)
                found = [signer.of(grams[a:b], by_chance[a:b])[0] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                sizes = np.array([len(f) for f in found], np.int64)
                names = np.repeat(node_names(grams, bounds)[:, :8].copy().view(np.int64)[:, 0], sizes)
                signatures = np.concatenate([np.zeros(0, np.uint64), *found])
                yield pa.RecordBatch.from_arrays([pa.array(signatures.view(np.int64)), pa.array(names)], names=["sig", "name"])

    signed = rows.mapInArrow(run, "sig bigint, name bigint")
    several = signed.groupBy("sig").agg(F.min("name").alias("low"), F.max("name").alias("high")).filter("low != high")
    return bitmaps.collected(several, bitmaps.bit_of_long(F.col("sig")))


def _nodes(rows: DataFrame, width: int, percent: int, counters, live) -> DataFrame:
    """Nodes with a live signature: size, rare tokens, signatures and their places, a parity sketch and its mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(counters.value, percent)
        for batch in batches:
            for texts in flat.slices(batch.column(1), flat.SMALL_SLICE_BYTES):
                grams, bounds, by_chance = signer.sets(texts, width)
                names, out, at = node_names(grams, bounds), [], []
                for i in range(len(texts)):
                    own = grams[bounds[i] : bounds[i + 1]]
                    signatures, places, rare = signer.of(own, by_chance[bounds[i] : bounds[i + 1]])
                    held = bitmaps.holds(live.value, signatures)
                    if held.any():
                        sketch = parity_sketch(own)
                        out.append((len(own), rare, signatures[held].view(np.int64), places[held], sketch.tobytes(), mark(sketch)))
                        at.append(i)
                if out:
                    kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()))
                    arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([bitmaps.as_binary(names[at]), *arrays], names=["node", "n", "rare", "sigs", "places", "sketch", "mark"])

    schema = "node binary, n int, rare int, sigs array<bigint>, places array<int>, sketch binary, mark array<bigint>"
    return rows.mapInArrow(run, schema).dropDuplicates(["node"])


def _sets(rows: DataFrame, width: int, pairs: DataFrame) -> DataFrame:
    """The sets of the nodes in the pairs, and of a few others."""
    names = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    wanted = rows.sparkSession.sparkContext.broadcast(bitmaps.collected(names, bitmaps.bit_of_name(F.col("node"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in flat.slices(batch.column(1), flat.SMALL_SLICE_BYTES):
                grams, bounds, _ = shingle_sets(texts, width)
                names = node_names(grams, bounds)
                at = np.flatnonzero(bitmaps.holds_names(wanted.value, names))
                if len(at):
                    own = [grams[bounds[i] : bounds[i + 1]].tobytes() for i in at]
                    yield pa.RecordBatch.from_arrays([bitmaps.as_binary(names[at]), pa.array(own, pa.binary())], names=["node", "grams"])

    return rows.mapInArrow(run, "node binary, grams binary").dropDuplicates(["node"])


def _near_enough(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches do not tell that too many tokens differ."""
    first = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("left"))
    second = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, left, right in zip(batch.column(2).to_numpy(), batch.column(3), batch.column(4), strict=True):
                differ = least_difference(np.frombuffer(left.as_buffer(), np.uint8), np.frombuffer(right.as_buffer(), np.uint8))
                keep.append((100 + percent) * differ <= (100 - percent) * int(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(first, "a").join(second, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "left", "right")
    return both.mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    sets = written(_sets(rows, width, pairs), "sets")
    first = sets.select(F.col("node").alias("a"), F.col("grams").alias("left"))
    second = sets.select(F.col("node").alias("b"), F.col("grams").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(second, "b").join(first, "a").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a binary, b binary")


def _possible(percent: int, x: str, y: str):
    """Length and position bounds for two postings."""
    n_x, n_y = F.col(f"{x}.n"), F.col(f"{y}.n")
    most = F.least(n_x - F.col(f"{x}.place"), n_y - F.col(f"{y}.place"))
    return (100 * F.least(n_x, n_y) >= percent * F.greatest(n_x, n_y)) & ((100 + percent) * most >= percent * (n_x + n_y))


def _differing(x: Column, y: Column) -> Column:
    """``least_difference`` of two marks."""
    return sum(F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(SKETCH_BITS // 64))


def _with_firsts(postings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Postings, each with its node's mark and first signatures by place, an order that is the same for all nodes."""
    places = F.sort_array(F.collect_list(F.struct("place", "sig")))
    whole = postings.groupBy("node", "n", "root").agg(places.alias("places"))
    whole = whole.withColumn("firsts", F.transform(F.slice("places", 1, FIRSTS), lambda p: p["sig"]))
    whole = whole.join(nodes.select("node", "mark"), "node")
    return whole.select("node", "n", "root", "mark", "firsts", F.explode("places").alias("p")).select("node", "n", "root", "mark", "firsts", "p.sig", "p.place")


def linked_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row's id, the size of its set (``n_shingles``) and the smallest id it is linked with, over any number of links (``component_id``).

    Sets are linked if 100 * intersection >= percent * union.
    """
    with shuffles_removed(docs.sparkSession), small_batches(docs.sparkSession):
        return _linked_classes(docs, width, percent, id_column, text_column)


def _linked_classes(docs: DataFrame, width: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    if not 50 < percent <= 100 or width < 1:
        raise ValueError("percent must be over 50 and at most 100, width at least 1")
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    measured = written(_measured(rows, width, _id_type(docs, id_column)), "shingle-sets")
    counters = context.broadcast(_counters(measured))
    live = context.broadcast(_live(rows, width, percent, counters))
    nodes = written(_nodes(rows, width, percent, counters, live), "shingle-nodes")
    postings = nodes.select("node", "n", "rare", F.explode(F.arrays_zip("sigs", "places")).alias("x")).select("node", "n", "rare", F.col("x.sigs").alias("sig"), F.col("x.places").alias("place"))

    # One node under each signature, with few tokens of its own, against all others.
    centre = postings.groupBy("sig").agg(F.min(F.struct("rare", "node", "n", "place")).alias("c"))
    centre = centre.select("sig", F.col("c.node").alias("node"), F.col("c.n").alias("n"), F.col("c.place").alias("place"))
    near = postings.alias("x").join(centre.alias("y"), "sig").filter((F.col("x.node") != F.col("y.node")) & _possible(percent, "x", "y"))
    near = near.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    tried = written(_near_enough(near, nodes, percent), "pairs")
    links = written(_verified(tried, rows, width, percent), "links")

    # Then those that are not yet in one component.
    roots = components(links)
    placed = nodes.select("node", "n", "sigs", "places").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "shingle-nodes").select("node", "n", "root", F.explode(F.arrays_zip("sigs", "places")).alias("x"))
    placed = placed.select("node", "n", "root", F.col("x.sigs").alias("sig"), F.col("x.places").alias("place"))
    open_ = placed.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("sig")
    rest = _with_firsts(placed.join(open_, "sig", "left_semi"), nodes)
    rest = written(rest, "postings")
    # A pair comes out under the first signature that both have, if that is among the first of both; else under each.
    first = F.coalesce(F.get(F.array_intersect("x.firsts", "y.firsts"), F.lit(0)) == F.col("x.sig"), F.lit(True))
    # Of a large group of near copies below the threshold, marks reject most pairs before they become rows.
    near = (100 + percent) * _differing(F.col("x.mark"), F.col("y.mark")) <= (100 - percent) * (F.col("x.n") + F.col("y.n"))
    cross = rest.alias("x").join(rest.alias("y"), "sig").filter((F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _possible(percent, "x", "y") & first & near)
    cross = cross.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    new = written(_near_enough(cross, nodes, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    if not new.isEmpty():
        roots = components(links.union(written(_verified(new, rows, width, percent), "links")))

    rows = measured.filter(F.col("chunk").isNull()).select("id", "n", "node")
    held = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    full = held.filter("n > 0")
    least = full.groupBy("root").agg(F.min("id").alias("least"))
    return (
        full.join(least, "root").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
        .union(held.filter("n = 0").select("id", "n", "id"))
    )
