"""Periodic runs: passages that repeat themselves word for word, found by dyadic square catching.

A run is a stretch of consecutive words with smallest period q, at least
``least_power`` periods and ``least_length`` words long, that no neighbouring
word extends. Of each run the first period may be kept and the rest dropped.

Catching. Whenever a block of 2**k words, at a multiple of 2**k, is complete, a
catcher is set on it. It watches the words appended from 2**k to 2**(k+1) - 1
words after the block: when the last 2**k words equal the block, at distance p,
the words between repeat with period p. At each level one catcher watches each
appended word, so all of them make n comparisons a level and n log n in all. A
stretch of period q, 2**k <= q < 2**(k+1), and of three periods holds a block of
level k together with its next copy, so no run escapes. The suffixes that are
compared are hashes, made for level k + 1 from two of level k; what a word
brings about depends on the words before it alone, so all words of a slice's
documents take a level's step at once.

Merging. Catches of one distance on neighbouring blocks belong to one stretch,
whose ends are then found by comparing words. That comparison decides: a chance
equality of hashes yields no run. A catch inside a run of a lower level has a
multiple of its period and is dropped.

Texts stay in their partitions: no shuffle. Memory is bounded by a slice, and
by one document where that is longer; documents leave the levels that are too
long for them.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``. A null, an empty or a blank
text has no words, no runs and an empty collapsed text. Repeated rows are
searched one by one, whatever their ids; an empty table gives an empty table;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm import flat
from tributary.llm.by_slice import over_texts
from tributary.llm.pieces import ragged

LEAST_LENGTH = 24
LEAST_POWER = 3
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_FAR = np.uint64(0xA24BAED4963EE407)
_LONG_WORD = 512  # bytes; the rolling hash tells shorter words apart, whatever their pattern


def word_keys(texts: flat.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit key of each word, where words begin and end, and the bounds of each text's words."""
    starts, ends, bounds = texts.words()
    keys = texts.hashes(starts, ends)
    for i in np.flatnonzero(ends - starts >= _LONG_WORD):
        keys[i] = int.from_bytes(hashlib.blake2b(texts.data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return keys, starts, ends, bounds


class _Known:
    """Runs found at lower levels: does one of them cover a stretch?"""

    def __init__(self):
        self.rows: list[tuple[int, int, int]] = []  # start, end, period
        self._starts, self._reach = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, found: list[tuple[int, int, int]]) -> None:
        if found:
            self.rows += found
            rows = np.array(sorted(self.rows), np.int64)
            self._starts, self._reach = rows[:, 0], np.maximum.accumulate(rows[:, 1])

    def covers(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not self.rows:
            return np.zeros(len(starts), bool)
        before = np.searchsorted(self._starts, starts, side="right") - 1
        return (before >= 0) & (self._reach[np.maximum(before, 0)] >= ends)


def _catches(suffixes: np.ndarray, order: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words at which the last ``size`` words equal the watched block, and the distance; ``order`` numbers a text's words from 0."""
    distance = size + (order + 1) % size
    at = np.flatnonzero(order + 1 >= 2 * size)
    at = at[suffixes[at] == suffixes[at - distance[at]]]
    return at, distance[at]


def _stretches(at: np.ndarray, distance: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Catches on neighbouring blocks joined: first and last word that repeat the word ``distance`` before them."""
    by = np.lexsort((at, distance))
    at, distance = at[by], distance[by]
    new = np.ones(len(at), bool)
    new[1:] = (distance[1:] != distance[:-1]) | (at[1:] - at[:-1] != size)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return at[first] - size + 1, at[last], distance[first]


def _equal_stretches(keys: np.ndarray, low: int, high: int, period: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Maximal stretches of words in low .. high - 1 that repeat the word a period before, ``least`` or more of them, with that first period."""
    same = np.concatenate([[False], keys[low:high] == keys[low - period : high - period], [False]])
    turns = np.flatnonzero(same[1:] != same[:-1])
    for begin, end in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        if end - begin >= least:
            yield low + begin - period, low + end, period


def find_runs(keys: np.ndarray, bounds: np.ndarray, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> np.ndarray:
    """Rows of document, start (in the document), length and period, by document, start, period; ``bounds`` are those of each document's keys."""
    if least_power < 3:
        raise ValueError("catchers find stretches of three periods and more")
    counts, known = np.diff(bounds), _Known()
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.arange(len(keys)) - bounds[owner]
    place, suffixes, size = np.arange(len(keys)), flat.mixed(keys), 1
    while True:
        stay = counts[owner] >= max(least_length, least_power * size)
        owner, order, place, suffixes = owner[stay], order[stay], place[stay], suffixes[stay]
        if not len(place):
            break
        first, last, period = _stretches(*_catches(suffixes, order, size), size)
        needed = np.maximum(least_length, least_power * period)
        enough = last - first + 1 + period + 2 * (size - 1) >= needed
        first, last, period = place[first[enough]], place[last[enough]], period[enough]
        open_ = ~known.covers(first - period, last + 1)
        found = set()
        for a, b, p in zip(first[open_].tolist(), last[open_].tolist(), period[open_].tolist(), strict=True):
            doc = int(np.searchsorted(bounds, a, side="right")) - 1
            low, high = max(a - size + 1, int(bounds[doc]) + p), min(b + size, int(bounds[doc + 1]))
            found.update(_equal_stretches(keys, low, high, p, max(least_length, least_power * p) - p))
        known.add(sorted(found))
        whole = order + 1 >= 2 * size
        longer = suffixes.copy()
        longer[whole] = flat.mixed(suffixes[np.flatnonzero(whole) - size] * _FAR + suffixes[whole])
        suffixes, size = longer, 2 * size
    rows = np.array([(start, end - start, period) for start, end, period in known.rows], np.int64).reshape(-1, 3)
    docs = np.searchsorted(bounds, rows[:, 0], side="right") - 1
    rows = np.column_stack([docs, rows[:, 0] - bounds[docs], rows[:, 1], rows[:, 2]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _collapsed(texts: flat.Texts, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, runs: np.ndarray) -> list[bytes]:
    """Each text's words, but for those that a run repeats, with one space between them."""
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, bounds[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(depth, bounds[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    sizes = (ends - starts)[kept] + 1  # with a space after the word
    after = np.concatenate([[0], np.cumsum(sizes)])
    out = np.append(texts.data, np.uint8(0x20))[ragged(starts[kept], sizes)]
    out[after[1:] - 1] = 0x20
    data, of_text = out.tobytes(), after[np.searchsorted(kept, bounds)]
    return [data[a : max(a, b - 1)] for a, b in zip(of_text[:-1].tolist(), of_text[1:].tolist(), strict=True)]


def periodic_runs(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The id of each row, its number of words, its runs by start and period, and its text without what runs repeat (``collapsed``)."""

    def arrays(texts: flat.Texts) -> list[pa.Array]:
        keys, starts, ends, bounds = word_keys(texts)
        runs = find_runs(keys, bounds, least_length, least_power)
        each: list[list[dict[str, int]]] = [[] for _ in range(len(texts))]
        for doc, start, length, period in runs.tolist():
            each[doc].append({"start": start, "length": length, "period": period})
        collapsed = pa.array(_collapsed(texts, starts, ends, bounds, runs), pa.binary()).view(pa.string())
        return [pa.array(np.diff(bounds)), pa.array(each, RUN_TYPE), collapsed]

    columns = {"n_words": "bigint", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}
    return over_texts(docs, id_column, text_column, columns, arrays)


def strongest(runs: Column) -> Column:
    """Of runs by start and period the first with the greatest length / period, compared exactly; null if there are none."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, run: F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best))
