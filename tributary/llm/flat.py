"""Texts of an Arrow batch as flat numpy arrays: bytes, words, word hashes.

Python operators work on these arrays, a slice of documents at a time, so that
memory is bounded by a slice (and by one document, where that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 * 2**20
#: For operators that hold many arrays, or tables, beside a slice.
SMALL_SLICE_BYTES = 2**19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = {}


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_EXACT = _table(20)
_FOLDED = _EXACT.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _EXACT[ord("a") : ord("z") + 1]


def power(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0 .. n, modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) <= n:
        size = -(-(n + 1) // SMALL_SLICE_BYTES) * SMALL_SLICE_BYTES
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = known
    return known[: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that their order says nothing of their source."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


@dataclass
class Texts:
    """Some whole documents: their bytes, one after another, and where each begins and ends."""

    first: int  # index in the batch of the first document
    data: np.ndarray  # uint8
    bounds: np.ndarray  # int64, one more than there are documents

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def folded(self) -> np.ndarray:
        """The bytes with A-Z lower-cased."""
        capital = (self.data >= 65) & (self.data <= 90)
        return self.data + (capital * np.uint8(32))

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The document of each byte position."""
        return np.searchsorted(self.bounds, positions, side="right") - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of marked bytes that do not cross documents: starts, ends, and bounds of each document's runs."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self) + 1, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:n]
        closes[:-1] &= ~inside[1:] | edge[1:n]
        starts = np.flatnonzero(opens)
        return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, self.bounds)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words between white space (0x20, 0x09-0x0D)."""
        return self.runs(~IS_SPACE[self.data])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes (but for the case of A-Z, with ``fold``) give equal hashes."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _EXACT)[self.data] * power(_BASE, n)[:n], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * power(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``width`` consecutive words of a document, and the bounds of each document's."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), out_bounds
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + n]
    rolled = mixed(rolled)
    keep = np.ones(n, bool)
    for k in range(1, width):  # windows that begin less than `width` words before a document's end
        at = bounds[1:] - k
        at = at[(at >= bounds[:-1]) & (at < n)]
        keep[at] = False
    return rolled[keep], out_bounds


def run_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which ``run_hashes`` tells the hash of any run of the values."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mixed(values.astype(np.uint64)) * power(_BASE, len(values))[:-1], out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the runs of ``length`` values that begin at ``first``."""
    return mixed((sums[first + length] - sums[first]) * power(_INVERSE, len(sums) - 1)[first] + np.uint64(length))


def segment_ids(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a column, nulls as empty texts, in slices of about ``most`` bytes and one document at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1
        end = min(max(end, begin + 1), len(column))
        yield Texts(begin, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
        begin = end
