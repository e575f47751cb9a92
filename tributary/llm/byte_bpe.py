"""Byte-level BPE encoding and decoding, with the pieces cut by scans over arrays instead of a regex.

Cutting. Every code point of a slice has a class (letter, number, white space,
other), sharpened by the one or two code points after it: an apostrophe that
spells a contraction, the last blank before a word. A class is a function from
the state before a code point to the state after it. Such functions compose,
and composition is associative, so a prefix scan by doubling gives the state
at every place; all functions that the classes generate are few, and are
numbered once, so that composing is one look-up in a table. A text begins in a
known state. The scan ends as soon as no function depends on what came before
it, which takes a few code points in any text.

Merging. Pieces are byte slices. What a piece became is kept in a table of
bounded size; of a new piece the pair of least rank merges first, the leftmost
of equals, unless the whole piece is a token.

Decoding. The start of each token in its text's bytes is kept with the ids, and
the bytes of all tokens of a slice are gathered at once.

Texts stay in their partitions: no shuffle. Memory is bounded by a slice, by
the tables, and by one document (and its longest piece) where that is longer.

Defined results: a null text counts as an empty one, which has no tokens.
Bytes that are no UTF-8 count as U+FFFD. Repeated rows are encoded one by one,
whatever their ids; an empty table gives an empty table; columns other than the
id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from tributary.llm import flat
from tributary.llm.by_slice import over_texts
from tributary.llm.pieces import ragged

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
_MOST_PIECES = 300_000
_MOST_BYTES = 16 * 2**20

# Classes of code points, and what an apostrophe or white space is by its right neighbours.
LETTER, NUMBER, OTHER, SHORT, LONG, JOINING, LONE, INNER = range(8)
# States: a piece has to begin; in a run of letters, numbers, others or white space; after a joining blank; one or two letters of a contraction to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINED, IN_SPACE, ONE_MORE, TWO_MORE = range(8)
_RUN_OF = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, INNER: IN_SPACE}


def step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point, and whether a piece begins with it."""
    if state in (ONE_MORE, TWO_MORE) and kind == LETTER:  # nothing else follows there
        return (FRESH if state == ONE_MORE else ONE_MORE), False
    if kind in (SHORT, LONG):
        if state in (IN_OTHERS, JOINED):  # an apostrophe like any other sign
            return IN_OTHERS, False
        return (ONE_MORE if kind == SHORT else TWO_MORE), True
    if kind == JOINING:
        return JOINED, True
    if kind == LONE:
        return FRESH, True
    if kind == INNER:
        return IN_SPACE, state != IN_SPACE
    return _RUN_OF[kind], state not in (_RUN_OF[kind], JOINED)


class _Functions:
    """All functions of states that the classes generate, by number, and what any two of them compose to."""

    def __init__(self):
        states = range(8)
        of_class = [tuple(step(state, kind)[0] for state in states) for kind in range(8)]
        known = {f: i for i, f in enumerate(dict.fromkeys([(FRESH,) * 8, *of_class]))}
        queue = list(known)
        for f in queue:  # grows as it is read
            for g in of_class:
                both = tuple(g[state] for state in f)
                if both not in known:
                    known[both] = len(known)
                    queue.append(both)
        compose = [[known.setdefault(tuple(g[state] for state in f), len(known)) for g in queue] for f in queue]
        if len(known) != len(queue) or len(queue) > 256:
            raise AssertionError("the functions are not closed under composition")
        self.of_class = np.array([known[f] for f in of_class], np.uint8)
        self.compose = np.array(compose, np.uint8)
        self.fresh = known[(FRESH,) * 8]
        self.constant = np.array([len(set(f)) == 1 for f in queue])
        self.value = np.array([f[FRESH] for f in queue], np.uint8)
        self.begins = np.array([[step(state, kind)[1] for kind in range(8)] for state in states])


_FUNCTIONS = _Functions()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each code point whether it is a letter, a number, white space (INNER) or other, as the library's own patterns have it."""
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (INNER, r"\s+")):
        known = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = known.decode_bytes(known.encode_ordinary(points)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table


def _kinds(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The class of each code point, given those to its right in its text."""
    n = len(codes)
    kinds = _classes()[codes]
    last = np.zeros(n + 1, bool)  # the last code point of a text
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    space = kinds == INNER
    before_word = np.flatnonzero(space[:-1] & ~space[1:] & ~last[: n - 1])
    kinds[before_word] = np.where(codes[before_word] == ord(" "), JOINING, LONE)
    quotes = np.flatnonzero(codes == ord("'"))
    quotes = quotes[~last[quotes]]
    one = codes[quotes + 1]
    two = np.where(last[quotes + 1], 0, codes[np.minimum(quotes + 2, n - 1)])
    kinds[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    pairs = np.zeros(len(quotes), bool)
    for a, b in ("re", "ve", "ll"):
        pairs |= (one == ord(a)) & (two == ord(b))
    kinds[quotes[pairs]] = LONG
    return kinds


def piece_begins(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which code points begin a piece; ``bounds`` are those of the texts, in code points."""
    if not len(codes):
        return np.zeros(0, bool)
    kinds = _kinds(codes, bounds)
    firsts = bounds[:-1][np.diff(bounds) > 0]
    f = _FUNCTIONS.of_class[kinds]
    f[firsts] = _FUNCTIONS.compose[_FUNCTIONS.fresh, f[firsts]]
    reach = 1  # a function stands for this many code points, or is constant
    while len(at := np.flatnonzero(~_FUNCTIONS.constant[f])):
        f[at] = _FUNCTIONS.compose[f[at - reach], f[at]]
        reach *= 2
    before = np.empty(len(f), np.uint8)
    before[1:] = _FUNCTIONS.value[f[:-1]]
    before[firsts] = FRESH
    return _FUNCTIONS.begins[before, kinds]


def cut_pieces(texts: flat.Texts) -> tuple[flat.Texts, np.ndarray, np.ndarray]:
    """The texts in valid UTF-8, the byte at which each piece begins, and the bounds of each text's pieces."""
    data = texts.data
    if len(data) and data.max() >= 128:
        try:
            codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        except UnicodeDecodeError:
            cleaned = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(texts.bounds[:-1], texts.bounds[1:], strict=True)]
            bounds = np.concatenate([[0], np.cumsum([len(text) for text in cleaned])]).astype(np.int64)
            return cut_pieces(flat.Texts(texts.first, np.frombuffer(b"".join(cleaned), np.uint8), bounds))
        places = np.flatnonzero((data & 0xC0) != 0x80)
        begins = places[piece_begins(codes, np.searchsorted(places, texts.bounds))]
    else:
        begins = np.flatnonzero(piece_begins(data, texts.bounds))
    return texts, begins, np.searchsorted(begins, texts.bounds)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of a piece: itself if it is one, else what is left when no neighbours merge."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins here: its end (0: merged away), the part before it
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int, stop: int) -> None:
        rank = ranks.get(piece[i:stop])
        if rank is not None:
            heapq.heappush(heap, (rank, i, stop))

    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:  # a part of this pair has changed since
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            left[stop] = i
            offer(i, end[stop])
        if left[i] >= 0:
            offer(left[i], stop)
    return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]


class Codec:
    """The ranks of one file, the bytes of its tokens, and what recent pieces became."""

    def __init__(self, path: str = RANKS):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a byte has no token, so not every text can be encoded")
        tokens = dict((rank, token) for token, rank in self.ranks.items())
        self.size = max(tokens) + 1
        spelt = [tokens.get(i, b"") for i in range(self.size)]
        self._known = np.array([i in tokens for i in range(self.size)])
        self._lengths = np.array([len(token) for token in spelt], np.int64)
        self._places = np.cumsum(self._lengths) - self._lengths
        self._bytes = np.frombuffer(b"".join(spelt), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self._numbers: dict[bytes, int] = {}
        self._held = 0
        self._ids, self._counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        new = [piece for piece in dict.fromkeys(pieces) if piece not in self._numbers]
        if not new:
            return
        found = [merge(piece, self.ranks) for piece in new]
        self._numbers.update(zip(new, range(len(self._counts), len(self._counts) + len(new)), strict=True))
        self._held += sum(map(len, new))
        self._counts = np.concatenate([self._counts, np.fromiter(map(len, found), np.int64, len(found))])
        self._ids = np.concatenate([self._ids, np.array([i for ids in found for i in ids], np.int32)])

    def encode_slice(self, texts: flat.Texts) -> tuple[flat.Texts, np.ndarray, np.ndarray]:
        """The texts as encoded, all ids, and the bounds of each text's ids."""
        if len(self._numbers) > _MOST_PIECES or self._held > _MOST_BYTES:
            self._forget()
        texts, begins, bounds = cut_pieces(texts)
        data = texts.data.tobytes()
        ends = np.append(begins[1:], len(data)) if len(begins) else begins
        pieces = [data[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        self._learn(pieces)
        which = np.fromiter(map(self._numbers.__getitem__, pieces), np.int64, len(pieces))
        counts = self._counts[which]
        ids = self._ids[ragged((np.cumsum(self._counts) - self._counts)[which], counts)]
        return texts, ids, np.concatenate([[0], np.cumsum(counts)])[bounds]

    def starts(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The byte of its text at which each token begins; ``bounds`` are those of each text's ids."""
        lengths = self._lengths[ids]
        places = np.cumsum(lengths) - lengths
        sizes = np.diff(bounds)
        firsts = np.where(sizes > 0, places[np.minimum(bounds[:-1], max(len(ids) - 1, 0))] if len(ids) else 0, 0)
        return places - np.repeat(firsts, sizes)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or not self._known[ids].all()):
            raise ValueError("an id is outside the vocabulary")
        return self._bytes[ragged(self._places[ids], self._lengths[ids])].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, ranks: str = RANKS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id of each row, its token ids, and the byte of the text at which each token starts (``starts``)."""

    def arrays(texts: flat.Texts) -> list[pa.Array]:
        _, ids, bounds = codec(ranks).encode_slice(texts)
        return [_lists(ids, bounds), _lists(codec(ranks).starts(ids, bounds), bounds)]

    return over_texts(docs, id_column, text_column, {"ids": "array<int>", "starts": "array<int>"}, arrays)


def decode(encoded: DataFrame, ranks: str = RANKS, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The id of each row and the text of its token ids; null ids have a null text, bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else codec(ranks).decode_bytes(np.array(ids, np.int64)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["__id", "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    picked = encoded.select(encoded[id_column].alias("__id"), encoded[ids_column].alias("__ids"))
    return picked.mapInArrow(run, f"__id {kind}, text string").withColumnRenamed("__id", id_column)


def round_trip_digests(docs: DataFrame, ranks: str = RANKS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode each text, decode its ids, and return their number and the digests of the ids (32 bits each, low byte first) and of the decoded bytes."""

    def arrays(texts: flat.Texts) -> list[pa.Array]:
        own = codec(ranks)
        _, ids, bounds = own.encode_slice(texts)
        each = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [
            pa.array(np.diff(bounds)),
            pa.array([hashlib.sha256(part.astype("<u4").tobytes()).hexdigest() for part in each], pa.string()),
            pa.array([hashlib.sha256(own.decode_bytes(part)).hexdigest() for part in each], pa.string()),
        ]

    return over_texts(docs, id_column, text_column, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, arrays)
