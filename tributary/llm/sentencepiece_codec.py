"""SentencePiece encoding and decoding by vectorised merge rounds.

All words of a slice lie in one flat array of symbols. A round finds the rank
of every adjacent pair, the least rank in each word, and merges that pair
wherever it stands in the word, leftmost first; the array is compacted, and
words without a pair leave it. Merging one pair can make another of lower rank
that has to go first: a word where that happens merges its leftmost pair alone
in that round. So every word sees its merges in the library's own order.

Texts stay in their partitions; memory is bounded by a slice, and by a word
table of bounded size.

Defined results: a null text counts as an empty one, which encodes to the end
id alone (to nothing, without an end id). Characters outside the vocabulary
become their UTF-8 bytes. Repeated rows are encoded one by one; an empty table
gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tributary.llm import flat
from tributary.llm.pieces import SPACE, WordTable, ragged

MODEL = public_tokenizers.path("piece_bpe_32k.model")
UNKNOWN = " ⁇ "  # fixed: what the library decodes the unknown id to
_SHIFT = np.int64(21)  # a code point beyond the vocabulary stays below 2**21
_NO_PAIR = np.int64(2**40)


def _replaced(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("each-byte", _replaced)


class _PairTable:
    """Open addressing over pairs of symbols, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(8 * max(len(keys), 1)))))
        self._down, size = np.uint64(64 - bits), 2**bits
        self._mask = np.int64(size - 1)
        self._keys = np.full(size, -1, np.int64)
        self._ranks, self._merged = np.full(size, _NO_PAIR, np.int64), np.zeros(size, np.int64)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self._keys[slots[left]] == -1]
            self._keys[slots[free]] = keys[free]  # the last one of a slot's claimants stays
            placed = left[self._keys[slots[left]] == keys[left]]
            self._ranks[slots[placed]], self._merged[slots[placed]] = ranks[placed], merged[placed]
            left = left[self._keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._down).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair."""
        keys = (left << _SHIFT) | right
        slots = self._slot(keys)
        there = self._keys[slots]
        lost = np.flatnonzero((there != keys) & (there != -1))
        while len(lost):
            slots[lost] = (slots[lost] + 1) & self._mask
            there = self._keys[slots[lost]]
            lost = lost[(there != keys[lost]) & (there != -1)]
        hit = self._keys[slots] == keys
        return np.where(hit, self._ranks[slots], _NO_PAIR), self._merged[slots]


class Codec:
    """One model's tables: symbols of characters, ranks of pairs, bytes and digits of ids."""

    def __init__(self, model: str = MODEL):
        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        size = processor.vocab_size()
        pieces = [processor.id_to_piece(i) for i in range(size)]
        special = [processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i) for i in range(size)]
        normal = {piece: i for i, piece in enumerate(pieces) if not special[i]}
        if any(SPACE in piece.lstrip(SPACE) for piece in normal):
            raise ValueError("the vocabulary has pieces that reach across words")
        self.size, self.end_id = size, processor.eos_id()
        self._is_control = np.array([processor.is_control(i) for i in range(size)])
        self._byte_ids = np.array([processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self._char_symbol = {ord(piece): i for piece, i in normal.items() if len(piece) == 1}

        def symbol(part: str) -> int:
            found = normal.get(part)
            return found if found is not None else size + ord(part) if len(part) == 1 else -1

        ranks = {score: rank for rank, score in enumerate(sorted({processor.get_score(i) for i in normal.values()}, reverse=True))}
        pairs = [
            (left << int(_SHIFT) | right, ranks[processor.get_score(i)], i)
            for piece, i in normal.items()
            for k in range(1, len(piece))
            if (left := symbol(piece[:k])) >= 0 and (right := symbol(piece[k:])) >= 0
        ]
        self._pairs = _PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T.copy())

        surfaces = [
            bytes([int(piece[1:-1], 16)]) if processor.is_byte(i)
            else b"" if processor.is_control(i)
            else UNKNOWN.encode() if processor.is_unknown(i)
            else piece.replace(SPACE, " ").encode()
            for i, piece in enumerate(pieces)
        ]
        self._surface, self._surface_at, self._surface_len = self._table(surfaces)
        self._digits, self._digits_at, self._digits_len = self._table([b"%d " % i for i in range(size)])
        self._spaced = np.array([piece.startswith(SPACE) for piece in pieces]) & ~np.array(special)

    @staticmethod
    def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(s) for s in strings], np.int64)
        return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths, lengths

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all characters, and the word of each."""
        text = "".join([SPACE + word for word in words])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        kinds, where = np.unique(codes, return_inverse=True)
        known = np.array([self._char_symbol.get(int(code), self.size + int(code)) for code in kinds], np.int64)
        return known[where], np.repeat(np.arange(len(words)), [len(word) + 1 for word in words])

    def _round(self, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pairs merge in this round, what they become, and which words have no pair left."""
        n = len(symbols)
        ranks, merged = np.full(n, _NO_PAIR, np.int64), np.zeros(n, np.int64)
        inner = np.flatnonzero(words[1:] == words[:-1])
        ranks[inner], merged[inner] = self._pairs.find(symbols[inner], symbols[inner + 1])
        begins = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        least = np.minimum.reduceat(ranks, begins)
        sizes = np.diff(np.append(begins, n))
        least_here = np.repeat(least, sizes)
        done = least_here == _NO_PAIR
        at = np.flatnonzero((ranks == least_here) & ~done)
        if not len(at):
            return at, merged, done
        # Of overlapping places take the first, the third, ...
        run = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(at) > 1]), np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        many = np.flatnonzero((np.diff(words[at], prepend=-1) == 0) | (np.diff(words[at], append=-1) == 0))
        if len(many):
            at = np.delete(at, self._too_early(symbols, words, merged, least_here, at, many))
        return at, merged, done

    def _too_early(self, symbols, words, merged, least_here, at, many) -> np.ndarray:
        """Indices into ``at`` of merges that have to wait, in words with several."""
        here = at[many]
        new = merged[here]
        after = np.minimum(here + 2, len(symbols) - 1)
        rank_after, _ = self._pairs.find(new, symbols[after])
        rank_after[(here + 2 >= len(symbols)) | (words[after] != words[here])] = _NO_PAIR
        before = np.maximum(here - 1, 0)
        joined = np.isin(here - 2, here)  # the symbol before is itself part of a merge
        left = np.where(joined, merged[np.maximum(here - 2, 0)], symbols[before])
        rank_before, _ = self._pairs.find(left, new)
        rank_before[(here == 0) | (words[before] != words[here])] = _NO_PAIR
        unsafe = np.minimum(rank_after, rank_before) <= least_here[here]
        bad_words = np.unique(words[here[unsafe]])
        first = np.concatenate([[True], words[here][1:] != words[here][:-1]])
        return many[~first & np.isin(words[here], bad_words)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each with one space sign before it, and how many each has."""
        symbols, owner = self._symbols(words)
        done_symbols, done_owner = [], []
        while len(symbols):
            at, merged, done = self._round(symbols, owner)
            done_symbols.append(symbols[done])
            done_owner.append(owner[done])
            keep = ~done
            symbols[at] = merged[at]
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        symbols, owner = self._as_bytes(symbols[order], owner[order])
        return symbols.astype(np.int32), np.bincount(owner, minlength=len(words))

    def _as_bytes(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary as ids of their bytes."""
        foreign = np.flatnonzero(symbols >= self.size)
        if not len(foreign):
            return symbols, owner
        kinds, where = np.unique(symbols[foreign] - self.size, return_inverse=True)
        spelt = [chr(int(code)).encode("utf-8", "replace") for code in kinds]
        blob, starts, lengths = self._table(spelt)
        times = np.ones(len(symbols), np.int64)
        times[foreign] = lengths[where]
        out, marks = np.repeat(symbols, times), np.repeat(symbols >= self.size, times)
        out[marks] = self._byte_ids[blob[ragged(starts[where], lengths[where])]]
        return out, np.repeat(owner, times)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The text of ids, in UTF-8."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside the vocabulary")
        data = self._surface[ragged(self._surface_at[ids], self._surface_len[ids])].tobytes()
        shown = np.flatnonzero(~self._is_control[ids])
        if len(shown) and self._spaced[ids[shown[0]]]:
            data = data[1:]
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            return data.decode("utf-8", "each-byte").encode()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.array(ids, np.int64)).decode()

    def digits(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, one space between them."""
        return self._digits[ragged(self._digits_at[ids], self._digits_len[ids])].tobytes()[:-1]


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    return Codec(model)


@lru_cache(maxsize=2)
def _words(model: str) -> WordTable:
    return WordTable(codec(model).encode_words)


def encode_slice(texts: flat.Texts, model: str, end: bool) -> list[np.ndarray]:
    """The ids of each document of a slice."""
    ids, bounds = _words(model).ids(texts)
    last = np.array([codec(model).end_id] if end else [], np.int32)
    return [np.concatenate([ids[bounds[i] : bounds[i + 1]], last]) for i in range(len(texts))]


def _over_texts(df: DataFrame, id_column: str, text_column: str, columns: dict[str, tuple[pa.DataType, str]], rows) -> DataFrame:
    """``rows(texts)`` gives the values of each column for a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in flat.slices(batch.column(1), flat.SMALL_SLICE_BYTES):
                values = rows(texts)
                ids = batch.column(0).slice(texts.first, len(texts))
                arrays = [pa.array(v, kind) for v, (kind, _) in zip(values, columns.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *arrays], names=["id", *columns])

    kind = df.schema[id_column].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{name} {sql}" for name, (_, sql) in columns.items())])
    picked = df.select(df[id_column].alias("id"), df[text_column].cast("string").alias("text"))
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def encode(docs: DataFrame, model: str = MODEL, end: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and the token ids (``ids``) of each row's text."""
    return _over_texts(docs, id_column, text_column, {"ids": (pa.list_(pa.int32()), "array<int>")}, lambda texts: [encode_slice(texts, model, end)])


def decode(encoded: DataFrame, model: str = MODEL, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The id and the text that each row's ids stand for; null ids have a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else codec(model).decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    picked = encoded.select(encoded[id_column].alias("id"), encoded[ids_column].alias("ids"))
    return picked.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)


def round_trip_digests(docs: DataFrame, model: str = MODEL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode each text, decode its ids, and return the number of ids and the digests of ids and of decoded text."""

    def rows(texts: flat.Texts) -> list[list]:
        own, out = codec(model), ([], [], [])
        for ids in encode_slice(texts, model, end=True):
            out[0].append(len(ids))
            out[1].append(hashlib.sha256(own.digits(ids)).hexdigest())
            out[2].append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
        return list(out)

    columns = {"n_tokens": (pa.int64(), "bigint"), "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string")}
    return _over_texts(docs, id_column, text_column, columns, rows)


def encode_with_digest(docs: DataFrame, model: str = MODEL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, the number of ids, the ids (end id included), and the digest of the text that they decode to."""

    def rows(texts: flat.Texts) -> list[list]:
        found = encode_slice(texts, model, end=True)
        return [[len(ids) for ids in found], found, [hashlib.sha256(codec(model).decode_bytes(ids)).hexdigest() for ids in found]]

    columns = {"n_tokens": (pa.int64(), "bigint"), "ids": (pa.list_(pa.int32()), "array<int>"), "decoded_sha256": (pa.string(), "string")}
    return _over_texts(docs, id_column, text_column, columns, rows)
