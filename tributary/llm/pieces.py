"""Texts cut where no piece of the vocabulary reaches across, and what is known of each cut word.

Pieces of a SentencePiece vocabulary hold the space sign at their start only. A
text may then be cut before each run of spaces, and each word encoded once,
however often it comes. ``WordTable`` keeps what words became, within a bound.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from tributary.llm import flat

SPACE = "▁"
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")
_MOST_WORDS = 300_000
_MOST_CHARS = 16 * 2**20


def cut(text: str) -> list[str]:
    """The words of a text as a model with a dummy prefix sees them, less their first space sign."""
    if not text:
        return []
    if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [word[1:] for word in _WORDS.findall(SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordTable:
    """Ids of words, encoded at their first use; emptied when it has grown too large."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self._encode = encode
        self._forget()

    def _forget(self) -> None:
        self._index: dict[str, int] = {}
        self._chars = 0
        self._ids = [np.zeros(0, np.int32)]
        self._lengths = [np.zeros(0, np.int64)]

    def ids(self, texts: flat.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and the bounds of each document's."""
        if len(self._index) > _MOST_WORDS or self._chars > _MOST_CHARS:
            self._forget()
        data, index, words, counts = texts.data.tobytes(), self._index, [], np.zeros(len(texts), np.int64)
        for i in range(len(texts)):
            found = cut(data[texts.bounds[i] : texts.bounds[i + 1]].decode("utf-8", "replace"))
            counts[i] = len(found)
            words += found
        new = [word for word in dict.fromkeys(words) if word not in index]
        if new:
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            self._chars += sum(map(len, new))
            ids, lengths = self._encode(new)
            self._ids.append(ids)
            self._lengths.append(lengths)
            self._ids, self._lengths = [np.concatenate(self._ids)], [np.concatenate(self._lengths)]
        which = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        lengths, ends = self._lengths[0], np.cumsum(self._lengths[0])
        flat_ids = self._ids[0][ragged((ends - lengths)[which], lengths[which])]
        done = np.concatenate([[0], np.cumsum(lengths[which])])
        return flat_ids, done[np.concatenate([[0], np.cumsum(counts)])]
