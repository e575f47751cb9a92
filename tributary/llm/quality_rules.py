"""Quality rules: how well public tokenisers fit a text, beside plain counts.

A text in a language that a vocabulary knows takes few tokens, few of them
byte fallbacks, and uses many different ones. Noise, encoded data and endless
repetition do not. Two vocabularies measure each text: one of pieces with byte
fallback, and a byte-level one made of many languages. Each script, and each of
four languages of the Latin script, has a band of allowed values for characters
per token and token entropy (bits) under both, and for the byte-fallback share;
a text outside its band is rejected. A text's language is the one whose
commonest words it holds most of. Short texts have no stable figures: bands
apply from ``MIN_TOKENS`` tokens on.

The bands of the languages are bounds that hardly a good text falls below: they
lie under the 0.2nd percentile of the texts labelled good that pass the base,
of each language, among 18,000 labelled documents. They are constants; no run
fits them to its input.

Texts stay in their partitions: one pass, no shuffle, a slice at a time.

Defined results: a null text counts as an empty one and has no words, so it
fails the base rules. Repeated rows are judged one by one. An empty table gives
an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame

from tributary.llm import flat
from tributary.llm.pieces import WordTable

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MANY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MIN_TOKENS = 50


@dataclass(frozen=True)
class Band:
    """Allowed figures, bounds included."""

    chars_per_token: tuple[float, float]
    byte_share: float  # at most
    entropy: float  # at least, bits
    many_chars: float = 0.0  # characters per token of the vocabulary of many languages, at least
    many_entropy: float = 0.0  # its tokens' entropy, at least, bits


#: Scripts that are written in the vocabulary's common pieces are held to closer bands than those it mostly spells in bytes.
BANDS = {
    "english": Band((2.30, 8.0), 0.10, 5.7, 2.44, 5.78),
    "german": Band((2.30, 8.0), 0.10, 5.7, 2.46, 5.78),
    "spanish": Band((2.05, 8.0), 0.10, 5.5, 2.25, 5.6),
    "french": Band((2.13, 8.0), 0.10, 5.6, 2.25, 5.72),
    "latin": Band((1.6, 8.0), 0.10, 3.5),  # of no language that is known here
    "cyrillic": Band((1.2, 8.0), 0.15, 3.5),
    "greek": Band((0.9, 6.0), 0.50, 3.5),
    "hebrew": Band((0.7, 6.0), 0.60, 3.0),
    "arabic": Band((0.7, 6.0), 0.60, 3.0),
    "han": Band((0.3, 4.0), 0.90, 3.5),
    "hangul": Band((0.3, 4.0), 0.95, 3.0),
    "other": Band((0.2, 8.0), 1.00, 2.5),
    "none": Band((0.5, 8.0), 0.50, 3.0),  # no letters: figures, signs
}

# First bytes of UTF-8 sequences by script.
_SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "han", "hangul", "other")
_SCRIPT_OF = np.zeros(256, np.uint8)
for _name, _first, _last in (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC3, 0xCB), ("greek", 0xCD, 0xCF), ("cyrillic", 0xD0, 0xD4),
    ("hebrew", 0xD6, 0xD7), ("arabic", 0xD8, 0xDD), ("other", 0xDE, 0xE2), ("han", 0xE3, 0xE9), ("hangul", 0xEA, 0xED),
    ("other", 0xEE, 0xF4),
):
    _SCRIPT_OF[_first : _last + 1] = _SCRIPTS.index(_name)

# Among the commonest words of each language, none of them shared.
_COMMON = {
    "english": "the of and to is that for it with was by this from are be have not they his which",
    "german": "der die und das den von zu mit ist auf des nicht ein eine dem sich im auch wird werden",
    "spanish": "el los y las una del por con para su al lo como pero sus fue esta son entre desde",
    "french": "le les et du dans pour est qui sur pas au par il ce avec sont cette mais ou ses",
}
_LANGUAGES = tuple(_COMMON)
#: Of a document's words that have to be common ones of a language to be judged as a text in it.
LEAST_SHARE = 0.01
#: What a document is judged as: its script, or of the Latin script its language.
_KINDS = (*_SCRIPTS, *_LANGUAGES)

_IN_LETTERS = _SCRIPT_OF > 0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class QualityRules:
    min_words: int = MIN_WORDS
    max_repeated_percent: int = MAX_REPEATED_PERCENT
    min_tokens: int = MIN_TOKENS
    model: str = MODEL
    many: str = MANY
    bands: dict[str, Band] = field(default_factory=lambda: BANDS)


MEASURES = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
    "script": pa.string(),
    "n_tokens": pa.int64(),
    "chars_per_token": pa.float64(),
    "byte_share": pa.float64(),
    "token_entropy": pa.float64(),
    "language": pa.string(),
    "many_chars_per_token": pa.float64(),
    "many_entropy": pa.float64(),
}
_SPARK_TYPES = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string", pa.float64(): "double"}


@lru_cache(maxsize=2)
def _tokenizer(model: str, many: str) -> tuple[WordTable, np.ndarray]:
    """Each word's ids under both vocabularies, those of the second beyond the first's, and which ids are single bytes of the first."""
    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    size = processor.vocab_size()
    with open(many, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) + size for token, rank in map(bytes.split, file)}
    second = tiktoken.Encoding("many", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [a + second.encode_ordinary(f" {word}") for word, a in zip(words, processor.encode(words), strict=True)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, lengths.sum()), lengths

    return WordTable(encode), np.array([processor.is_byte(i) for i in range(size)])


@lru_cache(maxsize=1)
def _common_words() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the languages' commonest words, sorted, and the language of each."""
    words = [(word, k) for k, language in enumerate(_LANGUAGES) for word in _COMMON[language].split()]
    data = np.frombuffer("".join(word for word, _ in words).encode(), np.uint8)
    ends = np.cumsum([len(word.encode()) for word, _ in words])
    hashes = flat.Texts(0, data, np.array([0, len(data)])).hashes(np.append(0, ends[:-1]), ends)
    order = np.argsort(hashes)
    return hashes[order], np.array([k for _, k in words])[order]


def _per_document(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values over each document's range."""
    sums = np.zeros(len(bounds) - 1, np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):  # the ranges follow on each other
        sums[full] = np.add.reduceat(values, bounds[full], dtype=np.int64)
    return sums


def repeated(keys: np.ndarray, owners: np.ndarray, first_too: bool) -> np.ndarray:
    """Which keys occur more than once in their document; without the first occurrence unless asked for."""
    marks = np.zeros(len(keys), bool)
    if len(keys) < 2:
        return marks
    own = keys ^ flat.mixed(owners.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    marks[order[1:][same]] = True
    if first_too:
        marks[order[:-1][same]] = True
    return marks


def base_counts(texts: flat.Texts) -> dict[str, np.ndarray]:
    """Counts of words, of characters in words, of symbols, and of repetition."""
    data, bounds = texts.data, texts.bounds
    starts, ends, words = texts.words()
    hashes = texts.hashes(starts, ends)
    begins_char = (data & 0xC0) != 0x80
    grams, gram_bounds = flat.shingles(hashes, words, 3)
    gram_owner = flat.segment_ids(gram_bounds)
    twice = repeated(grams, gram_owner, first_too=True)
    first_word = np.arange(len(grams)) - gram_bounds[gram_owner] + words[gram_owner] if len(grams) else np.zeros(0, np.int64)
    covered = np.zeros(len(starts), bool)
    for k in range(3):
        covered[first_word[twice] + k] = True
    line_starts, line_ends, lines = texts.runs(data != 10)
    word_line = np.searchsorted(line_starts, starts, side="right") - 1
    worded = np.zeros(len(line_starts), bool)
    worded[word_line] = True
    # An empty line between others holds no word, so runs of other bytes are all that counts.
    again = repeated(texts.hashes(line_starts, line_ends), flat.segment_ids(lines), first_too=False)
    return {
        "languages": _languages(texts),
        "n_words": np.diff(words),
        "word_chars": _per_document(bounds, begins_char & ~flat.IS_SPACE[data]),
        "n_symbols": _per_document(bounds, _SYMBOL[data]),
        "n_dup_lines": _per_document(lines, again & worded),
        "n_repeat_words": _per_document(words, covered),
        "n_chars": _per_document(bounds, begins_char),
    }


def _languages(texts: flat.Texts) -> np.ndarray:
    """The language whose common words each document holds most of, whatever signs stand around them; -1 if they are too few."""
    starts, ends, bounds = texts.runs(_IN_LETTERS[texts.data])
    hashes = texts.hashes(starts, ends, fold=True)
    known, of = _common_words()
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    found = known[at] == hashes
    counts = np.stack([_per_document(bounds, found & (of[at] == k)) for k in range(len(_LANGUAGES))], axis=1)
    most = counts.max(axis=1)
    return np.where((most > 0) & (LEAST_SHARE * np.diff(bounds) <= most), counts.argmax(axis=1), -1)


def scripts(texts: flat.Texts) -> np.ndarray:
    """The script that most letters of each document belong to."""
    kinds = _SCRIPT_OF[texts.data]
    counts = np.zeros((len(texts), len(_SCRIPTS) - 1), np.int64)
    counts[:, 0] = _per_document(texts.bounds, kinds == 1)  # Latin letters are most of many texts
    others = np.flatnonzero(kinds > 1)
    np.add.at(counts, (texts.owner(others), kinds[others].astype(np.int64) - 1), 1)
    return np.where(counts.max(axis=1, initial=0) > 0, counts.argmax(axis=1) + 1, 0)


def _figures(ids: np.ndarray, bounds: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, characters per token and entropy in bits of each document."""
    n = np.diff(bounds)
    entropy = np.zeros(len(n))
    for i in np.flatnonzero(n):
        counts = np.bincount(ids[bounds[i] : bounds[i + 1]])
        p = counts[counts > 0] / n[i]
        entropy[i] = -(p * np.log2(p)).sum()
    return n, n_chars / np.maximum(n, 1), entropy


def token_figures(texts: flat.Texts, n_chars: np.ndarray, model: str, many: str) -> dict[str, np.ndarray]:
    """Tokens, characters per token, entropy and byte-fallback share of each document, and the first two of the other vocabulary."""
    words, is_byte = _tokenizer(model, many)
    ids, bounds = words.ids(texts)
    second = ids >= len(is_byte)
    before = np.concatenate([[0], np.cumsum(second)])[bounds]
    pieces = ids[~second]
    n, chars, entropy = _figures(pieces, bounds - before, n_chars)
    _, many_chars, many_entropy = _figures(ids[second] - len(is_byte), before, n_chars)
    share = _per_document(bounds - before, is_byte[pieces]) / np.maximum(n, 1)
    return {
        "n_tokens": n, "chars_per_token": chars, "byte_share": share, "token_entropy": entropy,
        "many_chars_per_token": many_chars, "many_entropy": many_entropy,
    }


def judge(texts: flat.Texts, rules: QualityRules) -> dict[str, np.ndarray]:
    """All measures and the verdict of each document of a slice."""
    found = base_counts(texts)
    n_chars = found.pop("n_chars")
    found["base_failed"] = (found["n_words"] < rules.min_words) | (
        100 * found["n_repeat_words"] > rules.max_repeated_percent * found["n_words"]
    )
    script, language = scripts(texts), found.pop("languages")
    found |= token_figures(texts, n_chars, rules.model, rules.many)
    latin = (script == _SCRIPTS.index("latin")) & (language >= 0)
    kind = np.where(latin, len(_SCRIPTS) + language, script)
    bands = [rules.bands.get(name, rules.bands["other"]) for name in _KINDS]

    def bound(of: Callable[[Band], float]) -> np.ndarray:
        return np.array([of(band) for band in bands])[kind]

    inside = (found["chars_per_token"] >= bound(lambda b: b.chars_per_token[0])) & (found["chars_per_token"] <= bound(lambda b: b.chars_per_token[1]))
    inside &= (found["byte_share"] <= bound(lambda b: b.byte_share)) & (found["token_entropy"] >= bound(lambda b: b.entropy))
    inside &= (found["many_chars_per_token"] >= bound(lambda b: b.many_chars)) & (found["many_entropy"] >= bound(lambda b: b.many_entropy))
    found["kept"] = ~found["base_failed"] & (inside | (found["n_tokens"] < rules.min_tokens))
    found["script"] = np.array(_SCRIPTS, dtype=object)[script]
    found["language"] = np.where(latin, np.array(_LANGUAGES, dtype=object)[language], None)
    return found


def quality(docs: DataFrame, rules: QualityRules | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and all measures of each row's text."""
    rules = rules or QualityRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in flat.slices(batch.column(1), flat.SMALL_SLICE_BYTES):
                found = judge(texts, rules)
                ids = batch.column(0).slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(found[name], kind) for name, kind in MEASURES.items())], names=["id", *MEASURES]
                )

    kind = docs.schema[id_column].dataType.simpleString()
    columns = ", ".join(f"{name} {_SPARK_TYPES[type_]}" for name, type_ in MEASURES.items())
    measured = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    return measured.mapInArrow(run, f"id {kind}, {columns}").withColumnRenamed("id", id_column)


def keep_good(docs: DataFrame, rules: QualityRules | None = None, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text the rules keep."""
    rules = rules or QualityRules()
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in flat.slices(batch.column(at), flat.SMALL_SLICE_BYTES):
                yield batch.slice(texts.first, len(texts)).filter(pa.array(judge(texts, rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
