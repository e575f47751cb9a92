"""Cutting, merging and decoding against the library."""

import base64
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from tributary.llm import byte_bpe, flat
from tributary.llm.queries import QUERIES

SCALE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    """Ids and starts of each text."""
    own, out = byte_bpe.codec(byte_bpe.RANKS), []
    for part in flat.slices(pa.array(texts, pa.string())):
        _, ids, bounds = own.encode_slice(part)
        starts = own.starts(ids, bounds)
        out += [(ids[a:b].tolist(), starts[a:b].tolist()) for a, b in itertools.pairwise(bounds)]
    return out


def test_every_short_text_over_the_classes(library):
    """All texts of up to five signs, of one code point per class and all letters of contractions."""
    few = [" ", "\n", "'", "s", "r", "e", "1", "!"]
    texts = ["".join(t) for n in range(6) for t in itertools.product(few, repeat=n)]
    assert [ids for ids, _ in encoded(texts)] == [library.encode_ordinary(t) for t in texts]


def test_random_texts(library):
    rng = random.Random(3)
    signs = [*"aabcstmdrevl''''  \t\n\r 12.!-_é漢字ß", "　", " ", "\U0001f600", "٣", "ſ", "ǅ", "́", "‍", "Ⅷ", "²", "\x00", "\x1c", "\x85"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(8000)]
    for text, (ids, starts) in zip(texts, encoded(texts), strict=True):
        assert ids == library.encode_ordinary(text)
        tokens = [library.decode_single_token_bytes(i) for i in ids]
        assert starts == [0, *itertools.accumulate(map(len, tokens))][: len(ids)]


def test_every_code_point_has_the_librarys_class(library):
    """Each point between letters, figures and signs; pieces meet where the pattern cuts."""
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}a 1{c}1 !{c}! {c}\n" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    assert [ids for ids, _ in encoded(texts)] == [library.encode_ordinary(t) for t in texts]


def test_pieces_equal_the_pattern():
    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(4)
    texts = ["".join(rng.choices("ab'sve  \n1.", k=30)) for _ in range(2000)]
    for part in flat.slices(pa.array(texts)):
        _, begins, bounds = byte_bpe.cut_pieces(part)
        for i, (a, b) in enumerate(itertools.pairwise(bounds)):
            assert (begins[a:b] - part.bounds[i]).tolist() == [m.start() for m in pattern.finditer(texts[part.first + i])]


def test_merging_by_rank_with_ties_and_long_pieces(library):
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aaab": 4}
    assert byte_bpe.merge(b"aaa", ranks) == [2, 0]
    assert byte_bpe.merge(b"aaaab", ranks) == [2, 2, 1]
    assert byte_bpe.merge(b"aaab", ranks) == [4]  # a whole piece that is a token
    rng = random.Random(5)
    texts = ["a" * 50_000, "".join(rng.choices("etaoin", k=30_000)), "é" * 999, "!" * 20_000, " " * 20_000 + "x", "7" * 10_001]
    assert [ids for ids, _ in encoded(texts)] == [library.encode_ordinary(t) for t in texts]


def test_composition_is_that_of_the_steps():
    rng = random.Random(6)
    for _ in range(300):
        kinds = [rng.randrange(8) for _ in range(rng.randint(1, 9))]
        number = byte_bpe._FUNCTIONS.of_class[kinds[0]]
        for kind in kinds[1:]:
            number = byte_bpe._FUNCTIONS.compose[number, byte_bpe._FUNCTIONS.of_class[kind]]
        state = byte_bpe.FRESH
        for kind in kinds:
            state = byte_bpe.step(state, kind)[0]
        assert byte_bpe._FUNCTIONS.value[number] == state


def test_a_full_table_is_emptied(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "_MOST_PIECES", 50)
    texts = [" ".join(f"w{k}x{n}" for k in range(40)) for n in range(20)]
    own = byte_bpe.Codec()
    for text in texts:
        (part,) = flat.slices(pa.array([text]))
        assert own.encode_slice(part)[1].tolist() == library.encode_ordinary(text)
        assert len(own._numbers) < 200


def test_query(spark, library):
    docs = spark.read.parquet(f"{SCALE}/documents.parquet").collect()
    digest = lambda x: hashlib.sha256(x).hexdigest()
    expected = set()
    for r in docs:
        ids = library.encode_ordinary(r["text"] or "")
        expected.add((r["doc_id"], len(ids), digest(np.array(ids, "<u4").tobytes()), digest((r["text"] or "").encode())))
    assert {tuple(r) for r in QUERIES["op13_byte_bpe"](spark, SCALE).collect()} == expected


def test_awkward_rows(spark, library):
    texts = [None, "", " ", "\n\n", "same", "same", "x" * 100_000, "'s", "\U0001f600" * 100]
    rows = [(k if k else None, text, [k], "y") for k, text in enumerate(texts)] + [(4, "other", [], None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>, starts string").repartition(3)
    both = byte_bpe.encode(docs)
    got = sorted(((r["doc_id"], r["ids"]) for r in both.collect()), key=str)
    assert got == sorted(((i, library.encode_ordinary(text or "")) for i, text, _, _ in rows), key=str)
    back = sorted((tuple(r) for r in byte_bpe.decode(both).collect()), key=str)
    assert back == sorted(((i, text or "") for i, text, _, _ in rows), key=str)
    assert byte_bpe.encode(docs.limit(0)).collect() == []


def test_decoding_ids_that_are_none(spark):
    table = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert sorted(tuple(r) for r in byte_bpe.decode(table).collect() if r["text"] is not None) == [(2, "")]
    with pytest.raises(ValueError, match="outside the vocabulary"):
        byte_bpe.codec(byte_bpe.RANKS).decode_bytes(np.array([10**6]))


def test_bytes_that_are_no_text(spark, library):
    docs = spark.sql("SELECT 1 AS doc_id, cast(unhex('61ff62') AS string) AS text UNION ALL SELECT 2, 'ok'")
    got = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(docs).collect()}
    assert got == {1: library.encode_ordinary("a�b"), 2: library.encode_ordinary("ok")}
