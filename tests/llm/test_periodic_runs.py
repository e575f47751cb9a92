"""Square catching against a plain search for runs, and the query's whole result."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tributary.llm import flat, periodic_runs
from tributary.llm.queries import QUERIES, with_planted_runs

SCALE = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least_length=24, least_power=3):
    n, out = len(words), []
    for q in range(1, n // least_power + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            smallest = all(any(words[x] != words[x - r] for x in range(start + r, start + length)) for r in range(1, q) if q % r == 0)
            if length >= max(least_length, least_power * q) and smallest:
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(texts, **more):
    out = []
    for part in flat.slices(pa.array(texts, pa.string())):
        keys, _, _, bounds = periodic_runs.word_keys(part)
        found = periodic_runs.find_runs(keys, bounds, **more)
        out += [[tuple(r[1:]) for r in found[found[:, 0] == i].tolist()] for i in range(len(part))]
    return out


def random_words(rng, most):
    kinds = rng.choice([1, 2, 2, 3, 5, 50])
    words = [str(rng.randrange(kinds)) for _ in range(rng.randint(0, most))]
    for _ in range(rng.randint(0, 3)):
        p = rng.randint(1, 40)
        base = [str(rng.randrange(kinds)) for _ in range(p)]
        at = rng.randint(0, len(words))
        words[at:at] = [base[i % p] for i in range(rng.randint(p, 6 * p + 3))]
    return words


@pytest.mark.parametrize("least_length, least_power", [(24, 3), (1, 3), (10, 4)])
def test_random_texts(least_length, least_power):
    rng = random.Random(least_length)
    texts = [random_words(rng, 150) for _ in range(500)]
    expected = [plain_runs(words, least_length, least_power) for words in texts]
    assert runs_of([" ".join(words) for words in texts], least_length=least_length, least_power=least_power) == expected


def test_runs_of_all_periods_and_places():
    """Every period at every offset to the blocks, the shortest run that counts, and one word less."""
    texts, expected = [], []
    for q in [*range(1, 40), 63, 64, 65, 127, 128, 129, 500]:
        for offset in {0, 1, 7, q - 1, q, 3 * q + 1}:
            for length in (max(24, 3 * q), max(24, 3 * q) - 1):
                before, after = [f"b{k}" for k in range(offset)], ["z", "y"]
                texts.append(" ".join(before + [f"w{k % q}" for k in range(length)] + after))
                expected.append([(offset, length, q)] if length >= max(24, 3 * q) else [])
    assert runs_of(texts) == expected


def test_words_without_cubes():
    """Words over two letters that hold no three periods in a row, which polynomial hashes mix up."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    fibonacci, last = "ab", "a"
    while len(fibonacci) < 3000:
        fibonacci, last = fibonacci + last, fibonacci
    found = runs_of([" ".join(word), " ".join(fibonacci[:600]), " ".join("ab" * 5000), " ".join("a" * 30000)], least_length=1)
    assert found[0] == []
    assert found[1] == plain_runs(fibonacci[:600], 1)
    assert found[2:] == [[(0, 10000, 2)], [(0, 30000, 1)]]


def test_long_words_of_one_pattern_differ():
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    assert runs_of([" ".join([word, other] * 20)]) == [[(0, 40, 2)]]


def expected_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {i for start, length, period in runs for i in range(start + period, start + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(lines), digest(kept))


def test_query(spark):
    found = {tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SCALE).collect()}
    docs = spark.read.parquet(f"{SCALE}/documents.parquet").select("doc_id", "text").collect()
    short = {expected_row(*r) for r in docs if len(r["text"] or "") < 15_000}
    assert short <= found and len(found) == len(docs) and len(short) > 150
    assert sum(r[1] > 0 for r in found) >= 10


def test_query_on_awkward_texts(spark, folder):
    planting = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [None, "", " \n\t", "one", "a " * 50, "a b " * 30 + "c", " ".join(map(str, range(100))), "x" * 300_000, "ü ß\x0b ü ß " * 20, "a b " * 30]
    rows = [(i, text, 5) for k, text in enumerate(texts) for i in (*planting[:: len(planting) // 4], 1, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs int").repartition(3)
    docs.write.parquet(f"{folder}/documents.parquet")
    found = sorted((tuple(r) for r in QUERIES["op12_periodic_runs"](spark, folder).collect()), key=str)
    assert found == sorted((expected_row(i, text) for i, text, _ in rows), key=str)
    docs.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    assert QUERIES["op12_periodic_runs"](spark, f"{folder}/none").collect() == []


def test_planting_evaluates_words_row_by_row(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i + 1)), 0) for i in range(60)], "doc_id bigint, text string, n int")
    rows = {r["doc_id"]: r["text"].split() for r in with_planted_runs(docs).collect()}
    for i, words in rows.items():
        h = zlib.crc32(str(i).encode())
        n, g = i + 1, h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert words == [f"w{k if h % 10 or k < a else a + (k - a) % p}" for k in range(n)]


def test_operator_columns(spark):
    docs = spark.createDataFrame([("x", "a b " * 12 + "c", 1, "y")], "doc_id string, text string, runs int, collapsed string")
    row = periodic_runs.periodic_runs(docs).collect()[0].asDict(recursive=True)
    assert row == {"doc_id": "x", "n_words": 25, "runs": [{"start": 0, "length": 24, "period": 2}], "collapsed": "a b c"}
    assert np.array_equal(periodic_runs.find_runs(np.zeros(0, np.uint64), np.zeros(1, np.int64)), np.zeros((0, 4), np.int64))
    with pytest.raises(ValueError, match="three periods"):
        periodic_runs.find_runs(np.zeros(9, np.uint64), np.array([0, 9]), 1, 2)
