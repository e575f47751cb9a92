"""What the bands decide beyond the base rules, on labelled rows they were not set on, and on invented texts."""

import math
import zlib

import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken

from tributary.llm import flat, quality_rules
from tributary.llm.queries import QUERIES

SCALE = "/root/testdata/sf0.1"


def test_bands_alone_reject_poor_texts_and_keep_good_ones(spark):
    rows = QUERIES["op1_quality_rules"](spark, SCALE).join(spark.read.parquet(f"{SCALE}/labels.parquet"), "doc_id")
    rows = [r for r in rows.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and not r["base_failed"]]
    good, poor = ([r["kept"] for r in rows if r["quality"] == label] for label in (1, 0))
    assert len(good) > 500 and len(poor) > 50
    assert sum(good) >= 0.98 * len(good)
    assert poor.count(False) >= 0.6 * len(poor)


def figures(text):
    (part,) = flat.slices(pa.array([text]))
    return {name: values[0] for name, values in quality_rules.judge(part, quality_rules.QualityRules()).items()}


def entropy(ids):
    return -sum(k / len(ids) * math.log2(k / len(ids)) for k in map(ids.count, set(ids)))


def test_figures_are_those_of_both_libraries():
    text = "The house by the river was old, and its windows looked over water that hardly moved. " * 3 + "漢字 q"
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(quality_rules.MANY, "rb"))}
    many = tiktoken.Encoding("many", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(" " + text)
    pieces = sentencepiece.SentencePieceProcessor(model_file=quality_rules.MODEL).encode(text)
    found = figures(text)
    assert found["n_tokens"] == len(pieces) and math.isclose(found["token_entropy"], entropy(pieces))
    assert math.isclose(found["many_chars_per_token"], len(text) / len(many)) and math.isclose(found["many_entropy"], entropy(many))


def test_languages_are_told_by_their_common_words():
    texts = {
        "english": "***The*** house, (that) was by it", "german": "Das Haus ist nicht weit von der Stadt", "french": "Le chat dort dans les bras du roi",
        "spanish": "El perro y los gatos son para las casas", None: "zxq vvb",
    }
    assert {language: figures(text)["language"] for language, text in texts.items()} == {language: language for language in texts}
    assert figures("Это текст the of")["language"] is None


def test_columns_of_the_same_names_do_not_matter(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, "x"), (None, None, 8, "y")], "doc_id bigint, text string, kept int, script string")
    rows = {r["doc_id"]: r["n_words"] for r in quality_rules.quality(docs).collect()}
    assert rows == {1: 3, None: 0}
    assert quality_rules.keep_good(docs).columns == docs.columns
