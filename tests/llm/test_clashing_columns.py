"""Columns beside the id and the text, named as results or intermediate columns are, change no result."""

import pytest
from pyspark.sql import functions as F

from tributary.llm import byte_bpe, decontamination, jaccard_join, license_scans, periodic_runs, quality_rules, secret_scans, sentencepiece_codec, substring_dedup

NAMES = (
    "id", "row", "name", "node", "key", "sig", "hash", "word", "words", "n_words", "tokens", "kept", "spans", "labels", "score", "digest", "place",
    "at", "start", "end", "ids", "item_id", "shingle", "gram", "grams", "n_shingles", "component_id", "class_id", "rule", "kind", "root", "block", "runs",
)
PROSE = [" ".join(f"{a}{k * 7 % 31}{b}" for k in range(70) for a, b in (("wo", "rd"), ("li", "ne"))) for _ in range(2)]
TEXTS = [None, "", "one", *PROSE, PROSE[0] + " more at the end", "password=abcdef123 AKIA" + "A1" * 12, "Licensed CC BY\nall rights reserved", "a b " * 40]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (1, "")], "doc_id bigint, text string")
    return docs, docs.select("*", *[F.lit(f"a {name}").alias(name) for name in NAMES])


def hits(docs):
    items = docs.sparkSession.createDataFrame([("i1", " ".join(PROSE[0].split(" ")[5:25])), ("i2", "one"), ("i3", None)], "item_id string, text string")
    return decontamination.contaminated(docs, items)


@pytest.mark.parametrize(
    "operator",
    [
        quality_rules.quality,
        license_scans.scan,
        sentencepiece_codec.round_trip_digests,
        secret_scans.scan,
        hits,
        jaccard_join.linked_classes,
        substring_dedup.repeated_passages,
        periodic_runs.periodic_runs,
        byte_bpe.round_trip_digests,
    ],
)
def test_other_columns_change_nothing(tables, operator):
    plain, beside = (operator(docs) for docs in tables)
    names = [name for name in plain.columns if name in beside.columns]
    assert names == plain.columns
    listed = lambda df: sorted(repr(tuple(row)) for row in df.select(*names).collect())
    found = listed(plain)
    assert found == listed(beside)
    assert found
