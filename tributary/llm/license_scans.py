"""License scans: phrases in their places, and text blocks that contain a template.

A block is a line. It holds a template if at least ``threshold`` of the
template's distinct words are among its own (A-Z lower-cased). The search is an
exact set-similarity join: words are put in one order, rarest in the documents
first; a template is indexed under the few first words of which any block that
holds it must have one, a block is looked up by the words of its own prefix;
pairs too short, or too far along in either order, are left out, and the
overlap of the rest is counted.

Word frequencies are counted over all documents; the driver gets one number for
each word of the templates, which are a parameter. Documents without a word of
an index entry are never cut into lines. Nothing but the templates is broadcast.

Defined results: a null text counts as an empty one and has no words. Copies of
a row get the same answer; rows of one id with different texts are answered by
their own text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.columns import BETWEEN, IN_WORD, cut_words, text_digest, text_or_empty, with_matches, word_count

THRESHOLD = 0.8

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label and wording of common licence lines.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)


@dataclass(frozen=True)
class _Template:
    label: str
    words: tuple[str, ...]  # distinct, in the common order
    needed: int

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.needed + 1]


def words_of(text: str) -> list[str]:
    """A template's words, as the documents' are taken."""
    return [w for w in re.split(BETWEEN + "+", re.sub("[A-Z]+", lambda m: m[0].lower(), text)) if w]


def phrase_pattern(phrase: str) -> str:
    """The phrase's words, consecutive, in any case of A-Z."""
    return f"(?i)(?<!{IN_WORD})" + (BETWEEN + "+").join(map(re.escape, words_of(phrase))) + f"(?!{IN_WORD})"


def _ordered(docs: DataFrame, templates: Sequence[tuple[str, str]], threshold: float) -> tuple[list[str], list[_Template]]:
    """All words of the templates by rising number of documents that hold them, and the templates, words in that order."""
    sets = [(label, set(words_of(text))) for label, text in templates]
    if not all(words for _, words in sets):
        raise ValueError("a template has no words")
    vocabulary = sorted(set().union(*(words for _, words in sets)))
    counts = docs.select(F.explode(F.array_intersect(F.lit(vocabulary), "words")).alias("word")).groupBy("word").count().collect()
    frequency = {row["word"]: row["count"] for row in counts}
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    needed = [max(1, ceil(round(threshold * len(words), 9))) for _, words in sets]
    return order, [_Template(label, tuple(w for w in order if w in words), n) for (label, words), n in zip(sets, needed, strict=True)]


def blocks_with_templates(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Every (id, digest of the text, line from 0, label) where the line holds a template of the label, with the best share held."""
    text = text_or_empty(F.col(text_column))
    rows = docs.select(F.col(id_column).alias("doc_id"), text_digest(text).alias("digest"), text.alias("text"), cut_words(text).alias("words"))
    order, ordered = _ordered(rows, templates, threshold)
    least = min(t.needed for t in ordered)
    index = docs.sparkSession.createDataFrame(
        [(i, t.label, list(t.words), t.needed, p, word) for i, t in enumerate(ordered) for p, word in enumerate(t.prefix)],
        "template int, label string, template_words array<string>, needed int, template_at int, word string",
    )
    starts = sorted({word for t in ordered for word in t.prefix})
    lines = rows.filter(F.arrays_overlap("words", F.lit(starts))).select("doc_id", "digest", F.posexplode(F.split("text", "\n")).alias("line", "block"))
    held = lines.select("doc_id", "digest", "line", F.array_intersect(F.lit(order), cut_words(F.col("block"))).alias("held"))
    prefixes = held.filter(F.size("held") >= least).select(
        "*", F.posexplode(F.slice("held", F.lit(1), F.size("held") - (least - 1))).alias("at", "word")
    )
    met = prefixes.join(index, "word").filter(
        (F.size("held") >= F.col("needed"))
        & (F.least(F.size("template_words") - F.col("template_at"), F.size("held") - F.col("at")) >= F.col("needed"))
    )
    overlap = F.size(F.array_intersect("held", "template_words"))
    return (
        met.withColumn("overlap", overlap)
        .filter(F.col("overlap") >= F.col("needed"))
        .groupBy("doc_id", "digest", "line", "label")
        .agg(F.max(F.col("overlap") / F.size("template_words")).alias("share"))
    )


def phrases_in(text: Column, words: Column, phrases: Sequence[tuple[str, str]] = PHRASES) -> Column:
    """For each phrase: its label, its number of places, and its first and last start (null without any)."""
    found = []
    for phrase, label in phrases:
        pattern, size = phrase_pattern(phrase), len(words_of(phrase))
        around = F.split(text, pattern, -1)
        first = word_count(cut_words(F.get(around, F.lit(0))))
        last = words - word_count(cut_words(F.element_at(around, -1))) - size
        here = text.rlike(pattern)
        found.append(
            F.struct(
                F.lit(label).alias("label"),
                F.when(here, F.size(around) - 1).otherwise(0).cast("bigint").alias("places"),
                F.when(here, first).alias("first"),
                F.when(here, last).alias("last"),
            )
        )
    return F.array(*found)


def scan(
    docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """The id of every row with its words, the places of phrases, all labels, and a score.

    The score is 1 where a phrase stands, else the best share of a template that
    a block holds, else 0.
    """
    text = text_or_empty(F.col(text_column))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text")).withColumn("digest", text_digest(F.col("text")))
    rows = rows.withColumn("n_words", word_count(cut_words(F.col("text")))).withColumn("phrases", phrases_in(F.col("text"), F.col("n_words"), phrases))
    blocks = blocks_with_templates(docs, templates, threshold, id_column, text_column)
    more = blocks.groupBy("doc_id", "digest").agg(F.collect_set("label").alias("labels"), F.max("share").alias("share"))
    narrow = rows.select("doc_id", "digest", "n_words", "phrases")
    both = with_matches(narrow, more, "doc_id", "digest")
    here = F.transform(F.filter("phrases", lambda p: p["places"] > 0), lambda p: p["label"])
    n_base = F.aggregate("phrases", F.lit(0).cast("bigint"), lambda n, p: n + p["places"])
    none = F.array().cast("array<string>")
    return both.select(
        F.col("doc_id").alias(id_column),
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.transform("phrases", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("phrases", lambda p: p["last"])).alias("last_word"),
        F.array_sort(F.array_distinct(here)).alias("base_labels"),
        F.array_sort(F.array_union(here, F.coalesce("labels", none))).alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
