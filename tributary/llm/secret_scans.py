"""Secret scans: a trigram index finds the documents a rule can match, and only those are searched.

From each rule's pattern follows a Boolean query on trigrams that every match
must satisfy: an AND of clauses, a clause an OR of alternatives, an alternative
an AND of trigrams. The index lists, for every trigram that a query asks for,
the documents that hold it (A-Z lower-cased). Its postings are intersected per
document and rule, and the pattern is run on what remains. A rule without a
mandatory trigram is run on every document.

Spans are in code points, the end excluded.

Defined results: a null text counts as an empty one. Copies of a row get the
same answer; rows of one id with different texts are answered by their own text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.columns import ascii_lower, text_digest, text_or_empty, with_matches

Alternative = frozenset[str]
Clause = tuple[Alternative, ...]
_MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if the group has at least so many characters."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", any_case=True, group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
#: Public formats of keys.
MORE_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=30),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


def trigram_query(pattern: str) -> list[Clause]:
    """What every match of the pattern must hold, trigrams lower-cased; empty if nothing follows."""
    clauses: list[Clause] = []

    def flush(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            weakest = [g for g in grams if not any(other < g for other in grams)]  # what a larger set asks for follows
            clauses.append(tuple(sorted(weakest, key=sorted)))

    def strings_of(nodes) -> set[str] | None:
        """All strings the nodes can match, if they are few."""
        found = {""}
        for node in nodes:
            step = of_node(node)
            if step is None or len(found) * len(step) > _MOST_STRINGS:
                return None
            found = {a + b for a in found for b in step}
        return found

    def of_node(node) -> set[str] | None:
        kind, value = node
        if kind is kinds.LITERAL:
            return {chr(value).lower()}
        if kind is kinds.IN and all(k is kinds.LITERAL for k, _ in value):
            return {chr(v).lower() for _, v in value}
        if kind is kinds.SUBPATTERN:
            return strings_of(value[-1])
        if kind is kinds.BRANCH:
            each = [strings_of(branch) for branch in value[1]]
            return None if None in each else set().union(*each)
        if kind is kinds.MAX_REPEAT and value[1] <= 3:
            step = strings_of(value[2])
            if step is None:
                return None
            found, power = set(), {""}
            for times in range(int(value[1]) + 1):
                if times >= value[0]:
                    found |= power
                power = {a + b for a in power for b in step}
                if len(power) > _MOST_STRINGS:
                    return None
            return found
        return None

    def walk(nodes) -> None:
        held = {""}
        for node in nodes:
            step = of_node(node)
            if step is not None and len(held) * len(step) <= _MOST_STRINGS:
                held = {a + b for a in held for b in step}
                continue
            flush(held)
            held = step if step is not None else {""}
            if step is None and node[0] is kinds.SUBPATTERN:
                walk(node[1][-1])
            elif step is None and node[0] is kinds.MAX_REPEAT and node[1][0] >= 1:
                walk(node[1][2])
        flush(held)

    walk(parser.parse(pattern))
    return clauses


def spans_of(text: Column, rule: Rule) -> Column:
    """(start, end) of the leftmost matches that do not overlap and are long enough."""
    pattern = F.lit(rule.java)
    around, hits = F.split(text, rule.java, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    gaps = F.transform(F.slice(around, 1, F.size(hits)), F.char_length)
    sizes = F.arrays_zip(gaps.alias("gap"), F.transform(hits, F.char_length).alias("size"), F.transform(measured, F.char_length).alias("tested"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["size"]
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["tested"] >= rule.least, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    # The patterns are looked for again only where something was found.
    return F.when(text.rlike(_quick(rule)), F.aggregate(sizes, start, step, lambda state: state["spans"])).otherwise(start["spans"])


def _quick(rule: Rule) -> str:
    """A pattern found wherever a long enough match is; maximal runs of a class are tested by length at once."""
    if not rule.group and re.fullmatch(r"\[[^\]]*\]\+", rule.pattern):
        return f"{rule.java[:-1]}{{{max(rule.least, 1)},}}"
    return rule.java


def postings(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """The index: each trigram with the documents that hold it (``doc_id``, ``digest``)."""
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda gram: F.contains(F.col("folded"), gram))
    folded = docs.select("doc_id", "digest", ascii_lower(F.col("text")).alias("folded"))
    return folded.select("doc_id", "digest", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Documents and the kinds of rules (``kinds``) whose trigram query they satisfy."""
    spark: SparkSession = docs.sparkSession
    asked = [
        (rule.kind, c, a, len(alternative), gram)
        for rule in rules
        for c, clause in enumerate(trigram_query(rule.pattern))
        for a, alternative in enumerate(clause)
        for gram in sorted(alternative)
    ]
    n_clauses = {rule.kind: len(trigram_query(rule.pattern)) for rule in rules}
    query = spark.createDataFrame(asked, "kind string, clause int, alternative int, size int, trigram string")
    found = postings(docs, sorted({row[-1] for row in asked})).distinct().join(query, "trigram")
    met = (
        found.groupBy("doc_id", "digest", "kind", "clause", "alternative", "size")
        .agg(F.count("trigram").alias("n"))
        .filter(F.col("n") == F.col("size"))
        .groupBy("doc_id", "digest", "kind")
        .agg(F.countDistinct("clause").alias("n_clauses"))
    )
    needed = F.create_map(*[F.lit(x) for pair in n_clauses.items() for x in pair])
    return met.filter(F.col("n_clauses") == needed[F.col("kind")]).groupBy("doc_id", "digest").agg(F.collect_set("kind").alias("kinds"))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id of every row and its ``spans``: (start, rank of the rule, end, kind), by start, then by the rules' order."""
    rows = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(F.col(text_column)).alias("text"))
    rows = rows.withColumn("digest", text_digest(F.col("text")))
    indexed = [rule for rule in rules if trigram_query(rule.pattern)]
    if indexed:
        hit = candidates(rows, indexed)
        joined = with_matches(rows, hit, "doc_id", "digest")
    else:
        joined = rows.select("doc_id", "text", F.lit(None).cast("array<string>").alias("kinds"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    each = []
    for rank, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule)
        if rule in indexed:
            spans = F.when(F.array_contains("kinds", rule.kind), spans).otherwise(none)
        each.append(F.transform(spans, _named(rank, rule.kind)))
    return joined.select(F.col("doc_id").alias(id_column), F.array_sort(F.concat(*each)).alias("spans"))


def _named(rank: int, kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
