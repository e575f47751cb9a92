"""The same results in SQL, for the operators that SQL can express."""

from __future__ import annotations

from tributary.llm.license_scans import PHRASES, TEMPLATES, words_of
from tributary.llm.secret_scans import RULES as SECRET_RULES
from tributary.llm.url_filters import RULES as URL_RULES

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_quoted(item) for item in items) + "]"


def _lower(text: str) -> str:
    return f"translate({text}, '{_CAPITALS}', '{_CAPITALS.lower()}')"


def _words(text: str) -> str:
    return f"regexp_extract_all({_lower(text)}, {_quoted(_WORD)})"


def _any_case(pattern: str) -> str:
    """Letters outside brackets in either case; ASCII only, unlike the engine's own flag."""
    out, depth, escaped = [], 0, 0
    for k, c in enumerate(pattern):
        depth += (c == "[") - (c == "]")
        escaped = 3 if c == "\\" and pattern[k + 1] == "x" else max(0, escaped - 1)
        out.append(f"[{c.lower()}{c.upper()}]" if c.isalpha() and not depth and not escaped else c)
    return "".join(out)


def _license_sql() -> str:
    places = []
    for phrase, label in PHRASES:
        test = " AND ".join(f"w[i + {k}] = {_quoted(word)}" for k, word in enumerate(words_of(phrase), start=1))
        places.append((label, f"list_filter(range(len(w)), lambda i: {test})"))
    columns = ", ".join(f"{sql} AS p{k}" for k, (_, sql) in enumerate(places))
    numbers = range(len(places))
    every = "flatten([" + ", ".join(f"p{k}" for k in numbers) + "])"
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN {_quoted(places[k][0])} END" for k in numbers)
    templates = ", ".join(f"({_quoted(label)}, {_list(sorted(set(words_of(text))))})" for label, text in TEMPLATES)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS w FROM documents),
placed AS (SELECT doc_id, w, {columns} FROM docs),
based AS (SELECT doc_id, len(w) AS n_words, {every} AS places, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM placed),
blocks AS (SELECT doc_id, list_distinct({_words("line")}) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)),
templates(label, t) AS (VALUES {templates}),
held AS (SELECT doc_id, label, len(list_intersect(t, w)) / len(t) AS share FROM blocks, templates WHERE 10 * len(list_intersect(t, w)) >= 8 * len(t)),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM held GROUP BY doc_id)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM based LEFT JOIN more USING (doc_id)"""


_LINES_SQL = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM docs),
keyed AS (SELECT *, {_lower("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, line, pos, last_doc IS NOT NULL AND doc_id <> last_doc AS dropped FROM keyed LEFT JOIN frequent USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def _secret_sql() -> str:
    each = []
    for rank, rule in enumerate(SECRET_RULES):
        pattern = _quoted(_any_case(rule.pattern) if rule.any_case else rule.pattern)
        each.append(
            f"SELECT doc_id, {rank} AS rank, {_quoted(rule.kind)} AS kind, {rule.least} AS least, string_split_regex(t, {pattern}) AS gaps, "
            f"regexp_extract_all(t, {pattern}) AS hits, regexp_extract_all(t, {pattern}, {rule.group}) AS tested FROM docs WHERE regexp_matches(t, {pattern})"
        )
    counts = ", ".join(f"count(*) FILTER (rank = {rank}) AS n_{SECRET_RULES[rank].kind}" for rank in range(3))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(each)}),
numbered AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found),
spans AS (
  SELECT doc_id, rank, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s,
    length(hits[i]) AS size FROM numbered WHERE length(tested[i]) >= least),
named AS (SELECT doc_id, rank, s, kind || ':' || s::BIGINT || ':' || (s + size)::BIGINT AS span FROM spans),
summed AS (
  SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans
  FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN summed USING (doc_id)"""


_BENCHMARK_SQL = f"""
WITH items AS (SELECT item_id, {_words("coalesce(text, '')")} AS w FROM benchmark),
windows AS (
  SELECT item_id, unnest(CASE WHEN len(w) <= 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS win FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS size FROM windows),
docs AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes),
held AS (SELECT doc_id, i, size, w[i:i + size - 1] AS win FROM places),
hits AS (SELECT DISTINCT doc_id, i, size, item_id FROM held JOIN windows USING (win)),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)"""


_JACCARD_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [w] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS s FROM docs WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


def _url_sql() -> str:
    rules = ", ".join(f"({_quoted(verdict)}, {_quoted(host)}, {_quoted(path)})" for verdict, host, path in URL_RULES)
    return f"""
WITH parsed AS (
  SELECT page_id, {_lower("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, rule_host, rule_path) AS (VALUES {rules}),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict FROM parsed, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN best USING (page_id)"""


def _clusters_sql(k: int = 40, rounds: int = 5, dimensions: int = 64) -> str:
    """The rounds one after another, each from all distances of all vectors."""
    number = f"range(1, {dimensions + 1})"
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), v) - 1 AS cluster, v AS c FROM kept ORDER BY cluster LIMIT {k})"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, min((d, cluster)) AS best FROM (
    SELECT vec_id, v, cluster, list_sum(list_transform({number}, lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM kept, c{r}) GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""s{r} AS (
  SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best[2] AS cluster, unnest(v) AS x, unnest({number}) AS i FROM a{r}) GROUP BY ALL),
m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    return f"""
WITH {", ".join(parts)},
found AS (SELECT vec_id, best[2] AS cluster, best[1] AS distance FROM a{rounds})
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM found JOIN c{rounds} USING (cluster)"""


ORACLE_SQL = {
    "op2_license_scans": _license_sql(),
    "op3_line_dedup": _LINES_SQL,
    "op5_secret_scans": _secret_sql(),
    "op6_decontamination": _BENCHMARK_SQL,
    "op7_jaccard_join": _JACCARD_SQL,
    "op8_url_filters": _url_sql(),
    "op11_centroid_clustering": _clusters_sql(),
}
