"""Pieces of the SQL that checks the queries: the same word lists, in the other engine's words."""

from __future__ import annotations

import re
from collections.abc import Iterable


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words: Iterable[str]) -> str:
    return "[" + ", ".join(quote(w) for w in words) + "]"


def pick(words: Iterable[str], index: str) -> str:
    words = list(words)
    return f"{listed(words)}[1 + ({index}) % {len(words)}]"


def any_sql(text: str, words: Iterable[str], bounded: Iterable[str] = ()) -> str:
    bounded = set(bounded)
    parts = [f"(^|[^A-Za-z0-9]){re.escape(w)}([^A-Za-z0-9]|$)" if w in bounded else re.escape(w) for w in words]
    return f"regexp_matches(coalesce({text}, ''), {quote('|'.join(parts))})"


def count_sql(text: str, words: Iterable[str]) -> str:
    return f"len(list_filter({listed(words)}, lambda w: contains({text}, w)))"


def weights_sql(text: str, weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, {quote(w)}) THEN {float(x)}::DOUBLE ELSE 0 END" for w, x in weights.items()) + ")"


def cases(pairs: Iterable[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in pairs) + f" ELSE {other} END"


def groups_sql(text: str, groups: Iterable[tuple[str, Iterable[str]]]) -> str:
    """Names of the groups found, sorted and joined by a comma."""
    parts = ", ".join(f"CASE WHEN {any_sql(text, words)} THEN {quote(name)} END" for name, words in groups)
    return f"array_to_string(list_sort(list_distinct(list_filter([{parts}], lambda x: x IS NOT NULL))), ',')"


def title_norm_sql(title: str) -> str:
    # no look-around here: dots that stand between digits are kept by marking them first
    marked = f"regexp_replace(regexp_replace(coalesce({title}, ''), '[^一-龥A-Za-z0-9.]+', '', 'g'), '([0-9])\\.([0-9])', '\\1\x01\\2', 'g')"
    twice = f"regexp_replace({marked}, '([0-9])\\.([0-9])', '\\1\x01\\2', 'g')"
    return f"substr(replace(replace({twice}, '.', ''), '\x01', '.'), 1, 40)"


def title_core_sql(title: str) -> str:
    return f"regexp_replace(coalesce({title}, ''), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


def clean_url_sql(url: str) -> str:
    u = f"regexp_replace(trim(coalesce({url}, '')), '[?#].*$', '')"
    host = f"regexp_replace(lower(regexp_extract({u}, '^[^:/]+://([^/]*)', 1)), '^www\\.', '')"
    path = f"regexp_replace(CASE WHEN regexp_matches({u}, '^[^:/]+://') THEN regexp_extract({u}, '^[^:/]+://[^/]*(.*)$', 1) ELSE {u} END, '/+$', '')"
    return f"CASE WHEN trim(coalesce({url}, '')) = '' THEN '' ELSE lower(regexp_extract({u}, '^([^:/]+)://', 1)) || '://' || {host} || {path} END"


def chars_sql(text: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({text}, ''), lambda c: c <> '')))"


def jaccard_sql(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


def simhash_sql(text: str) -> str:
    grams = f"list_transform(range(1, greatest(length({text}) - 1, 2)), lambda i: ('0x' || substr(md5(substr({text}, i::INTEGER, 3)), 9, 8))::BIGINT)"
    bits = " + ".join(f"CASE WHEN 2 * len(list_filter(h, lambda x: (x >> {b}) & 1 = 1)) > len(h) THEN {1 << b}::BIGINT ELSE 0 END" for b in range(32))
    return f"(SELECT CASE WHEN length({text}) < 5 THEN 0::BIGINT ELSE {bits} END FROM (SELECT {grams} AS h))"


def amounts_sql(text: str) -> str:
    pattern = quote(r"([0-9]+(?:\.[0-9]+)?)\s*(亿|万)")
    each = f"list_zip(regexp_extract_all({text}, {pattern}, 1), regexp_extract_all({text}, {pattern}, 2))"
    return f"array_to_string(list_sort(list_distinct(list_transform({each}, lambda p: p[2] || ':' || printf('%.3e', p[1]::DOUBLE)))), ',')"


FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d", "%Y%m%d", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d", "%Y%m%d %H:%M:%S"]


def time_sql(text: str, formats: int = 9) -> str:
    return "coalesce(" + ", ".join(f"try_strptime(trim({text}), {quote(f)})" for f in FORMATS[:formats]) + ")"


def greedy_sql(p: str, nodes: str, pairs: str) -> str:
    """CTEs that end in {p}_kept (seq): the rows of `nodes` that are not like an earlier kept one. pairs: a < b. Recursive."""
    return f"""{p}_n AS MATERIALIZED (SELECT seq, row_number() OVER (ORDER BY seq) AS i FROM {nodes}), {p}_l AS MATERIALIZED (SELECT b, list(a) AS earlier FROM {pairs} GROUP BY b),
{p}_w AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT n.i, CASE WHEN l.earlier IS NOT NULL AND list_has_any(w.kept, l.earlier) THEN w.kept ELSE list_append(w.kept, n.seq) END FROM {p}_w w JOIN {p}_n n ON n.i = w.i + 1 LEFT JOIN {p}_l l ON l.b = n.seq),
{p}_kept AS (SELECT unnest(kept) AS seq FROM (SELECT kept FROM {p}_w ORDER BY i DESC LIMIT 1))"""
