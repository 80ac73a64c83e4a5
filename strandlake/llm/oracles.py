"""The queries whose results SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

from .secret_scan import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p : p + n - 1], ' '))) AS g FROM sized),
grams AS (SELECT r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda p: {{'p': p, 'g': array_to_string(w[p : p + n - 1], ' ')}})) AS x FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT r, grams.n, x.p AS p, id FROM grams JOIN windows ON grams.n = windows.n AND x.g = windows.g),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""


def _spans(kind: str, order: int, pattern: str, group: int, least: int, base: bool) -> str:
    """A list of the matches of one kind, in order of the text."""
    p = "'" + pattern.replace("'", "''") + "'"
    sizes = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    each = f"list_transform(range(1, len(m) + 1), lambda k: {{'s': CAST({sizes('gaps[1 : k]')} + {sizes('m[1 : k - 1]')} AS BIGINT), 'o': {order}, 'n': length(m[k]), 'g': length(g[k])}})"
    listed = f"list_transform(list_filter({each}, lambda x: x.g >= {least}), lambda x: {{'s': x.s, 'o': x.o, 'kind': '{kind}', 'base': {base}, 'e': x.s + x.n}})"
    return f"(SELECT {listed} FROM (SELECT string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS g))"


#: The base patterns as the contract words them; the method's own come after.
_BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)


def secret_sql() -> str:
    kinds = [_spans(kind, i, pattern, group, least, True) for i, (kind, pattern, group, least) in enumerate(_BASE)]
    kinds += [_spans(r.kind, i, r.pattern, r.group, r.least, False) for i, r in enumerate(RULES) if not r.base]
    shown = lambda x: f"array_to_string(list_transform({x}, lambda x: x.kind || ':' || x.s || ':' || x.e), ',')"
    base = "list_filter(s, lambda x: x.base)"
    counts = ", ".join(f"CAST(len(list_filter(s, lambda x: x.kind = '{k}')) AS BIGINT) AS n_{k}" for k, *_ in _BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, list_sort(flatten([{', '.join(kinds)}])) AS s FROM d)
SELECT doc_id, {counts}, sha256(coalesce({shown(base)}, '')) AS base_sha256, coalesce({shown('s')}, '') AS spans FROM found
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": DECONTAMINATE, "op3_secret_scan": secret_sql()}
