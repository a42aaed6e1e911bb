"""DuckDB SQL for base spans: leftmost matches of a pattern with their places, which pass a test."""

from __future__ import annotations

from collections.abc import Iterable


def _spans(kind: str, pattern: str) -> str:
    ahead = "list_sum(list_transform(between[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1 : i - 1], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, '{kind}' AS kind, found[i] AS s, ({ahead})::BIGINT AS a
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS between FROM texts),
             unnest(range(1, len(found) + 1)) AS u(i)"""


def base_sql(kinds: Iterable[tuple[str, str, str]]) -> str:
    """(name, pattern, test of the match s) of each kind to counts and the digest of all spans in order."""
    kinds = list(kinds)
    found = " UNION ALL ".join(f"(SELECT *, {n} AS k FROM ({_spans(name, pattern)}) WHERE {test})" for n, (name, pattern, test) in enumerate(kinds))
    counts = ", ".join(f"count(*) FILTER (kind = '{name}') AS n_{name}" for name, _, _ in kinds)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS MATERIALIZED ({found})
SELECT d.doc_id, {counts},
       sha256(coalesce(string_agg(kind || ':' || a || ':' || (a + length(s)), ',' ORDER BY a, k), '')) AS base_sha256
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""
