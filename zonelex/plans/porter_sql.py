"""The Porter rules as a chain of SQL steps over a vocabulary, for the oracle only (not used by the engine)."""

from __future__ import annotations

from ..functions.porter import STEP_2, STEP_3, STEP_4


def _suffix(suffixes) -> str:
    return "CASE " + " ".join(f"WHEN w LIKE '%{s}' THEN '{s}'" for s in sorted(suffixes, key=len, reverse=True)) + " ELSE '' END"


def _swap(table: dict[str, str]) -> str:
    return "CASE s " + " ".join(f"WHEN '{s}' THEN '{r}'" for s, r in table.items()) + " END"


def porter_cte(source: str, name: str = "stems") -> str:
    """CTEs ending in ``name(tok, stem)`` for a CTE or table ``source(tok)`` of distinct tokens."""
    v, region = "[aeiouy]", "^[^aeiouy]*[aeiouy]+[^aeiouy]"
    short = "regexp_matches({}, '[^aeiouy][aeiouy][^aeiouywxY]$')"
    n = name
    return f"""
{n}_a AS (SELECT tok, regexp_replace(regexp_replace(tok, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {source} WHERE NOT regexp_matches(tok, '[0-9]')),
{n}_b AS (SELECT *, CASE WHEN regexp_matches(w, '{region}') THEN length(regexp_extract(w, '{region}')) ELSE length(w) END AS p1 FROM {n}_a),
{n}_c AS (SELECT *, CASE WHEN regexp_matches(substr(w, p1 + 1), '{region}') THEN p1 + length(regexp_extract(substr(w, p1 + 1), '{region}')) ELSE length(w) END AS p2 FROM {n}_b),
{n}_d AS (SELECT tok, p1, p2, CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, length(w) - 2) WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END AS w FROM {n}_c),
{n}_e AS (SELECT tok, p1, p2, w, CASE WHEN w LIKE '%eed' THEN 0 WHEN w LIKE '%ed' AND regexp_matches(left(w, length(w) - 2), '{v}') THEN 2
  WHEN w LIKE '%ing' AND regexp_matches(left(w, length(w) - 3), '{v}') THEN 3 ELSE 0 END AS c FROM {n}_d),
{n}_f AS (SELECT tok, p1, p2, c, CASE WHEN w LIKE '%eed' AND length(w) - 3 >= p1 THEN left(w, length(w) - 1) ELSE left(w, length(w) - c) END AS w FROM {n}_e),
{n}_g AS (SELECT tok, p1, p2, CASE WHEN c = 0 THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'
  WHEN regexp_matches(w, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(w, length(w) - 1) WHEN length(w) = p1 AND {short.format("w")} THEN w || 'e' ELSE w END AS w FROM {n}_f),
{n}_h AS (SELECT tok, p1, p2, CASE WHEN regexp_matches(w, '[yY]$') AND regexp_matches(left(w, length(w) - 1), '{v}') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM {n}_g),
{n}_i AS (SELECT *, {_suffix(STEP_2)} AS s FROM {n}_h),
{n}_j AS (SELECT tok, p1, p2, CASE WHEN s <> '' AND length(w) - length(s) >= p1 THEN left(w, length(w) - length(s)) || {_swap(STEP_2)} ELSE w END AS w FROM {n}_i),
{n}_k AS (SELECT *, {_suffix(STEP_3)} AS s FROM {n}_j),
{n}_l AS (SELECT tok, p1, p2, CASE WHEN s <> '' AND length(w) - length(s) >= p1 THEN left(w, length(w) - length(s)) || {_swap(STEP_3)} ELSE w END AS w FROM {n}_k),
{n}_m AS (SELECT *, {_suffix(STEP_4)} AS s FROM {n}_l),
{n}_n AS (SELECT tok, p1, p2, CASE WHEN s <> '' AND length(w) - length(s) >= p2 AND (s <> 'ion' OR regexp_matches(w, '[st]ion$')) THEN left(w, length(w) - length(s)) ELSE w END AS w FROM {n}_m),
{n}_o AS (SELECT tok, p1, p2, CASE WHEN w LIKE '%e' AND (length(w) - 1 >= p2 OR (length(w) - 1 >= p1 AND NOT {short.format("left(w, length(w) - 1)")})) THEN left(w, length(w) - 1) ELSE w END AS w FROM {n}_n),
{n}_p AS (SELECT tok, CASE WHEN w LIKE '%ll' AND length(w) - 1 >= p2 THEN left(w, length(w) - 1) ELSE w END AS w FROM {n}_o),
{n} AS (SELECT tok, replace(w, 'Y', 'y') AS stem FROM {n}_p UNION ALL SELECT tok, tok FROM {source} WHERE regexp_matches(tok, '[0-9]'))"""
