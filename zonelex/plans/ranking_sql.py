"""Query parsing and ranked search in SQL, for the oracle only (not used by the engine)."""

from __future__ import annotations

from .porter_sql import porter_cte

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def query_sql(queries: str) -> str:
    """CTEs ending in ``pq(query_id, zone, boosted, text)`` for a table (query_id, k, query_text)."""
    return f"""q AS (SELECT query_id, k, translate(coalesce(query_text, ''), {_AZ}) AS q FROM {queries} WHERE query_id IS NOT NULL),
parts AS (SELECT query_id, regexp_split_to_array(q, '[ticbrl]:') AS x, regexp_extract_all(q, '([ticbrl]):', 1) AS g FROM q),
zl AS (SELECT * FROM (VALUES (0, 'b', 1.0), (1, 'i', 2.0), (2, 'c', 2.0), (3, 't', 50.0), (4, 'l', 1.0), (5, 'r', 1.0)) AS v(zone, letter, weight)),
pp AS (SELECT query_id, unnest(range(1, len(g) + 1)) AS n, x, g FROM parts),
pq AS (SELECT query_id, zone, false AS boosted, x[1] AS text FROM parts, zl WHERE x[1] <> ''
  UNION ALL SELECT query_id, zl.zone, true, string_agg(x[n + 1], '' ORDER BY n) FROM pp JOIN zl ON zl.letter = g[n] GROUP BY query_id, zl.zone)"""


def token_sql(queries: str) -> str:
    """CTEs ending in ``tk(query_id, zone, boosted, term)``."""
    return f"""{query_sql(queries)}, qt AS (SELECT query_id, zone, boosted, unnest(regexp_extract_all(text, '[a-z0-9]+')) AS tok FROM pq),
qk AS (SELECT * FROM qt WHERE length(tok) BETWEEN 2 AND 25 AND NOT regexp_matches(tok, '^[0-9].*[a-z]') AND NOT regexp_matches(tok, '^[0-9]{{14,}}$')),
qvoc AS (SELECT DISTINCT tok FROM qk), {porter_cte("qvoc", "qstems")},
ta AS (SELECT qk.query_id, qk.zone, qk.boosted, qstems.stem AS term FROM qk JOIN qstems ON qstems.tok = qk.tok), tk AS (SELECT DISTINCT * FROM ta)"""


def score_sql(postings: str, queries: str, titles: str) -> str:
    """CTEs ending in ``sc(query_id, doc_id, score)``; ``postings`` are CTEs that give ``l(term, doc_id, zone, tf)``."""
    return f"""{postings}, {token_sql(queries)}, n AS (SELECT count(*) AS n FROM {titles}), zd AS (SELECT term, zone, count(*) AS df FROM l GROUP BY term, zone),
raw AS (SELECT tk.query_id, l.doc_id, l.zone, (1 + log10(CASE WHEN l.zone = 3 THEN least(l.tf, 1) ELSE l.tf END)) * log10((SELECT n FROM n) / zd.df::DOUBLE)
  * zl.weight * CASE WHEN tk.boosted THEN 100.0 ELSE 1.0 END AS s
  FROM tk JOIN l ON l.term = tk.term AND l.zone = tk.zone JOIN zd ON zd.term = tk.term AND zd.zone = tk.zone JOIN zl ON zl.zone = tk.zone),
sc AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM raw GROUP BY query_id, doc_id)"""


def ranked_sql(postings: str, queries: str, titles: str) -> str:
    """CTEs ending in ``res(query_id, rank, doc_id, title, score, is_padding)``."""
    return f"""{score_sql(postings, queries, titles)}, best AS (SELECT sc.query_id, q.k, sc.doc_id, sc.score, row_number() OVER (PARTITION BY sc.query_id ORDER BY sc.score DESC, sc.doc_id DESC) AS rank
  FROM sc JOIN q ON q.query_id = sc.query_id QUALIFY rank <= q.k),
h AS (SELECT q.query_id, q.k, count(best.doc_id) AS hits FROM q LEFT JOIN best ON best.query_id = q.query_id WHERE q.k > 0 GROUP BY q.query_id, q.k),
cand AS (SELECT query_id, k, hits, unnest(CASE WHEN hits = 0 THEN range(0, k) ELSE range(0, 2 * k + 1) END) AS doc_id FROM h WHERE hits < k),
fill AS (SELECT c.query_id, c.k, c.doc_id, c.hits + row_number() OVER (PARTITION BY c.query_id ORDER BY CASE WHEN c.hits = 0 THEN -c.doc_id ELSE c.doc_id END) AS rank
  FROM cand c WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.query_id = c.query_id AND b.doc_id = c.doc_id)),
res AS (SELECT u.query_id, CAST(u.rank AS INTEGER) AS rank, u.doc_id, coalesce(t.title, '') AS title, round(u.score, 6) AS score, u.is_padding FROM (
  SELECT query_id, rank, doc_id, score, false AS is_padding FROM best UNION ALL SELECT query_id, rank, doc_id, 0.0, true FROM fill WHERE rank <= k) u LEFT JOIN {titles} t ON t.doc_id = u.doc_id)"""
