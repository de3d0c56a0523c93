"""Queries of the index build: pages, zones, tokens, stems, postings, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.porter import stem_column
from ..functions.text import STOPWORDS, ascii_lower, is_digit, is_valid_char, keep_token, words
from ..operators import index as ix
from ..operators.search import search
from ..operators.zones import fragments, infobox_failures, page_terms
from ..session import materialized, table, temporary_path
from ..sources import lists, pages as page_source, storage
from .porter_sql import porter_cte
from .ranking_sql import ranked_sql


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return ix.kept_pages(page_source.wikify(table(spark, d, "documents")))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return ix.with_dense_ids(_pages(spark, d), ["id"])


def page_skip_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "wiki_page").select("page_row", "title", F.col("body").alias("text"))
    return ix.kept_pages(p).select("page_row", "title")


def doc_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "wiki_page").select("page_row", "title", F.col("body").alias("text"))
    return ix.with_dense_ids(ix.kept_pages(p).select("page_row", "title"), ["page_row"]).select("doc_id", "page_row")


def ascii_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = words(ascii_lower(F.coalesce("text", F.lit(""))))
    return table(spark, d, "documents").select("doc_id", F.size(w).cast("bigint").alias("n_tokens"))


def token_filter(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.explode(words(ascii_lower(F.col("text")))).alias("tok"))
    return t.groupBy("tok").agg(F.count(F.lit(1)).alias("n")).where(keep_token(F.col("tok")))


def stopword_extract(spark: SparkSession, d: str) -> DataFrame:
    """The leading word of every line of the corpus, as from a commented list."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return lists.extract_stopwords(lines).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def char_classes(spark: SparkSession, d: str) -> DataFrame:
    """Characters of the titles by class."""
    c = table(spark, d, "doc_title").select(F.explode(F.split("title_raw", "")).alias("c")).where("c <> ''")
    return c.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select("c", "n", is_valid_char(F.col("c")).alias("valid"), is_digit(F.col("c")).alias("digit"))


def porter_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.explode(words(ascii_lower(F.col("text")))).alias("tok")).distinct()
    return t.select("tok", stem_column(F.col("tok")).alias("stem"))


def zone_fragments(spark: SparkSession, d: str) -> DataFrame:
    f = fragments(_numbered(spark, d))
    return f.select("doc_id", "zone", F.size(words(F.col("fragment"))).cast("bigint").alias("n_tokens"))


def _dumped(spark: SparkSession, d: str) -> DataFrame:
    return ix.kept_pages(page_source.from_dump_table(table(spark, d, "dump_page"))).select(F.col("id").alias("doc_id"), "title", "text")


def dump_zones(spark: SparkSession, d: str) -> DataFrame:
    """Zones of the raw page texts of the dump table."""
    return fragments(_dumped(spark, d)).groupBy("zone").agg(F.count(F.lit(1)).alias("n_fragments"), F.sum(F.length("fragment")).alias("n_chars"))


def infobox_failure_log(spark: SparkSession, d: str) -> DataFrame:
    """Raw pages, and how many have an infobox that is never closed (as delivered, and cut off in the middle)."""
    pages = materialized(_dumped(spark, d))
    cut_off = pages.withColumn("text", F.expr("substring(text, 1, length(text) div 2)"))
    failed = [infobox_failures(p).agg(F.count(F.lit(1)).alias("n_unclosed")).withColumn("state", F.lit(state)) for state, p in (("whole", pages), ("half", cut_off))]
    n = pages.agg(F.count(F.lit(1)).alias("n_pages"))
    return failed[0].unionByName(failed[1]).crossJoin(F.broadcast(n)).select("state", "n_pages", "n_unclosed")


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return page_terms(_numbered(spark, d).select("doc_id", "title", "text"))


def term_zone_freq(spark: SparkSession, d: str) -> DataFrame:
    return ix.long_postings(_counted(spark, d))


def postings_wide(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d).select("doc_id", "term", *[F.col("tf")[i].alias(f"tf_{c}") for i, c in enumerate("bictlr")])


def df_filter(spark: SparkSession, d: str) -> DataFrame:
    return ix.long_postings(ix.frequent_postings(materialized(_counted(spark, d))))


def zone_df(spark: SparkSession, d: str) -> DataFrame:
    return ix.zone_frequencies(ix.frequent_postings(materialized(_counted(spark, d))))


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return ix.build_index(_numbered(spark, d)).stats


def term_milestones(spark: SparkSession, d: str) -> DataFrame:
    terms = ix.term_df(materialized(_counted(spark, d))).where("df > 4")
    return ix.milestones(ix.rank_splits(terms))


def exact_milestones(spark: SparkSession, d: str) -> DataFrame:
    return ix.milestones(ix.exact_splits(ix.term_df(materialized(_counted(spark, d)))))


def batch_volume(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.length("text")).alias("n_chars"))


def xml_scan(spark: SparkSession, d: str) -> DataFrame:
    """Write the dump table as XML files and read the folder back."""
    dump = page_source.from_dump_table(table(spark, d, "dump_page"))
    path = temporary_path(spark, "xml")
    page_source.write_xml(dump.where("id is not null and text is not null"), path)
    return page_source.read_xml(spark, [path]).select("id", "title", F.length("text").cast("bigint").alias("n_chars"))


def bz2_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Titles through bzip2-compressed text."""
    path = temporary_path(spark, "bz2")
    lists.write_text(table(spark, d, "doc_title").select("title"), path, compressed=True)
    return lists.text_volume(lists.read_text(spark, path))


def compare_indexes(spark: SparkSession, d: str) -> DataFrame:
    """What the df filter took away."""
    counted = materialized(_counted(spark, d))
    return ix.index_difference(ix.long_postings(counted), ix.long_postings(ix.frequent_postings(counted))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def engine_search(spark: SparkSession, d: str) -> DataFrame:
    """Pages are indexed, the index is written to a folder and read back, and the queries are answered from it."""
    folder = temporary_path(spark, "index")
    storage.write_index(ix.build_index(_numbered(spark, d).select("doc_id", "title", "text")), folder)
    index = storage.read_index(spark, folder)
    queries = table(spark, d, "search_query").select("query_id", "k", "query_text")
    # words of the corpus, as the queries of the table ask for another collection
    words_ = table(spark, d, "subject_area").select((1_000_000 + F.row_number().over(W.orderBy("subject"))).cast("bigint").alias("query_id"), F.lit(10).cast("bigint").alias("k"), F.concat("subject", F.lit(" i:"), "subject", F.lit(" "), "description").alias("query_text"))
    return search(queries.unionByName(words_), index.postings, index.docs, index.stats, index.zone_df).withColumn("score", F.round("score", 6))


QUERIES = {
    "engine_search": engine_search,
    "page_skip_filter": page_skip_filter, "doc_ids": doc_ids, "ascii_tokens": ascii_tokens, "token_filter": token_filter, "stopword_extract": stopword_extract, "char_classes": char_classes,
    "porter_vocabulary": porter_vocabulary, "zone_fragments": zone_fragments, "dump_zones": dump_zones, "infobox_failures": infobox_failure_log, "term_zone_freq": term_zone_freq,
    "postings_wide": postings_wide, "df_filter": df_filter, "zone_df": zone_df, "index_stats": index_stats, "milestones": term_milestones, "milestones_exact": exact_milestones,
    "batch_volume": batch_volume, "xml_scan": xml_scan, "bz2_roundtrip": bz2_roundtrip, "compare_indexes": compare_indexes,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_KEEP = f"""length(tok) BETWEEN 2 AND 25 AND NOT regexp_matches(tok, '^[0-9].*[a-z]') AND NOT regexp_matches(tok, '^[0-9]{{14,}}$')
  AND regexp_replace(tok, '[0-9]', '', 'g') NOT IN ({_STOP})"""
_SKIP = f"""length(title) > 0 AND NOT (starts_with(translate(title, {_AZ}), 'wikipedia:') OR starts_with(translate(title, {_AZ}), 'file:')
  OR starts_with(translate(title, {_AZ}), 'category:') OR starts_with(translate(coalesce(text, ''), {_AZ}), '#redirect'))"""
_Z = f"""k AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, doc_id AS src, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, coalesce(text, '') AS text
  FROM documents WHERE doc_id % 50 NOT IN (7, 13)),
z0 AS (SELECT doc_id, 0 AS zone, text || ' ' AS f FROM k UNION ALL SELECT doc_id, 1, 'infobox doc | lang={{{{l|' || lang || '}}}} | source=' || source FROM k
  UNION ALL SELECT doc_id, 2, 'category:' || lang || ' texts]]' FROM k UNION ALL SELECT doc_id, 3, 'article ' || source || ' ' || lang FROM k
  UNION ALL SELECT doc_id, 4, 'xternal links == link ' || lang FROM k UNION ALL SELECT doc_id, 5, 'eferences == ' || source || ' cited work ' FROM k),
z AS (SELECT doc_id, zone, translate(f, {_AZ}) AS f FROM z0)""".replace("{{{{", "{{").replace("}}}}", "}}")
_T = f"""{_Z}, t AS (SELECT doc_id, zone, unnest(regexp_extract_all(f, '[a-z0-9]+')) AS tok FROM z),
kept AS (SELECT * FROM t WHERE {_KEEP}), voc AS (SELECT DISTINCT tok FROM kept), {porter_cte("voc")},
a AS (SELECT s.stem AS term, kept.doc_id, kept.zone, CAST(count(*) AS INTEGER) AS tf FROM kept JOIN stems s ON s.tok = kept.tok GROUP BY ALL),
d AS (SELECT term, count(DISTINCT doc_id) AS df FROM a GROUP BY term), m AS (SELECT a.* FROM a JOIN d ON d.term = a.term WHERE d.df > 4)"""

#: The zone splitter position by position: every opening, where it ends, and the walk from one to the next.
_WALK = f"""pg AS (SELECT row_number() OVER () AS p, id, translate(title, {_AZ}) AS title, translate(coalesce(text, ''), {_AZ}) AS x
  FROM (SELECT DISTINCT id, title, revision.text AS text FROM dump_page) WHERE {_SKIP}),
ps AS (SELECT p, x, unnest(range(1, length(x) + 1)) AS i FROM pg),
op AS (SELECT p, i, CASE WHEN regexp_matches(substr(x, i, 10), '^\\{{\\{{ ?infobox') THEN 1 WHEN regexp_matches(substr(x, i, 11), '^\\[\\[ ?category') THEN 2
  WHEN regexp_matches(substr(x, i, 20), '^== ?external links ?==') THEN 3 WHEN regexp_matches(substr(x, i, 16), '^== ?references ?==') THEN 4 END AS kind
  FROM ps WHERE substr(x, i, 1) IN ('{{', '[', '=')),
o AS (SELECT * FROM op WHERE kind IS NOT NULL),
br AS (SELECT p, i, substr(x, i, 1) AS c, i - row_number() OVER (PARTITION BY p, substr(x, i, 1) ORDER BY i) AS run FROM ps WHERE substr(x, i, 1) IN ('{{', '}}')),
rn AS (SELECT p, c, min(i) AS i, count(*) // 2 AS n FROM br GROUP BY p, c, run),
tk AS (SELECT p, c, i + 2 * unnest(range(n)) AS j FROM rn WHERE n > 0),
dp AS (SELECT o.p, o.i, tk.j, 1 + sum(CASE tk.c WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY o.p, o.i ORDER BY tk.j) AS depth FROM o JOIN tk ON tk.p = o.p AND tk.j > o.i + 1 WHERE o.kind = 1),
ib AS (SELECT p, i, min(j) + 2 AS e FROM dp WHERE depth = 0 GROUP BY p, i),
cc AS (SELECT o.p, o.i, min(s.i) + 2 AS e FROM o JOIN ps s ON s.p = o.p AND s.i > o.i AND substr(s.x, s.i, 2) = ']]' WHERE o.kind = 2 GROUP BY o.p, o.i),
nx AS (SELECT o.p, o.i, min(f.i) AS e FROM o JOIN o f ON f.p = o.p AND f.i > o.i AND (f.kind = 2 OR o.kind = 4 AND f.kind = 3) WHERE o.kind IN (3, 4) GROUP BY o.p, o.i),
en AS (SELECT o.p, o.i, o.kind, coalesce(ib.e, cc.e, nx.e, length(pg.x) + 1) AS e, o.kind = 1 AND ib.e IS NULL AS failed FROM o JOIN pg ON pg.p = o.p
  LEFT JOIN ib ON ib.p = o.p AND ib.i = o.i LEFT JOIN cc ON cc.p = o.p AND cc.i = o.i LEFT JOIN nx ON nx.p = o.p AND nx.i = o.i),
wk(p, i, e) AS (SELECT p, CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM pg UNION ALL
  SELECT n.p, n.i, en.e FROM (SELECT wk.p, min(en.i) AS i FROM wk JOIN en ON en.p = wk.p AND en.i >= wk.e GROUP BY wk.p, wk.e) n JOIN en ON en.p = n.p AND en.i = n.i),
fr AS (SELECT en.p, en.kind, en.i, en.e, en.failed FROM wk JOIN en ON en.p = wk.p AND en.i = wk.i),
zn AS (SELECT CASE kind WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE kind END AS zone, greatest(0, e - i - CASE WHEN kind < 3 THEN 2 ELSE 4 END) AS n FROM fr
  UNION ALL SELECT 3, length(title) FROM pg
  UNION ALL SELECT 0, n FROM (SELECT length(pg.x) - coalesce(sum(fr.e - fr.i), 0) AS n FROM pg LEFT JOIN fr ON fr.p = pg.p GROUP BY pg.p, pg.x) WHERE n > 0)"""
_SCORED = ranked_sql(
    postings="l AS (SELECT term, doc_id, zone, tf FROM m)",
    queries="""(SELECT query_id, k, query_text FROM search_query UNION ALL
  SELECT 1000000 + row_number() OVER (ORDER BY subject), 10, subject || ' i:' || subject || ' ' || description FROM subject_area)""",
    titles=f"(SELECT doc_id, translate('article ' || source || ' ' || lang, {_AZ}) AS title FROM k)",
)

ORACLE = {
    "engine_search": f"""WITH {_T}, {_SCORED} SELECT * FROM res""",
    "page_skip_filter": f"SELECT page_row, title FROM (SELECT page_row, title, body AS text FROM wiki_page) WHERE {_SKIP}",
    "doc_ids": f"SELECT row_number() OVER (ORDER BY page_row) - 1 AS doc_id, page_row FROM (SELECT page_row, title, body AS text FROM wiki_page) WHERE {_SKIP}",
    "ascii_tokens": f"SELECT doc_id, CAST(len(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[a-z0-9]+')) AS BIGINT) AS n_tokens FROM documents",
    "token_filter": f"""WITH t AS (SELECT unnest(regexp_extract_all(translate(text, {_AZ}), '[a-z0-9]+')) AS tok FROM documents)
SELECT tok, count(*) AS n FROM t WHERE {_KEEP} GROUP BY tok""",
    "stopword_extract": r"""WITH l AS (SELECT regexp_extract(unnest(string_split(text, chr(10))), '^\s*([\w'']+)', 1) AS word FROM documents)
SELECT word, count(*) AS n FROM l WHERE word <> '' GROUP BY word""",
    "char_classes": """WITH c AS (SELECT unnest(regexp_extract_all(title_raw, '(?s).')) AS c FROM doc_title)
SELECT c, count(*) AS n, regexp_matches(c, '^[A-Za-z0-9]$') AS valid, regexp_matches(c, '^[0-9]$') AS digit FROM c GROUP BY c""",
    "porter_vocabulary": f"""WITH voc AS (SELECT DISTINCT unnest(regexp_extract_all(translate(text, {_AZ}), '[a-z0-9]+')) AS tok FROM documents), {porter_cte("voc")}
SELECT tok, stem FROM stems""",
    "zone_fragments": f"WITH {_Z} SELECT doc_id, zone, CAST(len(regexp_extract_all(f, '[a-z0-9]+')) AS BIGINT) AS n_tokens FROM z",
    "dump_zones": f"WITH RECURSIVE {_WALK} SELECT CAST(zone AS INTEGER) AS zone, count(*) AS n_fragments, CAST(sum(n) AS BIGINT) AS n_chars FROM zn GROUP BY zone",
    "infobox_failures": " UNION ALL ".join(
        f"SELECT * FROM (WITH RECURSIVE {_WALK.replace('revision.text AS text FROM', of + ' AS text FROM')} SELECT '{state}' AS state, (SELECT count(*) FROM pg) AS n_pages, (SELECT count(DISTINCT p) FROM fr WHERE failed) AS n_unclosed)"
        for state, of in (("whole", "revision.text"), ("half", "substr(revision.text, 1, length(revision.text) // 2)"))
    ),
    "term_zone_freq": f"WITH {_T} SELECT term, zone, doc_id, tf FROM a",
    "postings_wide": f"WITH {_T} SELECT doc_id, term, "
    + ", ".join(f"CAST(coalesce(sum(tf) FILTER (WHERE zone = {i}), 0) AS INTEGER) AS tf_{c}" for i, c in enumerate("bictlr"))
    + " FROM a GROUP BY doc_id, term",
    "df_filter": f"WITH {_T} SELECT term, zone, doc_id, tf FROM m",
    "zone_df": f"WITH {_T} SELECT term, zone, count(*) AS df FROM m GROUP BY term, zone",
    "index_stats": f"""WITH {_T} SELECT (SELECT count(*) FROM k) AS total_docs, (SELECT CAST(sum(tf) AS BIGINT) FROM a) AS total_tokens,
  (SELECT count(DISTINCT term) FROM m) AS total_terms, (SELECT CAST(ceil(count(DISTINCT term) / 10000.0) AS BIGINT) FROM m) AS splits""",
    "milestones": f"""WITH {_T}, r AS (SELECT term, (row_number() OVER (ORDER BY term) - 1) // 10000 AS split FROM d WHERE df > 4)
SELECT split, min(term) AS first_term, count(*) AS n_terms FROM r GROUP BY split""",
    "milestones_exact": f"""WITH RECURSIVE {_T}, o AS (SELECT term, df, row_number() OVER (ORDER BY term) AS i, CAST(sum(df) OVER (ORDER BY term) AS BIGINT) AS seen FROM d),
s(a, seen) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL
  SELECT e.i, e.seen FROM (SELECT s.a, min(o.i) AS i, min(o.seen) AS seen FROM s, o WHERE o.i > s.a AND (o.i - s.a >= 10000 OR o.seen - s.seen >= 1000000) GROUP BY s.a) e),
b AS (SELECT o.term, max(s.a) AS a FROM o, s WHERE s.a < o.i AND o.df > 4 GROUP BY o.term)
SELECT dense_rank() OVER (ORDER BY a) - 1 AS split, min(term) AS first_term, count(*) AS n_terms FROM b GROUP BY a""",
    "batch_volume": f"""WITH {_Z} SELECT count(*) AS n_pages, CAST(sum(length('{{{{Infobox doc | lang={{{{l|' || lang || '}}}} | source=' || source || ' }}}}' || text || ' == References == ' || source
  || ' cited work  == External links == link ' || lang || '[[Category:' || lang || ' texts]]')) AS BIGINT) AS n_chars FROM k""",
    "xml_scan": "SELECT DISTINCT id, title, length(revision.text) AS n_chars FROM dump_page WHERE id IS NOT NULL AND revision.text IS NOT NULL",
    "bz2_roundtrip": "SELECT count(*) AS n_lines, CAST(sum(length(title)) AS BIGINT) AS n_chars FROM doc_title",
    "compare_indexes": f"WITH {_T} SELECT 'left' AS side, (SELECT count(*) FROM a) - (SELECT count(*) FROM m) AS n",
}
