"""Problem 3: totals per term and per milestone split of the posting table, with the work evenly spread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import total_freq
from ..operators.postings import clean_term, split_starts, with_split
from ..operators.skew import heavy_keys, per_key_totals
from ..session import table

TERM_SHARE = 0.01
SPLIT_SHARE = 0.05


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posting").select(
        clean_term(F.col("term")).alias("term"), F.col("doc_id"), total_freq(F.col("freq")).alias("uses")
    )


def _by_split(spark: SparkSession, d: str) -> DataFrame:
    return with_split(_rows(spark, d), table(spark, d, "milestone"), ["doc_id", "uses"]).select("first_term", "doc_id", "uses")


def _split_totals(spark: SparkSession, d: str) -> DataFrame:
    return per_key_totals(_by_split(spark, d), "first_term", "uses", "doc_id", stable=_few_splits(spark, d))


def _few_splits(spark: SparkSession, d: str) -> bool:
    """With few splits the rows with their splits are still a projection of the file scan."""
    return split_starts(table(spark, d, "milestone")) is not None


def term_totals(spark: SparkSession, d: str) -> DataFrame:
    t = per_key_totals(_rows(spark, d), "term", "uses", "doc_id", stable=True)
    return t.where("term is not null").select("term", "n_rows", F.col("total").alias("uses"), F.col("low").alias("first_doc"), F.col("high").alias("last_doc"))


def split_totals(spark: SparkSession, d: str) -> DataFrame:
    t = _split_totals(spark, d)
    return t.where("first_term is not null").select("first_term", "n_rows", F.col("total").alias("uses"), F.col("low").alias("first_doc"), F.col("high").alias("last_doc"))


def chunk_balance(spark: SparkSession, d: str) -> DataFrame:
    """How evenly the work of the splits was spread: chunks and the largest of them."""
    t = _split_totals(spark, d)
    return t.where("first_term is not null").select("first_term", "n_rows", "n_chunks", "largest_chunk")


def found(spark: SparkSession, d: str) -> DataFrame:
    """Heavy terms and heavy splits, each from the folded chunks of its own keys."""
    terms = per_key_totals(_rows(spark, d), "term", "uses", "doc_id", stable=True)
    splits = _split_totals(spark, d)
    posting = table(spark, d, "posting")
    heavy = heavy_keys(terms, "term", TERM_SHARE, posting).select(F.lit("term").alias("key_kind"), F.col("term").alias("key_word"))
    return heavy.unionByName(heavy_keys(splits, "first_term", SPLIT_SHARE, posting).select(F.lit("milestone").alias("key_kind"), F.col("first_term").alias("key_word")))


QUERIES = {"p3_found": found, "p3_term_totals": term_totals, "p3_split_totals": split_totals, "p3_chunk_balance": chunk_balance}

_P = """p AS (SELECT translate(trim(term), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, doc_id,
  coalesce(try_cast(regexp_extract(freq, '^([0-9]+)', 1) AS BIGINT), 0) + coalesce(try_cast(regexp_extract(freq, 'i([0-9]+)', 1) AS BIGINT), 0)
  + coalesce(try_cast(regexp_extract(freq, 'c([0-9]+)', 1) AS BIGINT), 0) + least(coalesce(try_cast(regexp_extract(freq, 't([0-9]+)', 1) AS BIGINT), 0), 1)
  + coalesce(try_cast(regexp_extract(freq, 'l([0-9]+)', 1) AS BIGINT), 0) + coalesce(try_cast(regexp_extract(freq, 'r([0-9]+)', 1) AS BIGINT), 0) AS uses
  FROM posting)"""
_M = """m AS (SELECT DISTINCT first_term FROM milestone WHERE first_term IS NOT NULL),
t AS (SELECT term, doc_id, uses FROM p WHERE term IS NOT NULL),
s AS (SELECT v.first_term, t.doc_id, t.uses FROM t JOIN (SELECT d.term, max(m.first_term) AS first_term
  FROM (SELECT DISTINCT term FROM t) d JOIN m ON m.first_term <= d.term GROUP BY d.term) v ON v.term = t.term)"""
_AGG = "CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(uses) AS BIGINT) AS uses, min(doc_id) AS first_doc, max(doc_id) AS last_doc"

ORACLE = {
    "p3_found": f"""WITH {_P}, {_M}, n AS (SELECT count(*) AS c FROM posting)
SELECT 'term' AS key_kind, term AS key_word FROM t GROUP BY term HAVING count(*) >= 0.01 * (SELECT c FROM n)
UNION ALL SELECT 'milestone', first_term FROM s GROUP BY first_term HAVING count(*) >= 0.05 * (SELECT c FROM n)""",
    "p3_term_totals": f"WITH {_P}, {_M} SELECT term, {_AGG} FROM t GROUP BY term",
    "p3_split_totals": f"WITH {_P}, {_M} SELECT first_term, {_AGG} FROM s GROUP BY first_term",
    "p3_chunk_balance": f"""WITH {_P}, {_M} SELECT first_term, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(ceil(count(*) / 20000.0) AS BIGINT) AS n_chunks, CAST(least(count(*), 20000) AS BIGINT) AS largest_chunk FROM s GROUP BY first_term""",
}
