"""Problem 4: how characteristic a term is of a record (tf, smoothed idf, length normalisation).

Cases: null terms or records are no postings; a null, empty or unreadable frequency counts 0 uses and scores 0;
repeated rows of one (term, record) count once, the latest; ties in score go to the smaller term in byte order;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codec import total_freq
from ..operators.joins import join_back
from ..operators.postings import latest_postings
from ..session import materialized, table

#: A term used this often or less in a record is not characteristic of it.
TOO_FEW_USES = 2
#: A term in more than this share of the records is common.
COMMON_SHARE = 0.05
TOP = 3


def term_scores(postings: DataFrame) -> DataFrame:
    """(doc_id, term, tf, df, score) for each distinct posting.

    score = (1 + log10 tf) * log10((1 + N) / (1 + df)) / sqrt(length of the record in uses). Counts of terms and
    lengths of records are partially aggregated and joined back; neither a hot term nor a hot record
    meets in one task.
    """
    rows = materialized(latest_postings(postings).select("term", "doc_id", total_freq(F.col("freq")).alias("tf")))
    terms = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    records = rows.groupBy("doc_id").agg(F.count("term").alias("n_terms"), F.sum("tf").alias("doc_uses"))
    whole = records.agg(F.count(F.lit(1)).alias("n_docs"))
    both = join_back(join_back(rows, terms, "term", "df", ["doc_id"]), records, "doc_id", "n_terms", ["term"])
    sublinear = F.when(F.col("tf") > 0, 1 + F.log10("tf")).otherwise(F.lit(0.0))
    idf = F.log10((1 + F.col("n_docs")) / (1 + F.col("df")))
    return both.crossJoin(F.broadcast(whole)).select(
        "doc_id", "term", "tf", "df", "n_docs", (sublinear * idf / F.sqrt(F.greatest("doc_uses", F.lit(1)))).alias("score")
    )


def characteristic(scores: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best terms of each record among those used more than twice and not common. The rank limit is
    applied before the exchange (WindowGroupLimit), so a record's terms are cut down where they are."""
    w = W.partitionBy("doc_id").orderBy(F.round("score", 9).desc(), "term")
    fit = scores.where((F.col("tf") > TOO_FEW_USES) & (F.col("df") <= F.col("n_docs") * F.lit(COMMON_SHARE)))
    return fit.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= top)


def found(spark: SparkSession, d: str) -> DataFrame:
    return characteristic(term_scores(table(spark, d, "posting"))).select("doc_id", "term")


def scores(spark: SparkSession, d: str) -> DataFrame:
    s = term_scores(table(spark, d, "posting"))
    return s.select("doc_id", "term", "tf", "df", F.round("score", 6).alias("score"))


QUERIES = {"p4_found": found, "p4_term_scores": scores}

_TF = " + ".join(
    [f"coalesce(try_cast(regexp_extract(freq, '{p}', 1) AS BIGINT), 0)" for p in ("^([0-9]+)", "i([0-9]+)", "c([0-9]+)", "l([0-9]+)", "r([0-9]+)")]
    + ["least(coalesce(try_cast(regexp_extract(freq, 't([0-9]+)', 1) AS BIGINT), 0), 1)"]
)
_S = f"""r AS (SELECT translate(trim(term), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, doc_id, freq, loaded_at, posting_id FROM posting),
p AS (SELECT term, doc_id, {_TF} AS tf FROM r WHERE term IS NOT NULL AND doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY term, doc_id ORDER BY loaded_at DESC NULLS LAST, posting_id DESC) = 1),
x AS (SELECT doc_id, term, tf, count(*) OVER (PARTITION BY term) AS df, (SELECT count(DISTINCT doc_id) FROM p) AS n, sum(tf) OVER (PARTITION BY doc_id) AS len FROM p),
s AS (SELECT doc_id, term, tf, df, n, CASE WHEN tf > 0 THEN 1 + log10(tf) ELSE 0 END * log10((1 + n) / (1 + df)::DOUBLE) / sqrt(greatest(len, 1)) AS score FROM x)"""

ORACLE = {
    "p4_found": f"""WITH {_S} SELECT doc_id, term FROM s WHERE tf > 2 AND df <= n * 0.05
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term) <= 3""",
    "p4_term_scores": f"WITH {_S} SELECT doc_id, term, tf, df, round(score, 6) AS score FROM s",
}
