"""The posting table: clean terms, the row that counts, and the split a term belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from ..session import materialized
from .joins import join_back

#: Up to this many split starts become a comparison tree inside the plan; more are looked up by a range join.
MAX_SPLITS_IN_PLAN = 1024


def clean_term(c: Column) -> Column:
    """Trim blanks, lower A-Z."""
    return ascii_lower(F.trim(c))


def latest_postings(postings: DataFrame) -> DataFrame:
    """One row per (term, doc_id): the latest ``loaded_at``, then the largest ``posting_id``.

    Null terms or doc_ids are no postings. A null ``loaded_at`` is older than any other. One exchange on
    (term, doc_id) with map-side combining, so a hot term is spread over all tasks.
    """
    rows = postings.select(
        clean_term(F.col("term")).alias("term"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.struct("loaded_at", "posting_id", "freq").alias("row"),
    ).where("term is not null and doc_id is not null")
    return rows.groupBy("term", "doc_id").agg(F.max("row").alias("row")).select("term", "doc_id", F.col("row.freq").alias("freq"))


def split_starts(milestones: DataFrame, bound: int | None = None) -> list[str] | None:
    """The distinct first terms in byte order, None if there are more than ``bound``."""
    bound = MAX_SPLITS_IN_PLAN if bound is None else bound
    rows = milestones.select("first_term").where("first_term is not null").distinct().limit(bound + 1).collect()
    return sorted((r[0] for r in rows), key=lambda t: t.encode()) if len(rows) <= bound else None


def split_of(term: Column, starts: list[str]) -> Column:
    """The greatest start not above ``term`` in byte order (null below all), as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:  # the answer is starts[lo..hi], index -1 is none
        if lo == hi:
            return F.lit(starts[lo]) if lo >= 0 else F.lit(None).cast("string")
        mid = (lo + hi + 1) // 2
        return F.when(term >= F.lit(starts[mid]), tree(mid, hi)).otherwise(tree(lo, mid - 1))

    if not starts:
        return F.lit(None).cast("string")
    return F.when(term.isNotNull(), tree(-1, len(starts) - 1))


def split_by_range_join(terms: DataFrame, milestones: DataFrame) -> DataFrame:
    """(term, first_term) of distinct terms, for any number of splits: both sides are range-ordered by term once and
    written with their place, the last start seen is carried forward inside a partition, and over the borders of
    partitions from a broadcast of one row a partition."""
    starts = milestones.select(F.col("first_term").alias("term"), F.lit(0).alias("kind")).where("term is not null").distinct()
    both = starts.unionByName(terms.where("term is not null").select("term", F.lit(1).alias("kind")).distinct())
    placed = materialized(
        both.repartitionByRange("term", "kind")
        .sortWithinPartitions("term", "kind")
        .withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id(), "_start": F.when(F.col("kind") == 0, F.col("term"))})
    )
    inside = W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow)
    tops = placed.groupBy("_part").agg(F.max("_start").alias("_top"))
    carried = tops.select("_part", F.max("_top").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    seen = placed.withColumn("_start", F.last("_start", ignorenulls=True).over(inside)).where("kind = 1")
    return seen.join(F.broadcast(carried), "_part").select("term", F.coalesce("_start", "_carried").alias("first_term"))


def with_split(rows: DataFrame, milestones: DataFrame, spread_by: list[str]) -> DataFrame:
    """Add ``first_term``, the split of each row's ``term`` (null below all starts and for a null term). Up to
    ``MAX_SPLITS_IN_PLAN`` starts are compared inside the plan; more are looked up by the range join and joined back to
    the rows, hot terms spread by ``spread_by``."""
    starts = split_starts(milestones)
    if starts is not None:
        return rows.withColumn("first_term", split_of(F.col("term"), starts))
    counts = rows.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("_n"))
    known = join_back(rows.where("term is not null"), split_by_range_join(counts, milestones).join(counts, "term"), "term", "_n", spread_by)
    nothing = rows.where("term is null").withColumn("first_term", F.lit(None).cast("string"))
    return known.drop("_n").unionByName(nothing)
