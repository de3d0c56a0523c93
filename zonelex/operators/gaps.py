"""Gap coding of postings lists: the first id of a term as it is, every later one as its distance from the one before.

A hot term's list is as long as a third of all postings, so no window runs over a whole term. Rows are range-ordered by
(term, id) once and written with their partition and place; windows run inside a partition, and what crosses a border (one
row, or one sum a term and partition) is carried over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialized


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    return materialized(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    )


def gap_encode(postings: DataFrame) -> DataFrame:
    """Add ``gap`` to postings (term, doc_id, ...); each (term, doc_id) once."""
    placed = _placed(postings, "term", "doc_id")
    inside = W.partitionBy("_part").orderBy("_place")
    last = placed.groupBy("_part").agg(F.max_by(F.struct("term", "doc_id"), "_place").alias("_last"))
    borders = last.select("_part", F.lag("_last").over(W.orderBy("_part")).alias("_border"))
    before = F.coalesce(F.lag(F.struct("term", "doc_id")).over(inside), F.col("_border"))
    rows = placed.join(F.broadcast(borders), "_part").withColumn("_before", before)
    same = F.coalesce(F.col("_before.term") == F.col("term"), F.lit(False))
    return rows.withColumn("gap", F.col("doc_id") - F.when(same, F.col("_before.doc_id")).otherwise(F.lit(0))).select(*postings.columns, "gap")


def gap_decode(gaps: DataFrame, order: str) -> DataFrame:
    """Add ``doc_id`` to (term, gap, ``order``, ...): the running sum of a term's gaps."""
    placed = _placed(gaps, "term", order)
    inside = W.partitionBy("_part", "term").orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy("term").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy("_part", "term").agg(F.sum("gap").alias("_sum"))
    starts = sums.select("_part", "term", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    rows = placed.withColumn("_here", F.sum("gap").over(inside)).join(starts, ["_part", "term"])
    return rows.select(*gaps.columns, (F.col("_start") + F.col("_here")).alias("doc_id"))
