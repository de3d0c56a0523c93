"""Per-key results when a few keys hold most rows: exact offset chunking.

1. Count the rows of every key in every input partition (partial aggregation, no row is moved).
2. Prefix sums over the partitions give each (partition, key) the number its first row has within its key.
3. Rows are numbered inside (partition, key), which no hot key can outgrow: it is a part of one input split.
4. ``number div chunk_rows`` makes chunks of at most ``chunk_rows`` rows; each is folded by one task.
5. The boundary states of a key's chunks are merged in chunk order.

No row is dropped, sampled or salted at random, so a recomputed task gives the same chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialized

CHUNK_ROWS = 20_000


def number_rows(df: DataFrame, key: str, stable: bool = False) -> DataFrame:
    """Add ``_number``, the 0-based number of the row within its key in input order, exact and dense.

    The input is read twice and must give the same rows in the same partitions. A projection of a file scan does, and
    its caller says so by ``stable``; anything else (an exchange may be coalesced differently each time) is written to the
    shared folder first. Null keys are numbered like any other key. Columns may have any names but the ones added here.
    """
    if not stable:
        df = materialized(df)
    tagged = df.withColumns({"_pid": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()})
    counts = tagged.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.col(key).alias("_key"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_pid", key).orderBy("_seq")
    numbered = tagged.withColumn("_rn", F.row_number().over(inside) - 1)
    same = (numbered["_pid"] == offsets["_pid"]) & numbered[key].eqNullSafe(offsets["_key"])
    return numbered.join(offsets, same, "inner").select(
        *[numbered[c] for c in df.columns], (F.col("_offset") + F.col("_rn")).alias("_number")
    )


def chunk_states(df: DataFrame, key: str, value: str, item: str, chunk_rows: int = CHUNK_ROWS, stable: bool = False) -> DataFrame:
    """One boundary state per (key, chunk): rows, sum of ``value``, smallest and largest ``item``, and for the
    merge in order the first and last item of the chunk with the number of direct repeats inside it."""
    numbered = number_rows(df.select(key, value, item), key, stable).withColumn("_chunk", F.floor(F.col("_number") / chunk_rows).cast("bigint"))
    w = W.partitionBy(key, "_chunk").orderBy("_number")
    steps = numbered.withColumn("_again", F.col(item).eqNullSafe(F.lag(item).over(w)) & F.lag(F.lit(1)).over(w).isNotNull())
    return steps.groupBy(key, "_chunk").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias("total"),
        F.min(item).alias("low"),
        F.max(item).alias("high"),
        F.min_by(item, "_number").alias("first"),
        F.max_by(item, "_number").alias("last"),
        F.count_if("_again").alias("repeats"),
    )


def merge_states(states: DataFrame, key: str) -> DataFrame:
    """Fold the chunks of each key in order. At most rows/chunk_rows + 1 states of a key meet in one task; a
    window on (key, order of chunks) joins neighbours, then a partial aggregation adds them."""
    w = W.partitionBy(key).orderBy("_chunk")
    joined = states.withColumn(
        "_joint", (F.lag(F.lit(1)).over(w).isNotNull() & F.col("first").eqNullSafe(F.lag("last").over(w))).cast("bigint")
    )
    return joined.groupBy(key).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("total").alias("total"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        (F.sum("repeats") + F.sum("_joint")).alias("repeats"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.max("n_rows").alias("largest_chunk"),
    )


def per_key_totals(df: DataFrame, key: str, value: str, item: str, chunk_rows: int = CHUNK_ROWS, stable: bool = False) -> DataFrame:
    """Totals per key by offset chunking: n_rows, total, low, high, repeats, n_chunks, largest_chunk.

    Null keys form one group of their own, null values add nothing, an empty table gives no rows. Tied and
    repeated rows each count.
    """
    return merge_states(chunk_states(df, key, value, item, chunk_rows, stable), key)


def heavy_keys(totals: DataFrame, key: str, share: float, rows: DataFrame) -> DataFrame:
    """The keys with at least ``share`` of all ``rows`` (null keys count in the whole but are never reported)."""
    whole = rows.agg(F.count(F.lit(1)).alias("_all"))
    return totals.crossJoin(F.broadcast(whole)).where((F.col("n_rows") >= F.col("_all") * F.lit(share)) & F.col(key).isNotNull()).drop("_all")


def running_totals(df: DataFrame, key: str, value: str, chunk_rows: int = CHUNK_ROWS, stable: bool = False) -> DataFrame:
    """Per row, the sum of ``value`` over its key up to and with the row, in input order, without one task per
    key: sums of chunks, a prefix sum over chunks, then a window inside each chunk."""
    numbered = materialized(number_rows(df, key, stable)).withColumn("_chunk", F.floor(F.col("_number") / chunk_rows).cast("bigint"))
    sums = numbered.groupBy(key, "_chunk").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    before = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col(key).alias("_key"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(key, "_chunk").orderBy("_number").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        numbered.withColumn("_part", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, numbered[key].eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_c")))
        .select(*[numbered[c] for c in df.columns], F.col("_number").alias("number"), (F.col("_start") + F.col("_part")).alias("running"))
    )
