"""Joining per-key statistics back to rows when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialized

#: A key with at least this share of all rows is hot; so at most 1 / HOT_SHARE keys are broadcast.
HOT_SHARE = 0.001
SPREAD = 256


def join_back(rows: DataFrame, stats: DataFrame, key: str, count: str, spread_by: list[str], outer: bool = False) -> DataFrame:
    """Inner join (left join if ``outer``) of ``rows`` with ``stats`` (one row per ``key``; ``count`` is the key's number of rows).

    Hot keys, at most ``1 / HOT_SHARE`` of them whatever the input, are broadcast, and their rows go through the
    exchange spread by a hash of ``spread_by``; all other keys meet in a shuffled join. Rows with a null key match nothing.
    ``stats`` is read three times and so written once.
    """
    stats = materialized(stats)
    values = [c for c in stats.columns if c != key]
    whole = stats.agg(F.sum(count).alias("_all"))
    hot = (
        stats.crossJoin(F.broadcast(whole))
        .where(F.col(count) >= F.col("_all") * F.lit(HOT_SHARE))
        .select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    )
    cold = stats.select(F.col(key).alias("_cold"), F.lit(0).alias("_no_salt"), *[F.col(c).alias(f"_cold_{c}") for c in values])
    marked = rows.join(F.broadcast(hot), rows[key] == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(-1 - F.pmod(F.hash(*spread_by), F.lit(SPREAD)))
    )
    joined = marked.join(cold, (F.col(key) == F.col("_cold")) & (F.col("_salt") == F.col("_no_salt")), "left")
    return (
        (joined if outer else joined.where("_hot is not null or _cold is not null"))
        .select(*[F.col(c) for c in rows.columns], *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in values])
    )
