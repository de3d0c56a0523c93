"""Index pages as they arrive (an extension: the batch build has no stream).

Each micro-batch of page files is split, counted and appended to the long posting table. Document frequencies depend on
all postings and are recomputed by the batch job; a page delivered again within the watermark is taken once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import kept_pages, long_postings
from ..operators.zones import page_terms

ARRIVING = "doc_id BIGINT, title STRING, text STRING, arrived TIMESTAMP"


def arriving_pages(spark: SparkSession, path: str, lateness: str = "1 day", file_format: str = "parquet") -> DataFrame:
    """Pages of a folder of files (``parquet``, ``json`` or any other source of files), each doc_id once within ``lateness``."""
    stream = spark.readStream.schema(ARRIVING).format(file_format).load(path)
    return stream.withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["doc_id"])


def start_ingest(pages: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the postings of arriving pages to ``out``. Files and checkpoint make each page count exactly once."""
    postings = long_postings(page_terms(kept_pages(pages).select("doc_id", "title", "text")))
    writer = postings.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrivals_by_hour(pages: DataFrame) -> DataFrame:
    """Pages by hour of arrival, late ones included up to the watermark."""
    return pages.groupBy(F.window("arrived", "1 hour")).agg(F.count(F.lit(1)).alias("n_pages"))
