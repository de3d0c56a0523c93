"""The index folder: Parquet tables, and the plain-text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codec import FREQ_ORDER, decode_freq
from ..operators.index import Index, milestones, of_postings, rank_splits
from ..schema import MIN_DF
from ..session import materialized

TABLES = ("docs", "postings", "zone_df", "terms", "milestones", "stats")


def write_index(index: Index, path: str, records_per_file: int = 1_000_000) -> None:
    """Postings are range-partitioned and sorted by term, so that a search skips row groups by their statistics."""
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    index.wide.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("maxRecordsPerFile", records_per_file).parquet(f"{path}/postings")
    index.zone_df.repartitionByRange("term").sortWithinPartitions("term", "zone").write.mode("overwrite").parquet(f"{path}/zone_df")
    splits = rank_splits(index.terms)
    splits.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    milestones(index.docs.sparkSession.read.parquet(f"{path}/terms")).write.mode("overwrite").parquet(f"{path}/milestones")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str) -> Index:
    r = spark.read
    return Index(r.parquet(f"{path}/docs"), r.parquet(f"{path}/postings"), r.parquet(f"{path}/terms").select("term", "df"), r.parquet(f"{path}/zone_df"), r.parquet(f"{path}/stats"))


def read_partial(spark: SparkSession, folder: str) -> DataFrame:
    """(term, doc_id, tf) of partial index files: ``i<n>`` holds the number of terms, then each term with its number of
    postings; ``iid<n>`` the document ids and ``if<n>`` the frequency strings of all postings in the same order. A file belongs to
    one batch of pages and is read by one task; batches are read side by side."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    pieces = F.split(F.trim("value"), r"\s+")
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(name, r"^(i|iid|if)(\d+)(?:\.\w+)?$", 1).alias("kind"), F.regexp_extract(name, r"(\d+)", 1).alias("n"), pieces.alias("p"))

    def listed(kind: str, column: str) -> DataFrame:
        return files.where(F.col("kind") == kind).select("n", F.posexplode("p").alias("at", column))

    pairs = files.where("kind = 'i'").select("n", F.posexplode(F.expr("transform(sequence(1, int(p[0])), x -> struct(p[2 * x - 1] AS term, int(p[2 * x]) AS df))")).alias("place", "x"))
    start = F.sum("x.df").over(W.partitionBy("n").orderBy("place")) - F.col("x.df")
    placed = pairs.where("x.df > 0").select("n", "x.term", "x.df", start.alias("start"))
    terms = placed.select("n", "term", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("df") - 1)).alias("at"))
    both = terms.join(listed("iid", "doc"), ["n", "at"]).join(listed("if", "freq"), ["n", "at"])
    tf = F.array(*[decode_freq(F.col("freq"), letter, clamp_title=False) for letter in FREQ_ORDER])
    return both.select("term", F.col("doc").cast("bigint").alias("doc_id"), tf.alias("tf"))


def merge_indexes(spark: SparkSession, parts: list[str], min_df: int = MIN_DF) -> Index:
    """One index of several index folders, built without a df filter (``min_df`` 1), whose pages follow one another."""
    indexes = [read_index(spark, p) for p in parts]
    before, docs, wide = 0, None, None
    for index in indexes:
        shifted = [t.withColumn("doc_id", F.col("doc_id") + F.lit(before)) for t in (index.docs, index.wide)]
        docs, wide = shifted if docs is None else (docs.unionByName(shifted[0]), wide.unionByName(shifted[1]))
        before += index.stats.first()["total_docs"]
    return of_postings(docs, materialized(wide.select("term", "doc_id", "tf")), min_df)


def write_titles(docs: DataFrame, path: str) -> None:
    """One lower-case title a line, in id order; files are in order too, so their concatenation has line = id."""
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("title").write.mode("overwrite").text(path)


def write_failures(failures: DataFrame, path: str) -> None:
    failures.select(F.concat(F.lit("!"), "title")).write.mode("overwrite").text(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """The figures of the index as one line of text: documents, tokens, terms, splits."""
    stats.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("total_docs", "total_tokens", "total_terms", "splits")])).write.mode("overwrite").text(path)


def write_results(lines: DataFrame, path: str, seconds: float | None = None) -> None:
    """Result lines in query and rank order; with ``seconds``, each query is followed by the seconds of its batch (its
    queries are answered together) and a blank line."""
    if seconds is not None:
        last = lines.select("query_id").distinct()
        ends = F.explode(F.array(F.struct(F.lit(2**31 - 2).alias("rank"), F.lit(f"{seconds:.6f}").alias("line")), F.struct(F.lit(2**31 - 1).alias("rank"), F.lit("").alias("line"))))
        lines = lines.select("query_id", "rank", "line").unionByName(last.select("query_id", ends.alias("e")).select("query_id", "e.*"))
    lines.repartitionByRange("query_id").sortWithinPartitions("query_id", "rank").select("line").write.mode("overwrite").text(path)
