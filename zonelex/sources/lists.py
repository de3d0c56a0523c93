"""Small text sources: stopword lists, query files, plain and bzip2-compressed text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import with_dense_ids


def read_stopwords(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Words of a list whose first line is their number (1 to 1000)."""
    lines = [r[0].strip() for r in spark.read.text(path).limit(1002).collect()]
    if not lines or not lines[0].isdigit() or not 1 <= int(lines[0]) <= 1000:
        raise ValueError("a stopword list begins with the number of its words, 1 to 1000")
    words = [w for line in lines[1:] for w in line.split()]
    if len(words) < int(lines[0]):
        raise ValueError(f"{lines[0]} words announced, {len(words)} found")
    return tuple(words[: int(lines[0])])


def extract_stopwords(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word) of a commented list: the leading word of each line, where there is one."""
    return lines.select(F.regexp_extract(column, r"^\s*([\w']+)", 1).alias("word")).where("word <> ''")


def parse_query_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(k, query_text) of lines ``K, text``: the number, then everything behind the first space."""
    p = r"^\s*(\d+)[^ ]* (.*)$"
    rows = lines.where(F.col(column).rlike(p))
    return rows.withColumns({"k": F.regexp_extract(column, p, 1).cast("int"), "query_text": F.regexp_extract(column, p, 2)})


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, k, query_text) of a query file, numbered by line. The file is read in splits; a line's number comes from
    its split's place in the file and its place in the split."""
    place = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_seq")]
    lines = with_dense_ids(spark.read.text(path).select("value", *place), ["_path", "_start", "_seq"], "query_id")
    return parse_query_lines(lines).select("query_id", "k", "query_text")


def write_text(rows: DataFrame, path: str, compressed: bool = False) -> None:
    """One string column as text, bzip2-compressed if asked."""
    writer = rows.write.mode("overwrite")
    (writer.option("compression", "bzip2") if compressed else writer).text(path)


def read_text(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """(value) of plain or compressed text, split at a delimiter other than the line end if one is given."""
    reader = spark.read.option("lineSep", delimiter) if delimiter else spark.read
    return reader.text(path)


def text_volume(rows: DataFrame) -> DataFrame:
    """One row: lines and characters."""
    return rows.agg(F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("n_chars"))


def matching_lines(rows: DataFrame, pattern: str) -> DataFrame:
    return rows.where(F.col("value").rlike(pattern))


def archive_problem(spark: SparkSession, path: str) -> str | None:
    """None if compressed text can be read to its end with right check sums, else the first line of what is wrong."""
    try:
        spark.read.text(path).agg(F.count(F.lit(1))).collect()
    except Exception as e:  # noqa: BLE001 - any failure to read is the answer
        return str(e).strip().split("\n")[0] or type(e).__name__
    return None


def page_of_lines(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """(line_no, value) of ``n`` lines of plain or compressed text from the 0-based line ``start`` on."""
    place = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_seq")]
    lines = with_dense_ids(spark.read.text(path).select("value", *place), ["_path", "_start", "_seq"], "line_no")
    return lines.where((F.col("line_no") >= start) & (F.col("line_no") < start + n)).select("line_no", "value")
