"""Page sources: XML dumps, tables of raw pages, and pages assembled from plain documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PAGE


#: The columns that tell where a page stands: its file's place in the list, its split, its place in the split.
PLACE = ["file_no", "block", "seq"]


def read_xml(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_no, block, seq, id, title, text) of dump files or folders, read in one scan; ``file_no`` is the path's place in
    the list. Site information is skipped by the row tag; attributes of elements are ignored; ``.bz2`` files are read as
    they are."""
    if not paths:
        raise ValueError("no dump file")
    reader = spark.read.format("xml").option("rowTag", "page").option("mode", "FAILFAST").option("ignoreSurroundingSpaces", "false").schema(PAGE)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    full = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        full.append(p.getFileSystem(conf).makeQualified(p).toUri().getPath().rstrip("/"))
    here = F.expr("parse_url(_metadata.file_path, 'PATH')")
    number = F.lit(None).cast("int")
    for i, path in sorted(enumerate(full), key=lambda x: len(x[1])):
        number = F.when((here == path) | here.startswith(f"{path}/"), F.lit(i)).otherwise(number)
    place = [number.alias("file_no"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")]
    return reader.load(paths).select(*place, "id", "title", F.col("revision.text").alias("text"))


def from_dump_table(dump: DataFrame) -> DataFrame:
    """(id, title, text) of a table with the schema of the dump; repeated rows once."""
    return dump.select("id", "title", F.col("revision.text").alias("text")).distinct()


def write_xml(pages: DataFrame, path: str) -> None:
    """Pages (title, id, text) as ``<page>`` elements."""
    rows = pages.select("title", "id", F.struct("text").alias("revision"))
    rows.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").mode("overwrite").save(path)


def wikify(documents: DataFrame) -> DataFrame:
    """Pages (id, title, text) with all six zones, assembled from documents by a fixed rule: every 50th title is in the
    ``File:`` space, every 50th text redirects."""
    source, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    title = F.concat(F.when(F.col("doc_id") % 50 == 7, F.lit("File:")).otherwise(F.lit("")), F.lit("Article "), source, F.lit(" "), lang)
    page = F.concat(
        F.lit("{{Infobox doc | lang={{l|"), lang, F.lit("}} | source="), source, F.lit(" }}"), F.coalesce("text", F.lit("")),
        F.lit(" == References == "), source, F.lit(" cited work "), F.lit(" == External links == "), F.lit("link "), lang,
        F.lit("[[Category:"), lang, F.lit(" texts]]"),
    )
    return documents.select(F.col("doc_id").alias("id"), title.alias("title"), F.when(F.col("doc_id") % 50 == 13, F.lit("#REDIRECT [[x]]")).otherwise(page).alias("text"))
