"""Problem 5: uses and records of every term, from a vertical layout of compressed record bitmaps.

1. Each task turns its rows into partial bitmaps: per term, containers of 65,536 records with a counter of uses beside
   them. A container is stored in its smallest form: sorted 16-bit places, a bitmap of 8 KiB, or runs.
2. Partial containers meet in one exchange by (term, container) and are merged by union, in a stream over the sorted
   partition that holds one container at a time. So a hot term is spread over as many tasks as it has containers, its
   rows are already folded, and repeated rows set the same bit again.
3. The layout is written once; document frequency is the sum of the cardinalities of a term's containers.

Cases: null terms and null records are left out; a null, empty or unreadable frequency counts as 0 uses of a record
that still counts; negative records are records like others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import total_freq
from ..functions.text import ascii_lower, words
from ..operators.postings import clean_term, latest_postings, with_split
from ..session import materialized, table

RARE_RECORDS = 4
COMMON_SHARE = 0.5
#: Records of a container, and the most that are listed instead of mapped.
CONTAINER = 1 << 16
MOST_LISTED = 4096
#: Rows folded at once in a task.
AT_ONCE = 1 << 18
ARRAY, BITMAP, RUNS = 0, 1, 2
LAYOUT = "term string, container bigint, form tinyint, n_records int, uses bigint, data binary"


def pack(places: np.ndarray) -> tuple[int, bytes]:
    """The smallest form of sorted distinct 16-bit places."""
    first = np.flatnonzero(np.r_[True, np.diff(places.astype(np.int32)) != 1])
    least = min(2 * len(places), CONTAINER // 8)
    if 4 * len(first) < least:
        last = places[np.r_[first[1:] - 1, len(places) - 1]]
        return RUNS, np.stack([places[first], last], 1).astype("<u2").tobytes()
    if len(places) <= MOST_LISTED:
        return ARRAY, places.astype("<u2").tobytes()
    bits = np.zeros(CONTAINER, bool)
    bits[places] = True
    return BITMAP, np.packbits(bits, bitorder="little").tobytes()


def unpack(form: int, data: bytes) -> np.ndarray:
    """The sorted places of a container."""
    if form == BITMAP:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")).astype(np.uint16)
    listed = np.frombuffer(data, "<u2")
    if form == ARRAY:
        return listed
    return np.concatenate([np.arange(int(a), int(b) + 1) for a, b in listed.reshape(-1, 2)]).astype(np.uint16)


def _containers(terms: pa.Array, group: np.ndarray, container: np.ndarray, places: np.ndarray, uses: np.ndarray) -> pa.RecordBatch:
    """Containers of entries sorted by group and place, each place of a group once. ``terms`` and ``container`` are by group;
    ``uses`` too. Most containers are short lists, which are cut from one buffer; the others are packed one by one."""
    n = np.bincount(group, minlength=len(terms))
    start = np.cumsum(n) - n
    steps = np.r_[False, (np.diff(places.astype(np.int32)) == 1) & (np.diff(group) == 0)] if len(places) else np.zeros(0, bool)
    runs = n - np.bincount(group[steps], minlength=len(terms))
    odd = (n > MOST_LISTED) | (4 * runs < np.minimum(2 * n, CONTAINER // 8))
    form = np.zeros(len(terms), np.int8)
    lists = places.astype("<u2").tobytes()
    plain = pa.Array.from_buffers(pa.large_binary(), len(terms), [None, pa.py_buffer(np.r_[start, len(places)].astype(np.int64) * 2), pa.py_buffer(lists)])
    if odd.any():
        data = plain.to_pylist()
        for i in np.flatnonzero(odd):
            form[i], data[i] = pack(places[start[i] : start[i] + n[i]])
        plain = pa.array(data, pa.large_binary())
    columns = [terms, pa.array(container), pa.array(form), pa.array(n.astype(np.int32)), pa.array(uses), plain.cast(pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in LAYOUT.split(", ")])


def _fold(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Rows (term, record, uses) as partial containers."""
    rows = pa.Table.from_batches(batches)
    coded = rows.column(0).combine_chunks().dictionary_encode()
    code, record, uses = coded.indices.to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_numpy()
    container = record >> 16
    order = np.lexsort((record, code))
    code, record, container, uses = code[order], record[order], container[order], uses[order]
    new_group = np.r_[True, (np.diff(code) != 0) | (np.diff(container) != 0)]
    new_place = np.r_[True, (np.diff(code) != 0) | (np.diff(record) != 0)]
    first = np.flatnonzero(new_group)
    group = np.cumsum(new_group)[new_place] - 1
    return _containers(coded.dictionary.take(pa.array(code[first])), group, container[first], (record[new_place] & (CONTAINER - 1)).astype(np.uint16), np.add.reduceat(uses, first))


def partial_containers(rows: DataFrame) -> DataFrame:
    """Partial containers of rows (term, record, uses), folded inside each task."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                held.append(part)
                n += part.num_rows
                if n >= AT_ONCE:
                    yield _fold(held)
                    held, n = [], 0
        if n:
            yield _fold(held)

    return rows.mapInArrow(fold, LAYOUT)


def _union(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Whole containers of a batch sorted by (term, container)."""
    coded = batch.column(0).dictionary_encode()
    code, container = coded.indices.to_numpy(), batch.column(1).to_numpy()
    new = np.r_[True, (np.diff(code) != 0) | (np.diff(container) != 0)]
    first = np.flatnonzero(new)
    group_of = np.cumsum(new) - 1
    uses = np.add.reduceat(batch.column(4).to_numpy(), first)
    form, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
    if not form.any():
        data = batch.column(5)
        ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
        places = np.frombuffer(data.buffers()[2], "<u2", (ends[-1] - ends[0]) // 2, ends[0]) if ends[-1] > ends[0] else np.zeros(0, np.uint16)
    else:
        places = np.concatenate([unpack(f, d) for f, d in zip(form, batch.column(5).to_pylist())])
    key = np.unique(np.repeat(group_of, n) * CONTAINER + places)
    return _containers(batch.column(0).take(pa.array(first)), key // CONTAINER, container[first], (key % CONTAINER).astype(np.uint16), uses)


def merged_containers(partial: DataFrame) -> DataFrame:
    """Containers merged by union, one row per (term, container)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.RecordBatch | None = None  # the last container, which may go on
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                if kept is not None:
                    part = pa.Table.from_batches([kept, part.cast(kept.schema)]).combine_chunks().to_batches()[0]
                whole = _union(part)
                kept = whole.slice(whole.num_rows - 1)
                if whole.num_rows > 1:
                    yield whole.slice(0, whole.num_rows - 1)
        if kept is not None:
            yield kept

    keys = ("term", "container")
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, LAYOUT)


def vertical(rows: DataFrame, term: str, record: str, uses: Column) -> DataFrame:
    """The layout (term, container, form, n_records, uses, data) of rows with a term and a record, written once."""
    clean = rows.select(F.col(term).cast("string").alias("term"), F.col(record).cast("bigint").alias("record"), F.coalesce(uses.cast("bigint"), F.lit(0)).alias("uses"))
    return materialized(merged_containers(partial_containers(clean.where("term is not null and record is not null"))))


def dictionary(layout: DataFrame) -> DataFrame:
    """(term, n_uses, n_records); the exchange moves one partly added row per term and task."""
    return layout.groupBy("term").agg(F.sum("uses").alias("n_uses"), F.sum("n_records").cast("bigint").alias("n_records"))


def cardinality(rows: DataFrame, record: str) -> DataFrame:
    """One row: the number of distinct records, by union of all their bitmaps."""
    some = rows.where(F.col(record).isNotNull()).groupBy(F.shiftright(F.col(record).cast("bigint"), 6).alias("word_no")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({record} & 63 AS INT))")).alias("bits"))
    return some.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("bigint").alias("all_records"))


def marked(terms: DataFrame, whole: DataFrame) -> DataFrame:
    """Add ``mark``: 'rare', 'common' or null."""
    mark = F.when(F.col("n_records") <= RARE_RECORDS, "rare").when(F.col("n_records") > F.col("all_records") * F.lit(COMMON_SHARE), "common")
    return terms.crossJoin(F.broadcast(whole)).withColumn("mark", mark).drop("all_records")


def latest_pages(pages: DataFrame) -> DataFrame:
    """(id, body): of each page the row loaded last (then the largest page_row), if its body is not null."""
    row = F.struct("loaded_at", "page_row", "body")
    return pages.where("id is not null").groupBy("id").agg(F.max(row).alias("r")).select("id", F.col("r.body").alias("body")).where("body is not null")


def _index_rows(postings: DataFrame) -> DataFrame:
    """Every posting row; uses of a record delivered more than once are only told by ``index_terms``."""
    return postings.select(clean_term(F.col("term")).alias("term"), "doc_id", total_freq(F.col("freq")).alias("n"))


def _body_words(pages: DataFrame) -> DataFrame:
    return pages.select("id", F.explode(words(ascii_lower(F.col("body")))).alias("term"))


def found(spark: SparkSession, d: str) -> DataFrame:
    posting = _index_rows(table(spark, d, "posting"))
    pages = latest_pages(table(spark, d, "wiki_page"))
    index = marked(dictionary(vertical(posting, "term", "doc_id", F.col("n"))), cardinality(posting, "doc_id"))
    body = marked(dictionary(vertical(_body_words(pages), "term", "id", F.lit(1))), cardinality(pages, "id"))
    both = index.select(F.lit("index").alias("origin"), "term", "mark").unionByName(body.select(F.lit("body").alias("origin"), "term", "mark"))
    return both.where("mark is not null")


def index_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = latest_postings(table(spark, d, "posting")).select("term", "doc_id", total_freq(F.col("freq")).alias("n"))
    whole = cardinality(table(spark, d, "posting"), "doc_id")
    return marked(dictionary(vertical(rows, "term", "doc_id", F.col("n"))), whole)


def body_terms(spark: SparkSession, d: str) -> DataFrame:
    pages = latest_pages(table(spark, d, "wiki_page"))
    return marked(dictionary(vertical(_body_words(pages), "term", "id", F.lit(1))), cardinality(pages, "id"))


def split_terms(spark: SparkSession, d: str) -> DataFrame:
    """Uses and records by milestone split."""
    rows = latest_postings(table(spark, d, "posting")).select("term", "doc_id", total_freq(F.col("freq")).alias("n"))
    rows = with_split(rows, table(spark, d, "milestone"), ["doc_id"])
    return dictionary(vertical(rows, "first_term", "doc_id", F.col("n"))).withColumnRenamed("term", "first_term")


QUERIES = {"p5_found": found, "p5_index_terms": index_terms, "p5_body_terms": body_terms, "p5_split_terms": split_terms}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TF = " + ".join(
    [f"coalesce(try_cast(regexp_extract(freq, '{p}', 1) AS BIGINT), 0)" for p in ("^([0-9]+)", "i([0-9]+)", "c([0-9]+)", "l([0-9]+)", "r([0-9]+)")]
    + ["least(coalesce(try_cast(regexp_extract(freq, 't([0-9]+)', 1) AS BIGINT), 0), 1)"]
)
_P = f"""r AS (SELECT translate(trim(term), {_AZ}) AS term, doc_id, freq, loaded_at, posting_id FROM posting),
p AS (SELECT term, doc_id, {_TF} AS tf FROM r WHERE term IS NOT NULL AND doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY term, doc_id ORDER BY loaded_at DESC NULLS LAST, posting_id DESC) = 1)"""
_B = f"""b AS (SELECT id, body FROM (SELECT id, body FROM wiki_page WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, page_row DESC) = 1) WHERE body IS NOT NULL),
w AS (SELECT id, unnest(regexp_extract_all(translate(body, {_AZ}), '[a-z0-9]+')) AS term FROM b)"""
_MARK = "CASE WHEN n_records <= 4 THEN 'rare' WHEN n_records > n * 0.5 THEN 'common' END AS mark"

ORACLE = {
    "p5_found": f"""WITH {_P}, {_B},
i AS (SELECT term, count(*) AS n_records, (SELECT count(DISTINCT doc_id) FROM posting) AS n FROM p GROUP BY term),
c AS (SELECT term, count(DISTINCT id) AS n_records, (SELECT count(*) FROM b) AS n FROM w GROUP BY term),
u AS (SELECT 'index' AS origin, term, {_MARK} FROM i UNION ALL SELECT 'body', term, {_MARK} FROM c)
SELECT origin, term, mark FROM u WHERE mark IS NOT NULL""",
    "p5_index_terms": f"""WITH {_P}, i AS (SELECT term, CAST(sum(tf) AS BIGINT) AS n_uses, count(*) AS n_records,
  (SELECT count(DISTINCT doc_id) FROM posting) AS n FROM p GROUP BY term) SELECT term, n_uses, n_records, {_MARK} FROM i""",
    "p5_body_terms": f"""WITH {_B}, i AS (SELECT term, count(*) AS n_uses, count(DISTINCT id) AS n_records,
  (SELECT count(*) FROM b) AS n FROM w GROUP BY term) SELECT term, n_uses, n_records, {_MARK} FROM i""",
    "p5_split_terms": f"""WITH {_P}, m AS (SELECT DISTINCT first_term FROM milestone WHERE first_term IS NOT NULL),
s AS (SELECT v.first_term, p.doc_id, p.tf FROM p JOIN (SELECT t.term, max(m.first_term) AS first_term
  FROM (SELECT DISTINCT term FROM p) t JOIN m ON m.first_term <= t.term GROUP BY t.term) v ON v.term = p.term)
SELECT first_term, CAST(sum(tf) AS BIGINT) AS n_uses, count(DISTINCT doc_id) AS n_records FROM s GROUP BY first_term""",
}
