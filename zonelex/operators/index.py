"""Building the inverted index: page skipping, dense ids, postings, document frequencies, statistics, splits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codec import FREQ_ORDER, encode_freq
from ..functions.text import STOPWORDS, ascii_lower
from ..schema import MIN_DF, SPLIT_POSTINGS, SPLIT_TERMS
from ..session import materialized
from .joins import join_back
from .zones import page_terms

#: Titles and texts that are not indexed.
SKIPPED_TITLES = ("wikipedia:", "file:", "category:")
SKIPPED_TEXT = "#redirect"


def kept_pages(pages: DataFrame) -> DataFrame:
    """Pages to index. A null text is an empty page and stays; an empty title can't be indexed and is dropped."""
    title, text = ascii_lower(F.col("title")), ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    skip = text.startswith(SKIPPED_TEXT)
    for p in SKIPPED_TITLES:
        skip = skip | title.startswith(p)
    return pages.where(F.length("title") > 0).where(~skip)


def with_dense_ids(pages: DataFrame, order: list[str], name: str = "doc_id") -> DataFrame:
    """Add dense ids from 0 in ``order`` (which must be unique). Rows are range-ordered once and written with their
    place in their partition; the offsets of the partitions, one row each, are added from a broadcast."""
    placed = materialized(
        pages.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_part").select((F.col("_offset") + F.col("_place")).alias(name), *pages.columns)


@dataclass
class Index:
    docs: DataFrame  # doc_id, title, title_raw
    wide: DataFrame  # term, doc_id, tf array
    terms: DataFrame  # term, df
    zone_df: DataFrame  # term, zone, df
    stats: DataFrame  # total_docs, total_tokens, total_terms, splits

    @property
    def postings(self) -> DataFrame:
        """(term, zone, doc_id, tf), zones without the term left out."""
        return long_postings(self.wide)


def long_postings(wide: DataFrame) -> DataFrame:
    return wide.select("term", "doc_id", F.posexplode("tf").alias("zone", "tf")).where("tf > 0").select("term", "zone", "doc_id", "tf")


def term_df(wide: DataFrame) -> DataFrame:
    return wide.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def frequent_postings(wide: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """Postings of terms in at least ``min_df`` documents. Terms below are joined away; hot terms are broadcast."""
    if min_df <= 1:
        return wide
    terms = term_df(wide).where(F.col("df") >= min_df)
    return join_back(wide, terms, "term", "df", ["doc_id"]).drop("df")


def zone_frequencies(wide: DataFrame) -> DataFrame:
    """(term, zone, df): documents of a term by zone, from one partial aggregation."""
    counts = wide.groupBy("term").agg(*[F.count_if(F.col("tf")[z] > 0).alias(f"z{z}") for z in range(6)])
    return counts.select("term", F.posexplode(F.array(*[F.col(f"z{z}") for z in range(6)])).alias("zone", "df")).where("df > 0")


def index_stats(docs: DataFrame, all_terms: DataFrame, kept_terms: DataFrame) -> DataFrame:
    """One row: documents, tokens, terms of the merged index, splits by the default rule."""
    d = docs.agg(F.count(F.lit(1)).alias("total_docs"))
    t = all_terms.agg(F.coalesce(F.sum(F.aggregate("tf", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0)).alias("total_tokens"))
    k = kept_terms.agg(F.count(F.lit(1)).alias("total_terms"))
    return d.crossJoin(t).crossJoin(k).withColumn("splits", F.ceil(F.col("total_terms") / SPLIT_TERMS).cast("bigint"))


def build_index(pages: DataFrame, min_df: int = MIN_DF, stopwords: tuple[str, ...] = STOPWORDS, skip_marker: bool = False) -> Index:
    """Index of pages (doc_id, title, text). Counted terms are materialized once; everything else reads them."""
    docs = pages.select("doc_id", ascii_lower(F.col("title")).alias("title"), F.col("title").alias("title_raw"))
    return of_postings(docs, materialized(page_terms(pages, stopwords, skip_marker)), min_df)


def of_postings(docs: DataFrame, counted: DataFrame, min_df: int = MIN_DF) -> Index:
    """The index of documents and their counted terms (term, doc_id, tf)."""
    terms = term_df(counted).where(F.col("df") >= min_df)
    wide = frequent_postings(counted, min_df)
    return Index(docs, wide.select("term", "doc_id", "tf"), terms, zone_frequencies(wide), index_stats(docs, counted, terms))


def freq_strings(wide: DataFrame) -> DataFrame:
    """(term, doc_id, freq): the encoded form of the wide postings."""
    tf = {letter: F.col("tf")[i] for i, letter in enumerate(FREQ_ORDER)}
    return wide.select("term", "doc_id", encode_freq(tf).alias("freq"))


def rank_splits(terms: DataFrame, per_split: int = SPLIT_TERMS) -> DataFrame:
    """(term, df, split): splits of ``per_split`` terms in term order. The rank is a prefix sum over range partitions."""
    placed = with_dense_ids(terms.select("term", "df"), ["term"], "_rank")
    return placed.select("term", "df", F.floor(F.col("_rank") / per_split).cast("bigint").alias("split"))


def milestones(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split").agg(F.min("term").alias("first_term"), F.count(F.lit(1)).alias("n_terms"))


def exact_splits(all_terms: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """(term, df, split) by the rotation rule: a split is closed once 10,000 terms or 1,000,000 postings were *seen*,
    rare ones included; a split without a surviving term takes no number.

    A split that opens somewhere closes at a place that prefix sums tell, whatever came before. So each range partition
    says, for each of the at most 10,000 places at which the split it inherits can close, how many splits close in it and
    how much the last one leaves open. A fold over these heads gives each partition what it inherits (one row a
    partition, broadcast), and all partitions then number their terms at once.
    """
    most_terms, most_postings = SPLIT_TERMS, SPLIT_POSTINGS
    order = ["term"]
    placed = materialized(all_terms.select("term", "df").repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))

    def heads(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        count = df.sort_values("_place")["df"].to_numpy(np.int64)
        n, upto = len(count), np.r_[0, np.cumsum(count)]
        after = np.minimum(np.arange(n + 1) + most_terms, np.searchsorted(upto, upto + most_postings))
        closed, left, rest = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for i in range(n, -1, -1):  # from the end: what follows if a split closes before place i
            e = after[i]
            closed[i], left[i], rest[i] = (1, n - i, upto[n] - upto[i]) if e > n else (1 + closed[e], left[e], rest[e])
        first = np.arange(1, min(n, most_terms) + 1)
        whole = pd.DataFrame({"_part": [key[0]], "at": [0], "upto": [upto[n]], "closed": [0], "left": [n], "rest": [0]})
        return pd.concat([whole, pd.DataFrame({"_part": key[0], "at": first, "upto": upto[first], "closed": closed[first], "left": left[first], "rest": rest[first]})])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, terms, postings, held, part = 0, 0, 0, [], None

        def step() -> tuple[int, int, int, int]:
            nonlocal number, terms, postings
            here = (part, number, terms, postings)
            h = pd.concat(held)
            whole, rows = h.iloc[0], h.iloc[1:]
            hit = np.flatnonzero((rows["at"].to_numpy() + terms >= most_terms) | (rows["upto"].to_numpy() + postings >= most_postings))
            if len(hit):
                r = rows.iloc[hit[0]]
                number, terms, postings = number + int(r["closed"]), int(r["left"]), int(r["rest"])
            else:
                terms, postings = terms + int(whole["left"]), postings + int(whole["upto"])
            return here

        names = ["_part", "_number", "_terms", "_postings"]
        for b in batches:
            for key, rows in b.groupby("_part", sort=False):
                if key != part and held:
                    yield pd.DataFrame([step()], columns=names)
                    held.clear()
                part = key
                held.append(rows)
        if held:
            yield pd.DataFrame([step()], columns=names)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, split, terms, postings = None, 0, 0, 0
        for b in batches:
            out = []
            for p, n, t0, p0, df in zip(b["_part"], b["_number"], b["_terms"], b["_postings"], b["df"]):
                if p != part:
                    part, split, terms, postings = p, n, t0, p0
                out.append(split)
                terms += 1
                postings += df
                if terms >= most_terms or postings >= most_postings:
                    split, terms, postings = split + 1, 0, 0
            yield pd.DataFrame({"term": b["term"], "df": b["df"], "_seen": out})

    head = placed.groupBy("_part").applyInPandas(heads, "_part int, at bigint, upto bigint, closed bigint, left bigint, rest bigint")
    inherited = head.coalesce(1).sortWithinPartitions("_part", "at").mapInPandas(fold, "_part int, _number bigint, _terms bigint, _postings bigint")
    ordered = placed.join(F.broadcast(inherited), "_part").repartition("_part").sortWithinPartitions("_part", "_place")
    seen = materialized(ordered.select("_part", "_number", "_terms", "_postings", "term", "df").mapInPandas(number, "term string, df bigint, _seen bigint").where(F.col("df") >= min_df))
    numbers = with_dense_ids(seen.select("_seen").distinct(), ["_seen"], "split")
    return seen.join(F.broadcast(numbers), "_seen").select("term", "df", "split")


def index_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two posting tables has, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
