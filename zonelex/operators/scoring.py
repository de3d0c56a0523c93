"""Scores of many queries over postings, document by document.

All postings of a document that a query asks for come to one task, in one exchange that is as large as these postings. There
the weights of the queries, which every task holds, are added up to the document's scores, so that what a query and a
document share is never exchanged or stored; with a bound on the results only the best of a task leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PREFIX_BOOST, TITLE, ZONES

DIGITS = 9
#: Products of postings and query tokens that are expanded at once.
HITS = 250_000
#: Scores held in a dense array at once, if they are not many more than the hits.
CELLS = 1_000_000
#: Rows that wait until the best are picked.
WAITING = 400_000
#: A query with a larger k is not cut in the tasks.
HELD = 10_000


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x) + 0.0


class Weights:
    """Tokens (query_id, zone, boosted, term; k with ``best``) as arrays. Queries that ask for the same tokens are one class."""

    def __init__(self, tokens: pa.Table):
        words = tokens.column("term").combine_chunks().dictionary_encode()
        zones, boosted = (tokens.column(c).to_numpy().astype(np.int64) for c in ("zone", "boosted"))
        keys, place = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ZONES) + zones, return_inverse=True)
        self.zones, self.terms = keys % len(ZONES), words.dictionary.take(pa.array(keys // len(ZONES)))
        ids, query = np.unique(tokens.column("query_id").to_numpy().astype(np.int64), return_inverse=True)
        asked = place * 2 + boosted
        order = np.lexsort((asked, query))
        asked, ends = asked[order], np.cumsum(np.bincount(query, minlength=len(ids)))
        classes: dict[bytes, int] = {}
        of, first, at = np.empty(len(ids), np.int64), [], 0
        for i, end in enumerate(ends.tolist()):
            of[i] = n = classes.setdefault(asked[at:end].tobytes(), len(classes))
            if n == len(first):
                first.append(asked[at:end])
            at = end
        self.n = len(first)
        members = np.argsort(of, kind="stable")
        self.members, self.until = ids[members], np.cumsum(np.bincount(of, minlength=self.n))
        self.k = np.zeros(self.n, np.int64)
        if "k" in tokens.column_names:
            np.maximum.at(self.k, of[query], tokens.column("k").to_numpy().astype(np.int64))
        tokens_of = np.repeat(np.arange(self.n), [len(f) for f in first])
        asked = np.concatenate(first)
        order = np.lexsort((tokens_of, asked >> 1))
        self.cls, self.asked = tokens_of[order], asked[order]

    def table(self) -> pa.Table:
        return pa.table({"term": self.terms, "zone": pa.array(self.zones, pa.int32()), "place": pa.array(np.arange(len(self.zones)), pa.int32())})

    def arrays(self, place: np.ndarray, df: np.ndarray, n_docs: int) -> dict:
        """What the tasks get. Where no document frequency is known, a token has no hits."""
        factor = np.full(len(self.zones), np.nan)
        factor[place] = np.log10(n_docs / df) if n_docs > 0 else 0.0
        factor *= np.array([z.weight for z in ZONES])[self.zones]
        weight = factor[self.asked >> 1] * np.where(self.asked & 1, PREFIX_BOOST, 1.0)
        known = ~np.isnan(weight)
        start = np.r_[0, np.cumsum(np.bincount((self.asked >> 1)[known], minlength=len(self.zones)))]
        return {"n": self.n, "cls": self.cls[known], "weight": weight[known], "start": start, "members": self.members, "until": self.until, "k": self.k, "null": n_docs <= 0}


class Scorer:
    """Scores of the documents of one task; rows (doc_id, place, tf) come by descending document, then by place, so that equal
    documents get equal sums and of equal scores the larger document comes first."""

    def __init__(self, w: dict, best: bool, digits: int):
        self.w, self.best, self.digits = w, best, digits
        self.n = w["n"]
        self.positive = bool((w["weight"] > 0).all())
        self.base = 0.0 if self.positive else -np.inf
        self.low = np.full(self.n, self.base)  # sums up to it can't be among the best
        self.least = np.full(self.n, -np.inf)
        self.whole = w["k"] > HELD
        self.held: list[tuple[np.ndarray, ...]] = []
        self.waiting, self.pick_at = 0, WAITING

    def sums(self, local: np.ndarray, places: np.ndarray, value: np.ndarray, fan: np.ndarray, docs: int) -> tuple[np.ndarray, ...]:
        """(document, class, sum) of what can count."""
        w, n = self.w, self.n
        at = np.repeat(w["start"][places] - (np.cumsum(fan) - fan), fan)
        at += np.arange(len(at))
        key = np.repeat(local * n, fan)
        key += w["cls"][at]
        value = np.repeat(value, fan)
        value *= w["weight"][at]
        if docs * n <= max(CELLS, 30 * len(key)):
            total = np.bincount(key, value, docs * n)
            if not self.positive:
                there = np.zeros(docs * n, bool)
                there[key] = True
                total[~there] = -np.inf
            key = np.flatnonzero((total.reshape(docs, n) > self.low).ravel() if self.best else total > self.base)
            total = total[key]
            doc = key // n
            return doc, key - doc * n, total
        key, inverse = np.unique(key, return_inverse=True)
        total, doc = np.bincount(inverse, value), key // n
        cls = key - doc * n
        if self.best:
            can = total > self.low[cls]
            doc, cls, total = doc[can], cls[can], total[can]
        return doc, cls, total

    def rows(self, doc: np.ndarray, cls: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        w = self.w
        if len(w["members"]) == self.n:
            query = w["members"][cls]
        else:
            size = np.diff(w["until"], prepend=0)[cls]
            at = np.repeat(w["until"][cls] - np.cumsum(size), size) + np.arange(size.sum())
            query, doc, score = w["members"][at], np.repeat(doc, size), np.repeat(score, size)
        score = rounded(score, self.digits) if self.digits < DIGITS else score
        for i in range(0, len(query), HITS):
            part = slice(i, i + HITS)
            scores = pa.nulls(len(query[part]), pa.float64()) if w["null"] else pa.array(score[part])
            yield pa.RecordBatch.from_arrays([pa.array(query[part]), pa.array(doc[part]), scores], ["query_id", "doc_id", "score"])

    def pick(self) -> None:
        """Keep the best k of each class; what comes later has smaller documents and must score more."""
        if not self.held:
            return
        doc, cls, score = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((-score, cls))
        doc, cls, score = doc[order], cls[order], score[order]
        counts = np.bincount(cls, minlength=self.n)
        start, k = np.cumsum(counts) - counts, self.w["k"]
        full = (counts >= k) & (k > 0)
        self.least[full] = score[start[full] + k[full] - 1]
        self.low[full] = np.maximum(self.base, self.least[full] - 1e-8 - 1e-12 * np.abs(self.least[full]))
        keep = np.arange(len(cls)) - start[cls] < k[cls]
        self.held = [(doc[keep], cls[keep], score[keep])]
        self.waiting = int(keep.sum())
        self.pick_at = max(WAITING, 2 * self.waiting)

    def documents(self, doc: np.ndarray, places: np.ndarray, tf: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole documents."""
        new = np.r_[True, doc[1:] != doc[:-1]]
        local, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        ids, stops = doc[starts], np.r_[starts[1:], len(doc)]
        value = np.where(tf > 0, 1 + np.log10(np.maximum(tf, 1)), 0.0)
        fan = self.w["start"][places + 1] - self.w["start"][places]
        upto = np.cumsum(fan)[stops - 1]
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, "right")))
            rows = slice(starts[a], stops[b - 1])
            at, cls, total = self.sums(local[rows] - a, places[rows], value[rows], fan[rows], b - a)
            score, at = rounded(total, DIGITS), ids[a:b][at]
            a = b
            if not self.best:
                yield from self.rows(at, cls, score)
                continue
            can = score > self.least[cls]
            at, cls, score = at[can], cls[can], score[can]
            if self.whole.any():
                now = self.whole[cls]
                yield from self.rows(at[now], cls[now], score[now])
                at, cls, score = at[~now], cls[~now], score[~now]
            self.held.append((at, cls, score))
            self.waiting += len(at)
            if self.waiting > self.pick_at:
                self.pick()

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over: tuple[np.ndarray, ...] | None = None  # the document that the next batch may go on with
        for b in batches:
            rows = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(rows[0]):
                continue
            if over is not None:
                rows = tuple(np.concatenate(x) for x in zip(over, rows))
            last = len(rows[0]) - int(np.argmax(rows[0][::-1] != rows[0][-1])) if rows[0][0] != rows[0][-1] else 0
            over = tuple(x[last:] for x in rows)
            if last:
                yield from self.documents(*(x[:last] for x in rows))
        if over is not None:
            yield from self.documents(*over)
        if self.best:
            self.pick()
            for held in self.held:
                yield from self.rows(*held)


def scored(tokens: pa.Table, postings: DataFrame, n_docs: int, zone_df: DataFrame | None, best: bool, digits: int, pushed: int) -> DataFrame:
    """(query_id, doc_id, score) of tokens that fit the driver; their distinct terms are broadcast. With at most ``pushed`` of
    them, they become a filter that reaches the scan of the range-sorted index."""
    spark = postings.sparkSession
    weights = Weights(tokens)
    asked = F.broadcast(spark.createDataFrame(weights.table()))
    names = sorted(set(weights.terms.to_pylist()))

    def of_tokens(rows: DataFrame) -> DataFrame:
        few = rows.where(F.col("term").isin(names)) if len(names) <= pushed else rows
        return few.join(asked, ["term", "zone"])

    tf = F.when(F.col("zone") == TITLE, F.least("tf", F.lit(1))).otherwise(F.col("tf"))
    hit = of_tokens(postings).select(F.col("doc_id").cast("bigint").alias("doc_id"), "place", tf.cast("int").alias("tf"))
    df = of_tokens(zone_df).select("place", F.col("df").cast("bigint").alias("df")) if zone_df is not None else hit.groupBy("place").agg(F.count(F.lit(1)).alias("df"))
    known = df.toArrow()
    shared = spark.sparkContext.broadcast(weights.arrays(known.column("place").to_numpy(), known.column("df").to_numpy(), n_docs))
    tasks, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    by_doc = hit.repartition(max(2 * cores, tasks // 4 if best else tasks), "doc_id").sortWithinPartitions(F.desc("doc_id"), "place")
    return by_doc.mapInArrow(lambda batches: Scorer(shared.value, best, digits).run(batches), "query_id bigint, doc_id bigint, score double")
