"""Problem 2: subjects of pages from latent Dirichlet topics.

1. Every body becomes a sparse row of counts of its lower-case words. Words are hashed into ``BUCKETS`` buckets, so the
   vocabulary needs no bound, no word is dropped, and what is sent out has a fixed size. Buckets in too few or too many
   pages say nothing about subjects and are left out.
2. A latent Dirichlet topic model is fitted to all pages by variational EM: the expectation step runs in the tasks on
   blocks of pages and returns sums by (bucket, topic), which are added in the exchange; the driver holds only the topics
   (at most ``BUCKETS`` rows). Topics start from the words of a bounded sample of labelled pages, so the fit is
   reproducible; ``BACKGROUND`` topics take up words that belong to no subject.
3. Each topic is mapped to the subject to which its top terms belong most, by the labelled sample; a topic whose top
   terms favour none stays without.
4. A page's subjects come from its topic proportions: the subject with the largest share, and the second if its share
   reaches a threshold. The threshold fits one half of the labelled sample best; the other half measures it. An
   exact check follows for the second: its words stand in more than one sentence (one is a passing mention).
5. Where the body is null the categories decide: each category phrase (names and numbers masked) has the subject that
   pages with bodies assign to it.

Cases: null, empty and redirect bodies, and bodies that are residue as a whole, have no subject (a null body has its
categories'); labels with an unknown subject or row are ignored; ties go to the subject first in byte order; without
usable labels there is no row; more than ``MAX_SUBJECTS`` subjects are refused; repeated rows each count; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.joins import join_back
from ..session import materialized, table
from .residue import whole_bodies

BUCKETS = 1 << 18
MIN_PAGES = 3
MAX_SHARE = 0.6
MAX_SUBJECTS = 1_000
BACKGROUND = 4
SWEEPS = 2
INNER = 4
INNER_AT_END = 8
ALPHA = 0.1
ETA = 0.02
TOP_TERMS = 30
MAX_LABELLED = 2_000
AT_ONCE = 512

_MARKUP = re.compile(r"<[^<>]*>|\{\{[^{}]*\}\}|\[https?://[^\s\]]+|https?://\S+|\]\([^)]*\)|\\[a-z]+|&\w+;")
_MARKED = re.compile(r"[<{\[\]\\&]|://")
#: Words written in lower case, ends of sentences, and what parts two bodies.
_PIECE = re.compile(r"(?<![A-Za-z])[a-z]{3,}(?![A-Z])|[.!?](?=\s)|\n|\x00")
_END, _NEXT = -1, -2
COUNTS = "page_row bigint, n_words int, buckets array<int>, counts array<float>, sentences array<bigint>"


def _plain(text: str | None) -> str:
    """A body without markup; '' for a redirect."""
    if not text or text[:9].lower() == "#redirect":
        return ""
    return (_MARKUP.sub(" ", text) if _MARKED.search(text) else text).replace("\x00", " ")


class Hashed(dict):
    """Memory of the bucket of a word; the end of a sentence and the next body are no words."""

    BOUND = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.BOUND:
            self.clear()
        self[word] = out = _NEXT if word == "\x00" else _END if word in ".!?\n" else xxhash.xxh32_intdigest(word) % BUCKETS
        return out


_HASHED = Hashed()


def _counts(pages: DataFrame) -> DataFrame:
    """(page_row, n_words, buckets, counts, sentences) of each row with a body that isn't a redirect. Bit k of an entry's
    sentences stands for the k-th sentence, modulo 63."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, AT_ONCE):
                part = b.slice(a, AT_ONCE)
                joined = "\x00" + "\x00".join(map(_plain, part.column(1).to_pylist()))
                code = np.fromiter(map(_HASHED.__getitem__, _PIECE.findall(joined)), np.int64)
                word = code >= 0
                page, ends = np.cumsum(code == _NEXT)[word] - 1, np.cumsum(~word)[word]
                sizes = np.bincount(page, minlength=part.num_rows)
                new = np.r_[True, (np.diff(ends) > 0)][: len(page)]  # a sentence that has words
                number = np.cumsum(new) - 1
                first = np.flatnonzero(np.r_[True, np.diff(page) > 0][: len(page)])
                number -= np.repeat(number[first], np.diff(np.r_[first, len(page)]))
                key = page * BUCKETS + code[word]
                bit = np.int64(1) << (number % 63)
                order = np.argsort(key, kind="stable")
                key, first, count = np.unique(key[order], return_index=True, return_counts=True)
                bits = np.bitwise_or.reduceat(bit[order], first) if len(first) else bit
                ends = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1, dtype=np.int64) * BUCKETS).astype(np.int32))
                columns = (pa.array((key % BUCKETS).astype(np.int32)), pa.array(count.astype(np.float32)), pa.array(bits))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int32)), *(pa.ListArray.from_arrays(ends, c) for c in columns)], [x.split(" ")[0] for x in COUNTS.split(", ")])

    return pages.where("body is not null").select(F.col("page_row").cast("bigint").alias("page_row"), "body").mapInArrow(cut, COUNTS)


def _entries(buckets: pa.ListArray, counts: pa.ListArray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, row of the topics and count of the entries in buckets that are kept, and which entries these are."""
    n = np.diff(buckets.offsets.to_numpy())
    doc, bucket = np.repeat(np.arange(len(n)), n), buckets.flatten().to_numpy()
    at = np.minimum(np.searchsorted(kept, bucket), max(0, len(kept) - 1))
    good = kept[at] == bucket if len(kept) else np.zeros(len(bucket), bool)
    return doc[good], at[good], counts.flatten().to_numpy()[good], good


def _digamma(x: np.ndarray) -> np.ndarray:
    y = x + 6.0
    z = 1.0 / (y * y)
    out = np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z / 252))
    for i in range(6):
        out -= 1.0 / (x + i)
    return out


def infer(beta: np.ndarray, doc: np.ndarray, word: np.ndarray, count: np.ndarray, n: int, inner: int = INNER_AT_END) -> tuple[np.ndarray, np.ndarray]:
    """Variational proportions (documents x topics, unnormalized) and the expected counts of the entries. ``beta`` has a
    row a bucket."""
    k = beta.shape[1]
    total = np.bincount(doc, weights=count, minlength=n)
    gamma = np.full((n, k), ALPHA) + total[:, None] / k
    b = beta[word]
    start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    phi = np.zeros((0, k), beta.dtype)
    for step in range(inner):
        theta = np.exp(_digamma(gamma) - _digamma(gamma.sum(1))[:, None]).astype(beta.dtype)
        spread = theta[doc]
        share = count / np.maximum(np.einsum("ij,ij->i", spread, b), np.finfo(beta.dtype).tiny)
        own = b * share[:, None]
        gamma = np.full((n, k), ALPHA)
        if len(start):
            gamma[doc[start]] += theta[doc[start]] * np.add.reduceat(own, start, axis=0)
        if step == inner - 1:
            phi = spread * own
    return gamma, phi


def _sums(word: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur and the sums of their expected counts."""
    order = np.argsort(word, kind="stable")
    word = word[order]
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    return word[first], np.add.reduceat(phi[order].astype(np.float64), first, axis=0) if len(first) else np.zeros((0, phi.shape[1]))


def _topics(word: np.ndarray, sums: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    beta = np.full(shape, ETA)
    beta[word] += np.round(sums, 6)
    return (beta / beta.sum(0)).astype(np.float32)


def kept_buckets(counts: DataFrame) -> np.ndarray:
    """The buckets that stand in neither too few nor too many pages, in order."""
    n = counts.count()
    per = counts.select(F.explode("buckets").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    good = per.where((F.col("df") >= MIN_PAGES) & (F.col("df") <= max(MIN_PAGES, MAX_SHARE * n))).select("w").toPandas()
    return np.sort(good["w"].to_numpy(np.int32))


def fit(counts: DataFrame, kept: np.ndarray, beta: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Kept buckets x topics after ``sweeps`` passes over all pages."""
    k = beta.shape[1]
    for _ in range(sweeps):
        sent = counts.sparkSession.sparkContext.broadcast((beta, kept))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            b, buckets = sent.value
            total = np.zeros(b.shape)
            for batch in batches:
                for a in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(a, AT_ONCE)
                    doc, word, count, _ = _entries(part.column(0), part.column(1), buckets)
                    if len(doc):
                        at, sums = _sums(word, infer(b, doc, word, count, part.num_rows, INNER)[1])
                        total[at] += sums
            used = np.flatnonzero(total.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(np.round(total[used, t], 9)) for t in range(b.shape[1]))], ["w", *(f"t{t}" for t in range(b.shape[1]))])

        sums = counts.select("buckets", "counts").mapInArrow(expect, "w bigint, " + ", ".join(f"t{t} double" for t in range(k)))
        got = sums.groupBy("w").agg(*[F.sum(f"t{t}").alias(f"t{t}") for t in range(k)]).toPandas().sort_values("w")
        sent.unpersist()
        beta = _topics(got["w"].to_numpy(np.int64), got[[f"t{t}" for t in range(k)]].to_numpy(), beta.shape)
    return beta


@dataclass
class Subjects:
    names: list[str]
    kept: np.ndarray
    beta: np.ndarray
    topic_subject: np.ndarray  # index of the subject, -1 for none
    threshold: float

    def masses(self, buckets: pa.ListArray, counts: pa.ListArray, sentences: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Expected words of each page by subject, and the number of sentences in which they stand."""
        out = np.zeros((len(buckets), len(self.names)))
        spread = np.zeros(out.shape, np.int64)
        doc, word, count, good = _entries(buckets, counts, self.kept)
        if len(doc):
            gamma, phi = infer(self.beta, doc, word, count, len(buckets))
            bits = sentences.flatten().to_numpy()[good]
            start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            for s in range(len(self.names)):
                topics = np.flatnonzero(self.topic_subject == s)
                if len(topics):
                    out[:, s] = (gamma[:, topics] - ALPHA).sum(1)
                    own = np.where(phi[:, topics].sum(1) > 0.5 * count, bits, 0)
                    spread[doc[start], s] = np.bitwise_count(np.bitwise_or.reduceat(own, start))
        return out, spread

    def choose(self, masses: np.ndarray, spread: np.ndarray) -> list[list[int]]:
        """The subject of the largest share, and the second if its share reaches the threshold in more than one sentence."""
        out = []
        for v, n in zip(np.round(masses, 6), spread):
            order = [int(x) for x in np.argsort(-v, kind="stable")[:2]]
            second = [x for x in order[1:] if v[x] >= max(0.5, self.threshold * v.sum()) and n[x] > 1]
            out.append([order[0], *second] if v[order[0]] >= 0.5 else [])
        return out


def _labelled(counts: DataFrame, labels: DataFrame, names: list[str], bound: int) -> tuple[list[pa.ListArray], list[list[int]]]:
    """A bounded sample of labelled rows by a hash of the row: buckets, counts and sentences, and subjects."""
    at = {n: i for i, n in enumerate(names)}
    few = (
        labels.where(F.col("subject").isin(*names) & F.col("page_row").isNotNull())
        .groupBy("page_row")
        .agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
        .orderBy(F.xxhash64("page_row"), "page_row")
        .limit(bound)
    )
    got = counts.join(F.broadcast(few), "page_row").toPandas().sort_values("page_row")
    kinds = {"buckets": pa.int32(), "counts": pa.float32(), "sentences": pa.int64()}
    return [pa.array(list(got[c]), pa.list_(t)) for c, t in kinds.items()], [[at[s] for s in x] for x in got["subjects"]]


def start_topics(buckets: pa.ListArray, counts: pa.ListArray, of: list[list[int]], kept: np.ndarray, n_names: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The topics from which the fit starts, and how often and how purely each bucket stands for a subject."""
    doc, word, _, _ = _entries(buckets, counts, kept)
    share = np.zeros((len(of), n_names))
    for i, some in enumerate(of):
        share[i, some] = 1 / len(some)
    said = np.zeros((len(kept), n_names))
    np.add.at(said, word, share[doc])
    total = said.sum(1)
    purity = (said + 0.05) / (total + 0.05 * n_names)[:, None]
    # a subject's start: its words, by how much they belong to it; the background's: words of every subject
    start = np.maximum(total, 0.1)[:, None] * np.maximum(purity - 1.5 / n_names, 0) ** 2 + 1e-4
    spread = -(purity * np.log(purity)).sum(1) / np.log(max(2, n_names))
    background = (np.maximum(total, 0.1) * spread**4)[:, None] * np.random.default_rng(7).uniform(0.5, 1.5, (len(kept), BACKGROUND))
    beta = np.hstack([start, background])
    return (beta / beta.sum(0)).astype(np.float32), total, purity


def map_topics(beta: np.ndarray, total: np.ndarray, purity: np.ndarray) -> np.ndarray:
    """The subject of each topic by its top terms, -1 where they favour none."""
    topic = np.full(beta.shape[1], -1)
    mean = beta.mean(1)
    for t in range(beta.shape[1]):
        lift = beta[:, t].astype(float) * np.log(np.maximum(beta[:, t] / mean, 1e-9))
        top = np.argsort(-np.round(lift, 12), kind="stable")[:TOP_TERMS]
        weight = beta[top, t] * (total[top] > 0)
        score = (weight[:, None] * purity[top]).sum(0) / max(1e-12, weight.sum())
        if score.max() >= 0.4:
            topic[t] = int(np.round(score, 9).argmax())
    return topic


def best_threshold(model: Subjects, masses: np.ndarray, spread: np.ndarray, of: list[list[int]]) -> float:
    """The middle of the thresholds that suit most of the pages."""
    best, runs = -1, [model.threshold]
    for x in np.round(np.arange(0.05, 0.45, 0.01), 2):
        model.threshold = float(x)
        right = sum(set(a) == set(b) for a, b in zip(model.choose(masses, spread), of))
        if right > best:
            best, runs = right, [float(x)]
        elif right == best:
            runs.append(float(x))
    return runs[len(runs) // 2]


def train(counts: DataFrame, labels: DataFrame, areas: DataFrame, bound: int = MAX_LABELLED) -> Subjects | None:
    some = areas.select("subject").where("subject is not null").distinct().limit(MAX_SUBJECTS + 1).collect()
    if len(some) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    names = sorted((r[0] for r in some), key=lambda s: s.encode())
    if not names:
        return None
    sample, of = _labelled(counts, labels, names, bound)
    kept = kept_buckets(counts) if of else np.zeros(0, np.int32)
    if not len(kept):
        return None
    beta, total, purity = start_topics(*sample[:2], of, kept, len(names))
    beta = fit(counts, kept, beta)
    model = Subjects(names, kept, beta, map_topics(beta, total, purity), 0.25)
    masses, spread = model.masses(*sample)
    model.threshold = best_threshold(model, masses[::2], spread[::2], of[::2])
    return model


def _phrases(pages: DataFrame) -> DataFrame:
    """(page_row, phrase): the categories of each row with names and numbers masked."""
    each = pages.where("category is not null").select("page_row", F.explode(F.array_distinct(F.split("category", r"\|"))).alias("phrase"))
    masked = F.trim(F.regexp_replace(F.regexp_replace("phrase", r"(?<=.)\b[A-ZÀ-ÞÆ][\w'’.]*", "*"), r"\d+", "#"))
    return each.select("page_row", masked.alias("phrase")).where("phrase <> ''").distinct()


def _phrase_subjects(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """(phrase, subject, n) of the phrases that pages with bodies clearly assign to one subject."""
    votes = _phrases(pages).join(chosen, "page_row").groupBy("phrase", "subject").agg(F.count(F.lit(1)).alias("n"))
    whole = votes.groupBy("phrase").agg(F.sum("n").alias("all"), F.max(F.struct("n", "subject")).alias("top"))
    return whole.where("top.n >= 3 and top.n >= 0.5 * all").select("phrase", F.col("top.subject").alias("subject"), F.col("all").alias("n"))


def subjects(pages: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(page_row, subject)."""
    pages = pages.select(F.col("page_row").cast("bigint").alias("page_row"), "title", "body", "category")
    counts = materialized(_counts(pages))
    model = train(counts, labels, areas)
    if model is None:
        return pages.sparkSession.createDataFrame([], "page_row bigint, subject string")
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                masses, spread = m.masses(*part.columns[2:])
                got = [(p, m.names[x]) for p, some in zip(part.column(0).to_pylist(), m.choose(masses, spread)) for x in some]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int64()), pa.array([x for _, x in got], pa.string())], ["page_row", "subject"])

    bodies = pages.withColumn("infobox", F.lit(None).cast("string"))
    chosen = materialized(counts.mapInArrow(assign, "page_row bigint, subject string").join(whole_bodies(bodies), "page_row", "left_anti"))
    without = pages.where("body is null").select("page_row", "category")
    votes = join_back(_phrases(without), _phrase_subjects(pages, chosen), "phrase", "n", ["page_row"]).groupBy("page_row", "subject").agg(F.count(F.lit(1)).alias("v"))
    best = W.partitionBy("page_row").orderBy(F.desc("v"), "subject")
    by_category = votes.withColumn("r", F.row_number().over(best)).where("r <= 2").select("page_row", "subject")
    return chosen.unionByName(by_category)


def found(spark: SparkSession, d: str) -> DataFrame:
    return subjects(table(spark, d, "wiki_page"), table(spark, d, "subject_label"), table(spark, d, "subject_area")).distinct()


def composition(spark: SparkSession, d: str) -> DataFrame:
    """Pages and share by subject (a page with two subjects counts half for each)."""
    got = found(spark, d)
    weight = got.withColumn("w", 1.0 / F.count(F.lit(1)).over(W.partitionBy("page_row")))
    whole = got.agg(F.countDistinct("page_row").alias("all"))
    return weight.groupBy("subject").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("w").alias("w")).crossJoin(F.broadcast(whole)).select("subject", "n_rows", F.round(F.col("w") / F.col("all"), 6).alias("share"))


QUERIES = {"p2_found": found, "p2_composition": composition}
ORACLE: dict[str, str] = {}
