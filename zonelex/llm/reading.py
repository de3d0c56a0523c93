"""Problem 9: reading level of English texts from n-gram surprisal.

1. For each level an interpolated trigram model is trained on a bounded, documented sample of labelled texts (at most
   ``MAX_LABELLED`` texts and ``MAX_CHARS`` characters, in the order of a hash of the id). Names and numbers are classes.
2. One pass over the corpus: every sentence of the whole text gets its surprisal under each level's model. Its difficulty
   weighs how much less surprised each model is than the others, by least squares on labelled texts that the models
   have not seen; the distribution of difficulty over a document's words gives the document's difficulty as its median.
3. Isotonic regression (pool adjacent violators) on these unseen texts maps difficulty to the level.
4. A text is English if its surprisal per letter under a model of four letters, trained on the same labelled texts, lies
   nearer to that of unseen labelled texts than to that of letters at random.

Texts are scored where they are read; nothing is exchanged. Only the models (bounded by the sample) are broadcast.

Cases: null, empty and short texts (under ``MIN_WORDS`` words) and texts in other languages give no row, whatever
``lang`` says; repeated rows each count; labels without text, null or outside 1..5 are ignored; without any usable
label no row is given; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table

LEVELS = 5
MIN_WORDS = 25
#: At most so many labelled texts with so many characters in all are used; of each four one, unseen by the models,
#: fits the difficulty and the isotonic map.
MAX_LABELLED = 1_000
MAX_CHARS = 16_000_000
HELD_OUT = 4
#: Interpolation: weight of the longer history wherever it was seen in training.
LAMBDA_3 = 0.65
LAMBDA_2 = 0.75
LAMBDA_1 = 0.95
#: Texts scored at once.
AT_ONCE = 1024
#: A worker's memory of spellings is emptied beyond this size.
MAX_SPELLINGS = 400_000

_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[.!?\n]+|\x00")
EDGE, NAME, NUMBER, UNKNOWN = 0, 1, 2, 3
_FIRST = 4
_CAPITAL = 1 << 28
_ID = _CAPITAL - 1
_DOC = -1


class Spelling(dict):
    """Token to id (of its lower-cased form), with a flag for capitals. -1 begins a document."""

    def __init__(self, vocabulary: dict[str, int], grow: bool = False):
        super().__init__()
        self.vocabulary, self.grow = vocabulary, grow

    def __missing__(self, token: str) -> int:
        first = token[0]
        if first in ".!?\n\x00":
            code = _DOC if "\x00" in token else EDGE
        elif first.isdigit():
            code = NUMBER
        else:
            low = token.lower()
            if self.grow:
                code = self.vocabulary.setdefault(low, len(self.vocabulary) + _FIRST)
            else:
                code = self.vocabulary.get(low, UNKNOWN)
            code |= _CAPITAL * (first != low[0])
        self[token] = code
        return code


@dataclass
class Tokens:
    """Ids of a list of texts with one EDGE before each sentence; document of each sentence."""

    ids: np.ndarray
    sentence_start: np.ndarray  # places of the EDGE before a sentence of at least one word
    sentence_doc: np.ndarray
    sentence_words: np.ndarray
    words: np.ndarray  # by document


def tokenize(texts: list[str], spelling: Spelling) -> Tokens:
    if len(spelling) > MAX_SPELLINGS:
        spelling.clear()
    joined = "\x00" + "\x00".join(t.replace("\x00", " ") for t in texts)
    raw = np.fromiter(map(spelling.__getitem__, _TOKEN.findall(joined)), np.int64)
    is_doc = raw == _DOC
    doc = np.cumsum(is_doc) - 1
    edge = is_doc | (raw == EDGE)
    word = ~edge
    n = len(texts)
    ids = np.where(edge, EDGE, raw & _ID)
    after_edge = np.r_[True, edge[:-1]]
    ids[word & (raw & _CAPITAL > 0) & ~after_edge] = NAME
    start = np.flatnonzero(edge & np.r_[word[1:], False])
    total = np.cumsum(word)
    end = np.r_[start[1:], len(ids)] - 1 if len(start) else start
    return Tokens(ids, start, doc[start], total[end] - total[start] if len(start) else start, np.bincount(doc[word], minlength=n))


class LevelModels:
    """Interpolated trigram models of all levels over one vocabulary, as sorted arrays of n-grams."""

    def __init__(self, texts: list[str], levels: list[int]):
        self.vocabulary: dict[str, int] = {}
        t = tokenize(texts, Spelling(self.vocabulary, grow=True))
        v = len(self.vocabulary) + _FIRST
        self.size = v
        ids = t.ids
        level = np.asarray(levels, np.int64)[np.repeat(t.sentence_doc, np.diff(np.r_[t.sentence_start, len(ids)]))] - 1 if len(ids) else np.zeros(0, np.int64)
        if len(t.sentence_start):
            ids = ids[t.sentence_start[0] :]
        a, b, c = np.r_[EDGE, EDGE, ids[:-2]], np.r_[EDGE, ids[:-1]], ids
        a = np.where(b == EDGE, EDGE, a)
        keep = ~((b == EDGE) & (c == EDGE))
        a, b, c, level = a[keep], b[keep], c[keep], level[keep]

        def counts(key: np.ndarray, keys: np.ndarray) -> np.ndarray:
            out = np.zeros((len(keys), LEVELS))
            np.add.at(out, (np.searchsorted(keys, key), level), 1)
            return out

        one = np.zeros((v, LEVELS))
        np.add.at(one, (c, level), 1)
        total = np.maximum(1, one.sum(0))
        p1 = LAMBDA_1 * one / total + (1 - LAMBDA_1) / v
        self.log1 = np.log(p1).astype(np.float32)
        self.key2 = np.unique(b * v + c)
        n2 = counts(b * v + c, self.key2)
        context1 = np.zeros((v, LEVELS))
        np.add.at(context1, (b, level), 1)
        first, second = self.key2 // v, self.key2 % v
        seen = context1[first] > 0
        p2 = np.where(seen, LAMBDA_2 * n2 / np.maximum(1, context1[first]) + (1 - LAMBDA_2) * p1[second], p1[second])
        self.log2 = np.log(p2).astype(np.float32)
        self.back1 = np.where(context1 > 0, np.log(1 - LAMBDA_2), 0).astype(np.float32)
        # histories of two, as an index into key2 plus one; 0 is a history never seen
        history = np.searchsorted(self.key2, a * v + b)
        history = np.where(self.key2[np.minimum(history, len(self.key2) - 1)] == a * v + b, history + 1, 0) if len(self.key2) else history
        self.key3 = np.unique(history * v + c)
        n3 = counts(history * v + c, self.key3)
        context2 = np.zeros((len(self.key2) + 1, LEVELS))
        np.add.at(context2, (history, level), 1)
        h, w = self.key3 // v, self.key3 % v
        low = np.exp(self._log2(np.where(h > 0, self.key2[np.maximum(h - 1, 0)] % v, EDGE) if len(self.key2) else h, w))
        seen = context2[h] > 0
        p3 = np.where(seen, LAMBDA_3 * n3 / np.maximum(1, context2[h]) + (1 - LAMBDA_3) * low, low)
        self.log3 = np.log(p3).astype(np.float32)
        self.back2 = np.where(context2 > 0, np.log(1 - LAMBDA_3), 0).astype(np.float32)

    @staticmethod
    def _find(keys: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it is missing."""
        if not len(keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, at, -1)

    def _log2(self, b: np.ndarray, c: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        at = self._find(self.key2, b * self.size + c) if at is None else at
        out = self.log2[at] if len(self.key2) else np.zeros((len(b), LEVELS), np.float32)
        miss = np.flatnonzero(at < 0)
        out[miss] = self.back1[b[miss]] + self.log1[c[miss]]
        return out

    def log_likelihood(self, t: Tokens) -> np.ndarray:
        """By sentence and level: minus the surprisal."""
        ids = t.ids
        v = self.size
        b, c = np.r_[EDGE, ids[:-1]], ids
        two = self._find(self.key2, b * v + c)
        history = np.r_[0, two[:-1] + 1]
        start = np.flatnonzero((b == EDGE))  # a sentence's first word has the history (EDGE, EDGE), never a bigram
        history[start] = 0
        three = self._find(self.key3, history * v + c)
        out = self.log3[three] if len(self.key3) else np.zeros((len(ids), LEVELS), np.float32)
        miss = np.flatnonzero(three < 0)
        out[miss] = self.back2[history[miss]] + self._log2(b[miss], c[miss], two[miss])
        out[(b == EDGE) & (c == EDGE)] = 0
        total = np.cumsum(out, axis=0, dtype=np.float64)
        end = np.r_[t.sentence_start[1:], len(ids) - 1]  # the EDGE after a sentence belongs to it
        end = np.minimum(end, len(ids) - 1)
        return total[end] - total[t.sentence_start]

    def contrasts(self, t: Tokens) -> np.ndarray:
        """By sentence and level: how much less surprised the level's model is than the others, as shares of one."""
        ll = self.log_likelihood(t) if len(t.sentence_start) else np.zeros((0, LEVELS))
        e = np.exp(ll - ll.max(1, keepdims=True, initial=-np.inf))
        return e / e.sum(1, keepdims=True)


def weighted_medians(group: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The median of each group's values, each standing for its weight; 0 for an empty group."""
    out = np.zeros(n)
    if not len(group):
        return out
    order = np.lexsort((value, group))
    g, v, upto = group[order], value[order], np.cumsum(weight[order])
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    end = np.r_[start[1:], len(g)]
    before = np.r_[0, upto][start]
    at = np.searchsorted(upto, before + (upto[end - 1] - before) / 2)
    out[g[start]] = v[np.clip(at, start, end - 1)]
    return out


#: The letters a to z, everything between words, and any other letter.
LETTERS = 28
_LETTER = np.zeros(256, np.int32)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = _LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = np.arange(1, 27)
_LETTER[ord("?")] = 27  # what takes the place of a letter outside ASCII


def letter_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Four-letter grams of a list of texts, and the text of each; blanks and signs in a row are one."""
    raw = [t.replace("?", " ").replace("\xa0", " ").encode("ascii", "replace") + b" " for t in texts]
    c = _LETTER[np.frombuffer(b"".join(raw), np.uint8)]
    text = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    keep = np.r_[True, (c[1:] > 0) | (c[:-1] > 0)][: len(c)]
    c, text = c[keep], text[keep]
    p = np.r_[np.zeros(3, np.int32), c]
    return ((p[:-3] * LETTERS + p[1:-2]) * LETTERS + p[2:-1]) * LETTERS + p[3:], text


class LetterModel:
    """Surprisal of a letter after three others."""

    def __init__(self, texts: list[str]):
        n = np.bincount(letter_grams(texts)[0], minlength=LETTERS**4).astype(float).reshape(-1, LETTERS)
        one = (n.sum(0) + 1) / (n.sum() + LETTERS)
        self.surprisal = -np.log((n + 2 * one) / (n.sum(1, keepdims=True) + 2)).astype(np.float32).ravel()

    def mean(self, texts: list[str]) -> np.ndarray:
        """Mean surprisal of each text; infinite where there are fewer than two letters to a blank."""
        grams, text = letter_grams(texts)
        n = np.bincount(text, minlength=len(texts))
        blanks = np.bincount(text[grams % LETTERS == 0], minlength=len(texts))
        return np.where((n > 0) & (n >= 3 * blanks), np.bincount(text, weights=self.surprisal[grams], minlength=len(texts)) / np.maximum(1, n), np.inf)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone least squares by pooling adjacent violators: knots and fitted values."""
    order = np.lexsort((y, x))
    blocks: list[list[float]] = []
    for i in order:
        blocks.append([y[i], weight[i], x[i], x[i]])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            v, w, _, high = blocks.pop()
            u = blocks[-1]
            u[0], u[1], u[3] = (u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, high
    knots = np.array([k for b in blocks for k in (b[2], b[3])])
    return knots, np.array([b[0] for b in blocks for _ in (0, 1)])


@dataclass
class Grader:
    models: LevelModels
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    letters: LetterModel
    most_surprisal: float

    def difficulty(self, t: Tokens, n: int) -> np.ndarray:
        """The median over a document's words of the difficulty of their sentences."""
        return weighted_medians(t.sentence_doc, self.models.contrasts(t) @ self.weights, t.sentence_words, n)

    def grade(self, texts: list[str], spelling: Spelling, min_words: int = MIN_WORDS) -> np.ndarray:
        """Level of each text; 0 where it is no English text of enough words."""
        t = tokenize(texts, spelling)
        level = np.rint(np.interp(self.difficulty(t, len(texts)), self.knots, self.values)).astype(np.int64)
        words = t.words.copy()
        for i in np.flatnonzero((words > min_words - 10) & (words < min_words + 15)):  # near the limit, words as written
            words[i] = len(texts[i].split())
        english = self.letters.mean(texts) <= self.most_surprisal
        return np.where(english & (words >= min_words), np.clip(level, 1, LEVELS), 0)


def train(labelled: list[tuple[str, int]]) -> Grader | None:
    """Models on three quarters of the labelled texts; what is held out fits the difficulty and the isotonic map."""
    if not labelled:
        return None
    held = labelled[::HELD_OUT]
    fit = [x for i, x in enumerate(labelled) if i % HELD_OUT] or held
    models, letters = LevelModels([t for t, _ in fit], [n for _, n in fit]), LetterModel([t for t, _ in fit])
    t, level = tokenize([t for t, _ in held], Spelling(models.vocabulary)), np.array([n for _, n in held], float)
    root = np.sqrt(t.sentence_words.astype(float))
    weights = np.linalg.lstsq(models.contrasts(t) * root[:, None], level[t.sentence_doc] * root, rcond=1e-6)[0]
    grader = Grader(models, weights, np.zeros(1), np.zeros(1), letters, 0.0)
    grader.knots, grader.values = isotonic(grader.difficulty(t, len(held)), level, np.ones(len(held)))
    unseen = float(np.median(letters.mean([t for t, _ in held])))
    grader.most_surprisal = (unseen + float(np.log(LETTERS))) / 2
    return grader


def sample_labelled(documents: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, chars: int = MAX_CHARS) -> list[tuple[str, int]]:
    """At most ``bound`` labelled texts of ``chars`` characters in all, in the order of a hash of their id."""
    few = (
        labels.where(f"doc_id is not null and reading_level between 1 and {LEVELS}")
        .select("doc_id", F.col("reading_level").cast("int").alias("reading_level"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "reading_level")
        .limit(bound)
    )
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(few), "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "reading_level")
    so_far = F.sum(F.length("text")).over(W.orderBy("h", "doc_id", "reading_level"))
    got = rows.orderBy("h", "doc_id", "reading_level").limit(bound).withColumn("so_far", so_far).where(F.col("so_far") <= chars).collect()
    return [(r.text, r.reading_level) for r in sorted(got, key=lambda r: (r.h, r.doc_id, r.reading_level))]


def reading_levels(documents: DataFrame, labels: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, reading_level) of every English text of at least ``min_words`` words."""
    grader = train(sample_labelled(documents, labels))
    sent = documents.sparkSession.sparkContext.broadcast(grader)

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        spelling = Spelling(known.models.vocabulary) if known else None
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                if known is None:
                    continue
                level = known.grade([t or "" for t in part.column(1).to_pylist()], spelling, min_words)
                keep = pa.array(level > 0)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), pa.array(level[level > 0].astype(np.int32))], ["doc_id", "reading_level"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").mapInArrow(grade, "doc_id bigint, reading_level int")


def found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_label")).distinct()


def level_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source by level."""
    docs = table(spark, d, "documents")
    levels = reading_levels(docs, table(spark, d, "reading_label"))
    return levels.join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {"p9_found": found, "p9_level_profile": level_profile}
ORACLE: dict[str, str] = {}
