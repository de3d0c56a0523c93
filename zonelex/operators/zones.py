"""From pages to zone fragments and to counted terms, in one Arrow pass per page (a page is one row, so its counts need
no exchange)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.porter import Stems
from ..functions.text import MAX_DIGITS, MAX_TOKEN, MIN_TOKEN, STOPWORDS, ascii_lower
from ..schema import TITLE

#: What opens a zone in lowered text, and how many characters of it are not indexed.
_OPEN = re.compile(r"(\{\{ ?infobox)|(\[\[ ?category)|(== ?external links ?==)|(== ?references ?==)")
_BRACES = re.compile(r"\{\{|\}\}")
_AFTER_LINKS = re.compile(r"\[\[ ?category")
_AFTER_REFERENCES = re.compile(r"== ?external links ?==|\[\[ ?category")
_ZONE = {1: (1, 2), 2: (2, 2), 3: (4, 4), 4: (5, 4)}
_MARKER = re.compile(r"\{\{ ?|\[\[ ?|== ?(?:external links|references) ?== ?")

BODY = 0


def split_zones(text: str, skip_marker: bool = False) -> tuple[list[tuple[int, str]], bool]:
    """Zone fragments of a lowered text, body last, and whether an infobox stayed open.

    A region's first characters are dropped (two of an infobox or category, four of a heading), so that the rest of the
    marker is indexed; ``skip_marker`` drops the whole marker. The parts of the body are joined as they are.
    """
    found: list[tuple[int, str]] = []
    body: list[str] = []
    at, failed = 0, False
    while True:
        m = _OPEN.search(text, at)
        if not m:
            body.append(text[at:])
            break
        body.append(text[at : m.start()])
        kind = m.lastindex
        zone, dropped = _ZONE[kind]
        end = len(text)
        if kind == 1:
            depth = 0
            for b in _BRACES.finditer(text, m.start()):
                depth += 1 if b.group() == "{{" else -1
                if depth == 0:
                    end = b.end()
                    break
            else:
                failed = True
        elif kind == 2:
            close = text.find("]]", m.start())
            end = close + 2 if close >= 0 else end
        else:
            follow = (_AFTER_LINKS if kind == 3 else _AFTER_REFERENCES).search(text, m.start() + 1)
            end = follow.start() if follow else end
        start = m.start() + dropped
        if skip_marker:
            start = _MARKER.match(text, m.start()).end()
        found.append((zone, text[start:end]))
        at = end
    joined = "".join(body)
    if joined:
        found.append((BODY, joined))
    return found, failed


_TOKEN = re.compile(r"[a-z0-9]+")
_DIGIT = re.compile(r"[0-9]")


class Kept(dict):
    """Memory of what a token becomes: its stem, or None where the token filter drops it."""

    BOUND = 500_000

    def __init__(self, stopwords: frozenset[str]):
        super().__init__()
        self.stopwords, self.stems = stopwords, Stems()

    def __missing__(self, token: str) -> str | None:
        if len(self) > self.BOUND:
            self.clear()
        self[token] = out = self._of(token)
        return out

    def _of(self, t: str) -> str | None:
        if not MIN_TOKEN <= len(t) <= MAX_TOKEN or _DIGIT.sub("", t) in self.stopwords:
            return None
        if t[0].isdigit() and (not t.isdigit() or len(t) > MAX_DIGITS):
            return None
        return self.stems[t]


def tokens(text: str, kept: Kept) -> list[str]:
    """Stems of the tokens that stay, in order, duplicates kept."""
    return [s for s in map(kept.__getitem__, _TOKEN.findall(text)) if s is not None]


def fragments(pages: DataFrame, skip_marker: bool = False) -> DataFrame:
    """(doc_id, zone, fragment) of pages (doc_id, title, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, zones, texts = [], [], []
            for doc, title, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for zone, fragment in [*split_zones(text or "", skip_marker)[0], (TITLE, title or "")]:
                    ids.append(doc)
                    zones.append(zone)
                    texts.append(fragment)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(zones, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "zone", "fragment"])

    return _lowered(pages).mapInArrow(cut, "doc_id bigint, zone int, fragment string")


def _lowered(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("doc_id").cast("bigint").alias("doc_id"), ascii_lower(F.col("title")).alias("title"), ascii_lower(F.col("text")).alias("text"))


def page_terms(pages: DataFrame, stopwords: tuple[str, ...] = STOPWORDS, skip_marker: bool = False) -> DataFrame:
    """(doc_id, term, tf ARRAY<INT>, in zone order) of pages (doc_id, title, text)."""
    stop = frozenset(stopwords)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(stop)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                ids, terms, counts = [], [], []
                for doc, title, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    by_term: dict[str, list[int]] = {}
                    for zone, fragment in [*split_zones(text or "", skip_marker)[0], (TITLE, title or "")]:
                        for term, n in Counter(map(kept.__getitem__, _TOKEN.findall(fragment))).items():
                            if term is not None:
                                by_term.setdefault(term, [0] * 6)[zone] += n
                    ids += [doc] * len(by_term)
                    terms += by_term
                    counts += by_term.values()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "term", "tf"])

    return _lowered(pages).mapInArrow(count, "doc_id bigint, term string, tf array<int>")


def infobox_failures(pages: DataFrame) -> DataFrame:
    """(doc_id, title) of pages whose infobox is never closed."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = pa.array([split_zones(t or "")[1] for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(bad), batch.column(1).filter(bad)], ["doc_id", "title"])

    return _lowered(pages).mapInArrow(check, "doc_id bigint, title string")
