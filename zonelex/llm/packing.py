"""Problem 7: filling containers of fixed capacity with whole texts (hierarchical multi-length packing).

Only lengths matter for a filling, and there are at most as many lengths as the largest capacity. So the driver plans
over the histogram of lengths (its size is bounded by the capacity, not by the data), and the plan is a short table
"ranks a..b of length n go to containers c.., k a container, from position p on". Every text then finds its place from
its length and its rank within the length, which are numbered exactly and evenly (offset chunking), without moving any
text and without collecting rows.

1. Texts are measured in tokens of a public tokenizer. A text longer than the largest capacity, and no other, is
   divided into full pieces and a rest.
2. Each text is routed to the smallest window that holds ``ROUTE_RATIO`` texts of its length (else the largest).
3. Windows are packed from the longest to the shortest, each kind of container as full as possible (minimum bin
   slack over the histogram); the gaps left in a window's containers are then filled, best fit on decreasing
   lengths, from the shorter windows' texts before these are packed themselves.
4. The containers of a window are dealt to steps of ``STEP_TOKENS`` in serpentine order of their fill, so that
   the steps of a window carry nearly the same number of tokens.

Cases: null and empty texts have no tokens and are not placed; equal texts and repeated rows are placed each; equal
lengths are told apart by input order; an empty table gives no rows, and no window takes none; extra columns are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import number_rows
from ..session import materialized, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROUTE_RATIO = 6
STEP_TOKENS = 131_072

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once a process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, id_column: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every text with at least one token; null ids are kept."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], ["doc_id", "n_tokens"])

    return documents.select(documents[id_column].cast("bigint").alias("doc_id"), documents[text].alias("text")).mapInArrow(
        count, "doc_id bigint, n_tokens bigint"
    ).where("n_tokens > 0")


@dataclass
class Plan:
    """Placements (window, length, first rank, containers, copies a container, first container, position, offset) and
    the fill of every range of containers."""

    placed: list[tuple[int, int, int, int, int, int, int, int]] = field(default_factory=list)
    ranges: list[tuple[int, int, int, int]] = field(default_factory=list)  # window, first container, containers, unused


class _Window:
    """Open containers of one window, as groups (first container, containers, position) by their free space."""

    def __init__(self, number: int, capacity: int, plan: Plan):
        self.number, self.capacity, self.plan = number, capacity, plan
        self.free: list[int] = []
        self.groups: dict[int, list[tuple[int, int, int]]] = {}
        self.next = 0

    def _add(self, free: int, group: tuple[int, int, int]) -> None:
        if free not in self.groups:
            self.groups[free] = []
            insort(self.free, free)
        self.groups[free].append(group)

    def _place(self, length: int, rank: int, free: int, group: tuple[int, int, int], containers: int, copies: int) -> None:
        first, many, position = group
        self.plan.placed.append((self.number, length, rank, containers, copies, first, position, self.capacity - free))
        self._add(free - length * copies, (first, containers, position + copies))
        if containers < many:
            self._add(free, (first + containers, many - containers, position))

    def fill(self, length: int, count: int, rank: int) -> int:
        """Put up to ``count`` texts of one length into the gaps where they fit best; the number placed."""
        placed = 0
        while placed < count:
            at = bisect_left(self.free, length)
            if at < len(self.free):
                free = self.free[at]
                group = self.groups[free].pop()
                if not self.groups[free]:
                    del self.groups[free], self.free[at]
            else:
                break
            left, copies = count - placed, free // length
            whole = min(group[1], left // copies)
            if whole:
                self._place(length, rank + placed, free, group, whole, copies)
                placed += whole * copies
            else:  # fewer texts than one container takes
                self._place(length, rank + placed, free, group, 1, left)
                placed += left
        return placed

    def pack_own(self, count: dict[int, int], rank: dict[int, int]) -> None:
        """Place every text counted, filling one kind of container after the other as full as possible (minimum
        bin slack): the longest text left, then the longest that fit, and the last two or three chosen together
        to use up the rest. A kind is repeated as often as its lengths last."""
        have = np.zeros(self.capacity + 1, np.int64)
        for n, c in count.items():
            have[n] = c
        while have.any():
            kind = self._kind(have)
            many = min(int(have[n]) // k for n, k in kind.items())
            free, position = self.capacity, 0
            for n, k in sorted(kind.items(), reverse=True):
                self.plan.placed.append((self.number, n, rank[n], many, k, self.next, position, self.capacity - free))
                free, position = free - n * k, position + k
                have[n] -= many * k
                rank[n] += many * k
                count[n] -= many * k
            self._add(free, (self.next, many, position))
            self.next += many

    def _kind(self, have: np.ndarray) -> dict[int, int]:
        have = have.copy()
        kind: dict[int, int] = {}
        free = self.capacity

        def take(n: int) -> None:
            nonlocal free
            kind[n] = kind.get(n, 0) + 1
            have[n] -= 1
            free -= n

        take(int(np.flatnonzero(have)[-1]))
        while True:
            lengths = np.flatnonzero(have[: free + 1])
            if not len(lengths):
                return kind
            longest = int(lengths[-1])
            if free > 3 * longest:
                take(longest)
                continue
            best, chosen = longest, [longest]
            for first in [0, *{int(x) for x in lengths[:: max(1, len(lengths) // 8)]}]:
                rest = free - first
                a = lengths[lengths < rest]
                if first and not len(a) or best == free:
                    continue
                at = np.searchsorted(lengths, rest - a, side="right") - 1
                b = np.where(at >= 0, lengths[at], 0)
                use = a + b
                use[(b == 0) | (have[a] < 1 + (a == b) + (a == first)) | (have[b] < 1 + (a == b) + (b == first))] = 0
                if len(use) and use.max() and first + use.max() > best:
                    i = int(use.argmax())
                    best, chosen = first + int(use[i]), [x for x in (first, int(a[i]), int(b[i])) if x]
            for n in chosen:
                take(n)

    def close(self) -> None:
        for free, groups in self.groups.items():
            for first, many, _ in groups:
                self.plan.ranges.append((self.number, first, many, free))


def plan_windows(histogram: dict[int, int], windows: list[tuple[int, int]], route_ratio: int = ROUTE_RATIO) -> Plan:
    """Hierarchical plan for counts by length over (window, capacity)."""
    plan = Plan()
    order = sorted(windows, key=lambda w: w[1])
    if not order or not histogram:
        return plan
    home = {n: next((w for w, c in order if c >= route_ratio * n), order[-1][0]) for n in histogram}
    left, rank = dict(histogram), dict.fromkeys(histogram, 0)
    lengths = sorted(histogram, reverse=True)
    for number, capacity in reversed(order):
        window = _Window(number, capacity, plan)
        own = {n: left[n] for n in lengths if left[n] and home[n] == number}
        window.pack_own(own, rank)
        left.update(own)
        for n in lengths:  # its gaps
            if left[n] and n <= capacity:
                got = window.fill(n, left[n], rank[n])
                left[n] -= got
                rank[n] += got
        window.close()
    return plan


def plan_one(histogram: dict[int, int], window: int, capacity: int) -> Plan:
    """Everything into one window."""
    return plan_windows(histogram, [(window, capacity)])


def _steps(plan: Plan, capacities: dict[int, int], step_tokens: int) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """By window: first containers of its ranges, their places in the order of fill, and the number of steps."""
    out = {}
    for w, capacity in capacities.items():
        ranges = sorted((r for r in plan.ranges if r[0] == w), key=lambda r: (r[3], r[1]))
        if ranges:
            many = np.array([r[2] for r in ranges], np.int64)
            place = np.cumsum(many) - many
            first = np.array([r[1] for r in ranges], np.int64)
            by = np.argsort(first)
            steps = max(1, -(-int(many.sum()) * capacity // step_tokens))
            out[w] = (first[by], place[by], steps)
    return out


OUT = "window_id int, container bigint, position int, doc_id bigint, piece int, n_tokens bigint, offset bigint, step bigint"


def apply_plan(numbered: DataFrame, plan: Plan, capacities: dict[int, int], step_tokens: int = STEP_TOKENS) -> DataFrame:
    """The place of every (doc_id, piece, n_tokens, rank)."""
    rows = sorted(plan.placed, key=lambda r: (r[1], r[2]))
    table_ = np.array(rows, np.int64).reshape(-1, 8)
    steps = _steps(plan, capacities, step_tokens)
    sent = numbered.sparkSession.sparkContext.broadcast((table_, steps))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, by_window = sent.value
        key = t[:, 1] * (1 << 40) + t[:, 2]
        for batch in batches:
            doc, piece = batch.column(0), batch.column(1)
            n = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            r = t[np.searchsorted(key, n * (1 << 40) + rank, side="right") - 1]
            inner = rank - r[:, 2]
            container = r[:, 5] + inner // r[:, 4]
            within = inner % r[:, 4]
            step = np.zeros(len(n), np.int64)
            for w, (first, order, many) in by_window.items():
                here = r[:, 0] == w
                at = np.searchsorted(first, container[here], side="right") - 1
                lap, turn = np.divmod(order[at] + container[here] - first[at], many)
                step[here] = np.where(lap % 2 == 0, turn, many - 1 - turn)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(r[:, 0].astype(np.int32)),
                    pa.array(container),
                    pa.array((r[:, 6] + within).astype(np.int32)),
                    doc,
                    piece,
                    pa.array(n),
                    pa.array(r[:, 7] + within * n),
                    pa.array(step),
                ],
                ["window_id", "container", "position", "doc_id", "piece", "n_tokens", "offset", "step"],
            )

    return numbered.select("doc_id", "piece", "n_tokens", "rank").mapInArrow(place, OUT)


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """One row a text, or one a piece where the text alone exceeds the capacity."""
    full = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    return counts.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), full)).alias("piece"), full.alias("full")).select(
        "doc_id",
        "piece",
        F.when(F.col("piece") < F.col("full"), F.lit(capacity)).otherwise(F.col("n_tokens") - F.col("full") * capacity).cast("bigint").alias("n_tokens"),
    )


def _windows(windows: DataFrame) -> list[tuple[int, int]]:
    rows = windows.select("window_id", "capacity_tokens").where("window_id is not null and capacity_tokens > 0").distinct().limit(65).collect()
    if len(rows) > 64:
        raise ValueError("more than 64 windows")
    return [(r[0], r[1]) for r in rows]


def _histogram(items: DataFrame) -> dict[int, int]:
    """At most one entry a length, so at most as many as the capacity."""
    return {r[0]: r[1] for r in items.groupBy("n_tokens").count().collect()}


def pack(counts: DataFrame, windows: DataFrame, route_ratio: int = ROUTE_RATIO) -> DataFrame:
    """Every text once, in one of the windows."""
    w = _windows(windows)
    capacities = dict(w)
    if not w:
        return counts.sparkSession.createDataFrame([], OUT)
    items = materialized(pieces(counts, max(capacities.values())))
    numbered = number_rows(items, "n_tokens", stable=True).withColumnRenamed("_number", "rank")
    return apply_plan(numbered, plan_windows(_histogram(items), w, route_ratio), capacities)


def pack_each(counts: DataFrame, windows: DataFrame) -> DataFrame:
    """Every text once in each window; longer texts than a window are divided there."""
    counts, out = materialized(counts), None
    for number, capacity in _windows(windows):
        items = pieces(counts, capacity)
        numbered = number_rows(items, "n_tokens", stable=True).withColumnRenamed("_number", "rank")
        one = apply_plan(numbered, plan_one(_histogram(items), number, capacity), {number: capacity})
        out = one if out is None else out.unionByName(one)
    return out if out is not None else counts.sparkSession.createDataFrame([], OUT)


def packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(table(spark, d, "documents")), table(spark, d, "context_window"))


def packed_each(spark: SparkSession, d: str) -> DataFrame:
    return pack_each(token_counts(table(spark, d, "documents")), table(spark, d, "context_window"))


def fill_report(spark: SparkSession, d: str) -> DataFrame:
    """Per window: containers, tokens and the share of unused space."""
    caps = table(spark, d, "context_window").select("window_id", "capacity_tokens").distinct()
    by = packed(spark, d).groupBy("window_id").agg(F.max("container").alias("top"), F.sum("n_tokens").alias("tokens"))
    used = F.col("tokens") / ((F.col("top") + 1) * F.col("capacity_tokens"))
    return by.join(F.broadcast(caps), "window_id").select("window_id", (F.col("top") + 1).alias("containers"), "tokens", F.round(1 - used, 6).alias("unused"))


QUERIES = {"p7_packed": packed, "p7_packed_each_window": packed_each, "p7_fill_report": fill_report}
ORACLE: dict[str, str] = {}
