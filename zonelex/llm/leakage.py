"""Problem 8: passages of held-out items inside corpus texts, whole or in part and possibly altered.

Texts are reduced to their letters and digits (inline tags dropped, compatibility forms and look-alike letters folded,
ASCII-lowered), so case, spacing and punctuation don't matter. Then, in one pass over the corpus with no exchange:

1. Windows of ``WINDOW`` characters start every ``STRIDE`` characters of a text and at every character of an item, so
   each window of a copied passage meets the item's window at the same place.
2. A window is embedded by the random walk of Chakraborty, Goldenberg and Koucky: the walk copies the character under
   its cursor and moves on or not by a random bit of (step, character), which turns edits into few differing places.
3. ``REPEATS`` keys, each of ``SAMPLED`` places of the embedding, are looked up in the keys of the items (bit-sampling
   LSH). All walks of a batch advance together as arrays.
4. Pairs whose hit windows cover at least ``LEAST_HIT`` of the item are verified exactly over the whole text: common
   substrings that stand near each other are chained in order, gaps between them are aligned by longest common
   subsequence, and the matched characters must reach ``SHARE`` of the item's, less ``LEEWAY`` as copies are cut
   at word ends. If they do not, pieces of at least ``FAR`` characters are chained, whatever stands between them.

Up to ``BLOCK`` items go out by broadcast, and one map over the corpus does all. More items are never held in one place:
the keys of their windows are a table, the corpus is read once, its windows meet the item windows in an exchange on the
key (only those that pass a filter of fixed size over all item keys), coverage is gathered per pair, and the pairs
that are left meet their texts for the same verification. Cases: null, empty
and tiny texts and items give no rows (an item of fewer letters than a window counts where it stands whole and unaltered,
one of fewer than ``SEED_CHARS`` letters never); repeated documents each count; repeated items each count; very long texts
are read whole; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialized, table

WINDOW = 32
STRIDE = 8
REPEATS = 4
SAMPLED = 9
LEAST_HIT = 0.2
#: A leak holds at least this share of the item's characters (the definition says half).
SHARE = 0.5
LEEWAY = 8
SEED_CHARS = 10
#: Altered characters between two common substrings count where at least this share of them agrees in order.
ALIKE = 0.7
#: Common substrings of any size are chained within this many times the item's length, and SLACK characters; what stands
#: farther apart is chained over the whole text in pieces of at least FAR characters, SOLID of them without a change
#: or twice as many in all, as single short substrings stand in any long text by chance.
SPAN = 2
SLACK = 400
FAR = 32
SOLID = 24
BLOCK = 1_000
#: Windows embedded at once: keeps the arrays of the walk inside the CPU's cache.
AT_ONCE = 1 << 16
#: Characters of normalized text gathered before they are embedded.
GATHER = 1 << 22

_TAG = re.compile(r"<[^<>]{1,80}>")
_KEEP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_DROP = bytes(i for i in range(256) if not chr(i).isascii() or not chr(i).isalnum())
#: Letters of other scripts that look like ASCII letters.
_LOOKALIKE = str.maketrans(
    "аеорсухіјѕԁһӏԛԝвнмткзАЕОРСУХІЈЅВНМТКαονικυρτχηωΑΒΕΖΗΙΚΜΝΟΡΤΥΧɑıℓ",
    "aeopcyxijsdhlqwbhmtk3AEOPCYXIJSBHMTKaovikuptxnwABEZHIKMNOPTYXail",
)


def reduce_text(text: str | None) -> bytes:
    if not text:
        return b""
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_LOOKALIKE)).translate(_LOOKALIKE)
    return text.encode("ascii", "ignore").translate(_KEEP, _DROP)


def _walk_bits(seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    steps = 2 * WINDOW
    moves = rng.integers(0, 2, size=(steps, 256), dtype=np.int32)
    places = np.stack([np.sort(rng.choice(steps, SAMPLED, replace=False)) for _ in range(REPEATS)])
    factors = rng.integers(1, 2**62, size=(REPEATS, SAMPLED), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return moves, places, factors


def embed_keys(chars: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Per repeat, a 64-bit key of the sampled places of each window's embedding. ``chars`` must reach WINDOW
    characters beyond every start."""
    moves, places, factors = _walk_bits()
    keys = [np.zeros(len(starts), np.uint64) for _ in range(REPEATS)]
    for a in range(0, len(starts), AT_ONCE):
        first = starts[a : a + AT_ONCE]
        cursor = first.astype(np.int32)
        end = cursor + np.int32(WINDOW)
        part = [np.zeros(len(first), np.uint64) for _ in range(REPEATS)]
        for step in range(int(places.max()) + 1):
            c = chars[cursor]
            over = None
            if step >= WINDOW:
                over = cursor >= end
                c = np.where(over, np.uint8(0), c)
            for r in range(REPEATS):
                at = np.flatnonzero(places[r] == step)
                if len(at):
                    part[r] += (c.astype(np.uint64) + np.uint64(1)) * factors[r, at[0]]
            cursor += moves[step][c] if over is None else np.where(over, np.int32(0), moves[step][c])
        for r in range(REPEATS):
            h = part[r]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            keys[r][a : a + AT_ONCE] = h ^ (h >> np.uint64(32))
    return keys


class Items:
    """Keys and seeds of one block of items."""

    SLOTS = 22

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.texts = [reduce_text(t) for _, t in items]
        starts, owner, place, pool, at = [], [], [], [], 0
        for k, t in enumerate(self.texts):
            n = len(t) - WINDOW + 1
            if n > 0:
                starts.append(np.arange(at, at + n))
                owner.append(np.full(n, k, np.int32))
                place.append(np.arange(n, dtype=np.int32))
            pool.append(t + b"\0" * WINDOW)
            at += len(t) + WINDOW
        self.lengths = np.array([max(1, len(t)) for t in self.texts])
        self.chars = np.frombuffer(b"".join(pool) + b"\0", np.uint8)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int32)
        self.place = np.concatenate(place) if place else np.zeros(0, np.int32)
        self.tables = []
        for key in embed_keys(self.chars, np.concatenate(starts)) if starts else []:
            order = np.argsort(key, kind="stable")
            unique, first, count = np.unique(key[order], return_index=True, return_counts=True)
            seen = np.zeros(1 << self.SLOTS, bool)
            seen[(unique >> np.uint64(64 - self.SLOTS)).astype(np.int64)] = True
            self.tables.append((order, unique, first, count, seen))
        self.seeds: list[dict[bytes, list[int]] | None] = [None] * len(items)
        self.slots: list[np.ndarray | None] = [None] * len(items)
        self.seeded = np.zeros(1 << self.SLOTS, bool)
        self.seeded[_seed_slots(self.chars, self.SLOTS)] = True

    def hits(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(window index, item window index) of every collision in any repeat."""
        at, item = [], []
        for key, (order, unique, first, count, seen) in zip(keys, self.tables):
            maybe = np.flatnonzero(seen[(key >> np.uint64(64 - self.SLOTS)).astype(np.int64)])
            slot = np.searchsorted(unique, key[maybe])
            slot[slot == len(unique)] = 0
            same = unique[slot] == key[maybe]
            maybe, slot = maybe[same], slot[same]
            n = count[slot]
            at.append(np.repeat(maybe, n))
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item.append(order[np.repeat(first[slot], n) + inner])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate(at).astype(np.int64) * max(1, len(self.owner)) + np.concatenate(item))
        return both // max(1, len(self.owner)), both % max(1, len(self.owner))

    def seed(self, k: int) -> dict[bytes, list[int]]:
        if self.seeds[k] is None:
            t, d = self.texts[k], {}
            for p in range(len(t) - SEED_CHARS + 1):
                d.setdefault(t[p : p + SEED_CHARS], []).append(p)
            self.seeds[k] = d
        return self.seeds[k]

    def own_slots(self, k: int) -> np.ndarray:
        """The hashes of the item's seeds, in order."""
        if self.slots[k] is None:
            self.slots[k] = np.unique(_seed_slots(np.frombuffer(self.texts[k], np.uint8), self.SLOTS))
        return self.slots[k]

    def matched(self, k: int, text: bytes, blocks: list[tuple[int, int, int]]) -> float:
        """Share of the item's characters that stand near each other in ``text`` in the item's order."""
        item = self.texts[k]
        best, span = 0, SPAN * len(item) + SLACK
        score, begin = [], []
        for i, (p, d, n) in enumerate(blocks):
            top, start = n, d
            for j in range(i - 1, -1, -1):
                q, e, m = blocks[j]
                if d - e > span:
                    break
                if d + n - begin[j] > span:
                    continue
                lost = max(0, q + m - p, e + m - d)  # blocks may overlap a little
                if q < p and e < d and lost < n and lost < m:
                    gain = score[j] + n - lost
                    gap, wide = p - q - m, d - e - m
                    if 0 < gap <= 40 and 0 < wide <= 80:
                        if gain + gap <= top:
                            continue
                        same = _common(item[q + m : p], text[e + m : d])
                        gain += same if same >= ALIKE * max(gap, wide) else 0
                    if gain > top:
                        top, start = gain, begin[j]
            score.append(top)
            begin.append(start)
            best = max(best, top)
        return best / max(1, len(item))

    def blocks(self, k: int, text: bytes, places_in_text: list[int]) -> list[tuple[int, int, int]]:
        """(place in the item, place in the text, length) of the common substrings, in the text's order.
        ``places_in_text`` has every place where a seed of the item may begin."""
        item, seeds = self.texts[k], self.seed(k)
        blocks, reach = [], {}
        get = seeds.get
        for d in places_in_text:
            places = get(text[d : d + SEED_CHARS])
            if places:
                for p in places:
                    if reach.get(p - d, -1) >= p:
                        continue
                    n = SEED_CHARS
                    while p + n < len(item) and d + n < len(text) and item[p + n] == text[d + n]:
                        n += 1
                    reach[p - d] = p + n
                    blocks.append((p, d, n))
        return blocks

    def matched_apart(self, k: int, text: bytes, blocks: list[tuple[int, int, int]]) -> float:
        """Share of the item's characters that stand in ``text`` in the item's order in pieces of at least ``FAR``
        characters, ``SOLID`` of them without a change, whatever stands between the pieces."""
        item = self.texts[k]
        pieces = []  # of each block, the piece that ends with it: its characters, where it begins, its longest block
        events = []
        for i, (p, d, n) in enumerate(blocks):
            top, first, solid = n, (p, d), n
            for j in range(i - 1, -1, -1):
                q, e, m = blocks[j]
                if d - e > len(item) + 80:
                    break
                gap, wide = p - q - m, d - e - m
                lost = max(0, -gap, -wide)
                if q < p and e < d and gap <= 40 and wide <= 80 and lost < n and lost < m:
                    gain = pieces[j][0] + n - lost
                    if gap > 0 and wide > 0:
                        if gain + gap <= top:
                            continue
                        same = _common(item[q + m : p], text[e + m : d])
                        gain += same if same >= ALIKE * max(gap, wide) else 0
                    if gain > top:
                        top, first, solid = gain, pieces[j][1], max(n, pieces[j][2])
            pieces.append((top, first, solid))
            if top >= FAR and solid >= SOLID or top >= 2 * FAR:
                events += [(first[1], 1, i), (d + n, 0, i)]
        best = [0] * (len(item) + 1)  # most characters of pieces that end before a place of the item
        before = {}
        for _, begins, i in sorted(events):
            (p, _, n), (top, (start, _), _) = blocks[i], pieces[i]
            if begins:  # pieces may overlap a little in the item
                before[i] = max(best[x] - (x - start) for x in range(start, min(start + FAR, p + n)))
            else:
                for x in range(p + n, len(item) + 1):
                    if best[x] >= before[i] + top:
                        break
                    best[x] = before[i] + top
        return best[-1] / max(1, len(item))


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common subsequence, by bit-parallel addition."""
    where: dict[int, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def _seed_slots(chars: np.ndarray, bits: int) -> np.ndarray:
    """A hash of the SEED_CHARS characters from each place on."""
    n = max(0, len(chars) - SEED_CHARS + 1)
    h = np.zeros(n, np.uint64)
    for i in range(SEED_CHARS):
        h = h * np.uint64(0x9E3779B97F4A7C15) + chars[i : i + n]
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def scan(texts: list[str | None], items: Items, share: float = SHARE) -> list[tuple[int, int, float]]:
    """(text index, item index, matched share) of every leak in a list of texts."""
    out, reduced = [], [reduce_text(t) for t in texts]
    a = 0
    while a < len(reduced):
        b, size = a, 0
        while b < len(reduced) and (b == a or size + len(reduced[b]) < GATHER):
            size += len(reduced[b]) + WINDOW
            b += 1
        out += [(a + i, k, s) for i, k, s in _scan_some(reduced[a:b], items, share)]
        a = b
    return out


def _scan_some(reduced: list[bytes], items: Items, share: float) -> list[tuple[int, int, float]]:
    gap = b"\0" * WINDOW
    chars = np.frombuffer(gap.join(reduced) + gap + b"\0", np.uint8)
    sizes = np.array([len(t) for t in reduced], np.int64)
    begin = np.cumsum(sizes + WINDOW) - sizes - WINDOW
    n = np.maximum(0, (sizes - WINDOW) // STRIDE + 1)
    n[sizes < WINDOW] = 0
    out = _whole(chars.tobytes(), begin, items)
    if not n.sum() or not len(items.owner):
        return out
    doc = np.repeat(np.arange(len(reduced)), n)
    inside = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    window, target = items.hits(embed_keys(chars, begin[doc] + inside))
    if not len(window):
        return out
    pair = doc[window] * len(items.ids) + items.owner[target]
    place = items.place[target]
    order = np.lexsort((place, pair))
    pair, place = pair[order], place[order]
    new = np.r_[True, pair[1:] != pair[:-1]]
    step = np.minimum(np.r_[0, np.diff(place)], WINDOW)
    step[new] = WINDOW
    first = np.flatnonzero(new)
    covered = np.add.reduceat(step, first)
    slots = _seed_slots(chars, items.SLOTS)
    seeded = np.flatnonzero(items.seeded[slots])
    slots = slots[seeded]
    for i in np.flatnonzero(covered >= LEAST_HIT * items.lengths[pair[first] % len(items.ids)]):
        d, k = divmod(int(pair[first[i]]), len(items.ids))
        here = slice(*np.searchsorted(seeded, [begin[d], begin[d] + len(reduced[d])]))
        own = items.own_slots(k)
        known = own[np.minimum(np.searchsorted(own, slots[here]), len(own) - 1)] == slots[here]
        blocks = items.blocks(k, reduced[d], (seeded[here][known] - begin[d]).tolist())
        got = items.matched(k, reduced[d], blocks)
        least = share - LEEWAY / len(items.texts[k])
        if got < least:
            got = max(got, items.matched_apart(k, reduced[d], blocks))
        if got >= least:
            out.append((d, k, got))
    return out


def _whole(joined: bytes, begin: np.ndarray, items: Items) -> list[tuple[int, int, float]]:
    """Items too short for a window, where they stand whole and unaltered."""
    found = set()
    for k, item in enumerate(items.texts):
        if SEED_CHARS <= len(item) < WINDOW:
            at = joined.find(item)
            while at >= 0:
                found.add((int(np.searchsorted(begin, at, "right")) - 1, k))
                at = joined.find(item, at + 1)
    return [(d, k, 1.0) for d, k in sorted(found)]


def _pass(documents: DataFrame, id_column: str, text: str, rows: list[tuple[int, str]], share: float) -> DataFrame:
    """One map over the corpus for at most ``BLOCK`` items."""
    sent = documents.sparkSession.sparkContext.broadcast(rows)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                names = batch.column(0).slice(a, 4096).to_pylist()
                got = scan(batch.column(1).slice(a, 4096).to_pylist(), items, share)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[d] for d, _, _ in got], pa.int64()),
                        pa.array([items.ids[k] for _, k, _ in got], pa.int64()),
                        pa.array([s for _, _, s in got], pa.float64()),
                    ],
                    ["doc_id", "item_id", "share"],
                )

    return documents.select(documents[id_column].cast("bigint"), text).mapInArrow(find, "doc_id bigint, item_id bigint, share double")


def leaks(documents: DataFrame, eval_items: DataFrame, id_column: str = "doc_id", text: str = "text", share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, share): the corpus documents that hold held-out items."""
    items = eval_items.select(F.col("item_id").cast("bigint").alias("item_id"), "item_text").where("item_id is not null and item_text is not null")
    few = items.limit(block + 1).collect()
    if len(few) <= block:
        return _pass(documents, id_column, text, [(r[0], r[1]) for r in few], share)
    items = materialized(items)
    out = _exchanged(documents.select(documents[id_column].cast("bigint").alias("doc_id"), documents[text].alias("text")), items, share)
    some: list[tuple[int, str]] = []
    for r in _short(items).toLocalIterator():  # they have no window; one pass a block
        some.append((r[0], r[1]))
        if len(some) == block:
            out, some = out.unionByName(_pass(documents, id_column, text, some, share)), []
    return out.unionByName(_pass(documents, id_column, text, some, share)) if some else out


def _short(items: DataFrame) -> DataFrame:
    """Items with fewer letters than a window."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([SEED_CHARS <= len(reduce_text(t)) < WINDOW for t in batch.column(1).to_pylist()]))

    return items.mapInArrow(keep, items.schema)


#: Bits of the filter over the keys of all item windows.
FILTER_BITS = 1 << 26
#: Places of an item whose coverage by hit windows is told apart.
SEGMENTS = 64


def _keys_of(texts: list[bytes], stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and key of every window of every repeat; the repeat is part of the key."""
    gap = b"\0" * WINDOW
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + WINDOW) - sizes - WINDOW
    n = np.where(sizes >= WINDOW, (sizes - WINDOW) // stride + 1, 0)
    owner = np.repeat(np.arange(len(texts)), n)
    place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * stride
    keys = embed_keys(np.frombuffer(gap.join(texts) + gap + b"\0", np.uint8), begin[owner] + place)
    turned = [(k ^ np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64) for r, k in enumerate(keys)]
    return np.tile(owner, REPEATS), np.tile(place, REPEATS), np.concatenate(turned)


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with their reduced texts, some million characters each."""
    a = 0
    while a < batch.num_rows:
        texts, size = [], 0
        while a + len(texts) < batch.num_rows and (not texts or size < GATHER):
            texts.append(reduce_text(batch.column(1)[a + len(texts)].as_py()))
            size += len(texts[-1])
        yield batch.slice(a, len(texts)), texts
        a += len(texts)


def _exchanged(documents: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """The same search for any number of items. Equal texts are one candidate; hot keys are joined with salt."""
    spark = documents.sparkSession

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _batches(batch):
                owner, place, key = _keys_of(texts, 1)
                ids = part.column(0).take(pa.array(owner))
                length = np.array([len(t) for t in texts], np.int64)[owner]
                first, last = place * SEGMENTS // length, np.minimum(SEGMENTS - 1, (place + WINDOW - 1) * SEGMENTS // length)
                span = np.uint64(0xFFFFFFFFFFFFFFFF)
                bits = ((span >> (63 - (last - first)).astype(np.uint64)) << first.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(key), pa.array(bits)], ["item_id", "key", "bits"])

    windows = materialized(items.mapInArrow(item_windows, "item_id bigint, key bigint, bits bigint").groupBy("item_id", "key").agg(F.bit_or("bits").alias("bits")))
    slot = F.pmod(F.col("key"), F.lit(FILTER_BITS))
    words = windows.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(key, {FILTER_BITS}) & 63 AS INT))")).alias("b")).toPandas()
    known = np.zeros(FILTER_BITS // 64, np.int64)
    known[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(known)

    def corpus_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = sent.value
        for batch in batches:
            for part, texts in _batches(batch):
                owner, _, key = _keys_of(texts, STRIDE)
                at = key % FILTER_BITS
                hit = np.flatnonzero((table_[at >> 6] >> (at & 63)) & 1)
                pairs = np.unique(np.stack([owner[hit], key[hit]], 1), axis=0) if len(hit) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1])], ["h", "key"])

    texts = materialized(documents.where("text is not null").groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.min("text").alias("text")))
    texts = texts.select(F.xxhash64("h", "n").alias("h"), "text")
    hits = materialized(texts.mapInArrow(corpus_windows, "h bigint, key bigint"))
    # a key that many texts share is spread; each part meets a copy of the key's items
    often = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.lit(10_000)).select("key", F.least(F.lit(256), F.ceil(F.col("n") / 10_000)).cast("int").alias("parts"))
    spread = hits.join(often, "key", "left").withColumn("part", F.coalesce(F.pmod(F.col("h"), F.col("parts")), F.lit(0)).cast("int"))
    copies = windows.join(often, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    pairs = spread.join(copies, ["key", "part"]).groupBy("h", "item_id").agg(F.bit_or("bits").alias("covered")).where(F.bit_count("covered") >= F.lit(LEAST_HIT * SEGMENTS))
    held = pairs.join(items, "item_id").groupBy("h").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, t, some in zip(*(batch.column(i).to_pylist() for i in range(3))):
                got = scan([t], Items([(x["item_id"], x["item_text"]) for x in some]), share)
                out += [(h, some[k]["item_id"], s) for _, k, s in got]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["h", "item_id", "share"])

    found_ = texts.join(held, "h").select("h", "text", "items").mapInArrow(verify, "h bigint, item_id bigint, share double")
    names = documents.where("text is not null").select("doc_id", F.xxhash64(F.xxhash64("text"), F.length("text")).alias("h"))
    return names.join(found_, "h").select("doc_id", "item_id", "share")


def found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id").distinct()


def leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Report per item: leaking documents and the largest share found."""
    got = leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))
    return got.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.round(F.max("share"), 4).alias("largest_share"))


QUERIES = {"p8_found": found, "p8_leaked_items": leaked_items}
ORACLE: dict[str, str] = {}
