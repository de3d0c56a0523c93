import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zonelex.llm import packing as P

WINDOWS = [(1, 16), (2, 64), (3, 256)]


def places(plan):
    """Every placed text as (window, container, position, offset, length, rank)."""
    for w, n, rank, many, k, first, position, offset in plan.placed:
        for j in range(many * k):
            yield w, first + j // k, position + j % k, offset + j % k * n, n, rank + j


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 256), st.integers(1, 40), max_size=25))
def test_plan_is_exact(histogram):
    plan = P.plan_windows(histogram, WINDOWS)
    capacity, ranks, used, seen = dict(WINDOWS), defaultdict(list), defaultdict(list), Counter()
    for w, c, position, offset, n, rank in places(plan):
        ranks[n].append(rank)
        used[w, c].append((position, offset, n))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(k)) for n, k in histogram.items()}
    fill = {}
    for (w, c), items in used.items():
        items.sort()
        assert [p for p, _, _ in items] == list(range(len(items)))
        end = 0
        for _, offset, n in items:
            assert offset == end
            end += n
        assert end <= capacity[w]
        fill[w, c] = capacity[w] - end
        seen[w] += 1
    assert fill == {(w, first + i): free for w, first, many, free in plan.ranges for i in range(many)}


def test_little_space_is_left():
    rng = random.Random(1)
    h = Counter(min(256, max(1, int(rng.lognormvariate(2.5, 0.8)))) for _ in range(5000))
    plan = P.plan_windows(h, WINDOWS)
    capacity = dict(WINDOWS)
    whole = sum(m * capacity[w] for w, _, m, _ in plan.ranges)
    assert sum(m * f for _, _, m, f in plan.ranges) / whole < 0.01


def docs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 300))), i) for i in range(300)]
    rows += [(1000, None, 1), (1001, "", 1), (1002, "word " * 20_000, 1), (1003, rows[0][1], 1), (1003, rows[0][1], 1), (None, "x", 1), (1004, " \n", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")


def test_pack_places_every_text_once(spark, tokenizer):
    d = docs(spark)
    counts = P.token_counts(d, tokenizer=tokenizer)
    sizes = Counter()
    for r in counts.collect():
        sizes[r.doc_id] += r.n_tokens
    windows = spark.createDataFrame([(1, "s", 64), (2, "m", 256), (3, "l", 2048), (3, "l", 2048), (None, "x", 5), (4, "z", None)], "window_id int, window_name string, capacity_tokens int")
    for pack, times in ((P.pack, 1), (P.pack_each, 3)):
        rows = pack(counts, windows).collect()
        got = Counter()
        by = defaultdict(list)
        for r in rows:
            got[r.doc_id] += r.n_tokens
            by[r.window_id, r.container].append((r.position, r.offset, r.n_tokens))
        assert got == {k: v * times for k, v in sizes.items()}
        for (w, _), items in by.items():
            items.sort()
            assert [x[0] for x in items] == list(range(len(items))) and sum(x[2] for x in items) <= {1: 64, 2: 256, 3: 2048}[w]
    assert {r.doc_id for r in P.pack(counts, windows).where("piece > 0").collect()} == {1002}


def test_steps_carry_nearly_the_same(spark, tokenizer):
    plan = P.plan_windows({n: 50 for n in range(20, 200)}, [(1, 256)])
    steps = P._steps(plan, {1: 256}, 2560)[1]
    assert steps[2] == -(-sum(r[2] for r in plan.ranges) * 256 // 2560)


def test_nothing_to_pack(spark, tokenizer):
    windows = spark.createDataFrame([(1, "s", 64)], "window_id int, window_name string, capacity_tokens int")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(P.token_counts(empty, tokenizer=tokenizer), windows).count() == 0
    assert P.pack(P.token_counts(docs(spark), tokenizer=tokenizer), windows.limit(0)).count() == 0


def test_token_counts_equal_the_other_library(tokenizer):
    tokenizers = pytest.importorskip("tokenizers")
    import os

    twin = os.path.join(os.path.dirname(tokenizer), "byte_bpe_50k.json")
    if not os.path.exists(twin):
        pytest.skip("no second file of the vocabulary")
    t = tokenizers.Tokenizer.from_file(twin)
    for text in ("Hello world", "a  b\n\nc", "naïve café — 123,456", "x" * 500):
        assert len(P.encoder(tokenizer).encode_ordinary(text)) == len(t.encode(text, add_special_tokens=False).ids)
