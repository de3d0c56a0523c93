import random

import pytest

from zonelex.llm import leakage as L

rng = random.Random(4)
WORDS = [f"{a}{b}{c}" for a in "btkms" for b in ("al", "or", "in", "ever") for c in ("an", "y", "ost", "ic", "ed")]
ITEMS = [(i, " ".join(rng.choice(WORDS) for _ in range(60)).capitalize() + ". Which of the following best describes the role of it?") for i in range(30)]


def noise(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def altered(text, kind):
    w = text.split()
    if kind == "upper":
        return text.upper()
    if kind == "tags":
        return " ".join(f"<b>{x}</b>" if i % 3 == 0 else x for i, x in enumerate(w))
    if kind == "spaces":
        return "\u00a0\n".join(w)
    if kind == "words":
        return " ".join("other" if i % 9 == 4 else x for i, x in enumerate(w))
    if kind == "inserted":
        return " ".join(x + (" indeed" if i % 8 == 3 else "") for i, x in enumerate(w))
    if kind == "lookalike":
        return text.replace("a", "а").replace("o", "о")
    if kind == "half":
        return " ".join(w[: int(len(w) * 0.7)])
    if kind == "split":
        return " ".join(w[:30]) + " " + noise(12) + " " + " ".join(w[30:])
    if kind == "typos":
        return " ".join(x[:-1] + "q" if i % 6 == 0 else x for i, x in enumerate(w))
    return text


KINDS = ["same", "upper", "tags", "spaces", "words", "inserted", "lookalike", "half", "split", "typos"]


@pytest.mark.parametrize("kind", KINDS)
def test_altered_copies_are_found(kind):
    items = L.Items(ITEMS)
    texts = [noise(80) + " " + altered(t, kind) + " " + noise(80) for _, t in ITEMS]
    found = {(d, k) for d, k, _ in L.scan(texts, items)}
    assert len(found & {(i, i) for i in range(30)}) >= 29 and not {f for f in found if f[0] != f[1]}


def test_questions_and_short_quotations_are_none():
    items = L.Items(ITEMS)
    texts = [noise(50) + " Which of the following best describes the role of it? " + noise(50)] + [noise(40) + " " + " ".join(t.split()[:12]) + " " + noise(40) for _, t in ITEMS]
    assert L.scan(texts, items) == []


def test_common_subsequence_equals_the_table():
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = 0
            for j, y in enumerate(b):
                old, row[j + 1] = row[j + 1], old + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    for _ in range(200):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(20))) for _ in range(2))
        assert L._common(a, b) == table(a, b)


def test_table(spark):
    whole = ITEMS[3][1]
    docs = [(1, noise(30) + whole), (2, None), (3, ""), (4, "tiny"), (1, whole), (None, whole), (5, noise(60_000) + " " + whole), (6, whole.upper())]
    d = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(i, t) for i, t in ITEMS] + [(None, "x"), (77, None), (78, ""), (79, whole)], "item_id long, item_text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in L.leaks(d, e).collect())
    assert got == sorted((i, k) for i in (0, 1, 1, 5, 6) for k in (3, 79))
    assert sorted((r.doc_id or 0, r.item_id) for r in L.leaks(d, e, block=7).collect()) == got  # by an exchange of keys
    assert L.leaks(d.limit(0), e).count() == 0 and L.leaks(d, e.limit(0)).count() == 0


@pytest.mark.parametrize("between", [400, 3_000])
def test_pieces_far_apart_are_found(between):
    items = L.Items(ITEMS)
    other = noise(between)[::-1]
    halves = [(t.split()[:34], t.split()[34:]) for _, t in ITEMS[:12]]
    texts = [" ".join([noise(50), *a, other, *b, noise(50)]) for a, b in halves]
    assert {(d, k) for d, k, _ in L.scan(texts, items)} == {(i, i) for i in range(12)}
    one = [" ".join([noise(50), *a[:26], other, *a[:26]]) for a, _ in halves]  # the same part twice
    turned = [" ".join([noise(50), *b[:22], other, *a[10:]]) for a, b in halves]  # not in the item's order
    assert L.scan(one + turned, items) == []


@pytest.mark.parametrize("share", [0.5, 0.52, 0.54])
def test_half_copies_are_found(share):
    long = [(i, " ".join(rng.choice(WORDS) for _ in range(80))) for i in range(20)]
    texts = []
    for _, t in long:
        w = t.split()
        n = round(len(w) * share)
        texts.append(" ".join([noise(60), *w[20 : 20 + n], noise(60)]))
    assert {(d, k) for d, k, _ in L.scan(texts, L.Items(long))} == {(i, i) for i in range(20)}
    less = [" ".join([noise(60), *t.split()[20 : 20 + 24], noise(60)]) for _, t in long]
    assert L.scan(less, L.Items(long)) == []


@pytest.mark.parametrize("parts,between", [(2, 200), (4, 150), (4, 3_000)])
def test_complete_items_in_parts_are_found(parts, between):
    long = [(i, " ".join(rng.choice(WORDS) for _ in range(80))) for i in range(10)]
    texts = []
    for _, t in long:
        w, n = t.split(), 80 // parts
        texts.append(f" {noise(between)[::-1]} ".join(" ".join(w[a : a + n]) for a in range(0, 80, n)))
    assert {(d, k) for d, k, _ in L.scan(texts, L.Items(long))} == {(i, i) for i in range(10)}


def test_items_shorter_than_a_window():
    items = L.Items([(1, "Who drained the lake?"), (2, "Why?"), (3, ITEMS[0][1])])
    texts = ["He asked: who drained -- the LAKE", "who drained that lake", "why", None, "so who drained the lake. " * 3]
    assert L.scan(texts, items) == [(0, 0, 1.0), (4, 0, 1.0)]


def test_hashing_loses_few_of_what_an_alignment_of_all_pairs_finds():
    items = L.Items(ITEMS)
    texts = [noise(40) + " " + altered(" ".join(t.split()[: rng.randrange(42, 70)]), kind) + " " + noise(40) for kind in KINDS for _, t in ITEMS[:12]]
    reduced = [L.reduce_text(t) for t in texts]
    every = {
        (d, k)
        for d, t in enumerate(reduced)
        for k in range(len(ITEMS))
        if max(items.matched(k, t, items.blocks(k, t, list(range(len(t))))), items.matched_apart(k, t, items.blocks(k, t, list(range(len(t)))))) >= L.SHARE - L.LEEWAY / len(items.texts[k])
    }
    found = {(d, k) for d, k, _ in L.scan(texts, items)}
    assert found <= every and len(found) >= 0.9 * len(every) > 60


def test_exchanged_keys_find_what_the_broadcast_finds(spark):
    texts = [noise(60) + " " + altered(t, kind) + " " + noise(60) for kind in KINDS for _, t in ITEMS[:10]] + [noise(300)] * 20
    d = spark.createDataFrame(list(enumerate(texts + texts[:5])), "doc_id long, text string").repartition(4)
    e = spark.createDataFrame([*ITEMS, (900, "Who drained the lake?"), (901, texts[-1][:25]), (902, "Why?")], "item_id long, item_text string")
    one, other = ({(r.doc_id, r.item_id) for r in L.leaks(d, e, block=b).collect()} for b in (1_000, 10))
    assert one == other and len(one) >= 120 and {k for _, k in one} >= {901}
