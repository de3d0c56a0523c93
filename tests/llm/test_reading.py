import random

import numpy as np

from zonelex.llm import reading as R

rng = random.Random(6)
GRAMMAR = {
    1: ["The {n} is by the {n}.", "We can see a {n}.", "Look at the {n}!", "I like the {n}."],
    2: ["Every year people use the {n} because it is long.", "At first nobody knew who had left the {n} behind."],
    3: ["According to a report the {n} was moved to the town without asking anyone.", "In most parts each {n} had to be checked twice by the {n}."],
    4: ["Despite considerable opposition the administration consequently introduced a {n} which was intended to regulate the {n}."],
    5: ["Notwithstanding the epistemological character of the {n} it proves upon examination to be parasitic upon the {n}."],
}
NOUNS = "oven court cache medal river bell clinic verdict harbour tempo".split()


def text(level, n=12, mixed=0.25):
    said = []
    for _ in range(n):
        k = rng.randrange(1, 6) if rng.random() < mixed else level
        said.append(rng.choice(GRAMMAR[k]).replace("{n}", "@").replace("@", rng.choice(NOUNS), 1).replace("@", rng.choice(NOUNS)))
    said += [rng.choice(GRAMMAR[level]).replace("{n}", rng.choice(NOUNS)) for _ in range(n)]
    return " ".join(said)


def test_held_out_accuracy():
    data = [(text(k), k) for _ in range(40) for k in range(1, 6)]
    g = R.train(data[:120])
    got = g.grade([t for t, _ in data[120:]], R.Spelling(g.models.vocabulary))
    assert np.mean(got == np.array([k for _, k in data[120:]])) >= 0.95
    assert all(a <= b + 1e-12 for a, b in zip(g.values, g.values[1:]))


def test_models_are_distributions():
    m = R.LevelModels([text(k) for k in range(1, 6)], [1, 2, 3, 4, 5])
    v = m.size
    everything = m._log2(np.full(v, 7), np.arange(v))
    assert np.allclose(np.exp(everything).sum(0), 1, atol=1e-3) and np.allclose(np.exp(m.log1).sum(0), 1, atol=1e-3)


def test_isotonic_equals_brute_force():
    for _ in range(50):
        x = np.sort(np.round(np.random.default_rng(rng.randrange(10**6)).uniform(0, 5, 7), 2))
        y = np.random.default_rng(rng.randrange(10**6)).integers(1, 6, 7).astype(float)
        knots, values = R.isotonic(x, y, np.ones(7))
        fit = np.interp(x, knots, values)
        assert np.all(np.diff(fit) >= -1e-9)
        # min-max formula of isotonic regression
        expected = [max(min(np.mean(y[a : b + 1]) for b in range(i, 7)) for a in range(i + 1)) for i in range(7)]
        if len(set(x)) == 7:
            assert np.allclose(fit, expected)


def test_sentences_are_cut_at_their_documents():
    s = R.Spelling({}, grow=True)
    t = R.tokenize(["One two. Three\n\nfour!", "", "...", "Five six"], s)
    assert t.words.tolist() == [4, 0, 0, 2] and t.sentence_doc.tolist() == [0, 0, 0, 3] and t.sentence_words.tolist() == [2, 1, 1, 2]


def test_table(spark):
    data = [(i, text(k), k) for i, k in enumerate([1, 2, 3, 4, 5] * 30)]
    german = "Die Bewohner von Wexgalin nutzen das alte Rathaus als Schule und der Turm ist seit dem Umbau nicht mehr offen. " * 4
    rows = [(i, t, "x") for i, t, _ in data] + [(900, None, "en"), (901, "", "en"), (902, "Too short to grade.", "en"), (903, german, "en"), (904, text(1) * 200, "de"), (905, "123 456 " * 40, "en"), (None, text(2), None), (904, text(1) * 200, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, k) for i, _, k in data[:100]] + [(None, 1), (1, None), (2, 9), (12345, 3)], "doc_id long, reading_level int")
    got = [(r.doc_id, r.reading_level) for r in R.reading_levels(docs, labels).collect()]
    level = dict(got)
    assert np.mean([level.get(i) == k for i, _, k in data]) >= 0.95
    assert level[904] == 1 and level[None] == 2 and not {900, 901, 902, 903, 905} & set(level)
    assert sum(i == 904 for i, _ in got) == 2
    assert R.reading_levels(docs, labels.limit(0)).count() == 0 and R.reading_levels(docs.limit(0), labels).count() == 0
