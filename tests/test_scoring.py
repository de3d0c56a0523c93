import random
from collections import defaultdict
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from zonelex.operators import scoring
from zonelex.operators import search as sr
from zonelex.schema import ZONES

TOKENS = "query_id long, zone int, boosted boolean, term string"
POSTINGS = "term string, zone int, doc_id long, tf int"


def made_up(spark, queries=40, docs=60, n_docs=50):
    """With fewer documents than the commonest term has, some weights are 0 or negative."""
    rng = random.Random(queries)
    tokens = sorted({(q, rng.randrange(6), rng.random() < 0.3, f"t{rng.choice([0, 0, 1, 2, 3, 9])}") for q in range(queries) for _ in range(4)})
    tokens += [(1000 + q, z, b, t) for q, z, b, t in tokens if q < 10]  # the same query again under another id
    postings = sorted({(f"t{t}", z, d): (f"t{t}", z, d, rng.choice([1, 1, 2, 10])) for d in range(docs) for t in range(5) for z in range(6) if t == 0 or rng.random() < 0.3}.values())
    df, by = defaultdict(int), defaultdict(list)
    for t, z, d, tf in postings:
        df[t, z] += 1
        by[t, z].append((d, min(tf, 1) if z == 3 else tf))
    scores = defaultdict(float)
    for q, z, b, t in tokens:
        for d, tf in by[t, z]:
            scores[q, d] += (1 + log10(tf)) * log10(n_docs / df[t, z]) * ZONES[z].weight * (100 if b else 1)
    total = spark.createDataFrame([(n_docs,)], "total_docs long")
    return spark.createDataFrame(tokens, TOKENS), spark.createDataFrame(postings, POSTINGS), total, {k: round(v, 9) for k, v in scores.items()}


def as_dict(df):
    rows = df.collect()
    assert len({(r.query_id, r.doc_id) for r in rows}) == len(rows)
    return {(r.query_id, r.doc_id): r.score for r in rows}


@pytest.mark.parametrize("n_docs", [50, 60, 5000])
@pytest.mark.parametrize("cells", [1_000_000, 0])
def test_scores_equal_the_sums(spark, monkeypatch, n_docs, cells):
    tokens, postings, total, expected = made_up(spark, n_docs=n_docs)
    monkeypatch.setattr(scoring, "CELLS", cells)
    assert as_dict(sr.score(tokens, postings, total)) == pytest.approx(expected, abs=1e-8)
    monkeypatch.setattr(sr, "BLOCK_TOKENS", 30)
    assert as_dict(sr.score(tokens, postings, total)) == pytest.approx(expected, abs=1e-8)


def test_what_queries_and_documents_share_is_not_exchanged(spark):
    """search_all_zones: 200 queries for one word of 200 documents are 40,000 scores, of 200 postings."""
    tokens = spark.createDataFrame([(q, 0, False, "a") for q in range(200)], TOKENS)
    postings = spark.createDataFrame([("a", 0, d, 1) for d in range(200)], POSTINGS)
    scores = sr.score(tokens, postings, spark.createDataFrame([(400,)], "total_docs long"))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1 and "hashpartitioning(query_id" not in plan
    assert scores.count() == 40_000


def weights(tokens, k, place, df, n_docs):
    q, z, b, t = zip(*tokens)
    w = scoring.Weights(pa.table({"query_id": list(q), "zone": list(z), "boosted": list(b), "term": list(t), "k": [k] * len(q)}))
    return w.arrays(np.array(place), np.array(df), n_docs)


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
@pytest.mark.parametrize("hits", [1, 250_000])
def test_batches_that_part_documents(monkeypatch, size, hits):
    monkeypatch.setattr(scoring, "HITS", hits)
    w = weights([(7, 0, False, "a"), (7, 0, False, "b"), (8, 0, True, "b")], 3, [0, 1], [50, 10], 1000)
    rows = [(d, p, 1 + d % 3) for d in range(40, 0, -1) for p in (0, 1) if p == 0 or d % 4 == 0]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size])], ["doc_id", "place", "tf"]) for i in range(0, len(rows), size)]
    expected = defaultdict(float)
    for d, p, tf in rows:
        for q, x in [(7, 1)] if p == 0 else [(7, 1), (8, 100)]:
            expected[q, d] += (1 + log10(tf)) * log10(1000 / [50, 10][p]) * x
    got = {(r["query_id"], r["doc_id"]): r["score"] for b in scoring.Scorer(w, False, 9).run(batches) for r in b.to_pylist()}
    assert got == pytest.approx(expected, abs=1e-8)


@pytest.mark.parametrize("waiting, held", [(400_000, 10_000), (1, 10_000), (1, 2)])
@pytest.mark.parametrize("n_docs", [50, 5000])
def test_only_the_best_leave_a_task(waiting, held, n_docs, monkeypatch):
    """search_body_topk: k scores of each query of 2,000 documents, equal ones by the larger document."""
    monkeypatch.setattr(scoring, "WAITING", waiting)
    monkeypatch.setattr(scoring, "HELD", held)
    monkeypatch.setattr(scoring, "HITS", 500)
    w = weights([(7, 0, False, "a"), (7, 0, False, "b"), (8, 0, True, "b"), (9, 0, True, "b")], 3, [0, 1], [2000, 60], n_docs)
    rows = [(d, p, 1 + d % 5 % 3) for d in range(2000, 0, -1) for p in (0, 1) if p == 0 or d % 40 == 0]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 100])], ["doc_id", "place", "tf"]) for i in range(0, len(rows), 100)]

    def answers(best):
        out = defaultdict(list)
        for b in scoring.Scorer(w, best, 9).run(iter(batches)):
            for r in b.to_pylist():
                out[r["query_id"]].append((-r["score"], -r["doc_id"]))
        return {q: sorted(x) for q, x in out.items()}

    every, few = answers(False), answers(True)
    assert {q: x[:3] for q, x in every.items()} == {q: x[:3] for q, x in few.items()} and every[8] == every[9] and len(every[7]) == 2000
    assert held == 2 or all(len(x) == 3 for x in few.values())


def test_best_scores_equal_the_cut_of_all(spark):
    tokens, postings, total, _ = made_up(spark)
    queries = tokens.select("query_id").distinct().selectExpr("query_id", "cast(query_id % 6 as int) AS k")  # some want nothing
    best = sr.score(tokens, postings, total, best=queries)
    every = sr.score(tokens, postings, total)
    assert sorted(sr.top_k(best, queries).collect()) == sorted(sr.top_k(every, queries).collect())
    assert best.count() < every.count() / 2


def test_a_batch_moves_few_scores(spark, monkeypatch):
    """search_batch: of 100 queries for a word of 300 documents only the best scores of each task are ranked, not 30,000."""
    seen = []
    monkeypatch.setattr(sr, "top_k", lambda scores, queries, ranked=sr.top_k: (seen.append(scores.count()), ranked(scores, queries))[1])
    postings = spark.createDataFrame([("cat", 0, d, 1 + d % 3) for d in range(300)], POSTINGS)
    docs = spark.createDataFrame([(d, f"title {d}") for d in range(400)], "doc_id long, title string")
    queries = spark.createDataFrame([(q, 2, "cat") for q in range(100)], "query_id long, k int, query_text string")
    got = sr.search(queries, postings, docs).collect()
    assert sorted((r.query_id, r.rank, r.doc_id) for r in got) == sorted((q, i + 1, d) for q in range(100) for i, d in enumerate((299, 296)))
    tasks = max(2 * spark.sparkContext.defaultParallelism, 1)
    assert seen[0] <= 100 * 2 * tasks
