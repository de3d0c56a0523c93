import math
from collections import Counter, defaultdict

import pytest

from tests.compare import assert_same, duck
from zonelex.llm import distinctive, frequency

POSTING = "posting_id long, term string, doc_id long, freq string, checkpoint_no int, loaded_at timestamp, tf long, df long"


def postings(spark):
    import datetime as dt

    t = [dt.datetime(2020, 1, d) for d in (1, 2, 3)]
    rows = [
        (1, " Cat ", 1, "2", 0, t[0]), (2, "cat", 1, "9i1", 0, t[1]), (3, "cat", 2, None, 0, None), (4, "dog", 1, "", 0, t[0]), (5, "dog", 1, "5t3", 0, t[0]),
        (6, None, 1, "7", 0, t[0]), (7, "dog", None, "7", 0, t[0]), (8, "emu", 3, "4", 0, t[2]), (9, "emu", 3, "4", 0, t[2]), (10, "ox", 3, "4", 0, t[2]), (11, "yak", 3, "1", 0, t[2]),
    ]
    return spark.createDataFrame([(*r, 1, 1) for r in rows], POSTING)


def test_scores_by_hand(spark):
    got = {(r.doc_id, r.term): r for r in distinctive.term_scores(postings(spark)).collect()}
    assert set(got) == {(1, "cat"), (2, "cat"), (1, "dog"), (3, "emu"), (3, "ox"), (3, "yak")}
    assert (got[1, "cat"].tf, got[1, "dog"].tf, got[2, "cat"].tf) == (10, 6, 0)
    n, df, length = 3, 2, 16
    assert got[1, "cat"].score == pytest.approx((1 + math.log10(10)) * math.log10((1 + n) / (1 + df)) / math.sqrt(length))
    assert got[2, "cat"].score == 0


def test_characteristic_terms_break_ties_by_the_term(spark):
    rows = [(i, d, t, 5, 1, 100, 1.0) for i, (d, t) in enumerate([(1, "b"), (1, "a"), (1, "d"), (1, "c")])] + [(9, 1, "rare", 2, 1, 100, 9.0), (10, 1, "common", 50, 99, 100, 9.0)]
    s = spark.createDataFrame(rows, "i int, doc_id long, term string, tf long, df long, n_docs long, score double")
    assert sorted(r.term for r in distinctive.characteristic(s).collect()) == ["a", "b", "c"]


def test_bitmaps_equal_brute_force(spark):
    rows = [("hot", i % 900) for i in range(3000)] + [(f"t{i % 40}", i * 13 % 5000) for i in range(2000)] + [(None, 1), ("x", None), ("neg", -5), ("neg", -5), ("big", 2**40)]
    df = spark.createDataFrame([(t, r, "clash") for t, r in rows], "term string, rec long, bits string")
    layout = frequency.vertical(df, "term", "rec", __import__("pyspark").sql.functions.lit(1))
    got = {r.term: (r.n_uses, r.n_records) for r in frequency.dictionary(layout).collect()}
    uses, records = Counter(), defaultdict(set)
    for t, r in rows:
        if t is not None and r is not None:
            uses[t] += 1
            records[t].add(r)
    assert got == {t: (uses[t], len(records[t])) for t in uses}
    assert frequency.cardinality(df, "rec").first()[0] == len({r for _, r in rows if r is not None})
    back = defaultdict(set)
    for c in layout.collect():
        places = frequency.unpack(c.form, bytes(c.data))
        assert c.n_records == len(places) and list(places) == sorted(set(places.tolist()))
        back[c.term] |= {(c.container << 16) + int(x) for x in places}
    assert back == records
    assert layout.count() == len({(t, r >> 16) for t in records for r in records[t]})


@pytest.mark.parametrize("form, places", [(0, [3]), (0, [1, 5, 9, 65535]), (2, list(range(100, 9_000))), (1, list(range(0, 65_536, 3))), (2, list(range(65_536))), (2, list(range(10)) + [40, 41, 42, 43, 44, 45, 46])])
def test_forms_of_a_container(form, places):
    import numpy as np

    got, data = frequency.pack(np.array(places, np.uint16))
    assert got == form and frequency.unpack(got, data).tolist() == places and len(data) <= 8192


def test_dense_and_hot_terms_merge_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(frequency, "AT_ONCE", 1000)
    rows = [("dense", i) for i in range(20_000)] + [("third", i) for i in range(0, 200_000, 3)] + [("dense", i) for i in range(0, 20_000, 2)] + [("rare", 7)]
    df = spark.createDataFrame(rows, "term string, rec long").repartition(5)
    layout = frequency.vertical(df, "term", "rec", __import__("pyspark").sql.functions.lit(1))
    got = {r.term: (r.n_uses, r.n_records) for r in frequency.dictionary(layout).collect()}
    assert got == {"dense": (30_000, 20_000), "third": (66_667, 66_667), "rare": (1, 1)}
    forms = {(r.term, r.form) for r in layout.select("term", "form").distinct().collect()}
    assert ("dense", 2) in forms and ("third", 1) in forms and ("rare", 0) in forms


def test_latest_page_counts_and_null_bodies_do_not(spark):
    import datetime as dt

    t = dt.datetime(2020, 1, 1)
    rows = [(1, 7, t, "old words"), (2, 7, t, "New words!"), (3, 8, t, None), (4, 8, None, "older"), (5, None, t, "no page"), (6, 9, None, "")]
    pages = spark.createDataFrame(rows, "page_row long, id long, loaded_at timestamp, body string")
    assert {(r.id, r.body) for r in frequency.latest_pages(pages).collect()} == {(7, "New words!"), (9, "")}


@pytest.mark.parametrize("module", [distinctive, frequency])
def test_queries_equal_sql(spark, data, module):
    for name, sql in module.ORACLE.items():
        assert_same(module.QUERIES[name](spark, data), sql, duck(data))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], POSTING)
    assert distinctive.characteristic(distinctive.term_scores(empty)).count() == 0
    assert frequency.cardinality(empty, "doc_id").first()[0] == 0
    assert frequency.vertical(empty, "term", "doc_id", empty["tf"]).count() == 0
