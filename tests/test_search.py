import random

import pytest

from zonelex.operators import index as ix
from zonelex.operators import search as sr
from zonelex.sources import lists, storage

PARSED = {
    "people": ("people", {}),
    "t:egypt i:nile": ("", {3: "egypt ", 1: "nile"}),
    "world t:cup": ("world ", {3: "cup"}),
    "about:blank": ("abou", {3: "blank"}),
    "e:anarchism": ("e:anarchism", {}),
    "t:foo i:bar t:baz": ("", {3: "foo baz", 1: "bar "}),
    "t:foot:bar": ("", {3: "foobar"}),
    "i:": ("", {1: ""}),
}


@pytest.mark.parametrize("query", sorted(PARSED))
def test_query_parser(spark, query):
    free, zones = PARSED[query]
    got = sr.parse_queries(spark.createDataFrame([(1, 3, query)], "query_id long, k int, query_text string")).collect()
    assert {r.zone: r.text for r in got if r.boosted} == zones
    assert {(r.zone, r.text) for r in got if not r.boosted} == ({(z, free) for z in range(6)} if free else set())


@pytest.fixture(scope="module")
def small(spark):
    tf = [("cat", 0, 0, 1), ("cat", 0, 1, 2), ("cat", 0, 2, 10), ("cat", 0, 3, 1), ("cat", 0, 4, 1), ("cat", 3, 2, 1), ("ball", 0, 5, 1)]
    postings = spark.createDataFrame(tf, "term string, zone int, doc_id long, tf int")
    docs = spark.createDataFrame([(i, f"title {i}") for i in range(6)], "doc_id long, title string")
    return postings, docs


def run(spark, small, k, text, **how):
    q = spark.createDataFrame([(7, k, text)], "query_id long, k int, query_text string")
    return sr.search(q, *small, **how).orderBy("rank").collect()


def test_ranking(spark, small):
    got = run(spark, small, 3, "cat")
    assert [r.doc_id for r in got] == [2, 1, 4]
    assert [r.score for r in got] == pytest.approx([39.0659250113, 0.1030171762, 0.0791812460], abs=1e-8)
    assert [(r.doc_id, r.score) for r in run(spark, small, 3, "cat cat")] == [(r.doc_id, r.score) for r in got]


def test_padding_and_fallback(spark, small):
    got = run(spark, small, 5, "t:cat")
    assert [(r.doc_id, r.is_padding) for r in got] == [(2, False), (0, True), (1, True), (3, True), (4, True)]
    assert got[0].score == pytest.approx(3890.7562519182, abs=1e-6)
    assert [(r.doc_id, r.title, r.score) for r in run(spark, small, 3, "zzz")] == [(2, "title 2", 0.0), (1, "title 1", 0.0), (0, "title 0", 0.0)]
    assert len(run(spark, small, 9, "cat")) == 9  # more than there are documents: ids without a title
    assert run(spark, small, 0, "cat") == []


def one_split(spark):
    return spark.createDataFrame([("",)], "first_term string")


def test_forward_scan_compatibility(spark, small):
    tokens = sr.query_tokens(sr.parse_queries(spark.createDataFrame([(1, 3, "ball cat")], "query_id long, k int, query_text string")), distinct=False)
    alive = {(r.zone, r.term) for r in sr.scan_tokens(tokens, small[0], one_split(spark)).collect()}
    assert alive == {(0, "ball"), (0, "cat")}  # in the title zone the cursor ran out on "ball"
    clean = [r for r in run(spark, small, 6, "ball cat") if r.doc_id == 2][0].score
    compat = [r for r in run(spark, small, 6, "ball cat", milestones=one_split(spark)) if r.doc_id == 2][0].score
    assert clean > 39 > compat


def test_more_tokens_than_are_broadcast(spark, small, monkeypatch):
    q = spark.createDataFrame([(i, 4, t) for i, t in enumerate(["cat", "t:cat ball", "ball cat", "zzz"])], "query_id long, k int, query_text string")
    expected = sorted(tuple(r) for r in sr.search(q, *small).collect())
    monkeypatch.setattr(sr._side, "__defaults__", (1,))
    assert sorted(tuple(r) for r in sr.search(q, *small).collect()) == expected


PAGES = [(0, "Alpha", "{{Infobox a|cat}} cat cat Dog"), (1, "File:x", "cat"), (2, "Beta", "#REDIRECT [[a]]"), (3, "Gamma", None), (4, "", "cat"), (5, "Cat", "cat [[Category:cat]]")]


def test_build_write_read_and_search(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "id long, title string, text string")
    kept = ix.with_dense_ids(ix.kept_pages(pages), ["id"])
    assert [(r.doc_id, r.title) for r in kept.orderBy("doc_id").collect()] == [(0, "Alpha"), (1, "Gamma"), (2, "Cat")]
    index = ix.build_index(kept.select("doc_id", "title", "text"), min_df=1)
    storage.write_index(index, str(tmp_path / "index"))
    back = storage.read_index(spark, str(tmp_path / "index"))
    assert back.wide.count() == index.wide.count()
    stats = back.stats.first()
    assert (stats.total_docs, stats.total_terms, stats.splits) == (3, back.terms.count(), 1)
    got = {(r.term, r.doc_id): list(r.tf) for r in back.wide.collect()}
    assert got[("cat", 0)] == [2, 1, 0, 0, 0, 0] and got[("cat", 2)] == [1, 0, 1, 1, 0, 0]
    q = spark.createDataFrame([(1, 2, "dog")], "query_id long, k int, query_text string")
    best = sr.search(q, back.postings, back.docs, back.stats, back.zone_df).orderBy("rank").collect()
    assert (best[0].doc_id, best[0].title) == (0, "alpha")
    marks = spark.read.parquet(str(tmp_path / "index" / "milestones")).collect()
    assert len(marks) == 1 and marks[0].n_terms == stats.total_terms


def test_df_filter_counts_documents_not_uses(spark):
    rows = [(d, "often", [1, 1, 0, 0, 0, 0]) for d in range(5)] + [(d, "rare", [9, 0, 0, 0, 0, 0]) for d in range(4)]
    wide = spark.createDataFrame(rows, "doc_id long, term string, tf array<int>")
    assert {r.term for r in ix.frequent_postings(wide).collect()} == {"often"}
    assert {(r.zone, r.df) for r in ix.zone_frequencies(wide).where("term = 'often'").collect()} == {(0, 5), (1, 5)}


def brute_splits(terms, min_df=5, most_terms=10_000, most_postings=1_000_000):
    out, split, n, postings, kept = {}, 0, 0, 0, 0
    for t, df in sorted(terms):
        n, postings = n + 1, postings + df
        if df >= min_df:
            kept += 1
            out[t] = split
        if n >= most_terms or postings >= most_postings:
            split += kept > 0
            n = postings = kept = 0
    return out


@pytest.mark.parametrize("seed", range(4))
def test_exact_splits_equal_the_fold(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(ix, "SPLIT_TERMS", 37)
    monkeypatch.setattr(ix, "SPLIT_POSTINGS", 200)
    terms = [(f"t{i:05d}", rng.choice([1, 1, 2, 3, 5, 9, 30, 260])) for i in range(rng.choice([0, 1, 36, 900]))]
    terms += [(f"u{i:05d}", 1) for i in range(200 * (seed % 2))]  # splits without a term that stays
    terms += [(f"v{i:05d}", 6) for i in range(50)]
    got = ix.exact_splits(spark.createDataFrame(terms, "term string, df bigint")).collect()
    assert {r.term: r.split for r in got} == brute_splits(terms, most_terms=37, most_postings=200) and len(got) == len({r.term for r in got})
    assert ix.exact_splits(spark.createDataFrame([], "term string, df bigint")).count() == 0


def test_exact_splits_count_rare_terms_too(spark):
    terms = spark.createDataFrame([(f"t{i:05d}", 1 if i % 2 else 5) for i in range(20_004)], "term string, df bigint")
    got = ix.milestones(ix.exact_splits(terms)).orderBy("split").collect()
    assert [(r.split, r.first_term, r.n_terms) for r in got] == [(0, "t00000", 5000), (1, "t10000", 5000), (2, "t20000", 2)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("2\nthe\na\n")
    assert lists.read_stopwords(spark, str(tmp_path / "stop.txt")) == ("the", "a")
    (tmp_path / "bad.txt").write_text("the\n")
    with pytest.raises(ValueError):
        lists.read_stopwords(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "q.txt").write_text("3, world t:cup\nno number\n10,x  two blanks\n")
    assert [tuple(r) for r in lists.read_queries(spark, str(tmp_path / "q.txt")).collect()] == [(0, 3, "world t:cup"), (2, 10, " two blanks")]
    lists.write_text(spark.createDataFrame([("ab",), ("c",)], "value string"), str(tmp_path / "z"), compressed=True)
    assert list((tmp_path / "z").glob("*.bz2"))
    assert tuple(lists.text_volume(lists.read_text(spark, str(tmp_path / "z"))).first()) == (2, 3)
    assert lists.matching_lines(lists.read_text(spark, str(tmp_path / "z")), "^a").count() == 1


def test_xml_source(spark, tmp_path):
    from zonelex.sources.pages import read_xml

    head = '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/"><siteinfo><sitename>x</sitename></siteinfo>'
    for name, body in (("b.xml", "<page><title>T &amp; U</title><id>3</id><revision><id>9</id><text bytes=\"4\" xml:space=\"preserve\">a &lt;b</text></revision></page>"), ("a.xml", "<page><title>V</title><id>1</id><revision><text/></revision></page>")):
        (tmp_path / name).write_text(head + body + "</mediawiki>")
    got = read_xml(spark, [str(tmp_path / "b.xml"), str(tmp_path / "a.xml")]).orderBy("file_no").collect()
    assert [(r.file_no, r.id, r.title, r.text or "") for r in got] == [(0, 3, "T & U", "a <b"), (1, 1, "V", "")]
