import datetime as dt

from zonelex import cli
from zonelex.streaming.ingest import arrivals_by_hour, arriving_pages, start_ingest


def test_index_and_search_commands(spark, tmp_path):
    page = "<page><title>{t}</title><id>{i}</id><revision><text>{b}</text></revision></page>"
    texts = ["cat dog {{Infobox cat}}", "dog dog", "bird", "#REDIRECT [[x]]", "{{infobox open cat"]
    body = "".join(page.format(t=f"Title {i}", i=i, b=b) for i, b in enumerate(texts))
    (tmp_path / "dump.xml").write_text(f"<mediawiki><siteinfo/>{body}</mediawiki>")
    (tmp_path / "q.txt").write_text("2, cat\n1, t:bird\n3,  nothing\n")
    cli.build(spark, str(tmp_path / "index"), [str(tmp_path / "dump.xml")], min_df=1)
    cli.answer(spark, str(tmp_path / "index"), str(tmp_path / "q.txt"), str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    groups = [[x for x in g.split("\n") if x] for g in "\n".join(lines).split("\n\n")]
    assert [g[:-1] for g in groups if g] == [["0, title 0", "3, title 4"], ["0, title 0"], ["2, title 2", "1, title 1", "0, title 0"]]
    assert all(float(g[-1]) > 0 for g in groups if g)
    assert [f.read_text() for f in (tmp_path / "index" / "stat.txt").glob("part-*") if f.read_text()] == ["4 14 6 1\n"]
    titles = [x for f in sorted((tmp_path / "index" / "titles.txt").glob("part-*")) for x in f.read_text().splitlines()]
    assert titles == ["title 0", "title 1", "title 2", "title 4"]
    failed = [x for f in (tmp_path / "index" / "failures.txt").glob("part-*") for x in f.read_text().splitlines()]
    assert failed == ["!title 4"]
    cli.answer(spark, str(tmp_path / "index"), str(tmp_path / "q.txt"), str(tmp_path / "out2"), compat_scan=True)
    assert list((tmp_path / "out2").glob("part-*"))


def test_stream_takes_each_page_once(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "doc_id BIGINT, title STRING, text STRING, arrived TIMESTAMP"
    first = spark.createDataFrame([(0, "A", "cat cat", t), (1, "File:x", "cat", t)], schema)
    again = spark.createDataFrame([(0, "A", "cat cat", t), (2, "B", "dog [[Category:cat]]", t + dt.timedelta(hours=1))], schema)
    source = str(tmp_path / "in")
    first.write.parquet(source)
    for _ in range(2):  # the second run adds what is new
        start_ingest(arriving_pages(spark, source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        again.write.mode("append").parquet(source)
    start_ingest(arriving_pages(spark, source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.term, r.zone, r.doc_id, r.tf) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("cat", 0, 0, 2), ("dog", 0, 2, 1), ("categori", 2, 2, 1), ("cat", 2, 2, 1)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)
    assert arrivals_by_hour(spark.read.parquet(source)).count() == 2


def test_merged_indexes_equal_one_index(spark, tmp_path):
    page = "<page><title>{t}</title><id>{i}</id><revision><text>{b}</text></revision></page>"
    texts = ["cat dog {{Infobox cat}}", "dog dog", "bird cat", "#REDIRECT [[x]]", "cat [[Category:dog]]", "cat", "cat bird"]
    for name, some in (("a", texts[:3]), ("b", texts[3:]), ("all", texts)):
        first = 0 if name != "b" else 3
        body = "".join(page.format(t=f"Title {i + first}", i=i + first, b=b) for i, b in enumerate(some))
        (tmp_path / f"{name}.xml").write_text(f"<mediawiki><siteinfo/>{body}</mediawiki>")
        cli.build(spark, str(tmp_path / f"i_{name}"), [str(tmp_path / f"{name}.xml")], min_df=1 if name != "all" else 3)
    cli.merge(spark, str(tmp_path / "merged"), [str(tmp_path / "i_a"), str(tmp_path / "i_b")], min_df=3)

    def rows(folder, table):
        return sorted(tuple(map(str, r)) for r in spark.read.parquet(str(tmp_path / folder / table)).collect())

    for table in ("docs", "postings", "terms", "zone_df", "stats", "milestones"):
        assert rows("merged", table) == rows("i_all", table), table


def test_partial_index_files(spark, tmp_path):
    from zonelex.sources.storage import read_partial

    (tmp_path / "i0").write_text("2\ncat 2 dog 1 ")
    (tmp_path / "iid0").write_text("0 4 1 ")
    (tmp_path / "if0").write_text("12i3t1 c2 1 ")
    (tmp_path / "i1").write_text("1\ncat 1 ")
    (tmp_path / "iid1").write_text("7 ")
    (tmp_path / "if1").write_text("t1l2r3 ")
    got = sorted((r.term, r.doc_id, list(r.tf)) for r in read_partial(spark, str(tmp_path)).collect())
    assert got == [("cat", 0, [12, 3, 0, 1, 0, 0]), ("cat", 4, [0, 0, 2, 0, 0, 0]), ("cat", 7, [0, 0, 0, 1, 2, 3]), ("dog", 1, [1, 0, 0, 0, 0, 0])]


def test_archives(spark, tmp_path):
    import bz2

    from zonelex.sources.lists import archive_problem, page_of_lines

    data = bz2.compress("".join(f"line {i}\n" for i in range(5_000)).encode())
    (tmp_path / "good.bz2").write_bytes(data)
    (tmp_path / "bad.bz2").write_bytes(data[:200] + b"xxxx" + data[204:])
    assert archive_problem(spark, str(tmp_path / "good.bz2")) is None and archive_problem(spark, str(tmp_path / "bad.bz2"))
    assert sorted(tuple(r) for r in page_of_lines(spark, str(tmp_path / "good.bz2"), 4_998, 10).collect()) == [(4_998, "line 4998"), (4_999, "line 4999")]
