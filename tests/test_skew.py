import os
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

from pyspark.sql import functions as F

from zonelex.operators.joins import join_back
from zonelex.operators.postings import split_by_range_join, split_of, with_split
from zonelex.operators.skew import number_rows, per_key_totals, running_totals

SCHEMA = "k string, v long, item long, n_rows string, total int"


def rows(n=3000):
    out = []
    for i in range(n):
        k = "hot" if i % 3 else f"k{i % 17}" if i % 5 else None
        out.append((k, None if i % 11 == 0 else i % 7, None if i % 13 == 0 else i % 4, "clash", i))
    return out


def test_totals_equal_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {r.k: r for r in per_key_totals(df, "k", "v", "item", chunk_rows=100).collect()}
    n, total, items = Counter(), Counter(), defaultdict(list)
    for k, v, item, *_ in data:
        n[k] += 1
        total[k] += v or 0
        items[k].append(item)
    assert {k: (r.n_rows, r.total) for k, r in got.items()} == {k: (n[k], total[k]) for k in n}
    assert all(r.n_chunks == -(-r.n_rows // 100) and r.largest_chunk <= 100 for r in got.values())
    assert got["hot"].low == 0 and got["hot"].high == 3


def test_ordered_states_join_at_chunk_borders(spark):
    df = spark.createDataFrame([("a", 1, 5)] * 250 + [("a", 1, 6)] * 3, "k string, v long, item long").coalesce(1)
    for chunk in (1, 7, 100, 1000):
        assert per_key_totals(df, "k", "v", "item", chunk).first().repeats == 251


def test_numbers_are_dense_and_running_totals_exact(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(4).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    by = defaultdict(list)
    for r in number_rows(df.select("k", "v"), "k").collect():
        by[r.k].append(r._number)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    last = defaultdict(int)
    seen = defaultdict(list)
    for r in running_totals(df.select("k", "v"), "k", "v", chunk_rows=50).orderBy("k", "number").collect():
        last[r.k] += r.v or 0
        seen[r.k].append(r.running == last[r.k])
    assert all(all(x) for x in seen.values())


def test_shared_tables_are_read_once_written_and_released(spark):
    from zonelex.session import _WRITTEN, materialized, release

    df = materialized(spark.range(10))
    folder = Path(_WRITTEN[-1].removeprefix("file:"))
    assert df.count() == 10 and folder.exists()
    assert release(spark) >= 1 and not _WRITTEN and not folder.exists()


def test_shared_tables_go_with_the_driver(tmp_path):
    script = "from zonelex.session import local_session, materialized\ns = local_session(2, '1g')\nprint(materialized(s.range(10)).count())\ns.stop()\n"
    env = {**os.environ, "PYTHONPATH": str(Path(__file__).resolve().parents[1]), "PYSPARK_SUBMIT_ARGS": f"--conf spark.checkpoint.dir={tmp_path} pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, timeout=120, check=True)
    assert "10" in out.stdout and any(tmp_path.iterdir()) and not list(tmp_path.rglob("table-*"))


def test_empty_table(spark):
    assert per_key_totals(spark.createDataFrame([], SCHEMA), "k", "v", "item").count() == 0


def test_join_back_keeps_every_row(spark):
    data = [("hot" if i % 3 else f"k{i}" if i % 2 else None, i) for i in range(4000)]
    r = spark.createDataFrame(data, "k string, i long")
    stats = r.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("most"))
    n = Counter(k for k, _ in data if k)
    got = join_back(r, stats, "k", "n", ["i"]).collect()
    assert sorted((x.k, x.i, x.n) for x in got) == sorted((k, i, n[k]) for k, i in data if k)
    few = join_back(r, stats.where("k <> 'hot'"), "k", "n", ["i"], outer=True).collect()
    assert len(few) == len(data) and {x.i: x.n for x in few} == {i: n[k] if k and k != "hot" else None for k, i in data}


def test_split_lookup_both_ways(spark):
    starts = ["aa", "be", "ca", "été"]
    terms = ["0", "aa", "ab", "bd", "be", "cz", "z", "été", "ü"]
    expected = {t: max((s for s in starts if s.encode() <= t.encode()), key=lambda s: s.encode(), default=None) for t in terms}
    df = spark.createDataFrame([(t,) for t in terms] + [(None,)], "term string")
    assert {r.term: r.s for r in df.select("term", split_of(F.col("term"), starts).alias("s")).collect() if r.term is not None} == expected
    m = spark.createDataFrame([(s,) for s in starts + ["aa"]], "first_term string")
    assert {r.term: r.first_term for r in split_by_range_join(df.where("term is not null"), m).collect()} == expected


def test_more_splits_than_fit_in_a_plan(spark):
    starts = [f"s{i:05d}" for i in range(0, 2_050, 2)]
    assert len(starts) == 1025
    terms = [("a" if i % 3 == 0 else "s00700" if i % 3 == 1 else f"s{i % 2_060:05d}" if i % 5 else None, i) for i in range(6_000)]
    df = spark.createDataFrame([(t, i, "clash") for t, i in terms], "term string, i long, n int".replace("n int", "start string")).repartition(5)
    got = with_split(df, spark.createDataFrame([(s,) for s in starts], "first_term string"), ["i"]).collect()
    expected = {i: None if t is None else max((s for s in starts if s <= t), default=None) for t, i in terms}
    assert len(got) == len(terms) and {r.i: r.first_term for r in got} == expected
