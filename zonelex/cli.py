"""Commands: build an index from dumps, merge indexes, search one, extract stopwords.

    python -m zonelex.cli index OUT DUMP...           [--stopwords FILE] [--min-df N] [--skip-marker]
    python -m zonelex.cli merge OUT INDEX...          [--min-df N]      indexes built with --min-df 1, in page order
    python -m zonelex.cli search INDEX QUERIES OUT    [--compat-scan]
    python -m zonelex.cli stopwords COMMENTED OUT
    python -m zonelex.cli stem [ALGORITHM] < words
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .functions.text import STOPWORDS
from .operators import index as ix
from .operators.search import result_lines, search
from .operators.zones import infobox_failures
from .schema import MIN_DF
from .session import materialized, release
from .sources import lists, pages, storage


def _session() -> SparkSession:
    return SparkSession.builder.appName("zonelex").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def build(spark: SparkSession, out: str, dumps: list[str], stopwords: tuple[str, ...] = STOPWORDS, min_df: int = MIN_DF, skip_marker: bool = False) -> None:
    """Read dumps in list order, number the pages that stay, and write the index folder with its exports."""
    kept = ix.kept_pages(pages.read_xml(spark, dumps))
    numbered = ix.with_dense_ids(kept, pages.PLACE)
    index = ix.build_index(numbered.select("doc_id", "title", "text"), min_df, stopwords, skip_marker)
    storage.write_index(index, out)
    storage.write_titles(index.docs, f"{out}/titles.txt")
    storage.write_stats(index.stats, f"{out}/stat.txt")
    storage.write_failures(infobox_failures(numbered.select("doc_id", "title", "text")), f"{out}/failures.txt")
    release(spark)


def merge(spark: SparkSession, out: str, parts: list[str], min_df: int = MIN_DF) -> None:
    """Merge index folders and write the whole with its exports."""
    index = storage.merge_indexes(spark, parts, min_df)
    storage.write_index(index, out)
    storage.write_titles(index.docs, f"{out}/titles.txt")
    storage.write_stats(index.stats, f"{out}/stat.txt")
    release(spark)


def answer(spark: SparkSession, index_path: str, query_file: str, out: str, compat_scan: bool = False) -> float:
    """Answer all queries of a file in one job; seconds taken."""
    began = time.perf_counter()
    index = storage.read_index(spark, index_path)
    how = spark.read.parquet(f"{index_path}/milestones") if compat_scan else None
    found = search(lists.read_queries(spark, query_file), index.postings, index.docs, index.stats, index.zone_df, how)
    lines = materialized(result_lines(found))
    took = time.perf_counter() - began
    storage.write_results(lines, out, took)
    release(spark)
    return took


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="zonelex")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index")
    a.add_argument("out")
    a.add_argument("dumps", nargs="+")
    a.add_argument("--stopwords")
    a.add_argument("--min-df", type=int, default=MIN_DF)
    a.add_argument("--skip-marker", action="store_true")
    m = sub.add_parser("merge")
    m.add_argument("out")
    m.add_argument("parts", nargs="+")
    m.add_argument("--min-df", type=int, default=MIN_DF)
    b = sub.add_parser("search")
    b.add_argument("index")
    b.add_argument("queries")
    b.add_argument("out")
    b.add_argument("--compat-scan", action="store_true")
    c = sub.add_parser("stopwords")
    c.add_argument("commented")
    c.add_argument("out")
    s = sub.add_parser("stem")
    s.add_argument("algorithm", nargs="?", default="porter")
    args = p.parse_args(argv)
    if args.command == "stem":
        from .functions.stemmers import stemmer

        stem = stemmer(args.algorithm)
        for line in sys.stdin:
            print(stem(line.strip()))
        return 0
    spark = _session()
    if args.command == "index":
        words = lists.read_stopwords(spark, args.stopwords) if args.stopwords else STOPWORDS
        build(spark, args.out, args.dumps, words, args.min_df, args.skip_marker)
    elif args.command == "merge":
        merge(spark, args.out, args.parts, args.min_df)
    elif args.command == "search":
        print(f"{answer(spark, args.index, args.queries, args.out, args.compat_scan):.3f} s")
    else:
        words = lists.extract_stopwords(spark.read.text(args.commented)).coalesce(1)
        lists.write_text(words.select("word"), args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
