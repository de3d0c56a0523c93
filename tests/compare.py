"""A query's rows against its SQL in DuckDB, without order."""

import math
from pathlib import Path

import duckdb


def duck(folder: str):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in values), key=lambda r: tuple((x is None, str(x)) for x in r))


def assert_same(df, sql, connection):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    r = connection.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, r.fetchall())
