import pytest

from tests.compare import assert_same, duck
from zonelex.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, data, name):
    df = catalog.queries()[name](spark, data)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert_same(df, sql, duck(data))


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
