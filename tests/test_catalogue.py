"""Every query against its SQL, at the smallest size."""

import pytest

import __spark_entry__
from conftest import SF
from tablespark.plans import catalogue


@pytest.mark.parametrize("name", catalogue.queries())
def test_agrees_with_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(str(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).toLocalIterator())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    places = sorted((d[0], i) for i, d in enumerate(cursor.description))
    want = sorted(tuple(str(r[i]) for _, i in places) for r in cursor.fetchall())
    assert names == [n for n, _ in places] and got == want


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["o_orderkey", "c_name", "total"] and 0 < df.count() <= 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
