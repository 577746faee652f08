"""Row numbers and edits over tables of several files and ranges."""

import pytest
from pyspark.sql import functions as F

from tablespark.operators.edits import Overlay
from tablespark.operators.ordinals import keys_at, numbered
from tablespark.operators.query import with_result_index
from tablespark.operators.table import Table

N = 300_000


@pytest.fixture(scope="module")
def large(spark):
    """Rows in 8 partitions that are not in their order."""
    df = spark.range(0, N, 1, 8).select(((F.col("id") * 7919) % N).alias("o0"))
    return Table("large", ("key", "cell"), df.select("o0", F.col("o0").cast("string").alias("c0"), F.concat(F.lit("x"), F.col("o0")).alias("c1")))


def test_numbers_with_all_cells(large):
    got = with_result_index(large).df
    assert got.agg(F.count("*"), F.count_distinct("_result_index"), F.max("_result_index"), F.count_if(F.col("_result_index") != F.col("o0")), F.count_if(F.col("c1") != F.concat(F.lit("x"), F.col("o0")))).first() == (N, N, N - 1, 0, 0)


def test_numbers_of_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, "a"), (2, "b"), (2, "c"), (1, "d")], "k int, v string")
    got = {r["v"]: r["n"] for r in numbered(df, ["k"], "n").collect()}
    assert got["a"] == 0 and got["d"] == 1 and {got["b"], got["c"]} == {2, 3}
    assert numbered(df.where("false"), ["k"]).collect() == []


def test_edits_stay_in_their_rows(large):
    over = Overlay()
    rows = [0, 5, 150_000, 299_990, N - 1, N, -1]
    for r in rows:
        over.edit(large, r, 1, f"edited {r}", old="")
    got = over.apply(large).df
    found = {r["o0"]: r["c1"] for r in got.where(F.col("c1").startswith("edited")).collect()}
    assert found == {r: f"edited {r}" for r in rows[:5]}
    assert got.count() == N


def test_edits_of_numbered_tables_sort_nothing(large, capsys):
    for many in (3, 300):
        over = Overlay()
        for r in range(0, N, N // many):
            over.edit(large, r, 0, "!", old="")
        got = over.apply(large, "o0").df
        got.explain()
        plan = capsys.readouterr().out
        assert "Sort" not in plan and "rangepartitioning" not in plan
        assert got.where("c0 = '!' and o0 % {} = 0".format(N // many)).count() == len(range(0, N, N // many))


def test_many_edits_are_looked_up(spark, large):
    places = spark.range(0, N + 50, 10).withColumnRenamed("id", "_row")
    got = keys_at(large.df, ["o0"], places)
    assert got.agg(F.count("*"), F.count_if(F.col("o0") != F.col("_row"))).first() == (N // 10, 0)
