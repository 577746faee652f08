"""Views over streams and standing tables, recovered from their checkpoint."""

import pytest

from tablespark.operators.joins import View
from tablespark.operators.query import Rules
from tablespark.operators.table import Table
from tablespark.streaming.rules import filtered_stream, run_available, stream_table
from tablespark.streaming.views import stream_view

VIEWS = {"named": View("named", "events", "people", "who=id", "left", "n, right.name as person"), "chain": View("chain", "named", "ranks", "person=name", "inner", "n, person, right.rank")}


@pytest.fixture
def tables(spark, tmp_path):
    write = lambda rows: spark.createDataFrame(rows, "n int, who string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write([(1, "a"), (2, "b"), (3, "z")])
    people = Table.of(spark.createDataFrame([("a", "Ann"), ("b", "Bo")], "id string, name string"), "people", ["id"])
    ranks = Table.of(spark.createDataFrame([("Ann", "1st"), ("Bo", "2nd")], "name string, rank string"), "ranks", ["name"])
    return write, lambda: {"events": stream_table(spark, str(tmp_path / "in"), "*.parquet", ["n"], "events"), "people": people, "ranks": ranks}


@pytest.mark.parametrize(("name", "want"), [("named", {("1", "Ann"), ("2", "Bo"), ("3", ""), ("4", "Ann")}), ("chain", {("1", "Ann", "1st"), ("2", "Bo", "2nd"), ("4", "Ann", "1st")})])
def test_each_row_once_over_restarts(spark, tmp_path, tables, name, want):
    write, of = tables
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: run_available(filtered_stream(stream_view(name, of(), VIEWS), Rules(filter="n>0")), out, state)
    run()
    write([(4, "a"), (-5, "b")])
    run()
    run()
    got = [tuple(r) for r in spark.read.parquet(out).drop("_hl").collect()]
    assert len(got) == len(want) and set(got) == want


def test_kinds_that_never_settle(tables):
    of = tables[1]
    for kind in ("right", "full"):
        with pytest.raises(ValueError, match=f"late: a {kind} join with a stream on its left"):
            stream_view("late", of(), {"late": View("late", "events", "people", "who=id", kind)})
    with pytest.raises(ValueError, match="on both sides"):
        stream_view("late", of(), {"late": View("late", "events", "events", "who=who")})
    assert stream_view("gone", of(), VIEWS) is None
