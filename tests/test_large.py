"""Delimited files read in many splits, against Python's csv."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tablespark.sources.large import delimited_table, file_lines, read_delimited

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def splits(spark):
    """Sets the size of splits for one test."""
    held = {k: spark.conf.get(k) for k in (SPLIT, "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, str(n if k == SPLIT else 0)) for k in held]
    for k, v in held.items():
        spark.conf.set(k, v)


def rows_of(df):
    found = {}
    for r in df.orderBy("file", "record").collect():
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append(r["cells"])
    return found


@pytest.mark.parametrize("size", [16, 200, 1 << 20])
def test_any_split(spark, splits, tmp_path, size):
    random.seed(size)
    words = ["a", 'say ""x""', "line\nbreak", "l1\r\nl2\n\n", ",", "é表", '"', "", " "]
    want = {}
    for name in ("one.csv", "two.csv", "none.csv"):
        rows = [[f"{name}{i}", *random.choices(words, k=3)] for i in range(30 if size < 100 else 300)] if name != "none.csv" else []
        out = io.StringIO()
        csv.writer(out, lineterminator="\r\n" if name == "one.csv" else "\n").writerows(rows)
        (tmp_path / name).write_bytes((b"\xef\xbb\xbf" if name == "one.csv" else b"") + out.getvalue().encode())
        want[name] = [[c.replace("\r\n", "\n") for c in r] for r in rows]
    splits(size)
    assert rows_of(read_delimited(spark, str(tmp_path))) == {k: v for k, v in want.items() if v}


def test_open_quotes_and_limits(spark, splits, tmp_path):
    (tmp_path / "open.csv").write_text("a,b\n1,2\n" + '3,"x\n' + "y,z\n" * 30)
    splits(16)
    got = rows_of(read_delimited(spark, str(tmp_path)))["open.csv"]
    assert got == [["a", "b"], ["1", "2"], ["3", "x\n" + "y,z\n" * 29 + "y,z"]]
    with pytest.raises(Exception, match="a record is too long.*open.csv, record 2"):
        read_delimited(spark, str(tmp_path), largest=50).collect()


def test_many_splits_are_joined_by_a_shuffle(spark, splits, tmp_path, monkeypatch):
    monkeypatch.setattr("tablespark.sources.large.SENT", 0)
    (tmp_path / "t.tsv").write_text("k\tv\n" + "".join(f'{i}\t"v\n{i}"\n' for i in range(50)))
    splits(40)
    table = delimited_table(spark, str(tmp_path), "t", "\t")
    assert table.headers == ("k", "v") and [tuple(r) for r in table.ordered().select(*table.cells).collect()] == [(str(i), f"v\n{i}") for i in range(50)]
    assert delimited_table(spark, str(tmp_path / "t.tsv"), "t", "\t").df.where(F.col("c0") == "7").count() == 1


@pytest.mark.parametrize("size", ["1k", "2048b"])
def test_small_splits_share_tasks(spark, tmp_path, splits, size):
    """Hundreds of splits that cut through quotes, read by two tasks for each core."""
    lines = [f'{i},"a{i}\n""b""\n{"x" * (i % 50)}",c' for i in range(6000)]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    splits(size)
    cut = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    tasks = file_lines(spark, str(tmp_path)).rdd.getNumPartitions()
    assert cut > 100 and tasks <= 2 * spark.sparkContext.defaultParallelism
    got = [r["cells"] for r in read_delimited(spark, str(tmp_path)).orderBy("record").collect()]
    assert got == [[str(i), f'a{i}\n"b"\n{"x" * (i % 50)}', "c"] for i in range(6000)]
