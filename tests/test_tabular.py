"""The table function and the data source, against the parsers over corpora."""

import random

import pytest
from pyspark.sql import functions as F

from tablespark.sources.parsers import PARSERS
from tablespark.sources.tabular import FORMATS, TabularReader, register

MARKS = ["a", "b c", "  ", ",", ";", "\t", '"', '""', "\n", "\r\n", "|", "\\|", "\\", "\\x", "---", "| --- |", "é", " ", "\n\n"]


@pytest.fixture(scope="module")
def texts(spark):
    register(spark)
    random.seed(8)
    docs = ["", None, "﻿a,b\n1,2"] + ["".join(random.choices(MARKS, k=random.randint(1, 30))) for _ in range(250)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    df.createOrReplaceTempView("texts_of_test")
    return df


@pytest.mark.parametrize("fmt", FORMATS)
def test_same_rows_as_the_parsers(spark, texts, fmt):
    want = {}
    for r in PARSERS[fmt](texts).where(F.exists("cells", lambda c: c != "")).orderBy("doc_id", "row").collect():
        want.setdefault(r["doc_id"], []).append(r["cells"])
    got = {}
    for r in spark.sql(f"SELECT t.doc_id, p.row, p.cells FROM texts_of_test t, LATERAL parse_text(t.text, '{fmt}') p ORDER BY 1, 2").collect():
        assert r["row"] == len(got.setdefault(r["doc_id"], []))
        got[r["doc_id"]].append(r["cells"])
    assert got == want


def test_unknown_formats(spark, texts):
    with pytest.raises(Exception, match="no such format: html-table"):
        spark.sql("SELECT * FROM parse_text('a', 'html-table')").collect()
    with pytest.raises(Exception, match="no such format"):
        spark.read.format("tabular_text").option("format", "nope").load("/tmp").collect()


@pytest.mark.parametrize("split", [1, 10, 100, 10_000])
def test_blocks_hold_each_line_once(spark, texts, tmp_path, split):
    lines = [f"| {i} | é{'x' * (i % 13)} |" for i in range(60)]
    (tmp_path / "a.md").write_text("\n".join(lines[:40]))
    (tmp_path / "b.md").write_text("\r\n".join(lines[40:]) + "\r\n")
    (tmp_path / "c.md").write_text("")
    reader = TabularReader({"path": str(tmp_path), "format": "pipe-table", "split": str(split)})
    assert len(reader.partitions()) > 1
    rows = spark.read.format("tabular_text").option("format", "pipe-table").option("split", split).load(str(tmp_path)).orderBy("file", "block", "row").collect()
    assert [[c.strip() for c in r["cells"]] for r in rows] == [[c.strip() for c in t.strip("|").split("|")] for t in lines]


def test_quoted_files(spark, texts, tmp_path):
    (tmp_path / "t.csv").write_text('k,v\n1,"a\nb"\n\n2,"c ""d"""\n')
    rows = spark.read.format("tabular_text").load(str(tmp_path / "t.csv")).orderBy("row").collect()
    assert [(r["row"], r["cells"]) for r in rows] == [(0, ["k", "v"]), (1, ["1", "a\nb"]), (2, ["2", 'c "d"'])]
    (tmp_path / "none").mkdir()
    assert spark.read.format("tabular_text").load(str(tmp_path / "none")).collect() == []
