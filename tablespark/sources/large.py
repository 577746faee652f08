"""Delimited files of any size: a file is read in as many splits as Spark makes of it.

Whether a line begins a record depends on all quotes before it. Each split counts its own quotes and, for either state
at its start, the records that begin in it; the splits of a file then sum these up in order, one row for each split, and
every line knows its record. Lines of records that take one line never leave their task; the others alone are brought
together, across splits too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.table import Table, unique_headers
from .parsers import record_cells
from .text import LARGEST, stored

#: Up to so many splits are sent to every task; more are joined by a shuffle.
SENT = 200_000
#: Bytes of the small splits that share a task.
TASK = 32 << 20


@F.arrow_udf(T.StructType([T.StructField("line", T.LongType()), T.StructField("odd", T.BooleanType()), T.StructField("begun", T.LongType())]))
def _running(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of every line of a split, in order: its number, whether an odd number of the split's quotes stand before it, and how
    many lines up to it have an even number."""
    split, line, odd, begun = None, 0, 0, 0
    for splits, quotes in columns:
        splits, quotes = splits.to_numpy(zero_copy_only=False), quotes.to_numpy(zero_copy_only=False).astype(np.int64)
        edges = [0, *(np.flatnonzero(splits[1:] != splits[:-1]) + 1).tolist(), len(splits)]
        out = []
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if splits[a] != split:
                split, line, odd, begun = splits[a], 0, 0, 0
            before = (odd + np.concatenate([[0], np.cumsum(quotes[a:b])])) % 2
            starts = begun + np.cumsum(before[:-1] == 0)
            out.append((np.arange(line, line + b - a), before[:-1] == 1, starts))
            line, odd, begun = line + b - a, int(before[-1]), int(starts[-1])
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)]
        yield pa.StructArray.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.int64())], ["line", "odd", "begun"])


def _tasks(spark: SparkSession, splits: int) -> int:
    """Tasks for so many splits: small splits share one, of TASK bytes at most, as long as every core has two tasks."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
    size = int(number) << 10 * " kmgtp".index(unit or " ")
    return max(1, -(-splits // max(1, TASK // size)), min(splits, 2 * spark.sparkContext.defaultParallelism))


def file_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block (where the split starts), text, quotes and at (line, odd, begun) of every line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))
    lines = lines.coalesce(_tasks(spark, lines.rdd.getNumPartitions()))
    # Not deterministic, so that no condition on lines moves below what needs to see all of them.
    running = _running.asNondeterministic()
    lines = lines.withColumn("quotes", F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit(""))))
    return lines.withColumn("at", running(F.xxhash64("file", "block"), F.col("quotes")))


def split_starts(lines: DataFrame) -> DataFrame:
    """file, block, inside (the split starts between quotes) and base (records begun in the file before it)."""
    splits = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.count("*").alias("lines"), F.count_if(~F.col("at.odd")).alias("even"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    splits = splits.withColumn("starts", F.when(F.col("inside"), F.col("lines") - F.col("even")).otherwise(F.col("even")))
    return splits.select("file", "block", "inside", F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("base"))


def _joined(lines: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(lines), lambda s: s["text"]), "\n")


def read_records(spark: SparkSession, path: str | list[str], largest: int = LARGEST) -> DataFrame:
    """file, record (from 0 in each file) and text of every record of delimited files.

    Quotes may open anywhere; between them newlines are text. Line ends become single newlines; a byte order mark goes.
    An open quote makes the rest of its file one record; a record of more than `largest` characters is an error that
    names file and record, so no task ever holds more. Empty files give no rows.
    """
    lines = file_lines(spark, path)
    # Stored, or the count and the join would each read all lines for them.
    starts = stored(split_starts(lines), "splits")
    few = starts.count() <= SENT
    lines = lines.join(F.broadcast(starts) if few else starts, ["file", "block"])
    begins = F.col("at.odd") == F.col("inside")
    begun = F.when(F.col("inside"), F.col("at.line") + 1 - F.col("at.begun")).otherwise(F.col("at.begun"))
    lines = lines.select("file", "block", F.col("at.line").alias("line"), (F.col("base") + begun - 1).alias("record"), "text", (begins & (F.col("quotes") % 2 == 0)).alias("whole"))
    split = lines.where("not whole")
    size = F.sum(F.length("text").cast("long") + 1)
    too_long = F.raise_error(F.concat(F.lit("a record is too long: "), "file", F.lit(", record "), F.col("record").cast("string")))
    # Sizes are summed inside the tasks and judged before any lines are brought together.
    fits = split.groupBy("file", "record").agg(size.alias("size")).where(F.when(F.col("size") > largest, too_long.cast("boolean")).otherwise(F.lit(True))).select("file", "record")
    several = split.join(fits, ["file", "record"]).groupBy("file", "record").agg(_joined(F.collect_list(F.struct("block", "line", "text"))).alias("text"))
    records = lines.where("whole").select("file", "record", "text").unionByName(several)
    return records.withColumn("text", F.when(F.col("record") == 0, F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text")))


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = ",", largest: int = LARGEST) -> DataFrame:
    """file, record and cells of every record with a cell that is not empty."""
    rows = read_records(spark, path, largest).select("file", "record", record_cells(F.col("text"), sep).alias("cells"))
    return rows.where(F.exists("cells", lambda c: c != ""))


def delimited_table(spark: SparkSession, path: str, name: str, sep: str = ",") -> Table:
    """One table of delimited files that share their header, the first record of each; rows in the order of files and records."""
    rows = read_delimited(spark, path, sep)
    top = rows.where("record = 0").orderBy("file").first()
    if top is None:
        return Table(name, (), rows.select(F.col("file").alias("o0"), F.col("record").alias("o1")).where("false"), ("o0", "o1"))
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(len(top["cells"]))]
    return Table(name, tuple(unique_headers(top["cells"])), rows.where("record > 0").select(F.col("file").alias("o0"), F.col("record").alias("o1"), *cells), ("o0", "o1"))
