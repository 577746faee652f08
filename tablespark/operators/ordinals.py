"""Numbers of rows in a global order, without one task that sees all rows.

Spark draws new range bounds each time a range exchange runs, so partition sizes of one plan say nothing about the
partitions of another. Here the partitioned rows are written once; sizes and numbers both come from the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.text import stored

LOCAL = (1 << 33) - 1


def ranged(df: DataFrame, by: list[str | Column], parts: int | None = None) -> DataFrame:
    """The rows with _part, the number of their range in the order of `by`, written out."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "ranged")


def part_bases(rows: DataFrame) -> DataFrame:
    """_part, _base (rows in the parts before) and _size: one row for each part, so one task and a broadcast can hold them."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    return sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"), "_size")


def numbered(df: DataFrame, by: list[str | Column], name: str = "_number", parts: int | None = None) -> DataFrame:
    """df with its rows' numbers, from 0, in the order of `by`. Rows that agree in `by` get numbers in any order.

    The rows are sorted and written at once; an empty frame gives no rows. Only the sizes of the parts are summed
    over all parts.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    rows = stored(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(LOCAL)).alias("_local")), "numbered")
    return rows.join(F.broadcast(part_bases(rows).drop("_size")), "_part").withColumn(name, F.col("_base") + F.col("_local")).drop("_part", "_local", "_base")


def keys_at(df: DataFrame, order: list[str], wanted: DataFrame, parts: int | None = None) -> DataFrame:
    """wanted (_row, ...) with the order columns of the rows that stand there; places beyond the end are left out.

    The order columns alone are dealt into ranges; the ranges' sizes, summed up, tell which of them hold a wanted
    row, and only those are sorted.
    """
    keys = ranged(df.select(*order), order, parts)
    bases = part_bases(keys)
    # Wanted rows and parts: each wanted row meets its one part, by a range join against one row for each part.
    at = wanted.join(F.broadcast(bases), (F.col("_row") >= F.col("_base")) & (F.col("_row") < F.col("_base") + F.col("_size")))
    at = at.withColumn("_local", F.col("_row") - F.col("_base") + 1).drop("_base", "_size")
    touched = keys.join(F.broadcast(at.select("_part").distinct()), "_part", "left_semi")
    places = touched.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long"))
    return at.join(places, ["_part", "_local"]).drop("_part", "_local")
