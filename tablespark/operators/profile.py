"""Summaries of tables and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cell_type, inferred_type, looks_identifier, trim_all
from .table import Table

#: Sizes from which one table is shown at a time, words that label fields.
MANY_TABLES, MANY_ROWS, MANY_CELLS = 8, 1000, 30000
LABELS = "id|name|key|type|date|time|status|amount|price|count|validflag|field|column|addr|val|code|product|category|level|message|host|user|physical|feature|needed|used|active|字段|编号|名称|时间|状态|金额|数量"
WHOLE_LABELS = "id|name|key|type|date|time|status|amount|price|count|validflag|field|column|addr|val|code|product|category|level|message|host|user|字段|编号|名称|时间|状态|金额|数量"


def column_profile(table: Table) -> DataFrame:
    """One row for each column: header, first value that isn't blank, its type, filled cells. One pass."""
    order = F.struct(*table.order)
    filled = [trim_all(c) != "" for c in table.cells]
    firsts = [F.min_by(F.when(f, c), F.when(f, order)).alias(f"s{i}") for i, (c, f) in enumerate(zip(table.cells, filled))]
    counts = [F.count(F.when(f, 1)).alias(f"n{i}") for i, f in enumerate(filled)]
    one = table.df.agg(*firsts, *counts)
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(h).alias("header"), F.coalesce(f"s{i}", F.lit("")).alias("sample"), F.col(f"n{i}").alias("filled")) for i, h in enumerate(table.headers)])
    out = one.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("type", inferred_type(F.col("sample")))


def type_histogram(table: Table) -> DataFrame:
    """header, type, cells: how many cells of each type a column has."""
    pairs = F.array(*[F.struct(F.lit(h).alias("header"), cell_type(c).alias("type")) for h, c in zip(table.headers, table.cells)])
    return table.df.select(F.explode(pairs).alias("p")).groupBy("p.header", "p.type").agg(F.count("*").alias("cells"))


def summary(tables: list[Table]) -> DataFrame:
    """name, rows, columns and cells of each table."""
    one = [t.df.agg(F.count("*").alias("rows")).select(F.lit(t.name).alias("name"), "rows", F.lit(len(t.headers)).alias("columns"), (F.col("rows") * len(t.headers)).alias("cells")) for t in tables]
    return reduce(DataFrame.unionByName, one)


def single_table_mode(tables: list[Table]) -> bool:
    if len(tables) >= MANY_TABLES:
        return True
    got = summary(tables).agg(F.sum("rows"), F.sum("cells")).first()
    return (got[0] or 0) >= MANY_ROWS or (got[1] or 0) >= MANY_CELLS


def header_scores(lines: DataFrame, group: list[str]) -> DataFrame:
    """How much the first row of each group looks like a header, 0 to 1.

    lines: the group's columns, row (from 0) and cells (array of text). Looks at the first row and at most eleven
    more. One pass over cells: types are counted by column, the most frequent counts, ties to the type met first.
    """
    head = lines.where("row < 12").select(*group, "row", F.posexplode("cells").alias("place", "cell"))
    head = head.withColumn("type", cell_type(F.col("cell")))
    first = head.where("row = 0")
    kinds = head.where("row > 0 and type <> 'empty'").groupBy(*group, "place", "type").agg(F.count("*").alias("n"), F.min("row").alias("seen"))
    major = kinds.groupBy(*group, "place").agg(F.max_by("type", F.struct("n", (-F.col("seen")).alias("early"))).alias("major"))
    rows = lines.where("row < 12").groupBy(*group).agg(F.count("*").alias("rows"))
    s = trim_all(F.col("cell"))
    joined = first.join(major, [*group, "place"], "left")
    labelled = s.rlike(rf"(?iu)(?:^|[\s_./-])(?:{LABELS})(?:$|[\s_./-])")
    out = joined.groupBy(*group).agg(
        F.count(F.when(s != "", 1)).alias("filled"), F.count_distinct(F.when(s != "", F.lower(s))).alias("distinct"), F.count(F.when(looks_identifier(F.col("cell")), 1)).alias("names"),
        F.count(F.when(F.col("major").isNotNull() & (F.col("type") != F.col("major")), 1)).alias("differ"), F.count(F.when(labelled, 1)).alias("labels"),
        F.max(s.rlike(rf"(?iu)^(?:{WHOLE_LABELS})$")).alias("label"), F.min(F.col("type").isin("number", "date", "empty")).alias("numeric"),
    )
    out = out.join(rows, group)
    filled = F.col("filled")
    add = lambda test, n: F.when(test, n).otherwise(0.0)
    score = (
        add(F.col("distinct") == filled, 0.2) + add(F.col("names") / filled >= 0.7, 0.35) + add(F.col("differ") / filled >= 0.35, 0.35)
        + add(F.col("label") | (F.col("labels") >= F.greatest(F.lit(1), F.ceil(filled * 0.4))), 0.2) + F.when(~F.col("numeric"), 0.0).when(F.col("differ") == 0, -0.45).otherwise(0.1)
    )
    score = F.when((F.col("rows") < 2) | (filled == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 6))))
    return out.select(*group, score.alias("score"))
