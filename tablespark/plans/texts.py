"""Customers written out as texts of every format, a hundred keys each: the corpus that the parser queries read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("id", "name", "balance", "segment")
SIZES = (8, 22, 12, 14)
BLOCK = 100
SOURCE = ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def _padded(cells: list[Column]) -> Column:
    return F.rtrim(F.concat(*[F.rpad(c, n, " ") for c, n in zip(cells, SIZES)]))


def _heads() -> list[Column]:
    return [F.lit(f) for f in FIELDS]


def _between(start: str, sep: str, end: str = ""):
    return lambda cells: F.concat(F.lit(start), F.concat_ws(sep, *cells), F.lit(end))


def _record(cells: list[Column]) -> Column:
    pairs = [F.concat(F.lit(f'{f}: "'), c, F.lit('"')) for f, c in zip(FIELDS, cells)]
    return F.concat(F.lit("  { "), F.concat_ws(", ", *pairs), F.lit(" },"))


_BORDER = "+" + "+".join("-" * (n + 2) for n in SIZES) + "+"
_BOX = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.rpad(c, n, " ") for c, n in zip(cells, SIZES)]), F.lit(" |"))
_RULE = "-" * sum(SIZES)
#: format: (row, lines above with the header's row in place of None, lines below)
LAYOUTS = {
    "csv": (_between("", ","), [None], []),
    "excel-paste": (_between("", "\t"), [None], []),
    "semicolon-csv": (_between("", ";"), [None], []),
    "pipe-table": (_between("| ", " | ", " |"), [None, "| --- | --- | --- | --- |"], []),
    "ascii-table": (_BOX, [_BORDER, None, _BORDER], [_BORDER]),
    "fixed-width": (_padded, [None], []),
    "aligned-table": (_padded, [None, "------  --------------------  ----------  ----------"], []),
    "cli-multi-block": (_padded, ["Customers:", "=" * 56, None, _RULE], [""]),
    "cli-table-data": (_between("1\t", "\t"), ["table-data Customers", None], []),
    "data-block": (_record, ["data Customers ["], ["]"]),
    "html-table": (_between("<tr><td>", "</td><td>", "</td></tr>"), ['<table data-name="Customers">', None], ["</table>"]),
    "plain-text": (_between("", " "), [None], []),
}


def _header(fmt: str) -> Column:
    if fmt == "html-table":
        return F.lit("<tr>" + "".join(f"<th>{f}</th>" for f in FIELDS) + "</tr>")
    if fmt == "cli-table-data":
        return F.lit("\t".join(("validflag", *FIELDS)))
    return LAYOUTS[fmt][0](_heads())


def customers_as(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    """doc_id (the keys' hundred) and text, one text of the format for every hundred keys, so texts grow in number alone."""
    row, above, below = LAYOUTS[fmt]
    cells = [F.col(c).cast("string") for c in SOURCE]
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.floor(F.col("c_custkey") / BLOCK).cast("int").alias("doc_id"), F.struct("c_custkey", row(cells).alias("line")).alias("r"))
    texts = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]).alias("lines"))
    top = F.array(*[_header(fmt) if a is None else F.lit(a) for a in above]) if above else F.array().cast("array<string>")
    end = F.array(*map(F.lit, below)) if below else F.array().cast("array<string>")
    return texts.select("doc_id", F.array_join(F.concat(top, "lines", end), "\n").alias("text"))


def all_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (format and hundred) and text, of every format."""
    each = [customers_as(spark, sf_dir, f).select(F.concat(F.lit(f"{f}/"), F.col("doc_id").cast("string")).alias("doc_id"), "text") for f in LAYOUTS]
    return reduce(DataFrame.unionByName, each)


def shifted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: fifty customers below a title and a header that starts elsewhere than the cells do.

    Of every fifth customer the segment is missing; of every seventh other one it runs over its place.
    """
    key, long_ = F.col("c_custkey"), F.concat("c_mktsegment", F.lit(" and several other words  "))
    segment = F.when(key % 5 == 0, F.repeat(F.lit(" "), 14)).when(key % 7 == 0, long_).otherwise(F.rpad("c_mktsegment", 14, " "))
    line = F.concat(F.rpad(key.cast("string"), 10, " "), segment, "c_name")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.floor(key / 50).alias("doc_id"), F.struct(key, line.alias("line")).alias("r"))
    texts = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]).alias("lines"))
    top = F.array(F.concat(F.lit("Customers "), F.col("doc_id").cast("string")), F.lit(""), F.lit("ID          Segment       Name"))
    return texts.select("doc_id", F.array_join(F.concat(top, "lines"), "\n").alias("text"))
