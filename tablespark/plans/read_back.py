"""Queries that write the given tables out as text and read that back: by SQL, as a data source, in splits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.large import read_delimited
from ..sources.tabular import register
from ..sources.text import shared_folder, stored

#: Bytes of a split in `delimited_splits`: small, so that texts of the test tables reach over many of them.
SPLIT = 256 << 10


def _written(lines: DataFrame, name: str) -> str:
    path = f"{shared_folder(lines.sparkSession)}/{name}-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def sql_lateral_parse(s: SparkSession, d: str) -> DataFrame:
    """Orders of each customer as one text, taken apart by the table function."""
    register(s)
    line = F.concat_ws(",", "o_orderkey", F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(' ""x"",\n'), F.col("o_orderstatus"), F.lit('"')), "o_totalprice")
    texts = s.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda r: r["l"]), "\r\n").alias("text"))
    view = f"texts_{uuid.uuid4().hex}"
    texts.createOrReplaceTempView(view)
    return s.sql(f"SELECT t.o_custkey, p.row, p.cells[0] AS id, p.cells[1] AS note, p.cells[2] AS price FROM {view} t, LATERAL parse_text(t.text, 'csv') p")


LATERAL = """SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS row, CAST(o_orderkey AS VARCHAR) AS id,
    o_orderpriority || ' "x",' || chr(10) || o_orderstatus AS note, CAST(o_totalprice AS VARCHAR) AS price FROM orders"""


def data_source_read(s: SparkSession, d: str) -> DataFrame:
    """Parts as pipe tables in files, read as a data source in blocks."""
    register(s)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "p_partkey", "p_name", F.replace(F.concat("p_brand", F.lit("|"), "p_type"), F.lit("|"), F.lit("\\|")), "p_size"), F.lit(" |"))
    line = F.when(F.col("p_partkey") % 50 == 0, F.concat(F.lit("| --- | --- | --- | --- |\n"), line)).otherwise(line)
    path = _written(s.read.parquet(f"{d}/part.parquet").select(line), "parts")
    rows = s.read.format("tabular_text").option("format", "pipe-table").option("split", 10_000).load(path)
    return rows.select(*[F.trim(F.get("cells", F.lit(i))).alias(n) for i, n in enumerate(("id", "name", "make", "size"))])


SOURCE = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand || '|' || p_type AS make, CAST(p_size AS VARCHAR) AS size FROM part"


def delimited_splits(s: SparkSession, d: str) -> DataFrame:
    """Documents in quotes, newlines and all, read in splits that cut through them."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    path = _written(s.read.parquet(f"{d}/documents.parquet").select(F.concat_ws(",", F.coalesce("source", F.lit("")), quoted(F.col("text")), "doc_id")), "documents")
    sizes = {k: s.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in sizes:
            s.conf.set(k, str(SPLIT))
        rows = read_delimited(s, path)
        return stored(rows.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("source", "text", "doc_id"))]), "delimited")
    finally:
        for k, v in sizes.items():
            s.conf.set(k, v)


SPLITS = r"SELECT coalesce(source, '') AS source, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS text, CAST(doc_id AS VARCHAR) AS doc_id FROM documents"
QUERIES = {"sql_lateral_parse": (sql_lateral_parse, LATERAL), "data_source_read": (data_source_read, SOURCE), "delimited_splits": (delimited_splits, SPLITS)}
