"""Raw text sources and their lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bytes_label, utf16_length

LARGEST = 25 << 20


def normal_text(c: Column) -> Column:
    """No byte order mark, one newline for every line end; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "^﻿", ""), r"\r\n?", "\n")


def format_of_name(name: Column) -> Column:
    end = F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1))
    return F.when(end == "csv", "csv").when(end == "tsv", "excel-paste").when(end.isin("htm", "html"), "html-table").when(end.isin("md", "markdown"), "pipe-table").otherwise("auto")


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """doc_id (the file's name), text and hint of whole files; a file is one row, so files should fit a task."""
    df = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return df.select(F.input_file_name().alias("doc_id"), normal_text(F.col("value")).alias("text")).withColumn("hint", format_of_name(F.col("doc_id")))


def too_large(text: Column, limit: int = LARGEST) -> Column:
    return F.length(text) * 2 > limit


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 0), text: the lines of every text."""
    return docs.select("doc_id", F.posexplode(F.split(normal_text(F.col("text")), "\n", -1)).alias("line", "text"))


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, chars (UTF-16 units), lines (0 of an empty text) and label (the size in memory, as people read it)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "\n", -1)))
    return docs.select("doc_id", utf16_length(text).alias("chars"), lines.alias("lines"), bytes_label(utf16_length(text) * 2).alias("label"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the session names, else one in the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def settled(df: DataFrame) -> DataFrame:
    """df computed once, in the session's checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: later uses see the same rows and read only the
    columns that they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
