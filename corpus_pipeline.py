"""Corpus pipeline: language, near copies, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on, with the columns of documents; the last
returns packed pieces. Stages are written as Parquet and read again before the next.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_file
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablespark.llm import language_id, near_dups, packing, pii, suffix_dedup
from tablespark.llm.common import written
from tablespark.llm.queries import PII_KEY, REPORTED, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letters, or too far from every language's centroids."""
    model = language_id.fit_language_model(docs)
    found = language_id.identify_language(docs.select(*COLUMNS), model, keep=COLUMNS[1:])
    return found.where("not rejected").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return near_dups.keep_one(docs.select(*COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages of 240 bytes or more, which passages of 50 words have, out of the texts.

    A character cut in two goes with them. Every document stays.
    """
    found = suffix_dedup.remove_repeats(docs, REPORTED, keep=("lang", "source"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    text = F.when(F.col("n_removed") > 0, F.replace(text, F.lit("�"), F.lit(""))).otherwise(text)
    return found.withColumn("text", text).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates in place of personal data. Every document stays."""
    found = pii.replace_entities(docs, PII_KEY, keep=("lang", "source"))
    return found.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences with little padding, one row for each piece of a document."""
    pieces = packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("personal_data", personal_data), ("packed", packed)]
#: The stages' models, sketches and packing can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
