"""Texts that were pasted together with markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import trim_all
from .ingest import parse_texts
from .text import stored


def holds_table(html: Column) -> Column:
    return F.coalesce(html.rlike(r"(?i)<table[\s>]") & html.rlike(r"(?i)<tr[\s>]"), F.lit(False))


def with_markup(docs: DataFrame, pastes: DataFrame) -> DataFrame:
    """doc_id, text and markup: where the last paste of a text still is the text, and its markup holds a table, text is the
    markup.

    docs: doc_id, text as it stands now. pastes: doc_id, at (their order), plain and html, either of which may be null.
    White space around a text doesn't count as an edit. Texts without a paste stay; pastes without a text are left out.
    """
    last = pastes.groupBy("doc_id").agg(F.max_by(F.struct("plain", "html"), "at").alias("paste"))
    same = trim_all(F.coalesce("paste.plain", F.lit(""))) == trim_all(F.coalesce("text", F.lit("")))
    taken = F.coalesce(F.col("paste").isNotNull() & same, F.lit(False)) & holds_table(F.col("paste.html"))
    found = docs.join(last, "doc_id", "left").withColumn("markup", taken)
    return found.select("doc_id", F.when(F.col("markup"), F.col("paste.html")).otherwise(F.col("text")).alias("text"), "markup")


def parse_pasted(docs: DataFrame, pastes: DataFrame, header_mode: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(rows, diagnostics) as of `parse_texts`: tables of markup where it holds, else what is detected in the text."""
    # Stored, or each step of the detection and each parser would put texts and pastes together again.
    found = stored(with_markup(docs, pastes), "pasted")
    marked = parse_texts(found.where("markup").select("doc_id", "text"), "html-table", header_mode)
    plain = parse_texts(found.where("not markup").select("doc_id", "text"), None, header_mode)
    return marked[0].unionByName(plain[0]), marked[1].unionByName(plain[1])
