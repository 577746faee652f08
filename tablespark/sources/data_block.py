"""Data blocks, data NAME [ {key: value, ...} ... ], and what is wrong with them.

Quotes hide every mark up to their end, or to the end of what they stand in. After a fault the reading goes on at the
next mark: a record without its brace ends at the next opening one, a field without its colon at the next comma, a
block without its bracket at the end of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import trim_all
from .text import normal_text

NAME = r"[A-Za-z0-9_][A-Za-z0-9_$]*+"
#: A quoted stretch, closed or running to the end.
QUOTED = r'"(?:\\.|[^"\\])*+(?:"|\\?\z)'
BLOCK = rf"(?s){QUOTED}|(?<![A-Za-z0-9_$])data\s++{NAME}\s*+\[(?:{QUOTED}|[^\"\]])*+(?:\]|\z)"
RECORD = rf"(?s)\{{(?:{QUOTED}|[^\"{{}}])*+\}}?"
FIELD = rf"(?s){NAME}\s*+:\s*+(?:{QUOTED}|(?!\")(?:{QUOTED}|[^\",])*+)|[^\s,\"](?:{QUOTED}|[^\",])*+|{QUOTED}(?:{QUOTED}|[^\",])*+"
PAIR = rf"(?s)^({NAME})\s*+:\s*+(.*)$"
SLASH = "\u0004"


def unescaped(c: Column) -> Column:
    """Escapes of quotes, backslashes, newlines and tabs resolved; a last lone backslash goes."""
    c = F.replace(c, F.lit("\\\\"), F.lit(SLASH))
    for mark, raw in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"')):
        c = F.replace(c, F.lit(mark), F.lit(raw))
    return F.replace(F.regexp_replace(c, r"\\$", ""), F.lit(SLASH), F.lit("\\"))


def _all(c, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def blocks_of(docs: DataFrame) -> DataFrame:
    """doc_id, tab, title, body, closed: the blocks of each text. Words in quotes begin none."""
    found = F.filter(_all(normal_text(F.col("text")), BLOCK), lambda b: b.startswith("data"))
    blocks = docs.select("doc_id", F.posexplode(found).alias("tab", "block"))
    head = rf"(?s)^data\s++({NAME})\s*+\["
    body = F.regexp_replace("block", head, "")
    # A bracket closes the block unless it stands in quotes that run to the end.
    closed = F.col("block").rlike(rf"{head}(?:{QUOTED}|[^\"\]])*+\]$")
    blocks = blocks.select("doc_id", "tab", F.regexp_extract("block", head, 1).alias("title"), body.alias("body"), closed.alias("closed"))
    return blocks.withColumn("body", F.when(F.col("closed"), F.regexp_replace("body", r"\]$", "")).otherwise(F.col("body")))


def records_of(blocks: DataFrame) -> DataFrame:
    """doc_id, tab, title, row (from 1), complete, fields: the records of each block with their fields as text."""
    records = blocks.select("doc_id", "tab", "title", F.posexplode(_all("body", RECORD)).alias("row", "record"))
    # Braces outside quotes close a record; a last quote may run over one.
    complete = F.col("record").rlike(rf"(?s)^\{{(?:{QUOTED}|[^\"{{}}])*+\}}$")
    inner = F.regexp_replace("record", r"^\{", "")
    inner = F.when(F.col("complete"), F.regexp_replace(inner, r"\}$", "")).otherwise(inner)
    return records.withColumn("complete", complete).select("doc_id", "tab", "title", (F.col("row") + 1).alias("row"), "complete", _all(inner, FIELD).alias("fields"))


def data_block(docs: DataFrame) -> DataFrame:
    """One table for each block, columns in the order keys are first met; of a key's values in a record the last counts.

    Every closed record is a row, open ones are if they have a field.
    """
    blocks = blocks_of(docs)
    records = records_of(blocks)
    at = ["doc_id", "tab", "title"]
    value = F.regexp_extract("p", PAIR, 2)
    plain = F.when(value.startswith('"'), unescaped(F.regexp_replace(value, rf'(?s)^"((?:\\.|[^"\\])*+)"?', "$1"))).otherwise(trim_all(value))
    pairs = records.select(*at, "row", F.posexplode(F.filter("fields", lambda f: f.rlike(PAIR))).alias("at", "p")).select(*at, "row", "at", F.regexp_extract("p", PAIR, 1).alias("key"), plain.alias("value"))
    last = pairs.groupBy(*at, "row", "key").agg(F.max_by("value", "at").alias("value"))
    of_row = last.groupBy(*at, "row").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    order = pairs.groupBy(*at, "key").agg(F.min(F.struct("row", "at")).alias("first"))
    order = order.groupBy(*at).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "key"))), lambda s: s["key"]).alias("keys"))
    empty = F.array().cast("array<string>")
    heads = blocks.select(*at).join(order, at, "left").select(*at, F.coalesce("keys", empty).alias("keys"))
    rows = records.select(*at, "row", "complete").join(of_row, [*at, "row"], "left").where("complete or m is not null").join(heads, at)
    rows = rows.select(*at, "row", F.transform("keys", lambda k: F.coalesce(F.try_element_at("m", k), F.lit(""))).alias("cells"))
    rows = heads.select(*at, F.lit(0).alias("row"), F.col("keys").alias("cells")).unionByName(rows)
    return rows.select("doc_id", F.col("tab").cast("int").alias("tab"), "title", F.col("row").cast("int").alias("row"), "cells", F.lit(True).alias("forced"), F.lit(None).cast("string").alias("note"))


def data_block_problems(docs: DataFrame) -> DataFrame:
    """doc_id, tab, row, code, severity of the faults that reading recovered from; row is the record's number."""
    blocks = blocks_of(docs)
    records = records_of(blocks)
    has_pair = F.exists("fields", lambda f: f.rlike(PAIR))
    open_quote = F.exists("fields", lambda f: f.rlike(rf'(?s)^{NAME}\s*+:\s*+"') & ~f.rlike(rf'(?s)^{NAME}\s*+:\s*+"(?:\\.|[^"\\])*+"$'))
    note = lambda code, c, level="warning": F.when(c, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity")))
    lost = F.transform(F.filter("fields", lambda f: ~f.rlike(PAIR)), lambda f: F.struct(F.lit("MISSING_COLON").alias("code"), F.lit("warning").alias("severity")))
    of_record = F.concat(lost, F.array_compact(F.array(note("UNMATCHED_BRACE", ~F.col("complete")), note("UNCLOSED_QUOTE", open_quote))))
    found = records.select("doc_id", "tab", "row", F.explode(of_record).alias("n"))
    counts = records.groupBy("doc_id", "tab").agg(F.count_if(F.col("complete") | has_pair).alias("rows"))
    whole = blocks.join(counts, ["doc_id", "tab"], "left")
    barren = (F.coalesce("rows", F.lit(0)) == 0) & (trim_all(F.col("body")) != "")
    of_block = F.array_compact(F.array(note("UNCLOSED_DATA_BLOCK", ~F.col("closed"), "error"), note("NO_DATA_RECORDS", barren)))
    found = found.unionByName(whole.select("doc_id", "tab", F.lit(None).cast("int").alias("row"), F.explode(of_block).alias("n")))
    none = docs.join(blocks.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("int").alias("tab"), F.lit(None).cast("int").alias("row"), F.struct(F.lit("NO_DATA_BLOCK").alias("code"), F.lit("info").alias("severity")).alias("n"))
    return found.unionByName(none).select("doc_id", F.col("tab").cast("int").alias("tab"), F.col("row").cast("int").alias("row"), "n.code", "n.severity")
