"""From raw texts to tables: parse, normalise rows, decide on headers, diagnose."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_cell
from ..operators.profile import header_scores
from ..operators.table import Table, unique_headers, unique_name
from .data_block import data_block_problems
from .parsers import PARSERS, cli_problems, unclosed_quote
from .sniff import sniff
from .text import LARGEST, settled

HEADER = 0.65
KEY = ["doc_id", "tab"]
#: Fixed value: formats in the order in which a text that nothing fits tries them.
PROBE_ORDER = ("cli-table-data", "data-block", "html-table", "cli-multi-block", "ascii-table", "pipe-table", "excel-paste", "csv", "semicolon-csv", "fixed-width", "aligned-table", "plain-text")
#: Formats that keep cells and headers as they parsed them.
OWN_HEADERS = ("data-block", "cli-table-data")


def parse_texts(docs: DataFrame, fmt: str | None = None, header_mode: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(rows, diagnostics) of all tables of all texts (doc_id, text).

    rows: doc_id, tab, title, format, row (from 0, the header apart), is_header, cells. fmt names a parser for all
    texts; without it each text's format is detected and every parser gets its own texts. header_mode: auto,
    first-row or none.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if fmt:
        known = docs.withColumn("format", F.lit(fmt))
        names = [fmt]
    else:
        # Settled, or the filters below would repeat the whole of the scoring in each parser's branch.
        known = docs.join(probed(docs), "doc_id")
        names = _formats_in(known) or ["plain-text"]
    raw = reduce(DataFrame.unionByName, [PARSERS[n](known.where(F.col("format") == n)).withColumn("format", F.lit(n)) for n in names])
    own = F.col("format").isin(*OWN_HEADERS)
    raw = raw.withColumn("cells", F.when(F.col("format") == "data-block", F.col("cells")).otherwise(F.transform("cells", clean_cell)))
    raw = raw.where(F.exists("cells", lambda c: c != "") | (F.col("format") == "data-block"))
    numbered = _numbered(raw)
    scores = header_scores(numbered.select(*KEY, "row", "cells"), KEY) if header_mode == "auto" else None
    if scores is not None:
        numbered = numbered.join(scores, KEY, "left")
        decided = F.coalesce("forced", F.when(own, F.lit(True)), F.col("score") >= HEADER)
    else:
        decided = F.when(own, F.lit(True)).otherwise(F.lit(header_mode == "first-row"))
    numbered = numbered.withColumn("headed", F.coalesce(decided, F.lit(False)))
    uneven = numbered.where((F.size("cells") != F.col("width")) & (F.col("row") > 0))
    diagnostics = uneven.select(F.col("doc_id").cast("string").alias("doc_id"), "tab", "row", F.lit("ROW_WIDTH_MISMATCH").alias("code"), F.lit("warning").alias("severity"))
    noted = numbered.where(F.col("note").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), "tab", "row", F.explode(F.split("note", ",")).alias("code"), F.lit("warning").alias("severity"))
    diagnostics = diagnostics.unionByName(noted)
    if "cli-multi-block" in names:
        broken = cli_problems(known.where(F.col("format") == "cli-multi-block"))
        diagnostics = diagnostics.unionByName(broken.select(F.col("doc_id").cast("string").alias("doc_id"), "tab", F.lit(None).cast("int").alias("row"), "code", F.lit("warning").alias("severity")))
    if "data-block" in names:
        broken = data_block_problems(known.where(F.col("format") == "data-block"))
        diagnostics = diagnostics.unionByName(broken.withColumn("doc_id", F.col("doc_id").cast("string")))
    quoted = known.where(F.col("format").isin("csv", "semicolon-csv", "excel-paste") & unclosed_quote(F.col("text")))
    none = lambda df, code, level: df.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("int").alias("tab"), F.lit(None).cast("int").alias("row"), F.lit(code).alias("code"), F.lit(level).alias("severity"))
    diagnostics = diagnostics.unionByName(none(quoted, "UNCLOSED_QUOTE", "warning")).unionByName(none(known.where(F.trim("text") == ""), "EMPTY_INPUT", "warning"))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.col("width") - F.size("cells"))))
    rows = numbered.select("doc_id", "tab", "title", "format", (F.col("row") - F.col("headed").cast("int")).alias("row"), (F.col("headed") & (F.col("row") == 0)).alias("is_header"), padded.alias("cells"))
    return rows, diagnostics


def _formats_in(known: DataFrame) -> list[str]:
    found = {r["format"] for r in known.select("format").distinct().collect()}
    return [n for n in PARSERS if n in found]


def probed(docs: DataFrame) -> DataFrame:
    """doc_id and format: the candidate that fits best once its parser has been tried.

    A mark that decides alone is taken as it is. Else the three best candidates are tried, and a score counts 0.6,
    and 0.4 by how well the text parses; of equal ones the better candidate wins. Where none gives a cell, all
    formats are tried in order and the first that parses at all is taken, or plain text.
    """
    sniffed = settled(sniff(docs).select("doc_id", "format", "candidates"))
    sure = F.col("format").isin("html-table", "cli-table-data")
    unsure = sniffed.where(~sure).select("doc_id", F.posexplode("candidates").alias("at", "c")).select("doc_id", "at", F.col("c.format").alias("format"), F.col("c.score").alias("score"))
    tried = _tried(docs, unsure)
    best = tried.where("quality > 0").groupBy("doc_id").agg(F.max_by("format", F.struct(F.col("score") * (F.lit(0.6) + F.col("quality") * 0.4), -F.col("at"))).alias("format"))
    best = settled(best.unionByName(sniffed.where(sure).select("doc_id", "format")))
    left = sniffed.join(best, "doc_id", "left_anti").select("doc_id")
    if not left.isEmpty():
        every = F.posexplode(F.array(*map(F.lit, PROBE_ORDER))).alias("at", "format")
        any_ = _tried(docs, left.select("doc_id", every).withColumn("score", F.lit(1.0))).where("quality > 0.2")
        last = any_.groupBy("doc_id").agg(F.min_by("format", "at").alias("format"))
        best = best.unionByName(left.join(last, "doc_id", "left").select("doc_id", F.coalesce("format", F.lit("plain-text")).alias("format")))
    return best


def _tried(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, format, ...) with the quality of each parse; nothing for a format that finds no rows."""
    texts = settled(docs.join(wanted.select("doc_id", "format"), "doc_id"))
    found = []
    for name in _formats_in(texts):
        rows, diagnostics = parse_texts(texts.where(F.col("format") == name).select("doc_id", "text"), name)
        found.append(parse_quality(rows, diagnostics).withColumn("format", F.lit(name)))
    if not found:
        return wanted.withColumn("quality", F.lit(None).cast("double")).where(F.lit(False))
    quality = reduce(DataFrame.unionByName, found).withColumnRenamed("doc_id", "of")
    return wanted.join(quality, (F.col("doc_id").cast("string") == F.col("of")) & (wanted["format"] == quality["format"])).drop("of", quality["format"])


def _numbered(raw: DataFrame) -> DataFrame:
    """Rows of each table counted from 0, with the table's width."""
    part = Window.partitionBy(*KEY)
    return raw.withColumn("row", F.row_number().over(part.orderBy("row")) - 1).withColumn("width", F.max(F.size("cells")).over(part))


def parse_quality(rows: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """doc_id and how well its text parsed, 0 to 1: less for uneven rows and open quotes; 0.2 without cells."""
    cells = rows.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max(F.exists("cells", lambda c: c != "")).alias("any"))
    cost = F.when(F.col("code") == "UNCLOSED_QUOTE", 0.3).when(F.col("code") == "ROW_WIDTH_MISMATCH", 0.04).when(F.col("severity") == "error", 0.35).otherwise(0.0)
    shifted = F.count(F.when(F.col("code") == "ALIGNED_POSITION_MISMATCH", 1))
    costs = diagnostics.groupBy("doc_id").agg((F.sum(cost) + F.when(shifted > 0, F.least(F.lit(0.16), 0.08 + (shifted - 1) * 0.01)).otherwise(0.0)).alias("cost"))
    score = F.when(~F.col("any"), 0.2).otherwise(F.greatest(F.lit(0.15), F.lit(1.0) - F.coalesce("cost", F.lit(0.0))))
    return cells.join(costs, "doc_id", "left").select("doc_id", score.alias("quality"))


def tables_of(rows: DataFrame) -> list[Table]:
    """One Table for each parsed table, lazily. Only names, widths and header rows come to the driver."""
    rows = settled(rows)  # parsed once, not again for each table
    tops = rows.groupBy("doc_id", "tab").agg(F.first("title").alias("title"), F.max(F.size("cells")).alias("width"), F.max(F.when(F.col("is_header"), F.col("cells"))).alias("head"))
    used: set[str] = set()
    out = []
    for i, t in enumerate(tops.orderBy("doc_id", "tab").collect()):
        name = unique_name(t["title"].strip() or f"Table {i + 1}", used)
        headers = unique_headers([*(t["head"] or [""] * t["width"])])
        mine = rows.where((F.col("doc_id") == t["doc_id"]) & (F.col("tab") == t["tab"]) & ~F.col("is_header"))
        df = mine.select(F.col("row").cast("long").alias("o0"), *[F.coalesce(F.get("cells", F.lit(c)), F.lit("")).alias(f"c{c}") for c in range(len(headers))])
        out.append(Table(name, tuple(headers), df))
    return out


def parse_text(spark: SparkSession, text: str, fmt: str | None = None, header_mode: str = "auto") -> tuple[list[Table], list[str]]:
    """(tables, diagnostic codes) of one text."""
    docs = spark.createDataFrame([("text", text)], "doc_id string, text string")
    rows, diagnostics = parse_texts(docs, fmt, header_mode)
    return tables_of(rows), sorted(r["code"] for r in diagnostics.collect())


@dataclass(frozen=True)
class Imported:
    """format is empty for a text without cells and error for one that could not be parsed."""

    tables: list[Table]
    format: str
    diagnostics: list[tuple[str, int | None, int | None]]
    candidates: list[tuple[str, float]]


def import_text(spark: SparkSession, text: str | None, fmt: str = "auto", header_mode: str = "auto") -> Imported:
    """Everything that is known of one pasted or loaded text; never raises.

    diagnostics: (code, table, row), those of the detection before those of the parse, each once.
    """
    try:
        if len(text or "") * 2 > LARGEST:
            raise ValueError("the text is too large")
        docs = spark.createDataFrame([("text", text)], "doc_id string, text string")
        found = sniff(docs).first() if fmt == "auto" else None
        chosen = probed(docs).first()["format"] if found else fmt
        rows, diagnostics = parse_texts(docs, chosen, header_mode)
        tables = tables_of(rows)
        seen = [(n, None, None) for n in (found["notes"] if found else [])]
        seen += [(r["code"], r["tab"], r["row"]) for r in diagnostics.orderBy("tab", "row", "code").collect()]
        candidates = [(c["format"], c["score"]) for c in found["candidates"]] if found else [(fmt, 1.0)]
        return Imported(tables, chosen if tables else "empty", list(dict.fromkeys(seen)), candidates if tables else [])
    except Exception:
        logging.getLogger(__name__).exception("a text could not be parsed")
        return Imported([], "error", [("PARSE_ERROR", None, None)], [])
