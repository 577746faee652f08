"""Format detection over corpora of texts: features of the first lines, weighted signatures, ranked candidates."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parsers import MARKDOWN_RULE
from .text import normal_text

SAMPLE_CHARS, SAMPLE_LINES, LEAST, FEW_LINES, FEW_CAP, CLOSE = 4096, 50, 0.05, 3, 0.70, 0.12

#: Priority, what must be there (any of), what must not be, weighted features (name, test, bound, weight).
SIGNATURES: list[tuple[str, int, list[str], list[str], list[tuple[str, str, float, float]]]] = [
    ("data-block", 95, ["data_block"], [], [("data_block", "set", 0, 1.0)]),
    ("excel-paste", 85, ["has_tab"], ["md_rule", "ascii_rule", "aligned_rule", "cli_rule"], [("tab", "gt", 0, 0.35), ("tab_var", "lt", 0.10, 0.30), ("comma", "lt", 3, 0.15), ("empty", "lt", 0.15, 0.10), ("embedded", "zero", 0, 0.10)]),
    ("pipe-table", 82, ["has_pipe"], ["ascii_rule", "cli_rule"], [("md_rule", "set", 0, 0.40), ("pipe", "gt", 0, 0.20), ("pipe_var", "lt", 0.15, 0.15), ("tab", "zero", 0, 0.10), ("comma", "lt", 3, 0.10), ("empty", "lt", 0.3, 0.05)]),
    ("ascii-table", 78, ["has_pipe", "ascii_rule"], ["cli_rule"], [("ascii_rule", "set", 0, 0.50), ("pipe", "gt", 0, 0.20), ("pipe_var", "lt", 0.2, 0.15), ("tab", "zero", 0, 0.10), ("empty", "lt", 0.4, 0.05)]),
    ("csv", 75, ["has_comma"], ["md_rule", "ascii_rule", "aligned_rule", "cli_rule"], [("comma", "gt", 0, 0.30), ("comma_var", "lt", 0.18, 0.30), ("tab", "zero", 0, 0.20), ("semi", "lt", 1.5, 0.10), ("escaped", "set", 0, 0.05), ("empty", "lt", 0.2, 0.05)]),
    ("semicolon-csv", 70, ["has_semi"], ["md_rule", "ascii_rule"], [("semi", "gt", 0, 0.35), ("semi_var", "lt", 0.15, 0.30), ("comma", "lt", 2.5, 0.15), ("tab", "zero", 0, 0.15)]),
    ("cli-multi-block", 68, ["cli_rule"], [], [("cli_rule", "set", 0, 0.35), ("empty", "gt", 0.02, 0.25), ("length_var", "lt", 30, 0.15), ("tab", "zero", 0, 0.15), ("pipe", "lt", 2, 0.10)]),
    ("aligned-table", 65, ["aligned_gap"], ["ascii_rule", "md_rule", "cli_rule"], [("aligned_rule", "set", 0, 0.35), ("length_var", "lt", 30, 0.15), ("gap", "gt", 0, 0.15), ("tab", "zero", 0, 0.15), ("comma", "lt", 3, 0.10), ("pipe", "lt", 2, 0.10)]),
    ("fixed-width", 55, ["has_gap"], ["aligned_rule", "ascii_rule", "md_rule", "cli_rule", "cli_data"], [("gap", "gt", 0, 0.30), ("gap_var", "lt", 0.5, 0.25), ("tab", "zero", 0, 0.15), ("comma", "lt", 3, 0.10), ("pipe", "lt", 2, 0.10), ("length_var", "lt", 40, 0.10)]),
    ("plain-text", 0, [], ["md_rule", "ascii_rule", "aligned_rule", "cli_rule", "cli_data", "data_block", "has_tab", "has_pipe", "has_comma", "has_semi"], [("gap", "gt", 0, 0.30), ("tab", "zero", 0, 0.30), ("comma", "lt", 2, 0.20), ("semi", "lt", 1, 0.10), ("empty", "lt", 0.3, 0.10)]),
]
PRESENT = 0.15


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of its first lines. Marks are counted outside quotes, per line that isn't blank."""
    head = F.substring(normal_text(F.col("text")), 1, SAMPLE_CHARS)
    rows = docs.select("doc_id", head.alias("head"))
    rows = rows.select("doc_id", "head", F.slice(F.split("head", "\n", -1), 1, SAMPLE_LINES).alias("lines"))
    full = F.filter("lines", lambda s: F.trim(s) != "")
    bare = F.transform(full, lambda s: F.regexp_replace(s, '"[^"]*"', ""))
    count = lambda pattern: F.transform(bare, lambda s: F.regexp_count(s, F.lit(pattern)).cast("double"))
    rows = rows.select("doc_id", "head", "lines", full.alias("full"), count(r"\t").alias("tabs"), count(r"\|").alias("pipes"), count(",").alias("commas"), count(";").alias("semis"), count(r"\S\s{2,}(?=\S)").alias("gaps"), F.transform(full, lambda s: F.length(s).cast("double")).alias("lengths"))
    mean = lambda a: F.coalesce(F.try_divide(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), F.size(a)), F.lit(0.0))
    out = rows
    for name, column in (("tab", "tabs"), ("pipe", "pipes"), ("comma", "commas"), ("semi", "semis"), ("gap", "gaps"), ("length", "lengths")):
        out = out.withColumn(name, mean(F.col(column)))
        out = out.withColumn(f"{name}_var", mean(F.transform(column, lambda x: (x - F.col(name)) * (x - F.col(name)))))  # noqa: B023
    any_line = lambda pattern: F.exists("full", lambda s: s.rlike(pattern))
    empty = F.try_divide(F.size("lines") - F.size("full"), F.size("lines"))
    return out.select(
        "doc_id", "head", F.size("full").alias("n_lines"), *[c for n in ("tab", "pipe", "comma", "semi", "gap", "length") for c in (n, f"{n}_var")], F.coalesce(empty, F.lit(0.0)).alias("empty"),
        (F.col("head").contains('""')).alias("escaped"), F.when(F.col("head").rlike('"[^"\n]*\n[^"]*"'), 1.0).otherwise(0.0).alias("embedded"),
        (any_line(MARKDOWN_RULE) & any_line(r"\|")).alias("md_rule"), any_line(r"^\s*[+├┌└╔╚╠][-=─═+┬┴┼╦╩╬]{3,}").alias("ascii_rule"),
        any_line(r"^[\s+\-]*---[\s+\-]*$").alias("aligned_rule"), any_line(r"^[\s|+]*={10,}[=\s|+]*$").alias("cli_rule"),
        F.col("head").rlike(r"table[-_]data").alias("cli_data"), F.col("head").rlike(r"(?<![A-Za-z0-9_$])data\s+[A-Za-z0-9_][A-Za-z0-9_$]*\s*\[").alias("data_block"), F.col("head").rlike(r"(?i)<table\b").alias("html"),
    ).withColumns({f"has_{n}": F.col(n) > PRESENT for n in ("tab", "pipe", "comma", "semi", "gap")}).withColumn("aligned_gap", F.col("aligned_rule") & F.col("has_gap"))


def _credit(name: str, test: str, bound: float) -> Column:
    c = F.col(name)
    if test == "set":
        return F.when(c, 1.0).otherwise(0.0)
    if test == "zero":
        return F.lit(1.0) - F.least(F.lit(1.0), c)
    if test == "gt":
        part = F.least(F.lit(1.0), c / bound) if bound > 0 else F.lit(0.0)
        return F.when(c > bound, 1.0).otherwise(part)
    return F.when(c < bound, 1.0).otherwise(F.lit(bound) / c)


def sniff(docs: DataFrame) -> DataFrame:
    """doc_id, format, candidates (at most three: format, score) and notes (codes) for each text.

    A <table or table-data mark decides at once. Else signatures score; scores within 0.05 of one another rank by
    priority; texts of less than three lines score 0.70 at most; nothing found is plain text at 0.45.
    """
    f = features(docs)
    scored = []
    for name, priority, needs, bars, weighted in SIGNATURES:
        score = reduce(lambda a, b: a + b, [_credit(n, t, b) * w for n, t, b, w in weighted])
        open_ = reduce(or_, [F.col(n) for n in needs], F.lit(not needs))
        shut = reduce(or_, [F.col(n) for n in bars], F.lit(False))
        score = F.when(open_ & ~shut, score).otherwise(0.0)
        scored.append(F.struct(F.when(F.col("n_lines") < FEW_LINES, F.least(score, F.lit(FEW_CAP))).otherwise(score).alias("score"), F.lit(priority).alias("priority"), F.lit(name).alias("format")))
    soft = F.filter(F.array(*scored), lambda s: s["score"] > LEAST)
    near = lambda a, b: F.when(F.abs(a["score"] - b["score"]) > 0.05, F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["priority"] > b["priority"], -1).when(a["priority"] < b["priority"], 1).otherwise(0)
    hard = lambda name: F.array(F.struct(F.lit(1.0).alias("score"), F.lit(100).alias("priority"), F.lit(name).alias("format")))
    plain = F.array(F.struct(F.lit(0.45).alias("score"), F.lit(0).alias("priority"), F.lit("plain-text").alias("format")))
    # Not a total order, so candidates are ranked one by one: the best of those that are left.
    first = lambda a: F.aggregate(a, F.get(a, F.lit(0)), lambda x, y: F.when(near(y, x) < 0, y).otherwise(x))
    soft1 = f.withColumn("left0", F.when(F.col("html"), hard("html-table")).when(F.col("cli_data"), hard("cli-table-data")).when(F.size(soft) > 0, soft).otherwise(plain))
    for i in range(3):
        soft1 = soft1.withColumn(f"best{i}", first(F.col(f"left{i}")))
        soft1 = soft1.withColumn(f"left{i + 1}", F.filter(f"left{i}", lambda s: s["format"] != F.col(f"best{i}.format")))  # noqa: B023
    best = F.filter(F.array("best0", "best1", "best2"), lambda s: s.isNotNull())
    notes = F.filter(F.array(
        F.when(F.trim("head") == "", "EMPTY_INPUT"), F.when((F.col("n_lines") < FEW_LINES) & (F.trim("head") != ""), "LOW_SAMPLE"),
        F.when(F.col("best0.score") - F.col("best1.score") < CLOSE, "FORMAT_AMBIGUOUS"),
    ), lambda n: n.isNotNull())
    return soft1.select("doc_id", F.col("best0.format").alias("format"), F.transform(best, lambda s: F.struct(s["format"].alias("format"), s["score"].alias("score"))).alias("candidates"), notes.alias("notes"))
