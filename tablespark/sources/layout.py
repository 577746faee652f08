"""Columns of text without delimiters, found by the places where cells start.

A header need not start where its cells do. Cells repeat their starts from line to line, so the starts of the header
and those that most lines share both stand as candidates, and the better one cuts the table.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Least gap between cells, how far starts may lie apart, share of lines that must have a start.
GAP, NEAR, SHARE = 2, 1, 0.6
KEY = ["doc_id", "tab"]
WORD = re.compile(r"\S+")


def columns_of(ch: str) -> int:
    """How many columns of a terminal a character takes."""
    if ch < "̀":
        return int(ch >= " " and not "\x7f" <= ch < "\xa0")
    if unicodedata.category(ch) in ("Mn", "Me", "Cf"):
        return 0
    return 2 if unicodedata.east_asian_width(ch) in "WF" else 1


def _words(line: str) -> list[tuple[int, int, int]]:
    """(start, end, gap before) of each word, in columns."""
    if line.isascii() and line.isprintable():  # every character takes one column
        ends = [0, *(m.end() for m in WORD.finditer(line))]
        return [(m.start(), m.end(), m.start() - end) for m, end in zip(WORD.finditer(line), ends)]
    out, at, done = [], 0, 0
    for m in WORD.finditer(line):
        gap = sum(map(columns_of, line[done : m.start()]))
        start = at + gap
        at = start + sum(map(columns_of, m[0]))
        out.append((start, at, gap))
        done = m.end()
    return out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def starts_of(lines: pa.Array) -> pa.Array:
    """Where the cells of each line start: its first word, and those after a gap."""
    return pa.array([[s for i, (s, _, gap) in enumerate(_words(x)) if i == 0 or gap >= GAP] for x in lines.to_pylist()], pa.list_(pa.int32()))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def word_starts(lines: pa.Array) -> pa.Array:
    """Where the words of each line start."""
    return pa.array([[s for s, _, _ in _words(x)] for x in lines.to_pylist()], pa.list_(pa.int32()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def cut_at(lines: pa.Array, starts: pa.Array) -> pa.Array:
    """The cells of each line between starts; what lies before the first start is left out."""

    def one(line: str, at: list[int]) -> list[str]:
        if line.isascii() and line.isprintable():
            return [line[a:b].strip() for a, b in zip(at, [*at[1:], len(line)])]
        cells, column, k = [""] * len(at), 0, -1
        for ch in line:
            wide = columns_of(ch)
            while k + 1 < len(at) and column + wide > at[k + 1]:
                # A character across a start belongs to both cells.
                if k >= 0 and column < at[k + 1]:
                    cells[k] += ch
                k += 1
            if k >= 0:
                cells[k] += ch
            column += wide
        return [c.strip() for c in cells]

    return pa.array([one(x, s or []) for x, s in zip(lines.to_pylist(), starts.to_pylist())], pa.list_(pa.string()))


@F.arrow_udf(T.IntegerType())
def words_cut(lines: pa.Array, starts: pa.Array) -> pa.Array:
    """How many starts, the first apart, fall inside a word of the line."""
    return pa.array([sum(any(a < s < b for a, b, _ in _words(x)) for s in (at or [])[1:]) for x, at in zip(lines.to_pylist(), starts.to_pylist())], pa.int32())


def shared_columns(lines: DataFrame) -> DataFrame:
    """doc_id, tab and columns: the starts of a header's words that begin columns.

    lines: doc_id, tab, is_head and words (starts of the line's words), near (starts after a gap). A word after a gap
    begins one; another does if SHARE of the lines have a word that starts there. A header that begins further right
    leaves a column without a name before it.
    """
    heads = lines.where("is_head").groupBy(*KEY).agg(F.first(F.struct("words", "near")).alias("head"))
    body = lines.where("not is_head").join(heads, KEY)
    inner = F.array_except(F.array_intersect("words", F.col("head.words")), F.col("head.near"))
    seen = body.select(*KEY, F.explode(inner).alias("p")).groupBy(*KEY, "p").agg(F.count("*").alias("n"))
    sizes = body.groupBy(*KEY).agg(F.count("*").alias("lines"))
    held = seen.join(sizes, KEY).where(F.col("n") >= F.greatest(F.lit(1), F.ceil(F.col("lines") * SHARE))).groupBy(*KEY).agg(F.collect_list("p").alias("more"))
    every = heads.join(held, KEY, "left").withColumn("columns", F.array_sort(F.concat("head.near", F.coalesce("more", F.array().cast("array<int>")))))
    return every.select(*KEY, F.when(F.get("columns", F.lit(0)) > 0, F.concat(F.array(F.lit(0)), "columns")).otherwise(F.col("columns")).alias("columns"))


def layouts(lines: DataFrame) -> DataFrame:
    """doc_id, tab, columns (starts), by (header or data), score, coverage, support: one row for each table of lines.

    lines: doc_id, tab, line, text, is_head (one of a table's lines), starts. Counts for each place of a table are
    summed up in parts, so tables of any length are one row of places in the end.
    """
    body = lines.where(~F.col("is_head"))
    places = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s - NEAR, s + NEAR))))
    seen = body.select(*KEY, F.col("starts").alias("own"), F.explode(places).alias("p")).groupBy(*KEY, "p").agg(F.count("*").alias("support"), F.max(F.array_contains("own", F.col("p"))).alias("own"))
    of_body = seen.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("p", "support"))).alias("support"), F.array_sort(F.collect_list(F.when(F.col("own"), F.col("p")))).alias("seen"))
    heads = lines.groupBy(*KEY).agg(F.max(F.when(F.col("is_head"), F.struct("text", "starts"))).alias("head"), F.count(F.when(~F.col("is_head"), 1)).alias("n"))
    t = heads.join(of_body, KEY).select(*KEY, "n", "support", F.col("head.text").alias("head"), F.col("head.starts").alias("by_head"), "seen")
    firsts = F.filter("seen", lambda p, i: (i == 0) | (p - F.get("seen", i - 1) > NEAR))
    held = lambda p: F.coalesce(F.try_element_at("support", p), F.lit(0))
    t = t.withColumn("by_data", F.filter(firsts, lambda p: (p == 0) | (held(p) >= F.greatest(F.lit(1), F.ceil(F.col("n") * SHARE)))))
    more = F.size("by_data") != F.size("by_head")
    uneven = more & (F.size("by_data") > 0)
    candidates = []
    for by in ("head", "data"):
        at = F.col(f"by_{by}")
        t = t.withColumn(f"cells_{by}", cut_at("head", at)).withColumn(f"cut_{by}", words_cut("head", at))
        support = F.aggregate(at, F.lit(0.0), lambda a, p: a + held(p)) / F.col("n") / F.size(at)
        coverage = F.size(F.filter(f"cells_{by}", lambda c: c != "")) / F.size(at)
        whole = 1 - F.col(f"cut_{by}") / (F.size(at) - 1)
        extra = F.when(uneven, 0.10).otherwise(0.0)
        if by == "data":
            extra = extra + F.when(more, 0.08).otherwise(0.0) - F.when(F.size("by_data") < F.size("by_head"), 0.30).otherwise(0.0)
        else:
            extra = extra + F.when((coverage >= 1) & (support >= 0.5), 0.04).otherwise(0.0)
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), support * 0.40 + coverage * 0.25 + whole * 0.35 + extra))
        # Complete headers come first, then the score, then the data.
        found = F.struct((coverage >= 1).alias("complete"), score.alias("score"), F.lit(by).alias("by"), at.alias("columns"), coverage.alias("coverage"), support.alias("support"))
        candidates.append(F.when(F.size(at) >= 2, found))
    rank = lambda c: F.struct(c["complete"], c["score"], (c["by"] == "data").alias("data"))
    head, data = candidates
    best = F.when(data.isNull(), head).when(head.isNull(), data).when(rank(data) > rank(head), data).otherwise(head)
    return t.withColumn("best", best).where("best is not null").select(*KEY, "best.columns", "best.by", "best.score", "best.coverage", "best.support")
