"""Parsers of messy text, over whole corpora of texts.

Each takes (doc_id, text) and returns rows: doc_id, tab (table number from 0), title, row (ascending in the table),
cells (array of text), forced (true or false where the format decides on the header, else null), note (codes between
commas, where a line did not fit). Lines, sections and
states are windows over the lines of a text, ordered by line; cells come from expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import trim_all
from ..functions.markup import html_texts
from .data_block import data_block
from .layout import NEAR, SHARE, cut_at, layouts, shared_columns, starts_of, word_starts
from .text import lines_of, normal_text, settled

CELL, ROW, ESCAPED_PIPE, ESCAPED_SLASH = "\u0001", "\u0002", "\u0003", "\u0004"


def _by_line():
    return Window.partitionBy("doc_id").orderBy("line")


def _before():
    return _by_line().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _out(df: DataFrame, tab: Column | None = None, title: Column | None = None, row: str = "line", forced: Column | None = None, note: Column | None = None) -> DataFrame:
    return df.select("doc_id", (F.lit(0) if tab is None else tab).cast("int").alias("tab"), (F.lit("") if title is None else title).alias("title"), F.col(row).cast("int").alias("row"), "cells", (F.lit(None) if forced is None else forced).cast("boolean").alias("forced"), (F.lit(None) if note is None else note).cast("string").alias("note"))


def _marked(text: Column, sep: str) -> Column:
    """The text with marks in place of separators and newlines that stand outside quotes.

    Pieces between quotes alternate: outside, inside, outside; an empty outside piece between two inside ones is a
    doubled quote. So no state is carried along the text.
    """
    parts = F.split(text, '"', -1)
    outside = lambda p: F.replace(F.replace(p, F.lit("\n"), F.lit(ROW)), F.lit(sep), F.lit(CELL))
    whole = F.transform(parts, lambda p, i: F.when(i % 2 == 1, p).when((p == "") & (i > 0) & (i < F.size(parts) - 1), F.lit('"')).otherwise(outside(p)))
    return F.array_join(whole, "")


def record_cells(text: Column, sep: str) -> Column:
    """The cells of one record."""
    return F.split(_marked(text, sep), CELL, -1)


def delimited(sep: str) -> Callable[[DataFrame], DataFrame]:
    """Quotes may open anywhere in a cell; between quotes separators and newlines are text, a doubled quote is one."""

    def parse(docs: DataFrame) -> DataFrame:
        rows = docs.select("doc_id", F.posexplode(F.split(_marked(normal_text(F.col("text")), sep), ROW, -1)).alias("line", "text"))
        return _out(rows.select("doc_id", "line", F.split("text", CELL, -1).alias("cells")))

    return parse


def unclosed_quote(text: Column) -> Column:
    return F.size(F.split(normal_text(text), '"', -1)) % 2 == 0


def pipe_cells(line: Column) -> Column:
    """Cells between pipes, less one outer pipe on either side; a backslash takes the next character as it is."""
    s = F.replace(F.replace(trim_all(line), F.lit("\\\\"), F.lit(ESCAPED_SLASH)), F.lit("\\|"), F.lit(ESCAPED_PIPE))
    s = F.regexp_replace(F.regexp_replace(s, r"\\(.)", "$1"), r"^\||\|$", "")
    return F.transform(F.split(s, r"\|", -1), lambda c: F.replace(F.replace(c, F.lit(ESCAPED_PIPE), F.lit("|")), F.lit(ESCAPED_SLASH), F.lit("\\")))


MARKDOWN_RULE = r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$"


def pipe_table(docs: DataFrame) -> DataFrame:
    lines = lines_of(docs).where(F.col("text").contains("|")).withColumn("rule", F.col("text").rlike(MARKDOWN_RULE))
    lines = lines.withColumn("ruled", F.max("rule").over(Window.partitionBy("doc_id")))
    return _out(lines.where("not rule").withColumn("cells", pipe_cells(F.col("text"))), forced=F.when(F.col("ruled"), F.lit(True)))


def ascii_table(docs: DataFrame) -> DataFrame:
    lines = lines_of(docs).withColumn("text", F.translate("text", "│┃", "||"))
    lines = lines.where(F.col("text").contains("|") & ~F.col("text").rlike(r"^[\s+\-=|:─━┌┐└┘├┤┬┴┼╔╗╚╝═╠╣╦╩╬]*$"))
    return _out(lines.withColumn("cells", pipe_cells(F.col("text"))))


def spaced(pattern: str) -> Callable[[DataFrame], DataFrame]:
    def parse(docs: DataFrame) -> DataFrame:
        lines = lines_of(docs).withColumn("text", trim_all(F.col("text"))).where("text <> ''")
        return _out(lines.withColumn("cells", F.split("text", pattern, -1)))

    return parse


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _spread(rows: pa.Array) -> pa.Array:
    """Cells (text, colspan, rowspan) put on their grid places: text goes down with rowspan, blanks follow colspan."""

    def one(table):
        held, out = {}, []
        for cells in table or ():
            line, at, down = [], 0, {}
            for cell in [*cells, None]:
                while at in held:
                    text, left = held.pop(at)
                    line.append(text)
                    if left > 1:
                        down[at] = text, left - 1
                    at += 1
                if cell is not None:
                    for n in range(max(1, cell["across"])):
                        text = cell["text"] if n == 0 else ""
                        line.append(text)
                        if cell["down"] > 1:
                            down[at] = text, cell["down"] - 1
                        at += 1
            held = down
            out.append(line)
        return out

    # One table at a time as Python's lists, which take ten times the room.
    return pa.array((one(r.as_py()) for r in rows), pa.list_(pa.list_(pa.string())))


def html_table(docs: DataFrame) -> DataFrame:
    """Every <table>: rows of cells, spans spread out; a table with any <th> begins with its header.

    Tables are taken apart into rows before their cells are read, so that work and memory follow the row, whatever the
    size of a table. Only tables with cells that reach down are put together again.
    """
    tables = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(r"(?is)<table\b.*?(?:</table\s*>|\z)"), F.lit(0))).alias("tab", "html"))
    named = F.coalesce(F.nullif(F.regexp_extract("html", r"(?is)^<table\b[^>]*\bdata-name\s*=\s*[\"']([^\"']*)", 1), F.lit("")), F.nullif(F.regexp_extract("html", r"(?is)^<table\b[^>]*\bsummary\s*=\s*[\"']([^\"']*)", 1), F.lit("")))
    number = lambda c, name: F.coalesce(F.regexp_extract(c, rf"(?is)^<t[dh]\b[^>]*\b{name}\s*=\s*[\"']?(\d+)", 1).try_cast("int"), F.lit(1))
    title = F.coalesce(named, F.concat(F.lit("HTML Table "), F.col("tab") + 1)).alias("title")
    split = F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b.*?(?=<tr\b|</tr\s*>|\z)"), F.lit(0))).alias("row", "html")
    rows = tables.select("doc_id", "tab", title, F.col("html").rlike(r"(?i)<th\b").alias("head"), F.col("html").rlike(r"(?i)rowspan").alias("deep"), split)
    rows = rows.withColumn("cells", F.regexp_extract_all("html", F.lit(r"(?is)<t[dh]\b.*?(?=<t[dh]\b|</t[dh]\s*>|\z)"), F.lit(0)))
    rows = rows.select("doc_id", "tab", "title", "head", "deep", "row", "cells", html_texts(F.col("cells")).alias("texts"))
    across = lambda c, text: F.concat(F.array(text), F.array_repeat(F.lit(""), F.greatest(number(c, "colspan"), F.lit(1)) - 1))
    flat = rows.where("not deep").select("doc_id", "tab", "title", "head", "row", F.flatten(F.zip_with("cells", "texts", across)).alias("cells"))
    cell = lambda c, text: F.struct(text.alias("text"), number(c, "colspan").alias("across"), number(c, "rowspan").alias("down"))
    deep = rows.where("deep").select("doc_id", "tab", "title", "head", "row", F.zip_with("cells", "texts", cell).alias("cells"))
    deep = deep.groupBy("doc_id", "tab", "title", "head").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"))
    deep = deep.select("doc_id", "tab", "title", "head", F.posexplode(_spread(F.col("rows.cells"))).alias("row", "cells"))
    rows = flat.unionByName(deep)
    return _out(rows, F.col("tab"), F.col("title"), "row", F.when(F.col("head"), F.lit(True)))


def cli_table_data(docs: DataFrame) -> DataFrame:
    """Reports: a line with table-data names a table, the line with validflag is its header and sets the mode."""
    lines = lines_of(docs).withColumn("marks", F.col("text").contains("table-data"))
    lines = lines.withColumn("tab", F.sum(F.col("marks").cast("int")).over(_before()) - 1).where("tab >= 0")
    part = Window.partitionBy("doc_id", "tab").orderBy("line")
    so_far = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("title", F.first("text").over(part)).withColumn("title", F.regexp_extract("title", r"(?s)^.*table-data\W*(\S*)", 1))
    is_head = ~F.col("marks") & F.col("text").contains("validflag")
    lines = lines.withColumn("head", F.first(F.when(is_head, F.col("text")), ignorenulls=True).over(so_far)).withColumn("at", F.first(F.when(is_head, F.col("line")), ignorenulls=True).over(so_far))
    ended = F.max((~F.col("marks") & F.col("text").rlike(r"^\s*[<\[]")).cast("int")).over(so_far)
    lines = lines.withColumn("ended", ended).where("ended = 0 and head is not null and trim(text) <> ''")
    head, text = F.col("head"), F.col("text")
    mode = F.when(head.contains("\t"), "tab").when(head.contains(",") & ~head.rlike("  "), "csv").when(F.size(F.split(head, r"\|")) > 2, "pipe").otherwise("fixed")
    words = lambda c: F.split(trim_all(c), r"\s+")
    starts = F.filter(F.sequence(F.lit(1), F.length(head)), lambda i: head.substr(i, F.lit(1)).rlike(r"\S") & ((i == 1) | head.substr(i - 1, F.lit(1)).rlike(r"\s")))
    fixed = F.transform(starts, lambda s, i: text.substr(s, F.coalesce(F.try_element_at(starts, (i + 2).cast("int")) - s, F.lit(1 << 20))))
    by_mode = F.when(mode == "tab", F.split(text, "\t", -1)).when(mode == "csv", F.split(text, ",", -1)).when(mode == "pipe", pipe_cells(text)).otherwise(fixed)
    head_size = F.when(mode == "tab", F.size(F.split(head, "\t", -1))).when(mode == "csv", F.size(F.split(head, ",", -1))).when(mode == "pipe", F.size(pipe_cells(head))).otherwise(F.size(words(head)))
    lines = lines.withColumn("cells", F.when(F.size(words(text)) == head_size, words(text)).otherwise(by_mode))
    return _out(lines, F.col("tab"), F.col("title"), "line", F.lit(True))


def _only(marker: str) -> Column:
    """A rule line: ten marks or more, at least 60 % of what isn't white space, with pipes alone beside them."""
    dense = F.regexp_replace("text", r"\s", "")
    marks = F.length(F.regexp_replace(dense, rf"[^{marker}]", ""))
    return dense.rlike(rf"^[{marker}|+]+$") & (marks >= 10) & (marks >= F.length(dense) * 0.6)


def _cli_lines(docs: DataFrame) -> DataFrame:
    """Lines of sections, titles apart: tab, title, starts and ends (rules), ruled (below the second rule), over (below
    the first blank line after it), and of the section has_rule, has_head, has_data."""
    lines = lines_of(docs).withColumn("starts", _only("=")).withColumn("ends", ~F.col("starts") & _only(r"\-"))
    lines = lines.withColumn("again", F.col("starts") & F.lag("starts", 1, False).over(_by_line())).where("not again")
    lines = lines.withColumn("tab", F.sum(F.col("starts").cast("int")).over(_before()) - 1)
    named = F.when(F.lead("starts", 1, False).over(_by_line()) & (trim_all(F.col("text")) != "") & ~F.col("ends"), F.regexp_replace(trim_all(F.col("text")), r"[:：]$", ""))
    lines = lines.withColumn("named", named).withColumn("title", F.last("named", ignorenulls=True).over(_before())).where("tab >= 0 and named is null")
    part = Window.partitionBy("doc_id", "tab").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("ruled", F.max(F.col("ends").cast("int")).over(part)).withColumn("blank", trim_all(F.col("text")) == "")
    lines = lines.withColumn("over", F.max((F.col("blank") & (F.col("ruled") == 1)).cast("int")).over(part))
    whole = Window.partitionBy("doc_id", "tab")
    plain = ~F.col("blank") & ~F.col("starts") & ~F.col("ends")
    return lines.withColumns({
        "has_rule": F.max("ends").over(whole), "has_head": F.max(plain & (F.col("ruled") == 0)).over(whole), "has_data": F.max(plain & (F.col("ruled") == 1) & (F.col("over") == 0)).over(whole),
    })


def cli_problems(docs: DataFrame) -> DataFrame:
    """doc_id, tab, code of sections that give no table, and of headers without a first name."""
    lines = _cli_lines(docs)
    code = F.when(~F.col("has_rule"), "MISSING_SEPARATOR").when(~F.col("has_head"), "MISSING_HEADER").when(~F.col("has_data"), "EMPTY_TABLE_BLOCK").when(F.col("head").startswith(" "), "MISSING_FIRST_HEADER")
    head = F.min(F.when((F.col("ruled") == 0) & ~F.col("blank") & ~F.col("starts"), F.struct("line", "text")))
    blocks = lines.groupBy("doc_id", "tab", "has_rule", "has_head", "has_data").agg(head["text"].alias("head"))
    return blocks.select("doc_id", "tab", code.alias("code")).where("code is not null")


def cli_multi_block(docs: DataFrame) -> DataFrame:
    """Sections: title, ==== rule, header, ---- rule, rows to the first blank line. Sections without one of these give
    nothing.

    Columns start where the header's words do, if a gap stands before them or most rows have a word there. A row whose
    gaps give at least as many cells, and other ones than its places, keeps the cells between its gaps.
    """
    lines = _cli_lines(docs).where("has_rule and has_head and has_data and over = 0 and not starts and not ends and not blank")
    part = Window.partitionBy("doc_id", "tab").orderBy("line")
    lines = lines.withColumn("is_head", F.row_number().over(part) == 1).withColumn("heads", F.max((F.col("ruled") == 0).cast("int")).over(Window.partitionBy("doc_id", "tab"))).where("heads = 1")
    first_title = Window.partitionBy("doc_id", "title").orderBy("tab")
    lines = lines.withColumn("nth", F.dense_rank().over(first_title))
    title = F.when(F.col("nth") > 1, F.concat(F.coalesce("title", F.lit("Block")), F.lit(" ("), F.col("nth").cast("string"), F.lit(")"))).otherwise(F.coalesce("title", F.lit("Block")))
    lines = settled(lines.select("doc_id", "tab", title.alias("title"), "line", "text", "is_head", word_starts("text").alias("words"), starts_of("text").alias("near")))
    lines = lines.join(shared_columns(lines), ["doc_id", "tab"]).withColumn("placed", cut_at("text", "columns")).withColumn("gaps", F.split(trim_all(F.col("text")), r"\s{2,}"))
    many, few = F.size("gaps") >= F.size("columns"), F.size("gaps") < F.size("columns")
    moved = ~F.col("is_head") & many & (F.col("gaps") != F.col("placed"))
    odd = ~F.col("is_head") & ((F.size("gaps") > F.size("columns")) | (few & ~F.forall("columns", lambda c: F.array_contains("words", c))))
    notes = F.concat_ws(",", F.when(moved, "POSITION_MISMATCH"), F.when(odd, "ROW_WIDTH_MISMATCH"))
    return _out(lines.withColumn("cells", F.when(moved, F.col("gaps")).otherwise(F.col("placed"))), F.col("tab"), F.col("title"), "line", F.lit(True), F.nullif(notes, F.lit("")))


def aligned_table(docs: DataFrame) -> DataFrame:
    """Blocks of aligned lines; rules count as blank; a block of one line names the next, unless it is its header."""
    rule = trim_all(F.col("text")).rlike(r"^[\s+\-]*---[\s+\-]*$")
    lines = lines_of(docs).withColumn("rule", rule).withColumn("blank", (trim_all(F.col("text")) == "") | rule)
    lines = lines.withColumn("block", F.sum(F.col("blank").cast("int")).over(_before())).where("not blank")
    per = Window.partitionBy("doc_id", "block")
    lines = lines.withColumn("n", F.count("*").over(per)).withColumn("columns", F.size(F.split(trim_all(F.col("text")), r"\s{2,}")))
    # A lone line of several columns belongs to the block below; one of a single column is its title.
    blocks = lines.where("n = 1 and columns = 1").select("doc_id", "block", F.col("text").alias("named"))
    body = lines.where("n > 1 or columns > 1")
    opens = (F.col("n") == 1) | ((F.lag("n", 1, 0).over(_by_line()) != 1) & (F.col("block") != F.lag("block", 1, -1).over(_by_line())))
    body = body.withColumn("opens", F.coalesce(opens, F.lit(True)).cast("int")).withColumn("tab", F.sum("opens").over(_before()) - 1)
    tops = body.groupBy("doc_id", "tab").agg(F.min("block").alias("top"))
    titles = tops.join(blocks, "doc_id").where("block < top").groupBy("doc_id", "tab").agg(F.max_by("named", "block").alias("named"), F.max("block").alias("block"))
    first_use = Window.partitionBy("doc_id", "block").orderBy("tab")
    titles = titles.withColumn("use", F.row_number().over(first_use)).where("use = 1").select("doc_id", "tab", "named")
    part = Window.partitionBy("doc_id", "tab").orderBy("line")
    body = body.withColumn("is_head", F.row_number().over(part) == 1).withColumn("starts", starts_of("text"))
    body = settled(body.select("doc_id", "tab", "line", "text", "is_head", "starts"))
    found = layouts(body).where("coverage >= 1")
    body = body.join(found, ["doc_id", "tab"]).join(titles, ["doc_id", "tab"], "left")
    body = body.withColumn("gaps", F.split(trim_all(F.col("text")), r"\s{2,}")).withColumn("places", cut_at("text", "columns"))
    # A value that runs over its place is kept whole by the gaps between cells.
    over = ~F.col("is_head") & (F.size("gaps") >= F.size("columns")) & (F.col("gaps") != F.col("places"))
    met = F.size(F.filter("columns", lambda c: F.exists("starts", lambda s: F.abs(s - c) <= NEAR))) / F.size("columns")
    note = F.when(over & ((F.col("by") != "head") | (met >= SHARE)), "ALIGNED_POSITION_MISMATCH")
    body = body.withColumn("cells", F.when(over, F.col("gaps")).otherwise(F.col("places")))
    return _out(body, F.col("tab"), F.coalesce(trim_all(F.col("named")), F.lit("")), "line", F.lit(True), note)


#: Every parser by its format id, in order of precedence.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "html-table": html_table, "cli-table-data": cli_table_data, "data-block": data_block, "excel-paste": delimited("\t"), "pipe-table": pipe_table, "ascii-table": ascii_table,
    "csv": delimited(","), "semicolon-csv": delimited(";"), "cli-multi-block": cli_multi_block, "aligned-table": aligned_table, "fixed-width": spaced(r"\s{2,}"), "plain-text": spaced(r"\s+"),
}
