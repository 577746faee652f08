"""Tables as text: rows are rendered by the executors, in row order, one line or block for each."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.ordinals import numbered
from ..operators.table import Table

SEPARATORS = {"tsv": "\t", "csv": ","}


def widths(table: Table, kind: str = "markdown", protect: bool = True, header: bool = True) -> DataFrame:
    """One row: the display length of each column, 3 at least."""
    cell = C.markdown_cell if kind == "markdown" else C.ascii_cell
    longest = lambda i, c: F.greatest(F.lit(3), F.coalesce(F.max(F.length(cell(c, protect))), F.lit(0)), F.length(cell(F.lit(table.headers[i]), protect)) if header else F.lit(0))
    return table.df.agg(*[longest(i, c).cast("int").alias(f"w{i}") for i, c in enumerate(table.cells)])


def row_column(table: Table, kind: str, cells: list[Column], protect: bool = True, width: list[int] | None = None) -> Column:
    """One row's text; Markdown and ASCII need the widths."""
    if kind in SEPARATORS:
        return F.concat_ws(SEPARATORS[kind], *[C.delimited_cell(c, SEPARATORS[kind], protect) for c in cells])
    if kind in ("markdown", "ascii"):
        cell = C.markdown_cell if kind == "markdown" else C.ascii_cell
        padded = [F.rpad(cell(c, protect), F.greatest(F.lit(w), F.length(cell(c, protect))), F.lit(" ")) for c, w in zip(cells, width or [3] * len(cells))]
        return F.concat(F.lit("| "), F.concat_ws(" | ", *padded), F.lit(" |"))
    if kind == "html":
        return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), C.html_cell(c, protect), F.lit("</td>")) for c in cells], F.lit("</tr>"))
    if kind == "lua":
        fields = [F.concat(F.lit("["), C.lua_string(F.lit(h)), F.lit("] = "), C.lua_literal(c)) for h, c in zip(table.headers, cells)]
        return F.concat_ws(", ", *fields)
    raise ValueError(f"unknown format: {kind}")


def rendered_rows(table: Table, kind: str, protect: bool = True, header: bool = True) -> DataFrame:
    """The order columns and `line`, the text of each row. For corpora: write it with DataFrame.write.text."""
    width = [int(w) for w in widths(table, kind, protect, header).first()] if kind in ("markdown", "ascii") else None
    return table.df.select(*table.order, row_column(table, kind, table.cells, protect, width).alias("line"))


def _around(table: Table, kind: str, protect: bool, header: bool, width: list[int] | None) -> tuple[list[str], list[str]]:
    """The lines above and below the rows."""
    heads = table.df.sparkSession.range(1).select(row_column(table, kind, [F.lit(h) for h in table.headers], protect, width).alias("line")).first()["line"]
    rule = "" if width is None else "+" + "+".join("-" * (w + 2) for w in width) + "+"
    if kind == "html":
        top = ["<thead>" + heads.replace("<td>", "<th>").replace("</td>", "</th>") + "</thead>"] if header else []
        return ["<table>", *top, "<tbody>"], ["</tbody>", "</table>"]
    if kind == "ascii":
        return ([rule, heads, rule] if header else [rule]), [rule]
    if kind == "markdown":
        return ([heads, "| " + " | ".join("-" * w for w in width) + " |"] if header else []), []
    return ([heads] if header else []), []


def _lua_fields(table: Table) -> list[Column]:
    return [F.concat(F.lit("["), C.lua_string(F.lit(h)), F.lit("] = "), C.lua_literal(c)) for h, c in zip(table.headers, table.cells)]


def _lua_record(fields: list[Column], number: Column, layout: str, wide: list[int]) -> Column:
    """The lines of one record. In the inline layout fields stand below one another, so they are padded."""
    begin = F.concat(F.lit("    ["), number.cast("string"), F.lit("] = {"))
    if layout == "expanded":
        return F.concat_ws("\n", begin, *[F.concat(F.lit("        "), f, F.lit(",")) for f in fields], F.lit("    },"))
    padded = [F.rpad(F.concat(f, F.lit(",")), w + 2, " ") for f, w in zip(fields[:-1], wide)]
    return F.concat(begin, F.lit(" "), *padded, fields[-1], F.lit(" },"))


def _lua_widths(table: Table) -> list[int] | None:
    """The longest field of each column; None without rows or columns."""
    fields = _lua_fields(table)
    wide = table.df.agg(*[F.max(F.length(f)) for f in fields]).first() if fields else [None]
    return None if wide[0] is None else list(wide)


def lines(table: Table, kind: str, protect: bool = True, header: bool = True, layout: str = "inline") -> Iterator[str]:
    """All lines of the rendering, fetched partition by partition, for results that one reader takes in; tables of any size
    are written by `write_rendering`."""
    if kind == "lua":
        wide = _lua_widths(table)
        if wide is None:
            yield "{}"
            return
        yield "{"
        fields = table.df.select(*table.order, F.array(*_lua_fields(table)).alias("f")).orderBy(*table.order).select("f")
        for n, r in enumerate(fields.toLocalIterator(), 1):
            if layout == "expanded":
                yield f"    [{n}] = {{"
                yield from (f"        {f}," for f in r["f"])
                yield "    },"
            else:
                padded = [f"{f},".ljust(w + 2) for f, w in zip(r["f"][:-1], wide)]
                yield f"    [{n}] = {{ {''.join([*padded, r['f'][-1]])} }},"
        yield "}"
        return
    width = [int(w) for w in widths(table, kind, protect, header).first()] if kind in ("markdown", "ascii") else None
    above, below = _around(table, kind, protect, header, width)
    yield from above
    for r in table.df.select(*table.order, row_column(table, kind, table.cells, protect, width).alias("line")).orderBy(*table.order).select("line").toLocalIterator():
        yield r["line"]
    yield from below


def write_rendering(table: Table, kind: str, path: str, protect: bool = True, header: bool = True, layout: str = "inline") -> None:
    """Writes the rendering as text files whose names, in order, give its lines. Spark's commit makes them appear together.

    Rows are numbered, rendered and written by the executors; the driver makes the few lines around them.
    """
    spark, parts = table.df.sparkSession, int(table.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(table.df, list(table.order), "_n", parts)
    if kind == "lua":
        wide = _lua_widths(table)
        above, below = (["{}"], []) if wide is None else (["{"], ["}"])
        line = _lua_record(_lua_fields(table), F.col("_n") + 1, layout, wide) if wide else F.lit("")
        rows = rows if wide else rows.where(F.lit(False))
    else:
        width = [int(w) for w in widths(table, kind, protect, header).first()] if kind in ("markdown", "ascii") else None
        above, below = _around(table, kind, protect, header, width)
        line = row_column(table, kind, table.cells, protect, width)
    ends = [(i - len(above), t) for i, t in enumerate(above)] + [((1 << 62) + i, t) for i, t in enumerate(below)]
    every = rows.select("_n", line.alias("line")).unionByName(spark.createDataFrame(ends, "_n long, line string"))
    every.repartitionByRange(parts, "_n").sortWithinPartitions("_n").select("line").write.text(path)


def render(table: Table, kind: str = "tsv", **options) -> str:
    """The whole rendering as one text; for results that fit the driver, such as pages."""
    return "\n".join(lines(table, kind, **options))
