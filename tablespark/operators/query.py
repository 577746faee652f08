"""Filtering, marking, focusing, paging and turning of tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import column_filter, compile_rule
from .ordinals import numbered
from .table import Table

PAGE, LARGEST_PAGE = 100, 500


@dataclass
class Rules:
    """What holds for one table."""

    filter: str = ""
    highlight: str = ""
    focus: list[str] = field(default_factory=list)
    columns: dict[str, str] = field(default_factory=dict)


def focus_columns(headers: list[str], focus: list[str] | str | None, strict: bool = False) -> list[int]:
    """Places of the focused headers, in the wanted order; all if none is known. strict: names aren't trimmed."""
    names = focus.split(",") if isinstance(focus, str) else list(focus or [])
    names = names if strict else [n.strip() for n in names]
    found = [headers.index(n) for n in names if n in headers]
    return found or list(range(len(headers)))


def picker_order(headers: list[str], focus: list[str]) -> list[tuple[str, bool]]:
    """(header, chosen) as a picker of columns lists them: the focused ones in their order, then the rest."""
    first = [h for h in dict.fromkeys(focus) if h in headers]
    return [(h, True) for h in first] + [(h, False) for h in headers if h not in first]


def process(table: Table, rules: Rules | None = None, global_filter: str = "", highlight_on: bool = True, only_highlighted: bool = False) -> Table:
    """Global, table and column filters, then marks (_hl), then focus. Lazy; every predicate is total."""
    rules = rules or Rules()
    headers, df = list(table.headers), table.df
    keep = compile_rule(global_filter, headers, table.cells) & compile_rule(rules.filter, headers, table.cells)
    for header, text in rules.columns.items():
        if table.cell(header) is not None:
            keep = keep & column_filter(text, table.cell(header))
    marked = highlight_on and bool(rules.highlight.strip())
    mark = compile_rule(rules.highlight, headers, table.cells) if marked else F.lit(False)
    df = df.where(keep).withColumn("_hl", mark)
    if only_highlighted:
        df = df.where("_hl")
    places = focus_columns(headers, rules.focus)
    df = df.select(*table.order, *[F.col(f"c{p}").alias(f"c{i}") for i, p in enumerate(places)], "_hl")
    return table.with_df(df, headers=tuple(headers[p] for p in places), sources=tuple(places))


def page(table: Table, number: int = 1, size: int = PAGE) -> tuple[Table, dict]:
    """One page in row order, and {page, pages, rows}; the number is clamped. Only the page is sorted out."""
    rows = table.df.count()
    pages = max(1, -(-rows // size))
    number = min(max(1, number), pages)
    return table.with_df(table.ordered().offset((number - 1) * size).limit(size)), {"page": number, "pages": pages, "rows": rows}


def with_result_index(table: Table) -> Table:
    """_result_index, from 0 in row order. The rows are written once and numbered from there."""
    return table.with_df(numbered(table.df, list(table.order), "_result_index"))


def turned_cells(table: Table) -> DataFrame:
    """Every cell of a table of any size: field (place of its column, from 0), header, row (from 0 in row order), value."""
    rows = numbered(table.df.select(*table.order, F.array(*table.cells).alias("_cells")), list(table.order), "row")
    header = F.get(F.array(*map(F.lit, table.headers)), F.col("field"))
    return rows.select("row", F.posexplode("_cells").alias("field", "value")).select("field", header.alias("header"), "row", "value")


def transpose(table: Table, corner: str = "field") -> DataFrame:
    """One row for each header, one column `Row i` for each row of a page. For pages alone: the columns are its rows.

    The page's cells are regrouped by their column; only the number of its rows comes to the driver.
    """
    page_rows = table.df.orderBy(*table.order).limit(LARGEST_PAGE + 1)  # so one window sees a page at most
    n = page_rows.count()
    if n > LARGEST_PAGE:
        raise ValueError(f"at most {LARGEST_PAGE} rows can become columns: take a page")
    heads = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(h).alias("h")) for i, h in enumerate(table.headers)])
    fields = table.df.sparkSession.range(1).select(F.inline(heads)).select("i", F.col("h").alias(corner))
    if not n:
        return fields.orderBy("i").drop("i")
    rows = page_rows.select(F.row_number().over(Window.orderBy(*table.order)).alias("n"), F.array(*table.cells).alias("cells"))
    rows = rows.select("n", F.posexplode("cells").alias("i", "value"))
    turned = rows.groupBy("i").pivot("n", list(range(1, n + 1))).agg(F.first("value"))
    turned = turned.select("i", *[F.col(str(k)).alias(f"Row {k}") for k in range(1, n + 1)])
    return fields.join(turned, "i").orderBy("i").drop("i")


def turn_back(turned: DataFrame, corner: str = "field", name: str = "turned") -> Table:
    """A turned page or selection as a table again: its fields are the headers, each of its other columns is a record.

    Only the names of the fields come to the driver.
    """
    records = [c for c in turned.columns if c != corner]
    placed = turned.withColumn("_field", F.monotonically_increasing_id())
    fields = sorted(placed.select("_field", corner).collect())  # one for each column of the table
    values = placed.select("_field", F.posexplode(F.array(*[F.col(f"`{c}`") for c in records])).alias("o0", "value"))
    cells = values.groupBy("o0").pivot("_field", [f["_field"] for f in fields]).agg(F.first("value"))
    df = cells.select(F.col("o0").cast("long").alias("o0"), *[F.coalesce(F.col(str(f["_field"])), F.lit("")).alias(f"c{i}") for i, f in enumerate(fields)])
    return Table(name, tuple(f[corner] for f in fields), df)


def lua_selection(table: Table, rows: tuple[int, int], columns: tuple[int, int], turned: bool = False) -> Table:
    """What is copied as Lua when rows and columns of a view are selected: in a turned view its rows are fields and its
    columns are records, and each record stays one Lua table."""
    return rectangle(table, columns, rows) if turned else rectangle(table, rows, columns)


def rectangle(table: Table, rows: tuple[int, int], columns: tuple[int, int]) -> Table:
    """Rows and columns between two corners, in any order, both included."""
    r0, r1 = sorted(rows)
    c0, c1 = sorted(columns)
    df = table.ordered().offset(r0).limit(r1 - r0 + 1)
    places = range(max(c0, 0), min(c1, len(table.headers) - 1) + 1)
    df = df.select(*table.order, *[F.col(f"c{p}").alias(f"c{i}") for i, p in enumerate(places)])
    return table.with_df(df, headers=tuple(table.headers[p] for p in places))
