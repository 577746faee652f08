"""Named string tables over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import text_of


def unique_headers(names: list[str]) -> list[str]:
    """Trimmed; blank ones are Column{i}; the n-th that repeats, whatever its case, ends in _n."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        base = (name or "").replace(" ", " ").strip() or f"Column{i + 1}"
        n = seen[base.lower()] = seen.get(base.lower(), 0) + 1
        out.append(base if n == 1 else f"{base}_{n}")
    return out


def unique_name(name: str, used: set[str]) -> str:
    final, n = name, 2
    while final in used:
        final, n = f"{name}_{n}", n + 1
    used.add(final)
    return final


@dataclass(frozen=True)
class Table:
    """df holds the cells c0, c1, ... (text, never null) and the order columns o0, o1, ... that give row order.

    Headers can repeat, so cells go by place; headers are put on at the edge, by public().
    """

    name: str
    headers: tuple[str, ...]
    df: DataFrame
    order: tuple[str, ...] = ("o0",)
    read_only: bool = False
    sources: tuple[int, ...] | None = None
    meta: dict = field(default_factory=dict)

    @staticmethod
    def of(df: DataFrame, name: str, order_by: list[str], columns: list[str] | None = None) -> Table:
        """A table over a typed frame. order_by must be unique; it stays typed, so no global numbering is needed."""
        columns = columns or df.columns
        cells = [text_of(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)]
        order = [F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)]
        return Table(name, tuple(unique_headers(columns)), df.select(*order, *cells), tuple(f"o{i}" for i in range(len(order_by))))

    @property
    def cells(self) -> list[Column]:
        return [F.col(f"c{i}") for i in range(len(self.headers))]

    def with_df(self, df: DataFrame, **changes) -> Table:
        return replace(self, df=df, **changes)

    def cell(self, header: str) -> Column | None:
        return F.col(f"c{self.headers.index(header)}") if header in self.headers else None

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*self.order)

    def public(self, *extra: str) -> DataFrame:
        """The cells under their headers, with further columns; repeated headers stay as they are."""
        return self.df.select(*self.cells, *extra).toDF(*self.headers, *extra)
