"""Cell corrections that lie over a table, with undo and redo."""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import functions as F

from .ordinals import keys_at
from .table import Table

HISTORY = 100
#: Up to so many edits of a numbered table become expressions; more are joined.
INLINE = 200
#: Up to so many edited rows are sent to every task; more are joined by a shuffle.
SENT = 100_000


class Overlay:
    """Edits (row, column) -> value of the raw tables of one document. Rows count from 0 in table order."""

    def __init__(self):
        self.cells: dict[str, dict[tuple[int, int], str]] = {}
        self.done: deque[tuple[str, int, int, str, str]] = deque(maxlen=HISTORY)
        self.undone: list[tuple[str, int, int, str, str]] = []

    def edit(self, table: Table, row: int, column: int, value: str, old: str | None = None) -> bool:
        """False if the table is read-only, the place is outside, or nothing changes."""
        if table.read_only or not 0 <= column < len(table.headers) or row < 0:
            return False
        if old is None:
            old = self.cells.get(table.name, {}).get((row, column))
        if old is None:
            at = table.ordered().offset(row).limit(1).select(f"c{column}").first()
            if at is None:
                return False
            old = at[0]
        if old == value:
            return False
        self._put(table.name, row, column, value)
        self.done.append((table.name, row, column, old, value))
        self.undone.clear()
        return True

    def _put(self, name: str, row: int, column: int, value: str) -> None:
        self.cells.setdefault(name, {})[row, column] = value

    def undo(self) -> bool:
        """Puts the old value into the overlay; the entry itself stays."""
        if not self.done:
            return False
        name, row, column, old, new = self.done.pop()
        self._put(name, row, column, old)
        self.undone.append((name, row, column, old, new))
        return True

    def redo(self) -> bool:
        if not self.undone:
            return False
        name, row, column, old, new = self.undone.pop()
        self._put(name, row, column, new)
        self.done.append((name, row, column, old, new))
        return True

    def clear(self) -> None:
        self.__init__()

    def apply(self, table: Table, row_number: str | None = None) -> Table:
        """The corrected table. row_number names an order column that counts rows from 0; else the edited rows' order
        columns are looked up, and the table itself is neither sorted nor numbered.

        The order columns must name rows uniquely; where they don't, every row that shares an edited row's place is
        corrected. Edits outside the table are passed by. Few edits of a numbered table become expressions.
        """
        edits = {k: v for k, v in self.cells.get(table.name, {}).items() if 0 <= k[1] < len(table.headers)}
        if not edits or table.read_only:
            return table
        df = table.df
        if row_number and len(edits) <= INLINE:
            row = F.col(row_number)
            for c in {c for _, c in edits}:
                of = [(r, v) for (r, cc), v in edits.items() if cc == c]
                df = df.withColumn(f"c{c}", reduce(lambda e, rv: F.when(row == rv[0], F.lit(rv[1])).otherwise(e), of, F.col(f"c{c}")))
            return table.with_df(df.select(*table.df.columns))
        rows: dict[int, dict[int, str]] = {}
        for (r, c), v in edits.items():
            rows.setdefault(r, {})[c] = v
        frame = df.sparkSession.createDataFrame(list(rows.items()), "_row long, _edits map<int, string>")
        by = [row_number] if row_number else list(table.order)
        found = frame.withColumnRenamed("_row", row_number) if row_number else keys_at(df, by, frame).drop("_row")
        found = found.select(*[F.col(c).alias(f"_at_{c}") for c in by], "_edits")
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in by])
        # The edits are held by the driver, as people make them; Spark broadcasts them while they are few.
        df = df.join(F.broadcast(found) if len(rows) <= SENT else found, same, "left")
        cells = {f"c{i}": F.coalesce(F.try_element_at("_edits", F.lit(i)), c) for i, c in enumerate(table.cells)}
        return table.with_df(df.withColumns(cells).select(*table.df.columns))
