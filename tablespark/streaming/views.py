"""Views of a stream and tables that stay: each batch of the stream meets the tables as they are then."""

from __future__ import annotations

from ..operators.joins import View, resolve
from ..operators.table import Table

#: Kinds of joins whose rows a batch of the stream settles for good, by the side that the stream stands on.
SETTLED = {"left": ("inner", "left", "semi", "anti"), "right": ("inner", "right")}


def _streamed(name: str, tables: dict[str, Table], views: dict[str, View]) -> bool:
    if name in tables:
        return tables[name].df.isStreaming
    return name in views and any(_streamed(n, tables, views) for n in (views[name].left, views[name].right))


def stream_view(name: str, tables: dict[str, Table], views: dict[str, View]) -> Table | None:
    """The view of that name over streamed and standing tables, with its chain of views; None where `resolve` finds none.

    A join whose kind keeps standing rows until a later batch might match them, or of two streams, is refused with its
    name before the query starts.
    """
    for v in views.values():
        left, right = (_streamed(n, tables, views) for n in (v.left, v.right))
        side = "left" if left else "right"
        kind = (v.type or "inner").lower()
        kind = kind if kind in ("left", "right", "full", "semi", "anti") else "inner"
        if (left or right) and (left and right or kind not in SETTLED[side]):
            raise ValueError(f"{v.view}: a {kind} join with a stream {'on both sides' if left and right else f'on its {side}'} has no settled rows")
    return resolve(name, tables, views)
