"""Equality joins kept as named, chainable views."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .table import Table, unique_headers

ALIAS = re.compile(r"^(.*?)(?:\s+as\s+|\s*:\s*)(.+)$", re.I | re.S)


@dataclass
class View:
    view: str
    left: str
    right: str
    on: str
    type: str = "inner"
    select: str = ""
    enabled: bool = True


@dataclass(frozen=True)
class Output:
    side: str
    column: str
    alias: str

    @property
    def right(self) -> bool:
        return self.side in ("right", "r")


def outputs_of(select: str) -> list[Output]:
    """side.column [as alias | : alias], between commas or newlines; a side other than right or r is left."""
    out = []
    for token in filter(None, (t.strip() for t in (select or "").replace("\n", ",").split(","))):
        renamed = ALIAS.match(token)
        base, alias = (renamed[1].strip(), renamed[2].strip()) if renamed else (token, "")
        side, dot, column = base.partition(".")
        side, column = (side.lower() or "left", column.strip()) if dot else ("left", base)
        if column:
            out.append(Output(side, column, alias))
    return out


def pairs_of(on: str, left: Table, right: Table) -> list[tuple[str, str]]:
    """left=right between commas; pairs with another shape or unknown columns are dropped."""
    split = [[x.strip() for x in part.split("=")] for part in (on or "").split(",")]
    return [(p[0], p[1]) for p in split if len(p) == 2 and p[0] in left.headers and p[1] in right.headers]


def run_view(view: View, tables: dict[str, Table], views: dict[str, View], stack: tuple[str, ...] = ()) -> Table | None:
    """The joined table, or None if a source is missing, the views form a ring, or no pair of fields is left.

    Row order: rows with a left part by left order, then right order; then those with a right part alone. Kinds
    other than the six are inner. A semi join takes the right columns of the first match.
    """
    left, right = (resolve(n, tables, views, (*stack, view.view)) for n in (view.left, view.right))
    if left is None or right is None:
        return None
    pairs = pairs_of(view.on, left, right)
    if not pairs:
        return None
    outputs = outputs_of(view.select) or [Output("left", h, "") for h in left.headers] + [Output("right", h, "") for h in right.headers]
    l_keys, r_keys = [[t.headers.index(p[i]) for p in pairs] for i, t in ((0, left), (1, right))]
    ldf = left.df.select(*[F.col(o).alias(f"l_{o}") for o in left.order], *[F.col(f"c{i}").alias(f"l{i}") for i in range(len(left.headers))], F.lit(True).alias("has_l"))
    rdf = right.df.select(*[F.col(o).alias(f"r_{o}") for o in right.order], *[F.col(f"c{i}").alias(f"r{i}") for i in range(len(right.headers))], F.lit(True).alias("has_r"))
    l_order, r_order = [f"l_{o}" for o in left.order], [f"r_{o}" for o in right.order]
    kind = (view.type or "inner").lower()
    uses_right = any(o.right for o in outputs)
    same = [F.col(f"l{a}") == F.col(f"r{b}") for a, b in zip(l_keys, r_keys)]
    if kind == "semi" and uses_right:
        # One row for each key before the join: the first by right order. Partial minima leave the tasks.
        keys = [f"r{b}" for b in dict.fromkeys(r_keys)]
        rest = [c for c in rdf.columns if c not in keys]
        first = rdf.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*r_order)).alias("first"))
        joined = ldf.join(first.select(*keys, "first.*"), same, "inner")
    elif kind in ("semi", "anti"):
        joined = ldf.join(rdf, same, f"left_{kind}").withColumns({c: F.lit(None).cast(t) for c, t in rdf.dtypes})
    else:
        joined = ldf.join(rdf, same, {"left": "left", "right": "right", "full": "full"}.get(kind, "inner"))
    cells = [F.coalesce(_source(o, left, right), F.lit("")) for o in outputs]
    order = [F.when(F.col("has_l"), 0).otherwise(1), *map(F.col, l_order), *map(F.col, r_order)]
    df = joined.select(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[c.alias(f"c{i}") for i, c in enumerate(cells)])
    headers = unique_headers([o.alias or o.column for o in outputs])
    return Table(f"JOIN:{view.view}", tuple(headers), df, tuple(f"o{i}" for i in range(len(order))), read_only=True)


def _source(o: Output, left: Table, right: Table) -> Column:
    table, letter = (right, "r") if o.right else (left, "l")
    return F.col(f"{letter}{table.headers.index(o.column)}") if o.column in table.headers else F.lit("")


def resolve(name: str, tables: dict[str, Table], views: dict[str, View], stack: tuple[str, ...] = ()) -> Table | None:
    """A raw table hides a view of its name; a view that needs itself resolves to nothing."""
    if name in tables:
        return tables[name]
    return None if name in stack or name not in views else run_view(views[name], tables, views, stack)


def ring(views: dict[str, View]) -> list[str] | None:
    """Names along a ring of views, if there is one."""

    def walk(name: str, path: list[str]) -> list[str] | None:
        if name in path:
            return [*path[path.index(name) :], name]
        if name not in views:
            return None
        return walk(views[name].left, [*path, name]) or walk(views[name].right, [*path, name])

    return next((r for n in views if (r := walk(n, []))), None)


def dependencies(name: str, views: dict[str, View], depth: int = 0, seen: tuple[str, ...] = ()) -> list[str]:
    """The sources below a view, indented by depth."""
    line = ["  " * depth + name + (" (ring)" if name in seen else "")]
    if name in views and name not in seen:
        for child in (views[name].left, views[name].right):
            line += dependencies(child, views, depth + 1, (*seen, name))
    return line


def join_stats(left: Table, right: Table, on: str) -> DataFrame:
    """One row: sizes, matched pairs, left and right rows without a match, predicted rows of each kind.

    Counts for each key are joined, never the rows.
    """
    pairs = pairs_of(on, left, right)
    l_cells = [F.col(f"c{left.headers.index(a)}").alias(f"k{i}") for i, (a, _) in enumerate(pairs)]
    r_cells = [F.col(f"c{right.headers.index(b)}").alias(f"k{i}") for i, (_, b) in enumerate(pairs)]
    keys = [f"k{i}" for i in range(len(pairs))]
    a = left.df.select(*l_cells).groupBy(*keys).agg(F.count("*").alias("l"))
    b = right.df.select(*r_cells).groupBy(*keys).agg(F.count("*").alias("r"))
    n = a.join(b, keys, "full").select(F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = n.agg(
        total("l").alias("left_rows"), total("r").alias("right_rows"), total(F.col("l") * F.col("r")).alias("matched_pairs"),
        total(F.when(F.col("r") == 0, F.col("l"))).alias("left_only"), total(F.when(F.col("l") == 0, F.col("r"))).alias("right_only"),
    )
    m, lo, ro = F.col("matched_pairs"), F.col("left_only"), F.col("right_only")
    return out.select("*", m.alias("rows_inner"), (m + lo).alias("rows_left"), (m + ro).alias("rows_right"), (m + lo + ro).alias("rows_full"), (F.col("left_rows") - lo).alias("rows_semi"), lo.alias("rows_anti"))


def auto_match(left: list[str], right: list[str]) -> list[tuple[str, str]]:
    """Field pairs by equal names; else by names that differ in case alone; else without separators."""
    for form in (lambda h: h, str.lower, lambda h: re.sub(r"[_\-\s]", "", h).lower()):
        by = {}
        for h in right:
            by.setdefault(form(h), h)
        found = [(h, by[form(h)]) for h in left if form(h) in by]
        if found:
            return found
    return []


def saved_pairs(on: str) -> list[tuple[str, str]]:
    """Field pairs of a saved view, to be edited again; a part without = has no right field."""
    parts = [p.partition("=") for p in (on or "").split(",") if p.strip()]
    return [(left.strip(), right.strip()) for left, _, right in parts]


def select_text(outputs: list[Output]) -> str:
    return ", ".join(f"{'right' if o.right else 'left'}.{o.column}" + (f" as {o.alias}" if o.alias else "") for o in outputs)


def without_stale(pairs: list[tuple[str, str]], outputs: list[Output], left: list[str], right: list[str]) -> tuple[list[tuple[str, str]], list[Output]]:
    """After a source has changed: fields that are gone become blank in pairs and leave the outputs."""
    kept = [(a if a in left else "", b if b in right else "") for a, b in pairs]
    return kept, [o for o in outputs if o.column in (right if o.right else left)]


def in_source_order(outputs: list[Output], left: list[str], right: list[str]) -> list[Output]:
    """Left columns, then right ones, each as in their table; names given stay with their columns."""
    return sorted(outputs, key=lambda o: (o.right, (right if o.right else left).index(o.column)))


def toggled(outputs: list[Output], side: str, columns: list[str], on: bool) -> list[Output]:
    """Columns of one side added behind the others, or taken out."""
    is_right = side in ("right", "r")
    if not on:
        return [o for o in outputs if o.right != is_right or o.column not in columns]
    have = {o.column for o in outputs if o.right == is_right}
    return outputs + [Output(side, c, "") for c in columns if c not in have]


def view_problems(view: View, tables: dict[str, Table], views: dict[str, View]) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a view before it is saved."""
    errors, warnings = [], []
    if not view.view.strip():
        errors.append("name is missing")
    if view.view in tables:
        errors.append("a table has this name")
    if ring({**views, view.view: view}):
        return [*errors, "views form a ring"], warnings
    left, right = resolve(view.left, tables, views), resolve(view.right, tables, views)
    if left is None or right is None:
        return [*errors, "a source is missing"], warnings
    wanted = [p for p in view.on.split(",") if p.strip()]
    if not pairs_of(view.on, left, right):
        errors.append("no pair of fields matches")
    elif len(pairs_of(view.on, left, right)) < len(wanted):
        warnings.append("some pairs of fields are dropped")
    outputs = outputs_of(view.select)
    if not outputs:
        errors.append("no output column")
    if stale := [o.column for o in outputs if o.column not in (right if o.right else left).headers]:
        warnings.append(f"unknown output columns: {', '.join(stale)}")
    names = [(o.alias or o.column).lower() for o in outputs]
    if len(set(names)) < len(names):
        warnings.append("output names repeat")
    return errors, warnings
