"""Registered queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import profile
from ..operators.edits import Overlay
from ..operators.joins import View, join_stats, resolve, run_view
from ..operators.query import Rules, lua_selection, page, process, rectangle, transpose, turn_back, turned_cells, with_result_index
from ..operators.table import Table
from ..operators.workspace import Workspace
from ..sinks.render import row_column, widths, write_rendering
from ..sinks.xlsx import sheet_chunks
from ..sources.ingest import parse_quality, parse_texts
from ..sources.sniff import sniff
from ..sources.text import shared_folder
from ..streaming.rules import filtered_stream, run_available, stream_table
from ..streaming.views import stream_view
from . import hard_texts, read_back
from .texts import BLOCK, FIELDS, LAYOUTS, SOURCE, all_formats, customers_as, shifted_customers

Query = Callable[[SparkSession, str], DataFrame]

COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}


def tab(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return Table.of(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*COLUMNS[name]), name, COLUMNS[name][:1])


def text(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


def cells(name: str, only: list[str] | None = None) -> str:
    return ", ".join(f"{text(c)} AS {c}" for c in only or COLUMNS[name])


def row(name: str) -> str:
    return f"concat_ws(' ', {', '.join(map(text, COLUMNS[name]))})"


_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def rule(name: str, table: str, text_: str, where: str, **more) -> None:
    """A query that filters one table, and the SQL condition that must keep the same rows."""
    add(name, lambda s, d: process(tab(s, d, table), Rules(filter=text_, **more)).public(), f"SELECT {cells(table)} FROM {table} WHERE {where}")


# Rules.
rule("filter_eq_ci", "customer", "c_mktsegment=furniture", "lower(c_mktsegment) = 'furniture'")
rule("filter_contains", "part", "p_name:widg", "contains(lower(p_name), 'widg')")
rule("filter_not_equal", "orders", "o_orderstatus!=F", "lower(o_orderstatus) <> 'f'")
rule("filter_num_gt", "orders", "o_totalprice>100000", "o_totalprice > 100000")
rule("filter_num_ge", "part", "p_size>=25", "p_size >= 25")
rule("filter_num_lt", "customer", "c_acctbal<-500.5", "c_acctbal < -500.5")
rule("filter_num_le", "supplier", "s_acctbal<=1000", "s_acctbal <= 1000")
rule("filter_num_prefix", "orders", "o_orderpriority<3", r"TRY_CAST(regexp_extract(o_orderpriority, '^\s*([+-]?\d+\.?\d*)', 1) AS DOUBLE) < 3")
rule("filter_num_nan", "part", "p_type>0", "false")
rule("filter_regex_row", "orders", "/urgent|1997-05/", f"regexp_matches({row('orders')}, 'urgent|1997-05', 'i')")
rule("filter_regex_anchor", "part", "/^1.*0$/", f"regexp_matches({row('part')}, '^1.*0$', 'i')")
rule("filter_plaintext_row", "customer", "machin", f"contains(lower({row('customer')}), 'machin')")
rule("filter_cross_cell", "region", '"2 asia"|1', f"contains(lower({row('region')}), '\"2 asia\"') OR contains({row('region')}, '1')")
rule("filter_and", "orders", "o_orderstatus=o o_totalprice<50000 low", f"o_orderstatus = 'O' AND o_totalprice < 50000 AND contains(lower({row('orders')}), 'low')")
rule("filter_or", "part", "p_brand=brand#3|p_type=promo", "lower(p_brand) = 'brand#3' OR lower(p_type) = 'promo'")
rule("filter_or_no_key", "part", "p_type:promo|bolt", f"contains(lower(p_type), 'promo') OR contains(lower({row('part')}), 'bolt')")
rule("filter_not", "customer", "!c_mktsegment:build", "NOT contains(lower(c_mktsegment), 'build')")
rule("filter_not_or", "customer", "!building|c_acctbal<0", f"NOT contains(lower({row('customer')}), 'building') OR c_acctbal < 0")
rule("filter_quoted_value", "orders", 'o_orderpriority="4-NOT SPECIFIED"', "lower(o_orderpriority) = '4-not specified'")
rule("filter_empty_value", "customer", 'c_name=""', "c_name = ''")
rule("filter_unknown_column", "part", "nothing=1", "false")
rule("filter_not_unknown_column", "part", "!nothing=1", "true")
rule("filter_regex_with_operator", "part", "/a=b/", "false")
rule("filter_empty_or_branch", "part", "widget|", "true")
rule("filter_slash_alone", "nation", "/", "true")
rule("filter_bad_regex", "nation", "/(/", "false")
rule("colfilter_contains", "part", "", "contains(lower(p_name), 'red')", columns={"p_name": "RED"})
rule("colfilter_regex", "customer", "", "regexp_matches(c_name, '0[1-3]$', 'i')", columns={"c_name": "/0[1-3]$/"})
rule("colfilter_unknown_passes", "nation", "", "true", columns={"N_NAME": "zzz"})
add(
    "filter_three_level",
    lambda s, d: process(tab(s, d, "orders"), Rules(filter="o_totalprice>200000", columns={"o_orderpriority": "/high|urgent/"}), "o_orderstatus=p").public(),
    f"SELECT {cells('orders')} FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000 AND regexp_matches(o_orderpriority, 'high|urgent', 'i')",
)

# Marks and focus.
add(
    "highlight_mark",
    lambda s, d: process(tab(s, d, "part"), Rules(highlight="p_size>40")).public("_hl"),
    f"SELECT {cells('part')}, p_size > 40 AS _hl FROM part",
)
add("highlight_only", lambda s, d: process(tab(s, d, "part"), Rules(highlight="p_size>40"), only_highlighted=True).public(), f"SELECT {cells('part')} FROM part WHERE p_size > 40")
add("highlight_disabled_only", lambda s, d: process(tab(s, d, "part"), Rules(highlight="p_size>40"), highlight_on=False, only_highlighted=True).public(), f"SELECT {cells('part')} FROM part WHERE false")
add("focus_reorder", lambda s, d: process(tab(s, d, "orders"), Rules(focus=["o_totalprice", "missing", "o_orderkey"])).public(), f"SELECT {cells('orders', ['o_totalprice', 'o_orderkey'])} FROM orders")
add("focus_fallback", lambda s, d: process(tab(s, d, "nation"), Rules(focus=["missing"])).public(), f"SELECT {cells('nation')} FROM nation")

# Pages, ordinals, selections.
add("page_middle", lambda s, d: page(tab(s, d, "orders"), 3, 250)[0].public(), f"SELECT {cells('orders')} FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 250 OFFSET 500)")
add(
    "page_clamped",
    lambda s, d: page(process(tab(s, d, "customer"), Rules(filter="c_acctbal<0")), 10**6, 100)[0].public(),
    f"""WITH f AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS n, count(*) OVER () AS total FROM customer WHERE c_acctbal < 0)
    SELECT {cells('customer')} FROM f WHERE n >= (greatest(1, CAST(ceil(total / 100.0) AS BIGINT)) - 1) * 100""",
)
add(
    "result_index",
    lambda s, d: with_result_index(process(tab(s, d, "orders"), Rules(filter="o_orderstatus=p"))).df.select(F.col("o0").alias("o_orderkey"), F.col("_result_index").alias("result_index")),
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS result_index FROM orders WHERE o_orderstatus = 'P'",
)
add(
    "result_index_cells",
    lambda s, d: with_result_index(process(tab(s, d, "orders"), Rules(filter="o_orderstatus!=f"))).public("_result_index"),
    f"SELECT {cells('orders')}, row_number() OVER (ORDER BY o_orderkey) - 1 AS _result_index FROM orders WHERE lower(o_orderstatus) <> 'f'",
)
add(
    "result_index_view",
    lambda s, d: with_result_index(run_view(View("v", "customer", "orders", "c_custkey=o_custkey", "inner", "c_name, right.o_orderkey, right.o_totalprice as total"), {n: tab(s, d, n) for n in ("customer", "orders")}, {})).public("_result_index"),
    f"SELECT c_name, {text('o_orderkey')} AS o_orderkey, {text('o_totalprice')} AS total, row_number() OVER (ORDER BY c_custkey, o_orderkey) - 1 AS _result_index FROM customer JOIN orders ON c_custkey = o_custkey",
)
add(
    "transpose_page",
    lambda s, d: transpose(page(tab(s, d, "part"), 1, 4)[0]),
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, " + ", ".join(f"max(CASE WHEN n = {i} THEN {text(c)} END) AS \"Row {i}\"" for i in range(1, 5)) + " FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n FROM part)" for c in COLUMNS["part"]
    ),
)
add("transpose_and_back", lambda s, d: turn_back(transpose(page(tab(s, d, "part"), 2, 300)[0])).public(), f"WITH f AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS n, count(*) OVER () AS total FROM part) SELECT {cells('part')} FROM f WHERE n // 300 = least(2, CAST(ceil(total / 300.0) AS BIGINT)) - 1")
add(
    "turned_cells",
    lambda s, d: turned_cells(tab(s, d, "orders")),
    "WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders) " + " UNION ALL ".join(f"SELECT {i} AS field, '{c}' AS header, row, {text(c)} AS value FROM n" for i, c in enumerate(COLUMNS["orders"])),
)
add("lua_turned_selection", lambda s, d: lua_selection(tab(s, d, "orders"), (1, 3), (40, 90), turned=True).public(), f"SELECT {cells('orders', COLUMNS['orders'][1:4])} FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 51 OFFSET 40)")
add("select_rectangle", lambda s, d: rectangle(tab(s, d, "orders"), (120, 20), (4, 1)).public(), f"SELECT {cells('orders', COLUMNS['orders'][1:5])} FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 101 OFFSET 20)")


# Joins and views.
def view(name: str, v: View, sql: str) -> None:
    add(name, lambda s, d: run_view(v, {n: tab(s, d, n) for n in (v.left, v.right)}, {}).public(), sql)


_FILL = "coalesce({}, '')"
_CO = "left.c_custkey, left.c_name, right.o_orderkey, right.o_totalprice as total"
_CO_SQL = f"SELECT {_FILL.format(text('c_custkey'))} AS c_custkey, {_FILL.format('c_name')} AS c_name, {_FILL.format(text('o_orderkey'))} AS o_orderkey, {_FILL.format(text('o_totalprice'))} AS total FROM customer {{}} JOIN orders ON c_custkey = o_custkey"
for _kind in ("inner", "left", "right", "full"):
    view(f"join_{_kind}", View("v", "customer", "orders", "c_custkey=o_custkey", _kind, _CO), _CO_SQL.format(_kind))
view("join_unknown_kind", View("v", "customer", "orders", "c_custkey=o_custkey", "sideways", _CO), _CO_SQL.format("inner"))
view("join_semi_left_only", View("v", "customer", "orders", "c_custkey=o_custkey", "semi", "left.c_custkey, left.c_name"), f"SELECT {cells('customer', ['c_custkey', 'c_name'])} FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
view(
    "join_semi_first_match", View("v", "customer", "orders", "c_custkey=o_custkey", "semi", "left.c_custkey, r.o_orderkey, r.o_orderdate : day"),
    f"SELECT {text('c_custkey')} AS c_custkey, {text('o_orderkey')} AS o_orderkey, {text('o_orderdate')} AS day FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey) WHERE n = 1",
)
view("join_anti", View("v", "customer", "orders", "c_custkey=o_custkey", "anti", "left.c_custkey, right.o_orderkey"), f"SELECT {text('c_custkey')} AS c_custkey, '' AS o_orderkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
view("join_composite", View("v", "customer", "supplier", "c_nationkey=s_nationkey, c_custkey=s_suppkey", "inner", "c_name, right.s_name"), "SELECT c_name, s_name FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey")
view("join_partial_bad_pair", View("v", "supplier", "nation", "s_nationkey=n_nationkey, nothing=n_name, s_name", "inner", "s_name, right.n_name"), "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
view("join_alias_dup_headers", View("v", "supplier", "nation", "s_nationkey=n_nationkey", "left", "s_suppkey as id, right.n_nationkey as ID"), f"SELECT {text('s_suppkey')} AS id, coalesce({text('n_nationkey')}, '') AS \"ID_2\" FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
view("join_unknown_select_column", View("v", "nation", "region", "n_regionkey=r_regionkey", "inner", "n_name, right.gone"), "SELECT n_name, '' AS gone FROM nation JOIN region ON n_regionkey = r_regionkey")

_VIEWS = {
    "places": View("places", "nation", "region", "n_regionkey=r_regionkey", "left", "n_nationkey, n_name, right.r_name as region"),
    "sellers": View("sellers", "supplier", "places", "s_nationkey=n_nationkey", "inner", "s_suppkey, s_name, right.n_name, right.region"),
}
_SELLERS = "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, n_name, coalesce(r_name, '') AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"


def sellers(s: SparkSession, d: str) -> Table:
    return resolve("sellers", {n: tab(s, d, n) for n in ("nation", "region", "supplier")}, _VIEWS)


add("view_chain", lambda s, d: sellers(s, d).public(), _SELLERS)
add("view_then_filter", lambda s, d: process(sellers(s, d), Rules(filter="region=asia|n_name:_1", focus=["region", "s_name"])).public(), f"SELECT region, s_name FROM ({_SELLERS}) WHERE lower(region) = 'asia' OR contains(lower(n_name), '_1')")
add(
    "join_stats",
    lambda s, d: join_stats(tab(s, d, "customer"), tab(s, d, "orders"), "c_custkey=o_custkey"),
    """WITH l AS (SELECT c_custkey AS k, count(*) AS l FROM customer GROUP BY 1), r AS (SELECT o_custkey AS k, count(*) AS r FROM orders GROUP BY 1),
    n AS (SELECT coalesce(l, 0) AS l, coalesce(r, 0) AS r FROM l FULL JOIN r USING (k)),
    t AS (SELECT sum(l) AS left_rows, sum(r) AS right_rows, sum(l * r) AS matched_pairs, sum(CASE WHEN r = 0 THEN l ELSE 0 END) AS left_only, sum(CASE WHEN l = 0 THEN r ELSE 0 END) AS right_only FROM n),
    b AS (SELECT CAST(COLUMNS(*) AS BIGINT) FROM t)
    SELECT *, matched_pairs AS rows_inner, matched_pairs + left_only AS rows_left, matched_pairs + right_only AS rows_right, matched_pairs + left_only + right_only AS rows_full, left_rows - left_only AS rows_semi, left_only AS rows_anti FROM b""",
)


# Edits.
def edited(s: SparkSession, d: str) -> Table:
    over, orders = Overlay(), tab(s, d, "orders")
    for r, c, v in ((0, 2, "X"), (7, 5, "9-NEVER"), (7, 2, "X"), (10**9, 1, "beyond")):
        over.edit(orders, r, c, v, old="")
    over.edit(orders, 3, 2, "X", old="")
    over.undo()
    return over.apply(orders)


add(
    "cell_edit_overlay",
    lambda s, d: process(edited(s, d), Rules(filter="o_orderstatus=x|never|o_totalprice>499000")).public(),
    f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
    e AS (SELECT o_orderkey, o_custkey, CASE WHEN i IN (0, 7) THEN 'X' WHEN i = 3 THEN '' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, CASE WHEN i = 7 THEN '9-NEVER' ELSE o_orderpriority END AS o_orderpriority FROM n)
    SELECT {cells('orders')} FROM e WHERE lower(o_orderstatus) = 'x' OR contains(lower({row('orders')}), 'never') OR o_totalprice > 499000""",
)

def edited_everywhere(s: SparkSession, d: str) -> Table:
    """Edits in the first, the middle and the last row, and in every 997th."""
    over, orders = Overlay(), tab(s, d, "orders")
    n = orders.df.count()
    for r in {0, n // 2, n - 1, *range(5, n, 997)}:
        over.edit(orders, r, 2, f"row {r}", old="")
    over.edit(orders, n - 1, 5, "last", old="")
    over.edit(orders, n, 5, "beyond", old="")
    return over.apply(orders)


add(
    "cell_edits_everywhere",
    lambda s, d: edited_everywhere(s, d).public(),
    f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS total FROM orders),
    e AS (SELECT o_orderkey, o_custkey, CASE WHEN i IN (0, total // 2, total - 1) OR (i >= 5 AND (i - 5) % 997 = 0) THEN 'row ' || CAST(i AS VARCHAR) ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, CASE WHEN i = total - 1 THEN 'last' ELSE o_orderpriority END AS o_orderpriority FROM n)
    SELECT {cells('orders')} FROM e""",
)

# Profiles.
_TYPE = r"CASE WHEN trim({0}) = '' THEN 'empty' WHEN regexp_matches(trim({0}), '^(true|false|yes|no|是|否)$', 'i') THEN 'boolean' WHEN regexp_matches(trim({0}), '^-?\d+(\.\d+)?(e[+-]?\d+)?$', 'i') THEN 'number' WHEN regexp_matches(trim({0}), '^\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}(\s+\d{{1,2}}:\d{{2}}(:\d{{2}})?)?$') THEN 'date' ELSE 'string' END"
for _t in ("orders", "events"):
    add(
        f"cell_type_histogram_{_t}",
        lambda s, d, t=_t: profile.type_histogram(tab(s, d, t)),
        "SELECT header, type, count(*) AS cells FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS header, {_TYPE.format(text(c))} AS type FROM {_t}" for c in COLUMNS[_t]) + ") GROUP BY 1, 2",
    )
add(
    "profile_first_sample",
    lambda s, d: profile.column_profile(tab(s, d, "orders")).select("header", "sample", "filled", "type"),
    " UNION ALL ".join(
        rf"SELECT '{c}' AS header, arg_min({text(c)}, o_orderkey) AS sample, count(*) AS filled, CASE WHEN regexp_matches(arg_min({text(c)}, o_orderkey), '^[-+]?\d+(\.\d+)?$') THEN 'numeric' WHEN regexp_matches(arg_min({text(c)}, o_orderkey), '^\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}') THEN 'date' ELSE 'text' END AS type FROM orders"
        for c in COLUMNS["orders"]
    ),
)
add(
    "table_summary",
    lambda s, d: profile.summary([tab(s, d, n) for n in ("nation", "customer", "orders")]),
    " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, {len(COLUMNS[n])} AS columns, count(*) * {len(COLUMNS[n])} AS cells FROM {n}" for n in ("nation", "customer", "orders")),
)

# Cells and rows as text.
_RISKY = "CASE substr(c_mktsegment, 1, 1) WHEN 'B' THEN '=' WHEN 'M' THEN '+' WHEN 'F' THEN '-' WHEN 'H' THEN '@' ELSE '' END || c_name"
_SAFE = "CASE WHEN regexp_matches({0}, '^[=+@]') OR (starts_with({0}, '-') AND NOT regexp_matches({0}, '^-\\d+(\\.\\d+)?$')) THEN '''' || {0} ELSE {0} END"
add(
    "formula_protect",
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", C.formula_safe(F.expr(_RISKY)).alias("safe"), C.formula_safe(F.col("c_acctbal").cast("string")).alias("balance")),
    f"SELECT c_custkey, {_SAFE.format('(' + _RISKY + ')')} AS safe, {_SAFE.format(text('c_acctbal'))} AS balance FROM customer",
)


def document_table(s: SparkSession, d: str) -> Table:
    return Table.of(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text"), "documents", ["doc_id"])


def rendered(kind: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        t = document_table(s, d)
        return t.df.select(F.col("o0").alias("doc_id"), row_column(t, kind, t.cells).alias("line"))

    return query


_BREAKS = "regexp_replace(regexp_replace(coalesce({}, ''), '(<|&lt;)\\s*br\\s*/?\\s*(>|&gt;)', chr(10), 'gi'), '\\r\\n?', chr(10), 'g')"


def quoted(c: str, sep: str) -> str:
    safe = _SAFE.format(f"({_BREAKS.format(c)})")
    return f"CASE WHEN contains({safe}, {sep}) OR regexp_matches({safe}, '[\"\\r\\n]') THEN '\"' || replace({safe}, '\"', '\"\"') || '\"' ELSE {safe} END"


for _name, _sep in (("csv", "','"), ("tsv", "chr(9)")):
    add(f"{_name}_row_text", rendered(_name), f"SELECT doc_id, {f' || {_sep} || '.join(quoted(c, _sep) for c in (text('doc_id'), 'source', 'text'))} AS line FROM documents")
add(
    "markdown_widths",
    lambda s, d: widths(tab(s, d, "part"), "markdown"),
    "SELECT " + ", ".join(f"CAST(greatest(3, {len(c)}, max(length({text(c)}))) AS INTEGER) AS w{i}" for i, c in enumerate(COLUMNS["part"])) + " FROM part",
)


def ascii_rows(s: SparkSession, d: str) -> DataFrame:
    t = tab(s, d, "part")
    width = [int(w) for w in widths(t, "ascii").first()]
    return t.df.select(row_column(t, "ascii", t.cells, True, width).alias("line"))


add(
    "ascii_row_text",
    ascii_rows,
    "WITH w AS (SELECT " + ", ".join(f"greatest(3, {len(c)}, max(length({text(c)}))) AS w_{c}" for c in COLUMNS["part"]) + " FROM part) SELECT '| ' || " + " || ' | ' || ".join(f"rpad({text(c)}, CAST(w_{c} AS INTEGER), ' ')" for c in COLUMNS["part"]) + " || ' |' AS line FROM part, w",
)
add(
    "html_row_text",
    lambda s, d: (lambda t: t.df.select(row_column(t, "html", t.cells).alias("line")))(tab(s, d, "events")),
    "SELECT '<tr>' || " + " || ".join(f"'<td>' || replace(replace({text(c)}, '&', '&amp;'), '\"', '&quot;') || '</td>'" for c in COLUMNS["events"]) + " || '</tr>' AS line FROM events",
)
_LUA = r"""CASE WHEN regexp_matches({0}, '^-?(0|[1-9]\d*)$') OR regexp_matches({0}, '^-?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$') OR {0} IN ('true', 'false') THEN {0} ELSE '"' || replace(replace({0}, '\', '\\'), '"', '\"') || '"' END"""
add(
    "lua_literal",
    lambda s, d: (lambda t: t.df.select(row_column(t, "lua", t.cells).alias("line")))(tab(s, d, "events")),
    "SELECT " + " || ', ' || ".join(f"'[\"{c}\"] = ' || {_LUA.format(text(c))}" for c in COLUMNS["events"]) + " AS line FROM events",
)


def lua_files(s: SparkSession, d: str) -> DataFrame:
    """Customers written as a Lua table by the executors, read back line by line."""
    path = f"{shared_folder(s)}/lua-{uuid.uuid4().hex}"
    write_rendering(tab(s, d, "customer"), "lua", path)
    return s.read.text(path).select(F.col("value").alias("line"))


_FIELDS = ", ".join(f"'[\"{c}\"] = ' || {_LUA.format(text(c))} AS f{i}" for i, c in enumerate(COLUMNS["customer"]))
_LAST = len(COLUMNS["customer"]) - 1
add(
    "lua_files",
    lua_files,
    f"""WITH f AS (SELECT row_number() OVER (ORDER BY c_custkey) AS n, {_FIELDS} FROM customer),
    w AS (SELECT {", ".join(f"CAST(max(length(f{i})) + 2 AS INTEGER) AS w{i}" for i in range(_LAST))} FROM f)
    SELECT '    [' || CAST(n AS VARCHAR) || '] = {{ ' || {" || ".join(f"rpad(f{i} || ',', w{i}, ' ')" for i in range(_LAST))} || f{_LAST} || ' }},' AS line FROM f, w UNION ALL SELECT '{{' UNION ALL SELECT '}}'""",
)
_LONG = "CASE WHEN o_orderkey % 3 = 0 THEN '0' || CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey AS VARCHAR) || '12345678901234' ELSE CAST(o_totalprice AS VARCHAR) END"
add(
    "xlsx_number_safe",
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", C.number_safe(F.expr(_LONG.replace("VARCHAR", "STRING"))).alias("safe"), C.number_safe(F.col("o_orderpriority")).alias("word")),
    f"SELECT o_orderkey, NOT regexp_matches({_LONG}, '^0\\d+') AND length(regexp_replace(replace({_LONG}, '.', ''), '^0+', '')) <= 15 AS safe, false AS word FROM orders",
)
_XML = " || ".join(
    f"'<c t=\"n\"><v>' || {text(c)} || '</v></c>'" if c in ("o_orderkey", "o_custkey", "o_totalprice") else f"'<c t=\"inlineStr\"><is><t xml:space=\"preserve\">' || {text(c)} || '</t></is></c>'" for c in COLUMNS["orders"]
)
add(
    "xlsx_sheet_chunks",
    lambda s, d: sheet_chunks(tab(s, d, "orders")).select("sheet", "chunk", "n", "size"),
    f"""WITH x AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, strlen('<row>' || {_XML} || '</row>') AS size FROM orders)
    SELECT CAST(i // 41943 // 25 AS INTEGER) AS sheet, CAST(i // 41943 % 25 AS INTEGER) AS chunk, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM x GROUP BY 1, 2""",
)
add(
    "display_width",
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", C.display_width(F.concat(F.col("c_mktsegment"), F.expr("repeat('表', int(c_custkey % 4))"))).alias("width")),
    "SELECT c_custkey, CAST(length(c_mktsegment) + 2 * (c_custkey % 4) AS INTEGER) AS width FROM customer",
)
for _n, (_query, _sql) in (hard_texts.QUERIES | read_back.QUERIES).items():
    add(_n, _query, _sql)


# Texts of every format, parsed back.
def round_trip(fmt: str, detect: bool) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        rows, _ = parse_texts(customers_as(s, d, fmt), None if detect else fmt)
        first = 1 if fmt == "cli-table-data" else 0
        rows = rows.where("not is_header")
        return rows.select(F.col("doc_id").alias("doc"), "row", *[F.get("cells", F.lit(i + first)).alias(f) for i, f in enumerate(FIELDS)])

    return query


_DOC = f"CAST(c_custkey // {BLOCK} AS INTEGER)"
_PARSED = f"SELECT {_DOC} AS doc, CAST(row_number() OVER (PARTITION BY {_DOC} ORDER BY c_custkey) - 1 AS INTEGER) AS row, " + ", ".join(f"{text(c)} AS {f}" for c, f in zip(SOURCE, FIELDS)) + " FROM customer"
for _fmt in LAYOUTS:
    add(f"{_fmt.replace('-', '_')}_roundtrip", round_trip(_fmt, False), _PARSED)
for _fmt in ("csv", "pipe-table", "data-block", "html-table", "cli-multi-block"):
    add(f"{_fmt.replace('-', '_')}_detected", round_trip(_fmt, True), _PARSED)
_FORMATS = " UNION ALL ".join(f"SELECT '{f}' AS format" for f in LAYOUTS)
add(
    "sniff_format",
    lambda s, d: sniff(all_formats(s, d)).select("doc_id", "format"),
    f"SELECT DISTINCT format || '/' || CAST({_DOC} AS VARCHAR) AS doc_id, format FROM customer, ({_FORMATS})",
)
add(
    "header_inference",
    lambda s, d: parse_texts(customers_as(s, d, "csv"), "csv")[0].where("is_header").select(F.col("doc_id").alias("doc"), F.array_join("cells", ",").alias("header")),
    f"SELECT DISTINCT {_DOC} AS doc, '{','.join(FIELDS)}' AS header FROM customer",
)
add(
    "header_mode_none",
    lambda s, d: parse_texts(customers_as(s, d, "csv"), "csv", "none")[0].groupBy("is_header").agg(F.count("*").alias("n")),
    f"SELECT false AS is_header, count(*) + count(DISTINCT {_DOC}) AS n FROM customer",
)


def ragged(s: SparkSession, d: str) -> DataFrame:
    """Every customer text with one row too long and one open quote."""
    return customers_as(s, d, "csv").select("doc_id", F.concat("text", F.lit('\n1,2,3,4,5\n6,"7')).alias("text"))


add(
    "parse_diagnostics",
    lambda s, d: parse_texts(ragged(s, d), "csv")[1].groupBy("code").agg(F.count("*").alias("n")),
    f"""WITH n AS (SELECT count(DISTINCT {_DOC}) AS t, count(*) AS r FROM customer)
    SELECT 'ROW_WIDTH_MISMATCH' AS code, r + t AS n FROM n UNION ALL SELECT 'UNCLOSED_QUOTE', t FROM n""",
)
add(
    "parse_quality",
    lambda s, d: (lambda p: parse_quality(*p).select(F.col("doc_id").cast("int").alias("doc"), F.round("quality", 4).alias("quality")))(parse_texts(customers_as(s, d, "csv").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit('\n6,"7,8,9'))).otherwise(F.col("text"))), "csv")),
    f"SELECT DISTINCT {_DOC} AS doc, CAST(CASE WHEN {_DOC} % 2 = 0 THEN 0.66 ELSE 1 END AS DOUBLE) AS quality FROM customer",
)


add(
    "aligned_by_position",
    lambda s, d: parse_texts(shifted_customers(s, d), "aligned-table")[0].where(~F.col("is_header")).select("title", *[F.col("cells")[i].alias(n) for i, n in enumerate(("id", "segment", "name"))]),
    """SELECT 'Customers ' || CAST(c_custkey // 50 AS VARCHAR) AS title, CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
    CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN c_mktsegment || ' and several other words' ELSE c_mktsegment END AS segment FROM customer""",
)
add(
    "aligned_mismatches",
    lambda s, d: parse_texts(shifted_customers(s, d), "aligned-table")[1].groupBy("doc_id", "code").agg(F.count("*").alias("n")),
    "SELECT CAST(c_custkey // 50 AS VARCHAR) AS doc_id, 'ALIGNED_POSITION_MISMATCH' AS code, count(*) AS n FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 5 <> 0 GROUP BY 1",
)


# Streams.
def streamed(s: SparkSession, d: str) -> DataFrame:
    base = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    table = stream_table(s, d, "events.parquet", ["event_id"], "events")
    run_available(filtered_stream(table, Rules(filter="event_type=error|event_type=purchase value>20", focus=["event_id", "event_type", "value"])), f"{base}/out", f"{base}/state")
    return s.read.parquet(f"{base}/out").drop("_hl")


add("stream_rules", streamed, f"SELECT {cells('events', ['event_id', 'event_type', 'value'])} FROM events WHERE event_type IN ('error', 'purchase') AND value > 20")



def stream_joined(s: SparkSession, d: str) -> DataFrame:
    """Events as a stream, named by a chain of views over customers and nations that stay."""
    base = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    tables = {n: tab(s, d, n) for n in ("customer", "nation")} | {"events": stream_table(s, d, "events.parquet", ["event_id"], "events")}
    views = {
        "who": View("who", "events", "customer", "user_id=c_custkey", "inner", "event_id, event_type, right.c_name as name, right.c_nationkey"),
        "where": View("where", "who", "nation", "c_nationkey=n_nationkey", "left", "event_id, event_type, name, right.n_name as nation"),
    }
    run_available(filtered_stream(stream_view("where", tables, views), Rules(filter="event_type!=error")), f"{base}/out", f"{base}/state")
    return s.read.parquet(f"{base}/out").drop("_hl")


add(
    "stream_static_view", stream_joined,
    f"SELECT {text('event_id')} AS event_id, event_type, c_name AS name, coalesce(n_name, '') AS nation FROM events JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE lower(event_type) <> 'error'",
)

# A workspace's results: an edited and filtered table beside a view that takes the edit in.
def workspace_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace()
    work.put_view(View("big", "orders", "customer", "o_custkey=c_custkey", "inner", "o_orderkey, right.c_name, o_totalprice as total"))
    rules = {"customer": {"filter": "c_mktsegment=building", "focus": ["c_custkey", "c_name"]}, "JOIN:big": {"filter": "total>200000", "focus": ["o_orderkey", "c_name"]}}
    work.set_ui(displayTables=["customer"], enabledViews=["big"], rules=rules, cellEdits={"customer": {"0:1": "Edited"}})
    found = work.results([tab(spark, sf_dir, n) for n in ("orders", "customer")])
    one, two = [t.df.select(F.lit(t.name).alias("name"), F.col("_result_index").alias("place"), F.col("c0").alias("key"), F.col("c1").alias("value")) for t in found]
    return one.unionByName(two)


add(
    "workspace_results",
    workspace_results,
    f"""WITH c AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer) THEN 'Edited' ELSE c_name END AS c_name FROM customer)
    SELECT 'customer' AS name, row_number() OVER (ORDER BY c_custkey) - 1 AS place, {text('c_custkey')} AS key, c_name AS value FROM c WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT 'JOIN:big', row_number() OVER (ORDER BY o_orderkey) - 1, {text('o_orderkey')}, c_name FROM orders JOIN c ON o_custkey = c_custkey WHERE o_totalprice > 200000""",
)

# The flagship: a view, a rule on its output, focus, first page.
_FLAG = View("big", "orders", "customer", "o_custkey=c_custkey", "inner", "o_orderkey, right.c_name, o_totalprice as total, o_orderpriority")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = run_view(_FLAG, {n: tab(spark, sf_dir, n) for n in ("orders", "customer")}, {})
    kept = process(joined, Rules(filter="total>100000 o_orderpriority:urgent|o_orderpriority:high", focus=["o_orderkey", "c_name", "total"]))
    return page(kept, 1, 100)[0].public()


add(
    "flagship",
    flagship,
    f"SELECT {text('o_orderkey')} AS o_orderkey, c_name, {text('o_totalprice')} AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 AND regexp_matches(o_orderpriority, 'URGENT|HIGH') ORDER BY orders.o_orderkey LIMIT 100",
)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
