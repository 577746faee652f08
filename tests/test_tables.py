"""Rules, joins, edits, pages and renderings on small tables."""

import itertools
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tablespark.functions import columns as C
from tablespark.functions.rules import compile_rule, tokens_of
from tablespark.operators.edits import Overlay
from tablespark.operators.joins import View, auto_match, dependencies, join_stats, resolve, ring, run_view, view_problems
from tablespark.operators.query import Rules, focus_columns, lua_selection, page, process, transpose, turn_back, turned_cells
from tablespark.operators.table import Table, unique_headers, unique_name
from tablespark.sinks.render import render, write_rendering
from tablespark.sinks.xlsx import crc_of_both, file_prefix, sheet_name, write_xlsx


def table(spark, name, headers, rows):
    df = spark.createDataFrame([(i, *map(str, r)) for i, r in enumerate(rows)], "o0 long, " + ", ".join(f"c{i} string" for i in range(len(headers))))
    return Table(name, tuple(headers), df)


def rows_of(t):
    return [tuple(r) for r in t.ordered().select(*t.cells).collect()]


@pytest.fixture(scope="module")
def logs(spark):
    return table(spark, "Logs", ["level", "message", "Count"], [("WARN", "disk a=b full", "12abc"), ("info", "ready", "-3.5"), ("Error", "fan stopped É", ""), ("warn", "x/y", "1e3"), ("", '"a b"', "0x10")])


def plain_rule(rule, headers, row):
    """The rule language read word by word, row by row."""
    text, by = " ".join(row), {h.lower(): c for h, c in zip(headers, row)}
    number = lambda s: float(m[1]) if (m := re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)", s.lower())) else None

    def one(t):
        if t == "":
            return True
        if t[0] == "!" and len(t) > 1:
            return not one(t[1:])
        if m := re.match(r"^(.+?)(!=|>=|<=|=|>|<|:)(.+)$", t):
            key, op, value = m.groups()
            if value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            if key.lower() not in by:
                return False
            cell, value = by[key.lower()].lower(), value.lower()
            if op in ("=", "!=", ":"):
                return {"=": cell == value, "!=": cell != value, ":": value in cell}[op]
            a, b = number(cell), number(value)
            return a is not None and b is not None and {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
        if t[0] == t[-1] == "/":
            try:
                return re.search(t[1:-1], text, re.I) is not None
            except re.error:
                return False
        return t.lower() in text.lower()

    return all(any(one(a) for a in ([t] if t[0] == t[-1] == "/" else t.split("|"))) for t in tokens_of(rule))


RULES = [
    "", "warn", "level=warn", "level!=warn", "level:AR", "count>0", "count<=-3.5", "count>=1000", "count>nope", "nope=1", "!nope=1", "/a=b/", "/w.rn/", "!/w|e/", "é", "disk full", '"a b"', 'level=""', "level=", "/", "/(/", "a|", "|",
    "level:warn|ready", "!level=warn count<5", "!", "x/y", "level='WARN'", "/ready$/", "/^warn/",
]


@pytest.mark.parametrize("rule", RULES)
def test_rules(logs, rule):
    got = rows_of(process(logs, Rules(filter=rule)))
    assert got == [r for r in rows_of(logs) if plain_rule(rule, logs.headers, r)]


def test_rules_in_pairs(logs):
    rows = rows_of(logs)
    pairs = list(itertools.product(RULES[1:12], RULES[12:20]))
    marks = logs.ordered().select(*[compile_rule(f"{a} {b}", list(logs.headers), logs.cells).alias(f"m{i}") for i, (a, b) in enumerate(pairs)]).collect()
    for r, m in zip(rows, marks):
        assert [bool(x) for x in m] == [plain_rule(f"{a} {b}", logs.headers, r) for a, b in pairs]


def test_long_patterns_match_nothing(logs):
    assert rows_of(process(logs, Rules(filter=f"/{'a?' * 101}/"))) == []


def test_focus_and_marks(logs):
    assert focus_columns(["a", "b", "c"], "c, a") == [2, 0] and focus_columns(["a", "b"], "a, b", strict=True) == [0] and focus_columns(["a"], ["z"]) == [0]
    marked = process(logs, Rules(highlight="level=warn", focus=["message", "message"]))
    assert marked.headers == ("message", "message") and [r["_hl"] for r in marked.ordered().collect()] == [True, False, False, True, False]
    assert rows_of(process(logs, Rules(), only_highlighted=True)) == []


def test_pages(logs):
    t, info = page(logs, 9, 2)
    assert info == {"page": 3, "pages": 3, "rows": 5} and len(rows_of(t)) == 1
    assert page(process(logs, Rules(filter="nope=1")))[1] == {"page": 1, "pages": 1, "rows": 0}
    turned = transpose(page(logs, 1, 2)[0])
    assert turned.columns == ["field", "Row 1", "Row 2"] and [tuple(r) for r in turned.collect()][0] == ("level", "WARN", "info")


@pytest.fixture(scope="module")
def sides(spark):
    return {"L": table(spark, "L", ["id", "value"], [("1", "a"), ("2", ""), ("2", "c"), ("", "d")]), "R": table(spark, "R", ["id", "name"], [("2", "x"), ("2", "y"), ("3", "z"), ("", "e")])}


@pytest.mark.parametrize(
    "kind, want",
    [
        ("inner", [("2", "", "x"), ("2", "", "y"), ("2", "c", "x"), ("2", "c", "y"), ("", "d", "e")]),
        ("left", [("1", "a", ""), ("2", "", "x"), ("2", "", "y"), ("2", "c", "x"), ("2", "c", "y"), ("", "d", "e")]),
        ("right", [("2", "", "x"), ("2", "", "y"), ("2", "c", "x"), ("2", "c", "y"), ("", "d", "e"), ("", "", "z")]),
        ("full", [("1", "a", ""), ("2", "", "x"), ("2", "", "y"), ("2", "c", "x"), ("2", "c", "y"), ("", "d", "e"), ("", "", "z")]),
        ("semi", [("2", "", "x"), ("2", "c", "x"), ("", "d", "e")]),
        ("anti", [("1", "a", "")]),
    ],
)
def test_joins(sides, kind, want):
    got = run_view(View("v", "L", "R", "id=id", kind, "left.id, value, right.name"), sides, {})
    assert rows_of(got) == want and got.name == "JOIN:v" and got.read_only


def test_views(sides, spark):
    views = {"a": View("a", "L", "b", "id=id"), "b": View("b", "a", "R", "id=id")}
    assert ring(views) and resolve("a", sides, views) is None and dependencies("a", views)[0] == "a"
    assert run_view(View("v", "L", "R", "id=gone"), sides, {}) is None and run_view(View("v", "L", "Z", "id=id"), sides, {}) is None
    got = join_stats(sides["L"], sides["R"], "id=id").first().asDict()
    assert got == {"left_rows": 4, "right_rows": 4, "matched_pairs": 5, "left_only": 1, "right_only": 1, "rows_inner": 5, "rows_left": 6, "rows_right": 6, "rows_full": 7, "rows_semi": 3, "rows_anti": 1}
    assert auto_match(["User_ID", "x"], ["userid", "X"]) == [("x", "X")] and auto_match(["User_ID"], ["user id"]) == [("User_ID", "user id")]
    errors, warnings = view_problems(View("v", "L", "R", "id=id, q=r", "inner", "id, right.id, right.gone"), sides, {})
    assert errors == [] and len(warnings) == 3
    keys = {"A": table(spark, "A", ["a", "b"], [("x|||y", "z")]), "B": table(spark, "B", ["x", "y"], [("x", "y|||z")])}
    assert rows_of(run_view(View("v", "A", "B", "a=x,b=y"), keys, {})) == []


def test_edits(logs):
    over = Overlay()
    assert over.edit(logs, 1, 1, "done") and not over.edit(logs, 1, 1, "done") and not over.edit(logs, 99, 0, "x") and not over.edit(logs, 0, 9, "x")
    assert over.edit(logs, 1, 1, "again") and rows_of(over.apply(logs))[1][1] == "again"
    assert over.undo() and rows_of(over.apply(logs))[1][1] == "done" and over.undo() and rows_of(over.apply(logs)) == rows_of(logs)
    assert over.redo() and over.redo() and not over.redo() and rows_of(over.apply(logs))[1][1] == "again"
    many = Overlay()
    for i in range(250):
        many.edit(logs, i, 0, f"v{i}", old="")
    assert [r[0] for r in rows_of(many.apply(logs))] == [f"v{i}" for i in range(5)] and len(many.done) == 100


def test_names():
    assert unique_headers(["id", "", "ID", "id_2", " x "]) == ["id", "Column2", "ID_2", "id_2", "x"]
    used = set()
    assert [unique_name("t", used) for _ in range(3)] == ["t", "t_2", "t_3"]
    used = set()
    assert [sheet_name(n, used) for n in ("a/b:*", "ab", "x" * 40, "x" * 40)] == ["ab", "ab_2", "x" * 31, "x" * 29 + "_2"]
    assert file_prefix(' a b/"c" ') == "a_b_c"


def test_renderings(spark):
    t = table(spark, "t", ["id", "note"], [("1", 'a,"b"'), ("=2", "x\ny|z")])
    assert render(t, "csv") == 'id,note\n1,"a,""b"""\n\'=2,"x\ny|z"'
    assert render(t, "tsv", header=False, protect=False) == '1\t"a,""b"""\n=2\t"x\ny|z"'
    assert render(t, "markdown") == '| id  | note       |\n| --- | ---------- |\n| 1   | a,"b"      |\n| \'=2 | x<br>y\\|z  |'.replace("y\\|z  |", "y\\|z |").replace('a,"b"      |', 'a,"b"     |').replace("note       |", "note      |").replace("---------- |", "--------- |")
    assert render(t, "ascii").split("\n")[3:5] == ['| 1   | a,"b" |', "| '=2 | x y|z |"]
    assert "<td>a,&quot;b&quot;</td>" in render(t, "html") and "<th>id</th>" in render(t, "html")
    assert render(table(spark, "t", ["k"], [("007",), ("0x0",), ("-4.50",), ("true",), ('q"\n',)]), "lua").split("\n")[1:-1] == ['    [1] = { ["k"] = "007" },', '    [2] = { ["k"] = 0 },', '    [3] = { ["k"] = -4.50 },', '    [4] = { ["k"] = true },', '    [5] = { ["k"] = "q\\"\\n" },']
    assert render(t.with_df(t.df.where("false")), "lua") == "{}"


@pytest.mark.parametrize(("kind", "options"), [("csv", {}), ("markdown", {}), ("ascii", {"header": False}), ("html", {}), ("lua", {}), ("lua", {"layout": "expanded"})])
def test_written_renderings(spark, tmp_path, kind, options):
    t = table(spark, "t", ["id", "note"], [(i, "x" * (i % 7) + '"' * (i % 3)) for i in range(40)])
    for name, part in (("rows", t.with_df(t.df.repartition(5))), ("none", t.with_df(t.df.where("false")))):
        write_rendering(part, kind, str(tmp_path / name), **options)
        assert "".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*"))) == render(part, kind, **options) + "\n"


def test_workbook(spark, tmp_path):
    t = table(spark, "a/b", ["n"], [("123456789012345",), ("1234567890123456",), ("007",), ("-0.5",), ("<&>",), ("12e3",)])
    assert write_xlsx([t, t], str(tmp_path / "w.xlsx")) == ["ab", "ab_2"]
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        cells = [(c.get("t"), "".join(c.itertext())) for c in ElementTree.fromstring(z.read("xl/worksheets/sheet2.xml")).iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}c")]
    assert cells == [("inlineStr", "n"), ("n", "123456789012345"), ("inlineStr", "1234567890123456"), ("inlineStr", "007"), ("n", "-0.5"), ("inlineStr", "<&>"), ("n", "12e3")]


def test_workbook_of_many_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tablespark.sinks.xlsx.CHUNK", 7)
    monkeypatch.setattr("tablespark.sinks.xlsx.SHEET", 35)
    rows = [(i, f"é<{i}>&") for i in range(100)]
    t = table(spark, "big", ["n", "t"], rows).with_df(table(spark, "big", ["n", "t"], rows).df.repartition(5))
    for path in (str(tmp_path / "w.xlsx"), f"file://{tmp_path}/v.xlsx"):
        assert write_xlsx([t, t.with_df(t.df.where("false"), name="none")], path) == ["big", "big_2", "big_3", "none"]
    assert (tmp_path / "w.xlsx").read_bytes()[:2] == b"PK" and not list(tmp_path.glob("*.part"))
    for name in ("w.xlsx", "v.xlsx"):
        with zipfile.ZipFile(tmp_path / name) as z:
            assert z.testzip() is None and len(z.namelist()) == 8
            found = [["".join(c.itertext()) for c in r] for k in (1, 2, 3) for r in list(ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml"))[0])[1:]]
            assert found == [[str(i), x] for i, x in rows] and len(ElementTree.fromstring(z.read("xl/worksheets/sheet4.xml"))[0]) == 1
    with pytest.raises(Exception, match="gone"):
        write_xlsx([t.with_df(t.df.withColumn("c0", F.raise_error(F.lit("gone")).cast("string")))], str(tmp_path / "x.xlsx"))
    assert not (tmp_path / "x.xlsx").exists()


def test_checksums_of_stretches():
    a, b = b"first part" * 1000, bytes(range(256)) * 9000
    assert crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b) and crc_of_both(5, 0, 0) == 5


def test_turned_pages(logs):
    turned = transpose(page(logs, 1, 50)[0])
    assert turned.columns == ["field"] + [f"Row {i}" for i in range(1, 6)] and [r[0] for r in turned.collect()] == list(logs.headers)
    back = turn_back(turned)
    assert back.headers == logs.headers and rows_of(back) == rows_of(logs)
    assert [tuple(r) for r in transpose(logs.with_df(logs.df.where("false"))).collect()] == [(h,) for h in logs.headers]
    assert rows_of(lua_selection(logs, (0, 1), (1, 2), turned=True)) == [("info", "ready"), ("Error", "fan stopped É")] and lua_selection(logs, (0, 1), (1, 2)).headers == ("message", "Count")
    assert {tuple(r) for r in turned_cells(logs).where("field = 2").collect()} == {(2, "Count", i, r[2]) for i, r in enumerate(rows_of(logs))}


def test_cells(spark):
    values = ["", "是", "-1.5e3", "+1", "2024-1-2 3:04", "x", "No"]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert [r[0] for r in df.select(C.cell_type(F.col("c"))).collect()] == ["empty", "boolean", "number", "string", "date", "string", "boolean"]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(C.leading_number(F.lit(" -40.00dbm"))) == -40.0 and one(C.leading_number(F.lit("abc"))) is None
    assert one(C.formula_safe(F.lit("a<br>b"))) == "a\nb" and one(C.display_width(F.lit("表a"))) == 3
