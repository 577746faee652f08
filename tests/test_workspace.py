"""Workspaces: documents, views, files, results."""

import json

import pytest
from test_tables import rows_of, table

from tablespark.operators.joins import View, in_source_order, outputs_of, saved_pairs, select_text, toggled, without_stale
from tablespark.operators.query import picker_order
from tablespark.operators.workspace import DEPTH, Workspace, is_safe, migrated


@pytest.fixture(scope="module")
def tables(spark):
    return [table(spark, "L", ["id", "v"], [("1", "a"), ("2", "b"), ("3", "a")]), table(spark, "R", ["id", "name"], [("2", "x"), ("3", "y")])]


def test_documents():
    events = []
    w = Workspace(lambda name, about: events.append(name))
    one = w.active
    assert one.title == "Analysis 1" and not w.remove(one.id)
    two = w.add(raw="a,b")
    assert two.title == "Analysis 2" and w.active is two
    two.ui["cellEdits"] = {"T": {"0:0": "x"}}
    three = w.duplicate(two.id)
    assert three.raw == "a,b" and three.ui["cellEdits"] == {} and three.title == "Analysis 2 (copy)"
    assert w.rename(one.id, " Analysis \n 2 ") and one.title == "Analysis 2 (2)" and not w.rename(one.id, " ")
    assert w.move(three.id, one.id) and w.docs[0] is three and not w.move(three.id, three.id)
    assert w.remove(three.id) and w.active is one and not w.activate("gone")
    assert "document:moved" in events


def test_sources():
    events = []
    w = Workspace(lambda name, about: events.append(name))
    doc = w.active
    began = w.replace_source("a,b\n1,2")
    doc.ui["cellEdits"] = {"T": {"0:0": "x"}}
    assert w.replace_source("a,b\n1,2") == began and doc.ui["cellEdits"]
    assert w.replace_source("a,b\n1,2", fmt="csv") == began + 1 and doc.ui["cellEdits"] == {}
    assert not w.parse_completed(doc.id, began) and events[-1] == "parse:stale" and doc.parsed is None
    assert w.parse_completed(doc.id, began + 1, format="csv") and doc.parsed["format"] == "csv"


def test_views():
    w = Workspace()
    assert w.import_views('[{"view": "a", "left": "L", "right": "R", "on": "id=id"}, {"view": "bad"}, 3]') == 1
    assert w.import_views('{"kind": "join-view", "view": {"view": "b", "left": "a", "right": "R"}}') == 1
    assert w.import_views('{"views": [{"view": "a", "left": "X", "right": "R"}]}', overwrite=False) == 1
    assert w.import_views('{"globalViews": [{"view": "b", "left": "Z", "right": "R"}]}') == 1
    assert w.import_views('{"view": "c", "left": "L", "right": "R"}') == 1 and w.import_views("{}") == 0
    assert list(w.views) == ["a", "b", "a_2", "c"] and w.views["b"].left == "Z" and w.views["a"].left == "L"
    assert [v.view for v in w.find_views("ID=")] == ["a"] and [v.view for v in w.find_views()] == ["a", "a_2", "b", "c"]
    w.put_view(View("d", "L", "R", "id=id"), old_name="a")
    assert list(w.views) == ["d", "b", "a_2", "c"] and w.remove_views(["b", "gone"]) == 1
    other = Workspace()
    assert other.import_views(w.export_views(["d", "c"])) == 2 and other.views == {n: w.views[n] for n in ("d", "c")}


def test_designer():
    left, right, outputs = ["id", "v"], ["id", "name"], outputs_of("right.name as n, left.v, left.gone")
    pairs, kept = without_stale(saved_pairs("id=id, old=name, x"), outputs, left, right)
    assert pairs == [("id", "id"), ("", "name"), ("", "")] and select_text(in_source_order(kept, left, right)) == "left.v, right.name as n"
    more = toggled(kept, "left", ["id", "v"], True)
    assert [o.column for o in more] == ["name", "v", "id"] and [o.column for o in toggled(more, "r", ["name"], False)] == ["v", "id"]
    assert picker_order(["a", "b", "c"], ["c", "z", "a"]) == [("c", True), ("a", True), ("b", False)]


def test_files(spark, tmp_path):
    w = Workspace()
    w.replace_source('x "quoted"\nand é')
    w.put_view(View("v", "L", "R", "id=id"))
    w.set_ui(globalFilter="a", rules={"L": {"filter": "v=a", "focus": ["v"]}}, columnFilters={"L": {"v": "a", "id": " "}})
    assert w.active.active_filters() == [("global", "", "a"), ("table", "L", "v=a"), ("column", "L.v", "a")]
    w.save(spark, f"{tmp_path}/w")
    got = Workspace()
    assert got.load(spark, f"{tmp_path}/w") == 1 and got.payload() == w.payload()
    w.preferences["persistRaw"] = False
    assert w.payload()["docs"][0]["raw"] == ""
    spark.createDataFrame([("{",)], "value string").write.mode("overwrite").text(f"{tmp_path}/w")
    with pytest.raises(ValueError):
        got.load(spark, f"{tmp_path}/w")
    with pytest.raises(RuntimeError):
        got.save(spark, f"{tmp_path}/w")
    assert got.payload()["globalViews"]


def test_imports():
    w = Workspace()
    mine = w.active
    given = {"kind": "ota-workspace", "docs": [{"id": mine.id, "title": mine.title}, {"title": "x" * 50, "raw": "r"}]}
    assert w.import_workspace(given, merge=True) == 2
    assert [d.title for d in w.docs] == ["Analysis 1", "Analysis 1 (2)", "x" * 40] and len({d.id for d in w.docs}) == 3
    before = w.payload()
    for bad in ({**given, "kind": "other"}, {**given, "docs": []}, {**given, "docs": [{}] * 101}, {**given, "schemaVersion": 21}, {**given, "docs": [{"ui": {"__proto__": 1}}]}, {**given, "docs": [{"raw": "x" * 14_000_000}]}):
        with pytest.raises(ValueError):
            w.import_workspace(bad)
    assert w.payload() == before and migrated({}) == {"schemaVersion": 20, "docs": [], "globalViews": []}
    deep = 1
    for _ in range(DEPTH):
        deep = [deep]
    assert is_safe(deep) and not is_safe([deep])
    config = json.loads(json.dumps(w.export_config()))
    config["docs"][0]["ui"]["globalFilter"] = "z"
    config["docs"].append({"title": "new", "ui": {}})
    assert w.import_config(config) == (3, ["new"]) and w.docs[0].ui["globalFilter"] == "z"
    assert w.import_config(config, create=True)[1] == ["new"] and w.docs[-1].title == "new"


def test_results(tables):
    w = Workspace()
    w.put_view(View("j", "L", "R", "id=id", "inner", "left.v, right.name"))
    w.set_ui(displayTables=["L"], enabledViews=["j", "gone"], rules={"L": {"filter": "v=a", "focus": ["v"]}, "JOIN:j": {"focus": ["name"]}}, cellEdits={"R": {"0:1": "edited"}, "L": {"1:1": "a", "x": "y"}})
    first = w.results(tables)
    assert [t.name for t in first] == ["L", "JOIN:j"] and rows_of(first[0]) == [("a",)] * 3 and rows_of(first[1]) == [("edited",), ("y",)]
    assert [r[0] for r in first[0].ordered().select("_result_index").collect()] == [0, 1, 2]
    assert w.results(tables) is first
    w.set_ui(globalFilter="b")
    assert w.results(tables) is not first and w.columns_of("j", tables) == ["v", "name"] and w.columns_of("none", tables) == []
    assert [len(rows_of(t)) for t in w.exported(tables, "raw")] == [3, 2]
    w.set_ui(exportOnlyChecked=True, exportCols="shown")
    full = w.exported(tables, "full")
    assert [t.headers for t in full] == [("v",), ("name",)] and [len(rows_of(t)) for t in full] == [3, 2]
    for i in range(9):
        w.set_ui(globalFilter=str(i))
        w.results(tables)
    assert len(w._cache) == 8
