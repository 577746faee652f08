"""Detection by trying, and single texts taken in."""

from tablespark.sources.clipboard import parse_pasted, with_markup
from tablespark.sources.ingest import import_text, probed
from tablespark.sources.sniff import sniff
from tablespark.sources.text import text_stats


def test_the_better_parse_wins(spark):
    # Commas and semicolons score alike, and commas come first; but they cut the lines unevenly.
    uneven = "\n".join(f"n{i}, x{', y' if i % 5 == 0 else ''};{i}" for i in range(20))
    docs = spark.createDataFrame([("uneven", uneven), ("plain", "a b\n1 2\n3 4"), ("html", "<table><tr><td>1</td></tr></table>"), ("blank", " \n"), ("null", None), ("csv", "id,name\n1,x\n2,y")], "doc_id string, text string")
    first = {r["doc_id"]: r["format"] for r in sniff(docs).collect()}
    found = {r["doc_id"]: r["format"] for r in probed(docs).collect()}
    assert first["uneven"] == "csv" and found == {**first, "uneven": "semicolon-csv", "blank": "plain-text", "null": "plain-text"}
    assert probed(docs.limit(0)).count() == 0


def test_one_text(spark):
    got = import_text(spark, 'id,name\n1,x\n2,y,z\n"3')
    assert got.format == "csv" and [t.headers for t in got.tables] == [("id", "name", "Column3")] and got.candidates[0][0] == "csv"
    assert [d[0] for d in got.diagnostics].count("UNCLOSED_QUOTE") == 1 and ("ROW_WIDTH_MISMATCH", 0, 1) in got.diagnostics
    blank = import_text(spark, None)
    assert (blank.tables, blank.format, blank.diagnostics) == ([], "empty", [("EMPTY_INPUT", None, None)])
    assert import_text(spark, "a", fmt="nonsense").diagnostics == [("PARSE_ERROR", None, None)]
    assert import_text(spark, "x" * 14_000_000).format == "error"


def test_broken_sections(spark):
    rule, under = "=" * 12, "-" * 12
    text = "\n".join(["One:", rule, "A    B", under, "1    2", "", "Two", rule, "no rule", "", "Three", rule, under, "1", "", "Four", rule, "A   B", under, "", "Five", rule, "     B", under, "x    y"])
    got = import_text(spark, text, "cli-multi-block")
    assert [t.name for t in got.tables] == ["One", "Five"] and got.tables[1].headers == ("Column1", "B")
    assert [d[0] for d in got.diagnostics] == ["MISSING_SEPARATOR", "MISSING_HEADER", "EMPTY_TABLE_BLOCK", "MISSING_FIRST_HEADER"]


def test_sections_by_places_and_gaps(spark):
    text = "\n".join(["Wide", "=" * 20, "A     B     C", "-" * 20, "1     wide value     2     overflow", "", "Short", "=" * 20, "Id Key  Name", "-" * 20, "1  ab   x", "2  cd   y z", "   9", "表 ef   w"])
    got = import_text(spark, text, "cli-multi-block")
    rows = [[tuple(r) for r in t.ordered().select(*t.cells).collect()] for t in got.tables]
    assert rows == [[("1", "wide value", "2", "overflow")], [("1", "ab", "x"), ("2", "cd", "y z"), ("", "9", ""), ("表", "ef", "w")]]
    assert sorted(d[0] for d in got.diagnostics) == ["POSITION_MISMATCH", "ROW_WIDTH_MISMATCH", "ROW_WIDTH_MISMATCH"]


def test_pasted_markup(spark):
    table = "<table><tr><td>1</td></tr></table>"
    docs = spark.createDataFrame([(1, "a \n"), (2, "b"), (3, None), (4, "d"), (5, "e")], "doc_id int, text string")
    pastes = spark.createDataFrame([(1, 1, "old", table), (1, 2, "a", table), (2, 1, "b", table), (2, 2, "c", table), (3, 1, None, table), (4, 1, "d", "<p>x"), (9, 1, "a", table), (5, 1, "e", None)], "doc_id int, at int, plain string, html string")
    got = {r["doc_id"]: (r["text"], r["markup"]) for r in with_markup(docs, pastes).collect()}
    assert got == {1: (table, True), 2: ("b", False), 3: (table, True), 4: ("d", False), 5: ("e", False)}
    rows = [(r["doc_id"], r["format"], r["cells"]) for r in parse_pasted(docs, pastes)[0].orderBy("doc_id").collect()]
    assert rows[0] == (1, "html-table", ["1"]) and [r[0] for r in rows] == [1, 2, 3, 4, 5] and parse_pasted(docs.limit(0), pastes)[0].count() == 0


def test_sizes(spark):
    docs = spark.createDataFrame([(1, None), (2, "a\nb"), (3, "🙂" * 128), (4, "x" * 3_000_000), (5, "x" * 563)], "doc_id int, text string")
    assert [tuple(r)[1:] for r in text_stats(docs).orderBy("doc_id").collect()] == [(0, 0, "0 B"), (3, 2, "6 B"), (256, 1, "512 B"), (3_000_000, 1, "5.7 MB"), (563, 1, "1.1 KB")]


def test_texts_and_pastes_are_put_together_once(spark):
    """What is drawn for a text is drawn once, whatever the number of steps that detection and parsers take."""
    drawn = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            drawn.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(i, f"id,name\n{i},x\n{i + 1},y") for i in range(8)], "doc_id int, text string").mapInArrow(counted, "doc_id int, text string")
    pastes = spark.createDataFrame([(0, 1, "old", "<table><tr><td>1")], "doc_id int, at int, plain string, html string")
    assert parse_pasted(docs, pastes)[0].where("not is_header").count() == 16 and drawn.value == 8
