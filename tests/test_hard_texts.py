"""Readable text of markup, spans, and data blocks with faults."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tablespark.functions.columns import trim_all
from tablespark.functions.markup import html_text, html_texts, readable
from tablespark.sources.data_block import data_block, data_block_problems
from tablespark.sources.ingest import parse_text
from tablespark.sources.parsers import html_table

CELLS = [
    ("first<br>second<BR/>third<br />fourth&lt;br&gt;fifth", "first\nsecond\nthird\nfourth\nfifth"),
    ("<div>first</div><p>second <strong>line</strong></p><ul><li>third</li><li>fourth</li></ul>", "first\nsecond line\nthird\nfourth"),
    ("\n  line 1  \r\n\t line 2 \n", "line 1\nline 2"),
    ("<pre>  line 1\n    line 2</pre>", "line 1\n    line 2"),
    ("&nbsp;A &amp; B &lt;div&gt;literal&lt;/div&gt; &#x4e2d;&#25991;", "A & B <div>literal</div> 中文"),
    ("<br>first<br><br>third<br>", "first\n\nthird"),
    ("a<pre> b\n  &lt;br&gt; c </pre> d", "a\n b\n  <br> c \n d"),
    ("a<script>if(x) y</script>b<style>c</style><template><p>d</p></template>e", "abe"),
    ('<a title="x > y" href=\'>\'>in</a>side', "inside"),
    ("1 < 2 and <b unclosed", "1 < 2 and <b unclosed"),
    ("<!-- gone <p> -->kept<!-- open", "kept"),
    ("</pre></script>plain  text", "plain text"),
    ("<!DOCTYPE html>t", "<!DOCTYPE html>t"),
    ("&#xD800;&#1114112;&#99999999999999;&bogus;&AMP;&#39;", "&#xD800;&#1114112;&#99999999999999;&bogus;&'"),
    ("<p/>a<hr>b<img src=x>c", "a\nbc"),
    ("plain   cell", "plain cell"), ("", ""), (None, ""), ("<td> x </td>", "x"),
]


def test_text_of_cells(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CELLS)], "i int, c string")
    got = {r["i"]: r["t"] for r in df.select("i", html_text(F.col("c")).alias("t")).collect()}
    assert [got[i] for i in range(len(CELLS))] == [w for _, w in CELLS]
    assert df.where("false").select(html_text(F.col("c"))).collect() == []


def test_long_markup_takes_linear_time(spark):
    long = "<div><b>word</b> &amp; " * 60_000 + '<a href="'
    got = spark.createDataFrame([(long,)], "c string").select(html_text(F.col("c")).alias("t")).first()["t"]
    assert got.startswith("word &\nword &") and got.endswith('<a href="')


def test_spans(spark):
    html = '<table><tr><th>g</th><th>d</th><th>n</th></tr><tr><td rowspan="2" colspan="2">A<p>x</td><td>Alice</td></tr><tr><td>Bob</td></tr></table>'
    table = parse_text(spark, html)[0][0]
    assert [tuple(r) for r in table.ordered().select(*table.cells).collect()] == [("A\nx", "", "Alice"), ("A\nx", "", "Bob")]


# A plain reader of data blocks: every mark by hand.
def skip_quoted(t, i):
    m = re.compile(r'"(?:\\.|[^"\\])*(?:"|\\?\Z)', re.S).match(t, i)
    return m.end()


def find(t, i, marks):
    while i < len(t) and t[i] not in marks:
        i = skip_quoted(t, i) if t[i] == '"' else i + 1
    return i


def test_cells_in_and_outside_python(spark):
    """Bare cells are read by expressions, others by `readable`: both give the same."""
    cells = ["<td>a", "<TH class=x > a\t b\r\n c \n\n", "<td>\u00a0 1 > 2 \" ' ", "<td/>x", "<td-x>y", "<td>", "<td", "<td title='>'>q", "<td>&amp;", "<td><b>z</b>", "<td>a\r", "<td x\n>two\n"]
    rows = [(i, [c]) for i, c in enumerate(cells)] + [(99, cells), (98, []), (97, None)]
    got = dict(spark.createDataFrame(rows, "i int, c array<string>").select("i", html_texts(F.col("c"))).collect())
    want = spark.createDataFrame([(i, readable(c)) for i, c in enumerate(cells)], "i int, t string").select(trim_all(F.col("t")), "i").collect()
    assert [got[i] for _, i in want] == [[t] for t, _ in want] and got[99] == [t for t, _ in sorted(want, key=lambda w: w[1])] and got[98] == got[97] == []


@pytest.mark.parametrize("span", ["", ' rowspan="1"'])
def test_large_tables_cost_as_much_as_many_small_ones(spark, span):
    row = lambda i: f"<tr><td{span}>{i}</td><td><b>x</b></td></tr>"
    one = [(0, "<table>" + "".join(map(row, range(4000))) + "</table>")]
    many = [(k, "<table>" + "".join(map(row, range(40 * k, 40 * k + 40))) + "</table>") for k in range(100)]
    times = []
    for texts in (many, many, one):
        start = time.monotonic()
        got = html_table(spark.createDataFrame(texts, "doc_id int, text string")).select("row", "cells").collect()
        times.append(time.monotonic() - start)
        assert sorted(int(r["cells"][0]) for r in got) == list(range(4000)) and {r["cells"][1] for r in got} == {"x"}
    assert [int(r["cells"][0]) for r in sorted(got)] == list(range(4000)) and times[2] < 8 * times[1] + 4


def plain_blocks(t):
    i, blocks = 0, []
    while i < len(t):
        m = re.compile(r"data\s+([A-Za-z0-9_][A-Za-z0-9_$]*)\s*\[").match(t, i)
        if t[i] == '"':
            i = skip_quoted(t, i)
        elif m and not (i and re.match(r"[A-Za-z0-9_$]", t[i - 1])):
            end = find(t, m.end(), "]")
            blocks.append((m[1], t[m.end() : end], end < len(t)))
            i = end + 1
        else:
            i += 1
    return blocks


def plain_record(b):
    i, fields, codes = 0, {}, []
    while True:
        while i < len(b) and b[i] in " \n\t,":
            i += 1
        if i >= len(b):
            return fields, codes
        m = re.compile(r"([A-Za-z0-9_][A-Za-z0-9_$]*)\s*:\s*").match(b, i)
        if not m:
            codes.append("MISSING_COLON")
            i = find(b, i, ",")
        elif b[m.end() : m.end() + 1] == '"':
            end = skip_quoted(b, m.end())
            whole = re.fullmatch(r'"(?:\\.|[^"\\])*"', b[m.end() : end], re.S)
            raw = b[m.end() + 1 : end - 1] if whole else re.sub(r"(?<!\\)((?:\\\\)*)\\$", r"\1", b[m.end() + 1 : end])
            fields[m[1]] = re.sub(r"\\(.)", lambda e: {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\"}.get(e[1], e[0]), raw, flags=re.S)
            if not whole:
                return fields, [*codes, "UNCLOSED_QUOTE"]
            i = end
        else:
            end = find(b, m.end(), ",")
            fields[m[1]] = b[m.end() : end].strip()
            i = end


def plain_parse(t):
    tables, codes = [], []
    for name, body, closed in plain_blocks(t):
        i, rows = 0, []
        while (i := body.find("{", i)) >= 0:
            end = find(body, i + 1, "{}")
            complete = body[end : end + 1] == "}"
            fields, found = plain_record(body[i + 1 : end])
            codes += found + [] if complete else [*found, "UNMATCHED_BRACE"]
            if complete or fields:
                rows.append(fields)
            i = end + complete
        keys = list(dict.fromkeys(k for r in rows for k in r))
        tables.append((name, [keys, *[[r.get(k, "") for k in keys] for r in rows]]))
        codes += ([] if closed else ["UNCLOSED_DATA_BLOCK"]) + (["NO_DATA_RECORDS"] if not rows and body.strip() else [])
    return tables, sorted(codes if tables else ["NO_DATA_BLOCK"])


KNOWN = [
    'module MALL;\n\ndata First [\n {id : "0x01", name : "Alice", note : "a, b"},\n {id : "0x02", name : "Bob"}\n]\ndata Second [{id:"0x01", category:ELECTRONICS},{id:"0x03", category:"HOME"}]',
    'data Empty [] data Messages [{text:"say \\"hello\\"", path:"a/b"},{text:"next"}]', 'data Broken [{id "1", name:"ok"},{id:"2"', "module MALL;", 'data B [{id:"1"]', 'data B [{}, {a}, {b:1 {c:2]', '"data B [{a:1}]',
    'data B [{a:"x" b:"y", a:z}] metadata C [{a:1}] data$ D [{a:1}] data 9x$ [{q:"\\\\n\\t\\q"}]', 'data B [{a:"open}, {b:2}]', 'data B [ nothing ]', "", None,
]


def test_blocks_with_faults(spark):
    random.seed(4)
    marks = ["data T [", "data ", "{", "}", "]", "[", '"', '\\"', "\\", ":", ",", " ", "a:", 'b:"x"', "k", "$", "\n", "c : d", "{a:1}", '{a:"q"},']
    texts = KNOWN + ["data R [" * (i % 2) + "".join(random.choices(marks, k=random.randint(1, 25))) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows, found = {}, {}
    for r in data_block(docs).orderBy("doc_id", "tab", "row").collect():
        rows.setdefault(r["doc_id"], {}).setdefault((r["tab"], r["title"]), []).append(list(r["cells"]))
    for r in data_block_problems(docs).collect():
        found.setdefault(r["doc_id"], []).append(r["code"])
    for i, t in enumerate(texts):
        tables, codes = plain_parse(t or "")
        assert [(k[1], v) for k, v in sorted(rows.get(i, {}).items())] == tables, repr(t)
        assert sorted(found.get(i, [])) == codes, repr(t)


@pytest.mark.parametrize("text", [KNOWN[2], KNOWN[3]])
def test_faults_are_reported(spark, text):
    tables, codes = parse_text(spark, text, "data-block")
    assert (len(tables), codes) == ((1, ["MISSING_COLON", "UNCLOSED_DATA_BLOCK", "UNMATCHED_BRACE"]) if "Broken" in text else (0, ["NO_DATA_BLOCK"]))
