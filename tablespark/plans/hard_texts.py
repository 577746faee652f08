"""Queries over texts that are hard to read: markup with blocks, spans and entities, and data blocks with faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import BLOCKS, SKIPPED, html_text
from ..sources.clipboard import parse_pasted
from ..sources.ingest import parse_texts
from ..sources.text import text_stats


def _paged(spark: SparkSession, sf_dir: str, line: Column, size: int = 40) -> DataFrame:
    """doc_id and lines: one row for each `size` keys of the customers, lines in the order of the keys."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.floor(F.col("c_custkey") / size).alias("doc_id"), F.struct(F.col("c_custkey").alias("k"), line.alias("line")).alias("r"))
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]).alias("lines"))


def spanned_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: HTML tables in which two customers share a segment cell and one has a cell over two columns, with
    blocks, inline elements, preserved text, scripts, comments and entities in the cells."""
    key, name = F.col("c_custkey").cast("string"), F.col("c_name")
    first = F.concat(F.lit('<tr><td rowspan="2">'), "c_mktsegment", F.lit("</td><td>"), key, F.lit("</td><td colspan=2><div>"), name, F.lit("</div>x <i>y</i><BR/>z<pre>  p\n    q</pre></td></tr>"))
    rest = "&gt;&nbsp; &#x4e2d;&#25991; &amp;amp;<script>var a = 1;</script><!-- c > d -->!</td><td>a &lt;br&gt; b<ul><li>c</li><li>d</li></ul></td></tr>"
    second = F.concat(F.lit("<tr><td>"), key, F.lit('</td><td title="a>b">&lt;'), name, F.lit(rest))
    pages = _paged(spark, sf_dir, F.when(F.col("c_custkey") % 2 == 0, first).otherwise(second))
    top = F.lit("<p>Report</p><table summary='Pairs'><tr><th>segment</th><th>id</th><th>note</th><th>more</th></tr>")
    return pages.select("doc_id", F.concat(top, F.array_join("lines", "\n"), F.lit("</table>")).alias("text"))


def broken_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: data blocks whose records lack colons (every seventh key) or braces (every eleventh), whose ends
    are missing in several ways, and texts that hold no block at all."""
    key = F.col("c_custkey")
    colon = F.when(key % 7 == 0, F.lit(" ")).otherwise(F.lit(": "))
    brace = F.when(key % 11 == 0, F.lit("")).otherwise(F.lit("},"))
    second = F.when(key % 5 == 0, F.lit("balance:7")).otherwise(F.lit('seg"ment"'))
    line = F.concat(F.lit("  {id: "), key.cast("string"), F.lit(", "), second, F.lit(" , name"), colon, F.lit('"'), F.col("c_name"), F.lit(' \\"}\\n" '), brace)
    kind = F.col("doc_id") % 5
    end = F.when(kind == 1, "").when(kind == 2, '{id: "never closed').when(kind == 3, '] data Other [ nothing, here ] "data Quoted [{a:1}]"').otherwise("]")
    text = F.concat(F.lit("module M;\ndata Customers [\n"), F.array_join("lines", "\n"), end)
    return _paged(spark, sf_dir, line).select("doc_id", F.when(kind == 4, F.replace(text, F.lit("data "), F.lit("dates "))).otherwise(text).alias("text"))


_BLOCKS = ", ".join(f"'{b}'" for b in sorted(BLOCKS))
_OPEN = (*SKIPPED, "pre")
_SPACE = r"\t\f\v\r \x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_DELTA = ", ".join(f"CASE WHEN note OR tag <> '{x}' OR (NOT ends AND regexp_matches(tok, '/\\s*>$')) THEN 0 WHEN ends THEN -1 ELSE 1 END AS d_{x}" for x in _OPEN)
_SUMS = ", ".join(f"coalesce(sum(d_{x}) OVER b, 0) AS s_{x}" for x in _OPEN)
_HELD = ", ".join(f"s_{x} - least(0, min(s_{x}) OVER b) AS o_{x}" for x in _OPEN)
#: Tokens; open elements by running counts that don't fall below zero; pieces without doubled edges; runs of pieces that are kept or not.
READABLE = rf"""WITH l AS (SELECT page_id, regexp_extract_all(CAST(html AS VARCHAR), '(?s)<!--.*?(?:-->|\z)|<(?:[^"''>]|"[^"]*"|''[^'']*'')*>|[^<]+|<.*') AS toks FROM pages),
t AS (SELECT page_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM l),
n AS (SELECT *, starts_with(tok, '<!--') AS note, lower(regexp_extract(tok, '(?s)^<\s*(/?)\s*([A-Za-z][A-Za-z0-9_:-]*).*>$', 2)) AS tag, regexp_extract(tok, '(?s)^<\s*(/?)\s*([A-Za-z][A-Za-z0-9_:-]*).*>$', 1) = '/' AS ends FROM t),
d AS (SELECT *, {_DELTA} FROM n),
s AS (SELECT *, {_SUMS} FROM d WINDOW b AS (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, {_HELD} FROM s WINDOW b AS (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
p AS (SELECT page_id, i, o_pre > 0 AS kept, tag IN ({_BLOCKS}) AS edge, CASE WHEN tag = 'br' THEN CASE WHEN ends THEN '' ELSE chr(10) END WHEN tag IN ({_BLOCKS}) THEN chr(10) WHEN tag <> '' THEN ''
  ELSE replace(replace(replace(replace(replace(replace(tok, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') END AS piece FROM m WHERE NOT note AND o_script + o_style + o_template = 0),
q AS (SELECT *, lag(piece) OVER w AS last, lag(kept) OVER w AS was FROM p WHERE piece <> '' WINDOW w AS (PARTITION BY page_id ORDER BY i)),
r AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> kept THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM q),
c AS (SELECT page_id, run, any_value(kept) AS kept, replace(replace(string_agg(piece, '' ORDER BY i), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS x FROM r WHERE NOT coalesce(edge AND was = kept AND ends_with(last, chr(10)), false) GROUP BY 1, 2),
e AS (SELECT page_id, run, CASE WHEN kept THEN x ELSE regexp_replace(regexp_replace(x, '[{_SPACE}]+', ' ', 'g'), ' *\n *', chr(10), 'g') END AS x FROM c),
f AS (SELECT page_id, regexp_replace(string_agg(x, '' ORDER BY run), '^[\n{_SPACE}]+|[\n{_SPACE}]+$', '', 'g') AS x FROM e GROUP BY 1)
SELECT pages.page_id, coalesce(x, '') AS text FROM pages LEFT JOIN f ON pages.page_id = f.page_id"""


def html_cell_text(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", html_text(F.col("html").cast("string")).alias("text"))


def html_spans(s: SparkSession, d: str) -> DataFrame:
    rows = parse_texts(spanned_customers(s, d), "html-table")[0].where("not is_header")
    return rows.select("title", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("segment", "id", "note", "more"))])


SPANS = """SELECT 'Pairs' AS title, a.c_mktsegment AS segment, CAST(c.c_custkey AS VARCHAR) AS id,
    CASE WHEN c.c_custkey % 2 = 0 THEN c.c_name || chr(10) || 'x y' || chr(10) || 'z' || chr(10) || '  p' || chr(10) || '    q' ELSE '<' || c.c_name || '> 中文 &amp;!' END AS note,
    CASE WHEN c.c_custkey % 2 = 0 THEN '' ELSE 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' END AS more
    FROM customer c JOIN customer a ON a.c_custkey = c.c_custkey - c.c_custkey % 2"""


def data_block_faults(s: SparkSession, d: str) -> DataFrame:
    return parse_texts(broken_blocks(s, d), "data-block")[1].groupBy("doc_id", "code").agg(F.count("*").alias("n"))


FAULTS = """WITH c AS (SELECT c_custkey AS k, c_custkey // 40 AS doc FROM customer), l AS (SELECT *, doc % 5 AS kind FROM c), b AS (SELECT * FROM l WHERE kind < 4),
    f AS (SELECT doc, 'MISSING_COLON' AS code FROM b WHERE k % 5 <> 0 UNION ALL SELECT doc, 'MISSING_COLON' FROM b WHERE k % 7 = 0
      UNION ALL SELECT doc, 'UNMATCHED_BRACE' FROM b WHERE k % 11 = 0
      UNION ALL SELECT DISTINCT doc, 'UNMATCHED_BRACE' FROM b WHERE kind = 2 UNION ALL SELECT DISTINCT doc, 'UNCLOSED_QUOTE' FROM b WHERE kind = 2
      UNION ALL SELECT DISTINCT doc, 'UNCLOSED_DATA_BLOCK' FROM b WHERE kind IN (1, 2) UNION ALL SELECT DISTINCT doc, 'NO_DATA_RECORDS' FROM b WHERE kind = 3 UNION ALL SELECT DISTINCT doc, 'NO_DATA_BLOCK' FROM l WHERE kind = 4)
    SELECT CAST(doc AS VARCHAR) AS doc_id, code, count(*) AS n FROM f GROUP BY 1, 2"""


def data_block_recovered(s: SparkSession, d: str) -> DataFrame:
    rows = parse_texts(broken_blocks(s, d), "data-block")[0].where("not is_header and title = 'Customers'")
    return rows.select("row", F.get("cells", F.lit(0)).alias("id"), F.array_join(F.array_sort(F.slice("cells", 2, 9)), "|").alias("others"))


RECOVERED = """WITH c AS (SELECT *, c_custkey // 40 AS doc, row_number() OVER (PARTITION BY c_custkey // 40 ORDER BY c_custkey) - 1 AS row FROM customer)
    SELECT CAST(row AS INTEGER) AS row, CAST(c_custkey AS VARCHAR) AS id,
      CASE WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 5 = 0 THEN '|7' ELSE '|' END ELSE CASE WHEN c_custkey % 5 = 0 THEN '7|' ELSE '|' END || c_name || ' "}' || chr(10) END AS others FROM c WHERE doc % 5 <> 4
    UNION ALL SELECT CAST(count(*) AS INTEGER), 'never closed', '|' FROM c WHERE doc % 5 = 2 GROUP BY doc"""

def moved_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: CLI sections whose second header stands one blank after the first, with every ninth row out of its
    places and every tenth with a cell too many."""
    key = F.col("c_custkey")
    cells = [(key % 10).cast("string"), key.cast("string"), F.col("c_name"), F.col("c_mktsegment")]
    placed = F.rtrim(F.concat(*[F.rpad(c, n, " ") for c, n in zip(cells, (2, 8, 22, 12))]))
    free = F.concat_ws("  ", *cells)
    line = F.when(key % 10 == 1, F.concat(free, F.lit("   extra"))).when(key % 9 == 0, free).otherwise(placed)
    half = lambda n, top: F.concat(F.array(*map(F.lit, [f"Part {n}:", "=" * 40, "D Key     Customer Name         Segment", "-" * 40])), top, F.array(F.lit("")))
    both = F.concat(half(1, F.slice("lines", 1, 20)), half(2, F.slice("lines", 21, 20)))
    return _paged(spark, sf_dir, line).select("doc_id", F.array_join(F.concat(F.array(F.lit("report"), F.lit("")), both), "\n").alias("text"))


def cli_moved_rows(s: SparkSession, d: str) -> DataFrame:
    rows = parse_texts(moved_sections(s, d), "cli-multi-block")[0].where("not is_header")
    return rows.select("title", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("digit", "id", "name", "segment", "more"))])


MOVED = """SELECT 'Part ' || CAST(c_custkey % 40 // 20 + 1 AS VARCHAR) AS title, CAST(c_custkey % 10 AS VARCHAR) AS digit, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment,
    CASE WHEN c_custkey % 10 = 1 THEN 'extra' ELSE '' END AS more FROM customer"""


def cli_moved_codes(s: SparkSession, d: str) -> DataFrame:
    return parse_texts(moved_sections(s, d), "cli-multi-block")[1].groupBy("doc_id", "tab", "code").agg(F.count("*").alias("n"))


#: Rows with a cell too many widen their table, so that all its other rows are too short; a last text may end in its first section.
MOVED_CODES = """WITH c AS (SELECT CAST(c_custkey // 40 AS VARCHAR) AS doc_id, CAST(c_custkey % 40 // 20 AS INTEGER) AS tab, c_custkey AS k FROM customer)
    SELECT doc_id, tab, 'POSITION_MISMATCH' AS code, count(*) AS n FROM c WHERE k % 10 = 1 OR k % 9 = 0 GROUP BY 1, 2 UNION ALL SELECT doc_id, tab, 'ROW_WIDTH_MISMATCH', count(*) FROM c GROUP BY 1, 2
    UNION ALL SELECT doc_id, 1, 'EMPTY_TABLE_BLOCK', 1 FROM c GROUP BY doc_id HAVING max(tab) = 0"""

def clipboard_pairs(s: SparkSession, d: str) -> DataFrame:
    """Texts that were pasted twice. Of every third the last paste's markup still holds; of the next the text was edited
    since; the markup of the third is no table."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(","), F.col("c_name"))
    row = F.concat(F.lit("<tr>"), cell(F.col("c_custkey").cast("string")), cell(F.concat(F.lit("<b>"), "c_name", F.lit("</b> html"))), F.lit("</tr>"))
    text = _paged(s, d, line).select("doc_id", F.concat(F.lit("id,name\n"), F.array_join("lines", "\n")).alias("text"))
    html = _paged(s, d, row).select("doc_id", F.array_join("lines", "").alias("rows"))
    both = text.join(html, "doc_id")
    table = F.concat(F.lit("<table><tr><th>id</th><th>name</th></tr>"), "rows", F.lit("</table>"))
    kind = F.col("doc_id") % 3
    now = F.when(kind == 1, F.concat("text", F.lit("\n-1,edited"))).otherwise(F.concat("text", F.lit(" \n")))
    pastes = both.select("doc_id", F.lit(1).alias("at"), F.lit("older").alias("plain"), F.lit("<table><tr><td>older").alias("html"))
    pastes = pastes.unionByName(both.select("doc_id", F.lit(2).alias("at"), F.col("text").alias("plain"), F.when(kind == 2, F.lit("<p>no table</p>")).otherwise(table).alias("html")))
    rows = parse_pasted(both.select("doc_id", now.alias("text")), pastes)[0].where("not is_header")
    return rows.select("format", F.get("cells", F.lit(0)).alias("id"), F.get("cells", F.lit(1)).alias("name"))


PAIRS = """WITH c AS (SELECT *, c_custkey // 40 % 3 AS kind FROM customer)
    SELECT CASE WHEN kind = 0 THEN 'html-table' ELSE 'csv' END AS format, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN kind = 0 THEN c_name || ' html' ELSE c_name END AS name FROM c
    UNION ALL SELECT 'csv', '-1', 'edited' FROM (SELECT DISTINCT c_custkey // 40 FROM c WHERE kind = 1)"""


def source_stats(s: SparkSession, d: str) -> DataFrame:
    return text_stats(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


STATS = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT *, CAST(length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')) AS BIGINT) AS chars FROM t)
    SELECT doc_id, chars, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS INTEGER) AS lines,
    CASE WHEN chars * 2 < 1024 THEN CAST(chars * 2 AS VARCHAR) || ' B' WHEN chars * 2 < 1048576 THEN printf('%.1f KB', floor(chars * 2 / 1024 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(chars * 2 / 1048576 * 10 + 0.5) / 10) END AS label FROM c"""

QUERIES = {
    "clipboard_pairs": (clipboard_pairs, PAIRS), "source_stats": (source_stats, STATS),
    "cli_moved_rows": (cli_moved_rows, MOVED), "cli_moved_codes": (cli_moved_codes, MOVED_CODES),
    "html_cell_text": (html_cell_text, READABLE), "html_spans": (html_spans, SPANS), "data_block_faults": (data_block_faults, FAULTS), "data_block_recovered": (data_block_recovered, RECOVERED),
}
