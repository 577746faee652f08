"""Column helpers: every cell is text, a missing one is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes, characters that take two display columns, that take none.
SPACE = r"[\s ﻿  -     　]"
WIDE = r"[ᄀ-ᅟ⺀-〾ぁ-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]"
ZERO_WIDTH = r"[\p{Mn}\p{Me}​-‍]"


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def breaks_to_newlines(c: Column) -> Column:
    """Literal and escaped <br> and all line ends become one newline."""
    return F.regexp_replace(F.regexp_replace(c, r"(?i)(?:<|&lt;)\s*br\s*/?\s*(?:>|&gt;)", "\n"), r"\r\n?", "\n")


def clean_cell(c: Column) -> Column:
    return trim_all(breaks_to_newlines(F.translate(c, " ", " ")))


def leading_number(c: Column) -> Column:
    """The longest numeric prefix as a double, else null."""
    return F.regexp_extract(c, rf"^{SPACE}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def row_text(cells: list[Column]) -> Column:
    return F.concat_ws(" ", *cells)


def cell_type(c: Column) -> Column:
    s = trim_all(c)
    return (
        F.when(s == "", "empty").when(s.rlike(r"(?iu)^(?:true|false|yes|no|是|否)$"), "boolean").when(s.rlike(r"(?i)^-?\d+(?:\.\d+)?(?:e[+-]?\d+)?$"), "number")
        .when(s.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?$"), "date").otherwise("string")
    )


def looks_identifier(c: Column) -> Column:
    s = trim_all(c)
    return s.rlike(r"^[A-Za-z_一-龥][A-Za-z0-9_\s.()\-/一-龥]*$") & (cell_type(s) != "number")


def inferred_type(c: Column) -> Column:
    """Type shown for a join field. Dates beyond year-first ones are tried by a few common forms."""
    s = trim_all(c)
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in ("M/d/yyyy", "M-d-yyyy", "MMM d yyyy", "d-MMM-yyyy")])
    return (
        F.when(s == "", "empty").when(s.rlike(r"^[-+]?\d+(?:\.\d+)?$"), "numeric").when(s.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"), "date")
        .when(s.rlike("[-/]") & parsed.isNotNull(), "date").otherwise("text")
    )


def formula_safe(c: Column, protect: bool = True) -> Column:
    s = breaks_to_newlines(c)
    if not protect:
        return s
    risky = s.rlike(r"^[=+@]") | (s.rlike(r"^-") & ~s.rlike(r"^-\d+(?:\.\d+)?$"))
    return F.when(risky, F.concat(F.lit("'"), s)).otherwise(s)


def delimited_cell(c: Column, sep: str, protect: bool = True) -> Column:
    s = formula_safe(c, protect)
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(s.contains(sep) | s.rlike('["\r\n]'), quoted).otherwise(s)


def markdown_cell(c: Column, protect: bool = True) -> Column:
    return F.replace(F.replace(formula_safe(c, protect), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def ascii_cell(c: Column, protect: bool = True) -> Column:
    return F.replace(formula_safe(c, protect), F.lit("\n"), F.lit(" "))


def html_escaped(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def html_cell(c: Column, protect: bool = True) -> Column:
    return F.replace(html_escaped(formula_safe(c, protect)), F.lit("\n"), F.lit("<br>"))


def lua_string(c: Column) -> Column:
    for raw, name in (("\\", "\\\\"), ('"', '\\"'), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return F.concat(F.lit('"'), c, F.lit('"'))


def lua_kind(c: Column) -> Column:
    s = trim_all(c)
    return (
        F.when(s.rlike(r"^0[xX][0-9a-fA-F]+$"), "hex").when(s.rlike(r"^-?(?:0|[1-9]\d*)$"), "int")
        .when(s.rlike(r"^-?(?:(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)$"), "float").when(s.isin("true", "false"), "bool").otherwise("string")
    )


def lua_literal(c: Column) -> Column:
    s, kind = trim_all(c), lua_kind(c)
    return F.when(kind == "string", lua_string(c)).when((kind == "hex") & s.rlike("^0[xX]0+$"), "0").otherwise(s)


def number_safe(c: Column) -> Column:
    """Whether a spreadsheet can hold the text as a number without changing it."""
    s = trim_all(c)
    digits = F.regexp_replace(F.replace(F.regexp_replace(F.regexp_replace(s, r"^[+-]", ""), r"[eE].*$", ""), F.lit("."), F.lit("")), "^0+", "")
    value = s.try_cast("double")
    finite = value.isNotNull() & (F.abs(value) < float("inf"))
    return s.rlike(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$") & ~s.rlike(r"^-?0\d+") & (F.length(digits) <= 15) & finite


def display_width(c: Column) -> Column:
    """Columns that a text takes on a terminal."""
    return F.length(c) + F.regexp_count(c, F.lit(WIDE)) - F.regexp_count(c, F.lit(ZERO_WIDTH))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, as browsers count."""
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def bytes_label(n: Column) -> Column:
    """Bytes as people read them: B, KB or MB, the latter with one decimal."""
    tenths = lambda unit: F.format_string("%.1f", F.floor(n / float(unit) * 10 + 0.5) / 10)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(tenths(1 << 10), F.lit(" KB"))).otherwise(F.concat(tenths(1 << 20), F.lit(" MB")))
