"""The rule language, compiled to one Column.

rule: tokens between white space, all of which must hold; token: alternatives between |, one of which must hold;
alternative: !alternative, key OP value, /pattern/, or plain text searched in the whole row. Operators are looked
for before patterns, quotes only keep white space together, an empty alternative always holds, an unknown key
never does.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import leading_number, row_text

KEYED = re.compile(r"^(.+?)(!=|>=|<=|=|>|<|:)(.+)$", re.S)
LONGEST_PATTERN = 200
_NUMBER = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)")


def tokens_of(rule: str) -> list[str]:
    """Splits at white space outside quotes; the quotes stay in the tokens."""
    out, word, quote = [], "", ""
    for ch in rule or "":
        if quote:
            word, quote = word + ch, "" if ch == quote else quote
        elif ch in "\"'":
            word, quote = word + ch, ch
        elif ch.isspace():
            out, word = out + [word] * bool(word), ""
        else:
            word += ch
    return out + [word] * bool(word)


def alternatives_of(token: str) -> list[str]:
    whole = token.startswith("/") and token.endswith("/")
    return [token] if whole or "|" not in token else token.split("|")


def java_pattern(pattern: str) -> str | None:
    """The pattern in the JVM's dialect, ignoring case; None if it is too long or none at all."""
    if len(pattern) > LONGEST_PATTERN:
        return None
    out, inside, i = "", False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out, i = out + pattern[i : i + 2], i + 2
            continue
        if inside and ch == "[":
            ch = "\\["
        elif inside and pattern.startswith("&&", i):
            ch, i = "\\&\\&", i + 1
        elif not inside and ch == "$":
            ch = "\\z"
        inside = (inside or ch == "[") and ch != "]"
        out, i = out + ch, i + 1
    out = "(?iu)" + out
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(out)
    except Exception:  # whatever the JVM says: not a pattern, so it matches nothing
        return None
    return out


def matches(text: Column, pattern: str) -> Column:
    java = java_pattern(pattern)
    return F.lit(False) if java is None else text.rlike(java)


class Rule:
    """One rule over the headers and cell columns of a table. Of headers that differ in case the last counts."""

    def __init__(self, rule: str, headers: list[str], cells: list[Column]):
        self.rule, self.cells = rule, cells
        self.by_key = {h.lower(): c for h, c in zip(headers, cells)}

    def column(self) -> Column:
        return reduce(and_, [reduce(or_, map(self._alternative, alternatives_of(t))) for t in tokens_of(self.rule)], F.lit(True))

    def _alternative(self, text: str) -> Column:
        if not text:
            return F.lit(True)
        if text[0] == "!" and len(text) > 1:
            return ~self._alternative(text[1:])
        keyed = KEYED.match(text)
        if keyed:
            return self._keyed(*keyed.groups())
        if text[0] == text[-1] == "/":
            return matches(row_text(self.cells), text[1:-1])
        return F.contains(F.lower(row_text(self.cells)), F.lit(text.lower()))

    def _keyed(self, key: str, op: str, value: str) -> Column:
        value = value.strip()
        if value and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        value, cell = value.lower(), self.by_key.get(key.lower())
        if cell is None:
            return F.lit(False)
        cell = F.lower(cell)
        if op in ("=", "!=", ":"):
            return {"=": cell == value, "!=": cell != value, ":": F.contains(cell, F.lit(value))}[op]
        number = _NUMBER.match(value)
        if not number:
            return F.lit(False)
        left, right = leading_number(cell), float(number[1])
        return F.coalesce({">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op], F.lit(False))


def compile_rule(rule: str | None, headers: list[str], cells: list[Column]) -> Column:
    return Rule(rule or "", headers, cells).column()


def column_filter(text: str | None, cell: Column) -> Column:
    """Contains, or a /pattern/; blank holds always."""
    text = (text or "").strip()
    if not text:
        return F.lit(True)
    if len(text) > 1 and text[0] == text[-1] == "/":
        return matches(cell, text[1:-1])
    return F.contains(F.lower(cell), F.lit(text.lower()))
