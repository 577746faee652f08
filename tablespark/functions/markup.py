"""Readable text of HTML fragments: blocks are lines, inline elements stay together, <pre> keeps its white space."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import SPACE, trim_all

#: Elements that begin and end lines, elements without an end tag, elements whose content is not text, and entities with names.
BLOCKS = set(
    "address article aside blockquote dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = ("script", "style", "template")
NAMED = {"nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

#: A comment, a tag (quotes hide its end), text, or what begins like a tag and has no end.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:[^"'>]|"[^"]*"|'[^']*')*+>|[^<]+|<.*""", re.S)
TAG = re.compile(r"<\s*(/?)\s*([A-Za-z][A-Za-z0-9_:-]*).*>", re.S)
ENTITY = re.compile(r"&(?:(nbsp|amp|lt|gt|quot|apos)|#x([0-9a-f]+)|#([0-9]+));", re.I)
BREAK = re.compile(r"<\s*br\s*/?>", re.I)
BLANK = re.compile(rf"(?:(?!\n){SPACE})+")


def decoded(text: str) -> str:
    """Six named and all numeric entities; a number that is no character stays as it is."""

    def one(m: re.Match) -> str:
        if m[1]:
            return NAMED[m[1].lower()]
        digits, base = (m[2], 16) if m[2] else (m[3], 10)
        code = int(digits, base) if len(digits) < 12 else 1 << 30
        return chr(code) if code < 0xD800 or 0xDFFF < code <= 0x10FFFF else m[0]

    return ENTITY.sub(one, text) if "&" in text else text


def readable(html: str) -> str:
    """One pass over the tokens. Of the open elements only their numbers count: skipped ones hide text, pre keeps it."""
    opened: Counter[str] = Counter()
    pieces: list[tuple[bool, str]] = []

    def boundary(kept: bool) -> None:
        if not (pieces and pieces[-1][0] == kept and pieces[-1][1].endswith("\n")):
            pieces.append((kept, "\n"))

    for token in TOKEN.findall(html):
        hidden, kept = any(opened[s] > 0 for s in SKIPPED), opened["pre"] > 0
        if token.startswith("<!--"):
            continue
        tag = TAG.fullmatch(token) if token[0] == "<" and token[-1] == ">" else None
        if tag is None:
            text = "" if hidden else decoded(token)
            if text:
                # Escaped breaks in running text count; in an element without an end they don't.
                pieces.append((kept, BREAK.sub("\n", text) if token[0] != "<" and not kept else text))
            continue
        name = tag[2].lower()
        if not hidden and name == "br" and not tag[1]:
            pieces.append((kept, "\n"))
        elif not hidden and name in BLOCKS:
            boundary(kept)
        if tag[1]:
            opened[name] = max(0, opened[name] - 1)
        elif name not in VOID and not token[:-1].rstrip().endswith("/"):
            opened[name] += 1
    out, at = [], 0
    while at < len(pieces):
        end = at
        while end < len(pieces) and pieces[end][0] == pieces[at][0]:
            end += 1
        text = "".join(p for _, p in pieces[at:end]).replace(" ", " ").replace("\r\n", "\n").replace("\r", "\n")
        out.append(text if pieces[at][0] else re.sub(" *\n *", "\n", BLANK.sub(" ", text)))
        at = end
    return "".join(out)


@F.arrow_udf(T.StringType())
def _readable(cells: pa.Array) -> pa.Array:
    return pa.array([None if c is None else readable(c) for c in cells.to_pylist()], pa.string())


def _plain(c: Column) -> Column:
    """What `readable` makes of text with neither tags nor entities, before it is trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.translate(c, " ", " "), r"\r\n?", "\n"), rf"(?:(?!\n){SPACE})+", " "), " *\n *", "\n")


def html_text(c: Column) -> Column:
    """The text of markup, trimmed; null is empty. Cells with neither tags nor entities stay in the JVM."""
    marked = c.contains("<") | c.contains("&")
    return trim_all(F.coalesce(_readable(F.when(marked, c)), _plain(c), F.lit("")))


#: A cell with its own tag alone before its text; quotes could hide the tag's end.
BARE = r"""(?is)^<t[dh]\b[^<>&"']*>([^<&]*)$"""


def html_texts(cells: Column) -> Column:
    """html_text of every item of an array of table cells, each with its own tag before it. Lists of bare cells stay in the JVM."""
    cells = F.coalesce(cells, F.array().cast("array<string>"))
    bare = F.transform(cells, lambda c: _plain(F.regexp_extract(c, BARE, 1)))
    return F.transform(F.coalesce(_readable_items(F.when(F.exists(cells, lambda c: ~c.rlike(BARE)), cells)), bare), trim_all)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _readable_items(lists: pa.Array) -> pa.Array:
    # One list at a time as Python's strings.
    return pa.array((None if cells is None else ["" if c is None else readable(c) for c in cells] for cells in (x.as_py() for x in lists)), pa.list_(pa.string()))
