"""Parsing from SQL and as a data source.

`parse_text` is a table function for LATERAL, `tabular_text` a format for spark.read; `register` makes both known to a
session. They offer the formats whose rows can be cut one after the other with bounded memory; formats with layouts,
sections or markup need a view of the whole text: `parse_texts` reads those.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from ..functions.columns import SPACE
from .parsers import CELL, ESCAPED_PIPE, ESCAPED_SLASH, MARKDOWN_RULE

SEPARATORS = {"csv": ",", "semicolon-csv": ";", "excel-paste": "\t"}
GAPS = {"fixed-width": re.compile(r"\s{2,}", re.A), "plain-text": re.compile(r"\s+", re.A)}
FORMATS = (*SEPARATORS, *GAPS, "pipe-table")
_EDGES = re.compile(rf"^{SPACE}+|{SPACE}+$", re.A)
_RULE = re.compile(MARKDOWN_RULE, re.A)


def quoted_records(lines: Iterable[str]) -> Iterator[str]:
    """Lines joined while a quote is open. Only one record is held at a time."""
    held, odd = [], False
    for line in lines:
        held.append(line)
        odd ^= line.count('"') % 2 == 1
        if not odd:
            yield "\n".join(held)
            held = []
    if held:
        yield "\n".join(held)


def quoted_cells(record: str, sep: str) -> list[str]:
    parts = record.split('"')
    last = len(parts) - 1
    return "".join(p if i % 2 else '"' if p == "" and 0 < i < last else p.replace(sep, CELL) for i, p in enumerate(parts)).split(CELL)


def piped_cells(line: str) -> list[str]:
    s = _EDGES.sub("", line).replace("\\\\", ESCAPED_SLASH).replace("\\|", ESCAPED_PIPE)
    s = re.sub(r"^\||\|$", "", re.sub(r"\\(.)", r"\1", s))
    return [c.replace(ESCAPED_PIPE, "|").replace(ESCAPED_SLASH, "\\") for c in s.split("|")]


def rows_of(lines: Iterable[str], fmt: str) -> Iterator[list[str]]:
    """Cells of every row, blank rows left out. Lines have no ends."""
    if fmt in SEPARATORS:
        rows = (quoted_cells(r, SEPARATORS[fmt]) for r in quoted_records(lines))
    elif fmt in GAPS:
        rows = (GAPS[fmt].split(t) for t in (_EDGES.sub("", line) for line in lines) if t)
    elif fmt == "pipe-table":
        rows = (piped_cells(line) for line in lines if "|" in line and not _RULE.match(line))
    else:
        raise ValueError(f"no such format: {fmt}; known are {', '.join(FORMATS)}")
    return (r for r in rows if any(r))


@udtf(returnType=T.StructType([T.StructField("row", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))]))
class ParseText:
    """parse_text(text, format): row (from 0) and cells of a text; null has no rows."""

    def eval(self, text: str, fmt: str):
        if text is not None:
            lines = re.sub("\r\n?", "\n", text.removeprefix("﻿")).split("\n")
            yield from enumerate(rows_of(lines, fmt))


@dataclass
class Range(InputPartition):
    """Bytes start to end of a file; lines belong to the range that they begin in."""

    file: str
    start: int
    end: int


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub("^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class TabularReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.format, self.split = options["path"], options.get("format", "csv"), int(options.get("split", 64 << 20))
        if self.format not in FORMATS:
            raise ValueError(f"no such format: {self.format}; known are {', '.join(FORMATS)}")

    def partitions(self) -> list[Range]:
        """A range of `split` bytes each; whole files where quotes may hide newlines."""
        fs, path = _opened(self.path)
        found = fs.get_file_info(path)
        files = [found] if found.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted((f for f in files if f.is_file and f.size and f.base_name[0] not in "._"), key=lambda f: f.path)
        step = (lambda n: n) if self.format in SEPARATORS else (lambda n: self.split)
        return [Range(f.path, a, min(a + step(f.size), f.size)) for f in files for a in range(0, f.size, step(f.size))] or [Range("", 0, 0)]

    def read(self, part: Range):
        if not part.file:
            return
        fs, _ = _opened(self.path)
        at = part.start
        with io.BufferedReader(fs.open_input_file(part.file), 1 << 20) as f:
            # A range that begins inside a line leaves it to the range before.
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            starts: list[int] = []

            def lines():
                nonlocal at
                while at < part.end and (line := f.readline()):
                    starts.append(at)
                    at += len(line)
                    text = line.decode("utf-8", "replace").removesuffix("\n").removesuffix("\r")
                    yield from re.split("\r", text.removeprefix("﻿") if starts[-1] == 0 else text)

            for n, cells in enumerate(rows_of(lines(), self.format)):
                yield part.file, part.start, n, cells


class TabularText(DataSource):
    """spark.read.format("tabular_text").option("format", ...).load(path): file, block, row (from 0 in the block), cells.

    path is a file or a folder, local or a URI that Arrow's file systems know. Option split: bytes of a block. Formats
    with quotes are read one file a task, record by record; `read_delimited` splits those too.
    """

    @classmethod
    def name(cls) -> str:
        return "tabular_text"

    def schema(self) -> str:
        return "file string, block bigint, row bigint, cells array<string>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TabularReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes parse_text and tabular_text known to the session."""
    spark.udtf.register("parse_text", ParseText)
    spark.dataSource.register(TabularText)
