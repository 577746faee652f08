"""Workbooks: one sheet for each table, cells typed as numbers only where nothing is lost."""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable
from contextlib import contextmanager
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.ordinals import numbered
from ..operators.table import Table
from ..sources.text import stored

#: Names and types of a workbook's parts.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def sheet_name(name: str, used: set[str]) -> str:
    """Without forbidden characters, 31 at most, made unique with _2, _3 and so on."""
    base = re.sub(r"[\\/:?*\[\]]", "", name).strip()[:31] or "Sheet"
    final, n = base, 2
    while final in used:
        final, n = f"{base[: 31 - len(str(n)) - 1]}_{n}", n + 1
    used.add(final)
    return final


def file_prefix(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r'[\\/:*?"<>|\s]', "_", name)).strip("_")[:80]


#: Rows that a sheet can hold besides its header, and rows of a chunk, of which a sheet holds 25.
SHEET = 1_048_575
CHUNK = 41_943


def row_xml(table: Table) -> Column:
    def cell(c):
        text = F.regexp_replace(C.html_escaped(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")), "&#39;", "&apos;")
        number = F.concat(F.lit('<c t="n"><v>'), C.trim_all(c), F.lit("</v></c>"))
        return F.when(C.number_safe(c), number).otherwise(F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), text, F.lit("</t></is></c>")))

    return F.concat(F.lit("<row>"), *map(cell, table.cells), F.lit("</row>"))


def deflated(data: bytes, last: bool = False) -> bytes:
    """A stretch of a deflate stream that others can follow, unless it is the last."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    return squeeze.compress(data) + squeeze.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


def sheet_chunks(table: Table) -> DataFrame:
    """sheet, chunk, n (rows), size and crc of the XML, data (its deflated bytes): the table's rows in order, CHUNK rows each.

    Rows are rendered and deflated by the executors; a group never holds more than CHUNK of them.
    """
    rows = numbered(table.df.select(*table.order, row_xml(table).alias("xml")), list(table.order), "row").select("row", "xml")
    rows = rows.withColumn("at", F.floor(F.col("row") / CHUNK))

    def squeeze(group: pa.Table) -> pa.Table:
        xml = "".join(group.sort_by("row").column("xml").to_pylist()).encode()
        return pa.table({"at": group.column("at").slice(0, 1), "n": [group.num_rows], "size": [len(xml)], "crc": [zlib.crc32(xml)], "data": pa.array([deflated(xml)], pa.binary())})

    chunks = rows.groupBy("at").applyInArrow(squeeze, "at bigint, n bigint, size bigint, crc bigint, data binary")
    per = SHEET // CHUNK
    return stored(chunks.select(F.floor(F.col("at") / per).cast("int").alias("sheet"), (F.col("at") % per).cast("int").alias("chunk"), "n", "size", "crc", "data"), "sheet-chunks")


def crc_of_both(first: int, second: int, size: int) -> int:
    """The checksum of two stretches from theirs, when the second has so many bytes: checksums are linear, so those of as
    many zeros carry the first one on."""
    zeros, carried, plain = bytes(1 << 20), first, 0
    while size:
        part = zeros[: min(size, len(zeros))]
        carried, plain, size = zlib.crc32(part, carried), zlib.crc32(part, plain), size - len(part)
    return carried ^ plain ^ second


class Package:
    """A ZIP file written from front to back, whose members are deflated already."""

    def __init__(self, write):
        self.write, self.at, self.members = write, 0, []

    def put(self, data: bytes) -> None:
        self.write(data)
        self.at += len(data)

    def member(self, name: str, crc: int, size: int, stretches, packed: int) -> None:
        """stretches: an iterable of bytes, packed of them in all. Sizes always stand in 64 bits as well."""
        start, wide = self.at, struct.pack("<HHQQ", 1, 16, size, packed)
        common = struct.pack("<HHHHHIIIH", 45, 0x800, 8, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name.encode()))
        self.put(b"PK\x03\x04" + common + struct.pack("<H", len(wide)) + name.encode() + wide)
        body = self.at
        for s in stretches:
            self.put(s)
        if self.at - body != packed:
            raise RuntimeError(f"{name} changed while it was written")
        self.members.append((name.encode(), common, struct.pack("<HHQQQ", 1, 24, size, packed, start)))

    def text(self, name: str, text: str) -> None:
        data = text.encode()
        packed = deflated(data, True)
        self.member(name, zlib.crc32(data), len(data), [packed], len(packed))

    def close(self) -> None:
        start, n = self.at, len(self.members)
        for name, common, wide in self.members:
            self.put(b"PK\x01\x02" + struct.pack("<H", 45) + common + struct.pack("<HHHHII", len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + name + wide)
        end = self.at
        self.put(b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, end - start, start))
        self.put(b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1))
        self.put(b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), 0xFFFFFFFF, 0xFFFFFFFF, 0))


@contextmanager
def committed(spark: SparkSession, path: str):
    """A function that writes bytes to the path, which appears only when all is written. Paths with a scheme go through
    the file systems that Spark knows."""
    if "://" in path:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
        out = fs.create(part)
        write, close, drop = (lambda b: out.write(bytearray(b))), out.close, (lambda: fs.delete(part, False))

        def commit():
            fs.delete(target, False)
            if not fs.rename(part, target):
                raise OSError(f"{path} could not be written")
    else:
        part = f"{path}.{uuid.uuid4().hex}.part"
        file = open(part, "wb")
        write, close, drop, commit = file.write, file.close, (lambda: os.remove(part)), (lambda: os.replace(part, path))
    try:
        yield write
        close()
        commit()
    except BaseException:
        close()
        drop()
        raise


def write_xlsx(tables: Iterable[Table], path: str) -> list[str]:
    """Writes a workbook and returns its sheet names. The path holds nothing or the whole workbook.

    Executors make the deflated stretches of every sheet and their checksums; the driver copies one stretch of bytes after
    the other and sees no rows. A table of more than SHEET rows goes on in further sheets of its name, with its header.
    """
    tables, used, sheets = list(tables), set(), []
    for t in tables:
        chunks = sheet_chunks(t)
        found: dict[int, list] = {}
        for r in chunks.select("sheet", "chunk", "size", "crc", F.length("data").alias("packed")).orderBy("sheet", "chunk").collect():  # one row for each chunk
            found.setdefault(r["sheet"], []).append(r)
        sheets += [(sheet_name(t.name, used), t, chunks, k, found.get(k, [])) for k in (sorted(found) or [0])]
    names = [s[0] for s in sheets]
    with committed(tables[0].df.sparkSession if tables else SparkSession.active(), path) as write:
        z = Package(write)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names)))
        z.text("[Content_Types].xml", f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.text("_rels/.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(names))
        z.text("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{LINK}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i + 1}" Type="{LINK}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names)))
        z.text("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>')
        for i, (_, t, chunks, k, found) in enumerate(sheets):
            head = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(h)}</t></is></c>' for h in t.headers)
            first = f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData><row>{head}</row>'.encode()
            last = b"</sheetData></worksheet>"
            crc, size = zlib.crc32(first), len(first)
            for r in found:
                crc, size = crc_of_both(crc, r["crc"], r["size"]), size + r["size"]
            crc, size = crc_of_both(crc, zlib.crc32(last), len(last)), size + len(last)
            ends = deflated(first), deflated(last, True)
            middle = (bytes(r["data"]) for r in chunks.where(F.col("sheet") == k).orderBy("chunk").select("data").toLocalIterator())
            z.member(f"xl/worksheets/sheet{i + 1}.xml", crc, size, itertools.chain(ends[:1], middle if found else (), ends[1:]), sum(r["packed"] for r in found) + len(ends[0]) + len(ends[1]))
        z.close()
    return names


def to_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)
