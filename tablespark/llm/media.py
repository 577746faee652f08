"""Media columns: stored samples, signature sniffing, carving.

wave_bytes stores bytes losslessly as 8-bit samples. sniff walks over a value's bytes with an automaton of magic
bytes; at each hit a validator of that format reads the structure and its length, or rejects it. The form found
at the start corrects the declared type; valid forms further in are embedded media and can be cut out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

BLOCK = 192
RATE = 8000
FORM = "array<struct<kind:string,offset:bigint,length:bigint>>"


def wave_bytes(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF wave of one channel of unsigned 8-bit samples."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def wave_payload(media: bytes) -> bytes | None:
    """The samples of a wave file's data chunk."""
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return bytes(media[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return None


# Validators take the whole value and where the magic bytes begin, and return the form's length or 0.


def _riff(kinds: tuple[bytes, ...]) -> Callable[[bytes, int], int]:
    def check(b: bytes, at: int) -> int:
        if at + 12 > len(b) or b[at + 8 : at + 12] not in kinds:
            return 0
        end, p, chunks = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, 0
        if end > len(b):
            return 0
        while p + 8 <= end:
            size = struct.unpack_from("<I", b, p + 4)[0]
            p += 8 + size + (size & 1)
            chunks += 1
        return end - at if chunks and p == end else 0

    return check


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, p)
        if p + 12 + size > len(b) or (first and (name != b"IHDR" or size != 13)):
            return 0
        if zlib.crc32(memoryview(b)[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return 0
        p, first = p + 12 + size, False
        if name == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while p < len(b):
        mark = b[p]
        if mark == 0x3B:
            return p + 1 - at
        if mark == 0x21:
            p += 2
        elif mark == 0x2C and p + 10 <= len(b):
            p += 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0)
        else:
            return 0
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b):
        if b[p] != 0xFF or b[p + 1] in (0x00, 0xFF):
            return 0
        mark, size = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if mark == 0xD9 or size < 2:
            return 0
        p += 2 + size
        if mark == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return p + 2 - at
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
            if p < 0:
                return 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, zero, data, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (abs(width) * bits + 31) // 32 * 4
    fits = not zero and head in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + head <= data <= size
    return size if fits and width and height and at + size <= len(b) and data + row * abs(height) <= size + 3 else 0


def _ogg(b: bytes, at: int) -> int:
    p = at
    while p + 27 <= len(b) and b[p : p + 5] == b"OggS\0":
        n = b[p + 26]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if end > len(b) or p + 27 + n > len(b):
            return 0
        last, p = b[p + 5] & 4, end
        if last:
            return p - at
    return 0


#: Magic bytes by media type.
SIGNATURES: list[tuple[str, bytes, Callable[[bytes, int], int]]] = [
    ("image/png", b"\x89PNG\r\n\x1a\n", _png),
    ("image/gif", b"GIF87a", _gif),
    ("image/gif", b"GIF89a", _gif),
    ("image/jpeg", b"\xff\xd8\xff", _jpeg),
    ("image/bmp", b"BM", _bmp),
    ("audio/wav", b"RIFF", _riff((b"WAVE",))),
    ("image/webp", b"RIFF", _riff((b"WEBP",))),
    ("video/avi", b"RIFF", _riff((b"AVI ",))),
    ("audio/ogg", b"OggS", _ogg),
]


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic in {m for _, m, _ in SIGNATURES}:
        found.add_word(magic.decode("latin-1"), (len(magic), [(k, f) for k, m, f in SIGNATURES if m == magic]))
    found.make_automaton()
    return found


_hits = _automaton()


def sniff(value: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every valid form, by offset; forms inside a form are listed too."""
    out = []
    for end, (n, forms) in _hits.iter(value.decode("latin-1")):
        at = end + 1 - n
        out += [(kind, at, size) for kind, check in forms if (size := check(value, at))]
    return sorted(out, key=lambda f: (f[1], f[0]))


def sample_feature(payload: bytes) -> str:
    """Length, mean, root mean square and sign changes of the samples about their middle."""
    x = np.frombuffer(payload, dtype=np.uint8)
    total, squares, turns, before = 0, 0, 0, None
    for at in range(0, len(x), 1 << 20):
        part = x[at : at + (1 << 20)].astype(np.int64) - 128
        total, squares = total + int(part.sum()), squares + int((part * part).sum())
        signs = part >= 0
        turns += int((signs[1:] != signs[:-1]).sum()) + (before is not None and bool(signs[0]) != before)
        before = bool(signs[-1])
    n = max(len(x), 1)
    return f"n={len(x)};sum={total};mean={total / n:.4f};rms={(squares / n) ** 0.5:.4f};turns={turns}"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, declared, media: the text's UTF-8 bytes, filled with spaces, as 8-bit samples.

    One row for each row; null texts count as empty; the payload has a positive multiple of `block` bytes;
    equal texts give equal media; empty tables give no rows; further columns are left out.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                raw = batch.column("text").to_pylist()
                media = [wave_bytes(t.ljust(max(block, -(-len(t) // block) * block), b" ")) for t in raw]
                cols = [batch.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(["application/octet-stream"] * len(raw)), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "declared", "media"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, declared string, media binary")


def describe_media(rows: DataFrame, id_col: str = "doc_id", media_col: str = "media", declared_col: str = "declared", keep: tuple[str, ...] = (), carve: bool = False) -> DataFrame:
    """doc_id, kept columns, media, media_type, corrected, payload, embedded, carved, feature for each row.

    media_type is the type of a valid form at the start, else the declared one; corrected tells that they
    differ; payload holds a wave's samples, else the whole value; embedded lists the valid forms further in,
    and carved, if asked for, holds their bytes. Null media count as empty; equal values are described alike.
    """
    names = ["doc_id", *keep]
    rows = rows.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(media_col), F.lit(b"")).alias("_media"), F.col(declared_col).cast("string").alias("_declared"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    schema += f", media binary, media_type string, corrected boolean, payload binary, embedded {FORM}, carved array<binary>, feature string"
    form = pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                out: list[tuple] = []
                for value, declared in zip(batch.column("_media").to_pylist(), batch.column("_declared").to_pylist()):
                    forms = sniff(value)
                    first = next((f for f in forms if f[1] == 0), None)
                    inner = [f for f in forms if f[1] > 0]
                    kind = first[0] if first else declared
                    samples = wave_payload(value) if kind == "audio/wav" and first else None
                    payload = value if samples is None else samples
                    feature = f"type={kind};embedded={len(inner)};{sample_feature(payload)}"
                    listed = [{"kind": k, "offset": o, "length": n} for k, o, n in inner]
                    out.append((value, kind, kind != declared, payload, listed, [value[o : o + n] for _, o, n in inner] if carve else [], feature))
                kinds = [pa.binary(), pa.string(), pa.bool_(), pa.binary(), form, pa.list_(pa.binary()), pa.string()]
                cols = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *cols], names=[*names, "media", "media_type", "corrected", "payload", "embedded", "carved", "feature"])

    return rows.mapInArrow(run, schema)
