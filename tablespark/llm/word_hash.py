"""Hashes of words, straight from the bytes of an Arrow text column.

A word is a run of letters, digits and marks. Every character of a script that puts no spaces between words is a word.
Bytes that are no UTF-8 stand between words.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64)
_POWER = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(256)], dtype=np.uint64)
#: Bytes that may be parts of words: ASCII letters and digits, and all beyond ASCII.
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: First and last code points of scripts without spaces (Thai to Myanmar, Khmer, kana and Bopomofo, Han).
UNSPACED = [(0x0E00, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x9FFF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x3FFFF)]
_BETWEEN, _PART, _ALONE = 0, 1, 2


@cache
def _classes() -> np.ndarray:
    """For every code point: between words, part of a word, or a word of its own."""
    out = np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(0x110000)], dtype=np.uint8)
    for first, last in UNSPACED:
        out[first : last + 1] *= np.uint8(_ALONE)
    return out


def _byte_classes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of the character that each byte belongs to, whether a byte is a character's first). None spans two texts."""
    cls, lead = (_IN_WORD[data] & (data < 128)).astype(np.uint8), np.ones(len(data), dtype=bool)
    if not (data >= 128).any():
        return cls, lead
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    for size, low, high, least in ((2, 0xC2, 0xDF, 0x80), (3, 0xE0, 0xEF, 0x800), (4, 0xF0, 0xF4, 0x10000)):
        at = np.flatnonzero((data >= low) & (data <= high))
        point = padded[at] & np.uint32(0x7F >> size)
        good = np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, at + (size - 1), side="right")
        for j in range(1, size):
            good &= (padded[at + j] & 0xC0) == 0x80
            point = (point << np.uint32(6)) | (padded[at + j] & np.uint32(0x3F))
        good &= (point >= least) & (point < 0x110000)
        at, of = at[good], _classes()[point[good]]
        for j in range(size):
            cls[at + j], lead[at + j] = of, j == 0
    return cls, lead


def _next_gap(data: np.ndarray, at: int) -> int:
    """The first byte from at on that certainly is no part of a word."""
    while at < len(data):
        gaps = np.flatnonzero(~_IN_WORD[data[at : at + 4096]])
        if len(gaps):
            return at + int(gaps[0])
        at += 4096
    return len(data)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that scatters all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column without nulls."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each text and in all). Works in slices cut between words."""
    hashes, rows, at = [], [], 0
    while at < len(data):
        end = _next_gap(data, at + SLICE)
        cls, lead = _byte_classes(data[at:end], offsets - at)
        inside = np.flatnonzero(cls)
        if len(inside):
            where = inside + at
            row = np.searchsorted(offsets, where, side="right") - 1
            apart = (where[1:] != where[:-1] + 1) | (row[1:] != row[:-1])
            alone = cls[inside] == _ALONE
            begins = lead[inside[1:]] & (alone[1:] | alone[:-1])
            first = np.flatnonzero(np.concatenate([[True], apart | begins]))
            place = np.arange(len(where)) - np.repeat(first, np.diff(np.append(first, len(where))))
            with np.errstate(over="ignore"):
                hashes.append(mixed(np.add.reduceat(_BYTE[data[where]] * _POWER[place & 255], first)))
            rows.append(row[first])
        at = end
    row = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.searchsorted(row, np.arange(len(offsets)))
