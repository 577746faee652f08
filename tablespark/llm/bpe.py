"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a word has exactly one last token in its encoding. An automaton over the vocabulary names, at
each byte, all tokens that end there; the one that starts at the beginning of the word, or whose left
neighbour is the last token of the shorter prefix and stays apart from it, is stored. Following the stored
tokens back from the end gives the ids. Words are cut out of the text by the vocabulary's pattern and encoded
once for each Python worker, while a cache of bounded size lasts.
"""

from __future__ import annotations

import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the word pattern of the byte-level vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 600_000


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte: itself where printable, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class PrefixBpe:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in byte_letters().items()}
        model, self.special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = model["vocab"]
        raw = {t: bytes(to_byte[c] for c in t) for t in vocab if t not in self.special}
        self.token_bytes = {i: raw[t] for t, i in vocab.items() if t in raw} | {i: t.encode() for t, i in self.special.items()}
        self.id_bytes = {i: int(i).to_bytes(4, "little") for i in self.token_bytes}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = n
            if whole not in self.halves:
                self.halves[whole], self.made_at[whole] = (left, right), n
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if t in raw and (len(raw[t]) == 1 or i in self.halves):
                self.automaton.add_word(raw[t].decode("latin-1"), (i, len(raw[t])))
        self.automaton.make_automaton()
        self.pattern = regex.compile(WORDS)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.apart: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, are what their joined bytes encode to.

        Undoes merges from the latest to the earliest on the two sides of the border; a and b stay apart if no
        pair that meets at the border would have been merged before its own parts were.
        """
        known = self.apart.get((a, b))
        if known is not None:
            return known
        first, last = len(self.rank), len(self.rank)
        x, y = a, b
        while True:
            meets = self.rank.get((x, y), last)
            # A border merge wins against merges of later rank; of equal rank the left one comes first.
            if meets < first:
                found = False
                break
            left, right = self.made_at.get(x, -1), self.made_at.get(y, -1)
            if left < 0 and right < 0:
                found = True
                break
            if left > right:
                first, x = left, self.halves[x][1]
            else:
                # The left of two equal merges is done first, so a border merge of that rank comes between them.
                first, y = right + 1, self.halves[y][0]
        if len(self.apart) > CACHE:
            self.apart.clear()
        self.apart[a, b] = found
        return found

    def word_ids(self, word: bytes) -> list[int]:
        last, size = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        apart, test = self.apart, self.stays_apart
        for end, (token, n) in self.automaton.iter(word.decode("latin-1")):
            end += 1
            if last[end] < 0:
                before = last[end - n]
                if n == end or (before >= 0 and (apart[before, token] if (before, token) in apart else test(before, token))):
                    last[end], size[end] = token, n
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def _piece(self, piece: str) -> bytes:
        ids = self.id_bytes
        found = b"".join(ids[i] for w in self.pattern.findall(piece) for i in self.word_ids(w.encode()))
        if len(self.cache) >= CACHE:
            self.cache.clear()
        if len(piece) <= 64:
            self.cache[piece] = found
        return found

    def _plain(self, text: str) -> bytes:
        """Words never reach over white space that follows anything else, so such places are cut first."""
        if DOUBLE_SPACE.search(text):
            return b"".join(map(self._piece, CUTS.split(text)))
        get, piece, parts = self.cache.get, self._piece, []
        for n, line in enumerate(text.split("\n")):
            words = line.split(" ")
            for p in ["\n" + words[0] if n else words[0], *[" " + w for w in words[1:]]]:
                ids = get(p)
                parts.append(piece(p) if ids is None else ids)
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self.id_bytes[self.special[m.group()]]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


DOUBLE_SPACE = regex.compile(r"\s\s")
CUTS = regex.compile(r"(?<=\S)(?=\s)")
_loaded: dict[str, PrefixBpe] = {}


def encoder(path: str) -> PrefixBpe:
    """One encoder for each file and Python worker."""
    if path not in _loaded:
        _loaded[path] = PrefixBpe(path)
    return _loaded[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded, the text read back from the ids.

    One row for each row of docs; whole texts; null texts count as empty and give no ids; repeated rows are
    encoded alike; empty tables give no rows; further columns, whatever their names, are left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")
