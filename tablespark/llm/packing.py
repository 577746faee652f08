"""Packing token sequences by minimum bin slack.

Every document is cut into full windows; the rests, all shorter than a window, are dealt into groups of bounded
size. A group fills window after window: the longest rest is taken, a subset-sum program over the multiset of
the remaining lengths (one bit for each reachable sum, counts taken in powers of two) finds the selection that
comes closest to the room left, and following the program back gives how many of each length to take. A gap
that no selection closes is closed by cutting one rest; the last rests of a group go into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import math
import unicodedata
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_letters
from .common import bounded_batches, slices

WINDOW = 4096
GROUP = 1500
CACHE = 500_000
#: Texts, and their bytes, whose words are looked up together.
TEXTS = 512, 4 << 20


#: Fixed value: the word pattern of the word-level vocabulary.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\p{Z}\p{L}\p{N}]+")


def odd(c: str) -> bool:
    """Whether Python's tables may order or class a character otherwise than the tokenizers library's."""
    kind = unicodedata.category(c)
    return kind == "Cn" or kind[0] == "M" and not "\u0300" <= c <= "\u036f"


class WordIds(dict):
    """Ids of white-space-separated words, as bytes; a word met for the first time is encoded by the model.

    The tokenizer's own normalisation (NFC, lower case letter by letter) and word pattern are applied here, word
    by word, which its whole pipeline would do far more slowly. Words with characters that Python's tables don't
    know, or may order otherwise (marks beyond the common ones), go through the whole pipeline.
    """

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        letters = byte_letters()
        self.whole, self.model = tokenizer, tokenizer.model
        self.letters = {b: letters[b] for b in range(256)}
        self.old: dict[str, bytes] = {}
        self.known: set[str] = set(map(chr, range(128)))

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encoded(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def age(self) -> None:
        """Keeps the words met since the last time, as the older half; words used again come back from there."""
        self.old = dict(self)
        self.clear()

    def encoded(self, word: str) -> bytes:
        # A last comma and capitals leave the word's other ids as they are: most such words are known without them.
        if word[-1:] in (",", ".", ";", ":", "!", "?") and word[:-1].isalpha():
            return self[word[:-1]] + self[word[-1]]
        if word.isalpha() and "\u03a3" not in word and not word.islower() and unicodedata.is_normalized("NFC", word):
            low = word.lower()
            if low != word and low.isalpha() and self.known.issuperset(word):
                return self[low]
        if word.isascii():
            low, plain = word.lower(), word.isprintable()
        else:
            if not self.known.issuperset(word):
                if any(map(odd, word)):
                    return np.array(self.whole.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
                self.known.update(word)
            low, plain = unicodedata.normalize("NFC", word), False
            # Capital sigma is the one letter whose lower case depends on its neighbours.
            low = "".join([c.lower() for c in low]) if "\u03a3" in low else low.lower()
        ids = array("I")
        for w in (low,) if low.isalpha() else WORDS.findall(low):
            if not plain:
                w = w.encode().decode("latin-1").translate(self.letters)
            ids.extend([t.id for t in self.model.tokenize(w)])
        return ids.tobytes()


class WordTokenizer:
    """A tokenizer whose words never reach over white space, with the ids of single words kept in a bounded cache."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = WordIds(self.tokenizer)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.words) > CACHE // 2:
            self.words.age()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Ids of all texts (no nulls): each different word of them is made a Python string and looked up once."""
        if len(self.words) > CACHE // 2:
            self.words.age()
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        kinds = words.flatten().dictionary_encode()
        held = list(map(self.words.__getitem__, kinds.dictionary.to_numpy(zero_copy_only=False).tolist()))
        at, ends = kinds.indices.to_numpy().tolist(), words.offsets.to_pylist()
        out = [b"".join(map(held.__getitem__, at[a:b])) for a, b in zip(ends, ends[1:])]
        for s in self.special:
            for i in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist():
                out[i] = self.encode(texts[i].as_py())
        return out


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def fill_closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes as near to room as it can without passing it."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n, k in counts.items() if k and n <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(part, left)
            steps.append((length, take, reach))
            reach = (reach | reach << length * take) & mask
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            taken[length] += take
            total -= length * take
    return dict(taken)


def pack_rests(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (index, start, length) that hold every unit of every rest exactly once."""
    stacks: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, n in enumerate(lengths):
        if n:
            stacks[n].append((i, 0))
    total, out = sum(lengths), []

    def pop(n: int) -> tuple[int, int, int]:
        i, start = stacks[n].pop()
        if not stacks[n]:
            del stacks[n]
        return i, start, n

    while total >= window:
        sequence = [pop(max(stacks))]
        room = window - sequence[0][2]
        for n, k in fill_closest({n: len(s) for n, s in stacks.items()}, room).items():
            sequence += [pop(n) for _ in range(k)]
            room -= n * k
        if room:  # all that remain are longer than the gap
            i, start, n = pop(min(stacks))
            sequence.append((i, start, room))
            stacks[n - room].append((i, start + room))
        out.append(sequence)
        total -= window
    rest = [pop(n) for n in sorted(stacks, reverse=True) for _ in range(len(stacks[n]))]
    size = 1 << max(0, total.bit_length() - 1)
    sequence, room = [], size
    while total:
        i, start, n = rest.pop(0)
        take = min(n, room)
        sequence.append((i, start, take))
        if n > take:
            rest.insert(0, (i, start + take, n - take))
        room, total = room - take, total - take
        if not room:
            out.append(sequence)
            sequence = []
            room = 1 << max(0, total.bit_length() - 1)
    return out


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    One row for each piece; the pieces of a document hold its ids and the end id once each, in order. Sequences
    hold window ids or a power of two. Null texts count as empty and are the end id alone; repeated rows are
    packed each; empty tables give no rows; further columns, whatever their names, are left out. The groups
    hold about `group` rests; full windows are dealt evenly whatever the length of their document.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    groups = max(1, math.ceil(docs.count() / group))
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        tok = tokenizer(path)
        for whole in batches:
            for batch in slices(whole, "text", *TEXTS):
                pick, starts, ids, sizes = [], [], [], []
                for i, found in enumerate(tok.encode_column(batch.column("text"))):
                    found += end
                    for b in range(0, len(found), 4 * window):
                        pick.append(i)
                        starts.append(b // 4)
                        ids.append(found[b : b + 4 * window])
                        sizes.append(len(found) // 4)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(pick)), pa.array(starts, pa.int64()), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "start", "ids", "doc_tokens"])

    pieces = rows.mapInArrow(cut, f"doc_id {kind}, start bigint, ids binary, doc_tokens bigint")
    # A group comes from the piece itself, so a task that runs again deals it out the same way.
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(groups)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        ids, first = [x.as_buffer() for x in table.column("ids").combine_chunks()], int(table.column("grp")[0].as_py()) << 32
        sizes = [len(x) // 4 for x in ids]
        short = [i for i, n in enumerate(sizes) if n < window]
        sequences = [[(i, 0, window)] for i, n in enumerate(sizes) if n == window]
        sequences += [[(short[i], s, n) for i, s, n in q] for q in pack_rests([sizes[i] for i in short], window)]
        flat = [(i, s, n, first + k, o) for k, q in enumerate(sequences) for (i, s, n), o in zip(q, np.cumsum([0, *(n for _, _, n in q)]).tolist())]
        at = pa.array([f[0] for f in flat], pa.int64())
        doc = table.select(["doc_id", "start", "doc_tokens"]).take(at)
        starts = np.array(doc.column("start"), dtype=np.int64) + np.array([f[1] for f in flat], dtype=np.int64)
        cols = {
            "doc_id": doc.column("doc_id").combine_chunks(), "start": pa.array(starts), "length": pa.array([f[2] for f in flat], pa.int64()),
            "ids": pa.array([ids[i][4 * s : 4 * (s + n)].to_pybytes() for i, s, n, _, _ in flat], pa.binary()), "doc_tokens": doc.column("doc_tokens").combine_chunks(),
            "sequence_id": pa.array([f[3] for f in flat], pa.int64()), "offset": pa.array([f[4] for f in flat], pa.int64()),
        }
        return pa.table(cols)

    return pieces.groupBy("grp").applyInArrow(pack, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
