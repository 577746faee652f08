"""Best-fit packing planned over a histogram of lengths.

Documents longer than a window are cut into windows; every piece then has one of at most `window` lengths. The plan
knows the number of pieces of each length alone: lengths are taken from the longest down, and each goes to the fullest
sequences that still have room, many equal sequences at once. So a plan has few entries (`Slots`), whatever the number
of documents: all its sequences of one make-up are one class, a length splits at most one class, and no sequence
has more than about ninety different lengths. Pieces then take the planned slots by their rank within their length.

Ranks need no task that sees all pieces of a length: a piece is numbered inside its input partition while it is cut,
and the counts of all (partition, length) are summed up to give where each partition's ranks start.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, slices, written
from .packing import TEXTS, tokenizer

WINDOW = 4096
#: Up to so many (partition, length) starts are sent to every task; more are joined by a shuffle.
SENT = 1 << 20
#: Bits of a rank beside a length in one long.
RANKS = 43


@dataclass(frozen=True)
class Slots:
    """Entries of a plan, sorted by length and first rank. Entry i: ranks from first[i] on, per[i] in each sequence
    from sequence[i] on, side by side from offset[i] on."""

    length: np.ndarray
    first: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def at(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and rank."""
        entry = np.searchsorted(self.length << RANKS | self.first, length << RANKS | rank, "right") - 1
        past = rank - self.first[entry]
        return self.sequence[entry] + past // self.per[entry], self.offset[entry] + past % self.per[entry] * length


def plan_best_fit(counts: dict[int, int], window: int = WINDOW) -> Slots:
    """The sequences that best fit, lengths falling, makes of so many pieces of each length.

    A class is a number of sequences with the same room and make-up; make-up entries are (length, how many in each
    sequence, rank of the first).
    """
    by_room: dict[int, list[tuple[int, list[tuple[int, int, int]]]]] = defaultdict(list)
    rooms = 0  # bit r: some sequence has room r

    def put(number: int, room: int, made: list[tuple[int, int, int]]) -> None:
        nonlocal rooms
        if number:
            by_room[room].append((number, made))
            rooms |= 1 << room

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        while left:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                number, made = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, number, made = window, -(-left // (window // length)), []
            # As many as it holds go into each sequence; one sequence may take the rest; others stay as they are.
            each = room // length
            full = min(number, left // each)
            put(full, room - each * length, [*made, (length, each, rank)])
            left, rank = left - full * each, rank + full * each
            behind = [(n, k, first + full * k) for n, k, first in made]
            if left and full < number:
                put(1, room - left * length, [*behind, (length, left, rank)])
                behind = [(n, k, first + k) for n, k, first in behind]
                full, left = full + 1, 0
            put(number - full, room, behind)
    entries, sequence = [], 0
    for _, classes in sorted(by_room.items()):
        for number, made in classes:
            offset = 0
            for length, each, first in made:
                entries.append((length, first, each, sequence, offset))
                offset += length * each
            sequence += number
    table = np.array(sorted(entries), dtype=np.int64).reshape(-1, 5)
    return Slots(*table.T.copy(), sequence)


def cut_pieces(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """doc_id, piece, start, length, ids, part and local: the pieces of (doc_id, text), each numbered among the pieces
    of its length in its input partition, as a table."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids", "part", "local"]

    def cut(batches):
        tok, part, met = tokenizer(path), TaskContext.get().partitionId(), [0] * (window + 1)
        for whole in batches:
            for batch in slices(whole, "text", *TEXTS):
                pick, pieces, ids, lengths, local = [], [], [], [], []
                for i, found in enumerate(tok.encode_column(batch.column("text"))):
                    found += end
                    for k, b in enumerate(range(0, len(found), 4 * window)):
                        piece = found[b : b + 4 * window]
                        n = len(piece) // 4
                        pick.append(i)
                        pieces.append(k)
                        ids.append(piece)
                        lengths.append(n)
                        local.append(met[n])
                        met[n] += 1
                k = pa.array(pieces, pa.int32())
                starts = pa.array([window * p for p in pieces], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(pick)), k, starts, pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(pick), pa.int32()), pa.array(local, pa.int64())], names=names
                )

    return written(docs.mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, part int, local bigint"), "best-fit-pieces")


def pack_best_fit(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece (from 0), start, length, ids (binary, little-endian unsigned 32-bit), sequence_id, offset.

    One row for each piece. A document is its ids and the end id; only longer ones than a window are cut, into whole
    windows and a last piece. Sequences hold at most window ids, without gaps from offset 0, and number from 0. Null
    texts count as empty and are the end id alone; repeated rows are packed each, null ids too; equal lengths may
    change places; empty tables give no rows; further columns, whatever their names, are left out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = cut_pieces(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), path, end_id, window)
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "best-fit-counts")
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `window` rows
    slots = plan_best_fit({r["length"]: r["n"] for r in lengths}, window)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(F.broadcast(starts) if counts.count() <= SENT else starts, ["part", "length"])

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def slot(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = slots.at(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["sequence_id", "offset"])

    placed = ranked.withColumn("slot", slot("length", F.col("base") + F.col("local")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "slot.sequence_id", "slot.offset")
