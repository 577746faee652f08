"""Repeated passages, found with suffix arrays built by two-stage sorting.

A byte is removed if a string of `length` bytes that covers it also starts somewhere else. The windows of that
length are dealt out by their minimiser, the smallest hash among their seeds: equal windows choose equal seeds, so
a bucket holds every copy of its windows, as short stretches of text. Equal stretches are counted without their
text. Where one seed has several different stretches, one text of each goes into a suffix array: suffixes smaller
than their successor are sorted directly, the others are placed by scanning the buckets of first bytes, and
neighbours with a common prefix of `length` bytes are repeats. A seed with too many different stretches is split
by the place of the seed in the window, again and again down to single windows, so no group grows with the corpus.

Equal stretches are told by 128 bits, those of the seed's and the stretch's hash, and by place and length; their
bytes are not compared. Suffixes are sorted where the stretches of one seed differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .word_hash import column_bytes, mixed

LENGTH = 400
SLICE = 1 << 19
#: Different stretches of one seed that are sorted together; more are split.
TOGETHER = 300
#: Bytes sorted together.
ARRAY = 200_000
#: Stretches of one seed for each part of it in a join.
PART = 1000
_PLACE = np.uint64((1 << 22) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(4).integers(1, 1 << 63, size=256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        n = SLICE + LENGTH * 2
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers


def seed_bytes(length: int) -> int:
    """Bytes of a seed: a power of two, two fifths of a window at most."""
    return 1 << ((2 * length // 5).bit_length() - 1)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = seed_bytes(LENGTH)):
    """(text, first window, windows, seed place, seed hash, digest): all windows of all texts, cut where the minimiser changes.

    data holds at most SLICE bytes and a window more; the seed place counts from the first window.
    """
    n = len(data)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none, none, none
    up, down = _power_tables()
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:n], dtype=np.uint64)])
        hashes = mixed((sums[seed:] - sums[:-seed]) * down[: n - seed + 1])
    low = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    reach, need = 1, length - seed + 1
    while reach * 2 <= need:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if need > reach:
        low = np.minimum(low[: len(low) - (need - reach)], low[need - reach :])
    place = (low & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    good = np.arange(len(place)) + length <= offsets[row + 1]
    at = np.flatnonzero(good)
    if not len(at):
        return none, none, none, none, none, none
    new = np.concatenate([[True], (place[at][1:] != place[at][:-1]) | (at[1:] != at[:-1] + 1)])
    first = at[new]
    count = np.diff(np.append(np.flatnonzero(new), len(at)))
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    digests = np.fromiter((digest(view[s : s + c - 1 + length]) for s, c in zip(first.tolist(), count.tolist())), np.uint64, len(first))
    return row[first], first - offsets[row[first]], count, place[first] - first, hashes[place[first]].view(np.int64), digests.view(np.int64)


def suffix_order(text: bytes, depth: int, starts: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of text that begin where `starts` is true (all without it) by their first `depth` bytes at least.

    Two-stage sorting. A suffix is placed by way of its successor, so each run of starts goes on to the next suffix
    that is smaller than its successor; those in between are sorted with the others and left out of the result.
    """
    t = np.frombuffer(text, dtype=np.uint8)
    n = len(t)
    edges = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)  # last place of each run of one byte
    rises = np.append(t[np.minimum(edges[:-1] + 1, n - 1)] > t[edges[:-1]], False)
    smaller = np.repeat(rises, np.diff(np.concatenate([[-1], edges])))  # than its successor
    taking = np.ones(n, dtype=bool)
    if starts is not None:
        last = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
        stop = np.concatenate([[-1], np.maximum.accumulate(np.where(smaller, np.arange(n), -1))[:-1]])
        taking = starts | (last >= 0) & (stop < last)
    direct = sorted(np.flatnonzero(smaller & taking).tolist(), key=lambda i: text[i : i + depth])
    direct = np.array(direct, dtype=np.int64)
    ends = np.searchsorted(t[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    placed: list[list[np.ndarray]] = [[] for _ in range(256)]
    if taking[n - 1]:
        placed[t[n - 1]].append(np.array([n - 1]))
    induced = taking & ~smaller
    out = []
    for c in range(256):
        done, new = [], np.concatenate(placed[c]) if placed[c] else np.empty(0, np.int64)
        while len(new):
            done.append(new)
            new = new[new > 0] - 1
            new = new[induced[new] & (t[new] == c)]
        whole = np.concatenate([*done, direct[ends[c] : ends[c + 1]]])
        if len(whole):
            out.append(whole)
            left = whole[whole > 0] - 1
            left = left[induced[left] & (t[left] > c)]
            if len(left):
                order = np.argsort(t[left], kind="stable")
                left = left[order]
                cuts = np.flatnonzero(np.diff(t[left])) + 1
                for part in np.split(left, cuts):
                    placed[t[part[0]]].append(part)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    return order if starts is None else order[starts[order]]


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its windows occur at another place of these texts."""
    joined = b"".join(texts)
    flags = np.zeros(len(joined), dtype=bool)
    starts = np.cumsum([0, *map(len, texts)])
    if len(joined) >= length:
        is_window = np.zeros(len(joined), dtype=bool)
        for s, t in zip(starts, texts):
            is_window[s : s + max(0, len(t) - length + 1)] = True
        order = suffix_order(joined, length, is_window)
        t = np.frombuffer(joined, dtype=np.uint8)
        a, b = order[:-1], order[1:]
        for at in (0, length - 1, length // 2, length // 4, 3 * length // 4):
            same = t[a + at] == t[b + at]
            a, b = a[same], b[same]
        for x, y in zip(a.tolist(), b.tolist()):
            if joined[x : x + length] == joined[y : y + length]:
                flags[x] = flags[y] = True
    return [flags[s : s + max(0, len(t) - length + 1)] for s, t in zip(starts, texts)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - edges[::2]


_SPAN = "kh long, kg int, first long, windows long"
_STRETCH = _SPAN + ", place long, seed long, digest long"
_HELD = _STRETCH + ", alone boolean, content binary"


def _scan(docs: DataFrame, length: int, seed: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("content"))
            kh, kg = np.asarray(batch.column("kh")), np.asarray(batch.column("kg"))
            at = 0
            while at < len(kh):
                end = at + 1
                while end < len(kh) and offsets[end + 1] - offsets[at] <= SLICE:
                    end += 1
                begin = offsets[at]
                if offsets[end] - begin <= SLICE:
                    pieces = [(begin, offsets[at : end + 1] - begin, 0)]
                else:  # one long text, in slices that overlap by a window less one byte
                    pieces = []
                    for p in range(0, int(offsets[end] - begin), SLICE):
                        size = min(SLICE + length - 1, int(offsets[end] - begin) - p)
                        pieces.append((begin + p, np.array([0, size]), p))
                for start, cuts, shift in pieces:
                    row, first, count, place, hashed, digest = stretches(data[start : start + cuts[-1]], cuts, length, seed)
                    cols = [kh[at + row], kg[at + row], first + shift, count, place, hashed, digest]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kh", "kg", "first", "windows", "place", "seed", "digest"])
                at = end

    return docs.mapInArrow(run, _STRETCH)


def _cut_out(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The stretches in wanted, with their bytes."""
    lists = wanted.groupBy("kh", "kg").agg(F.collect_list(F.struct("first", "windows", "place", "seed", "digest", "alone")).alias("parts"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                out: list[tuple] = []
                for kh, kg, text, parts in zip(*(batch.column(c).to_pylist() for c in ("kh", "kg", "content", "parts"))):
                    out += [(kh, kg, p["first"], p["windows"], p["place"], p["seed"], p["digest"], p["alone"], text[p["first"] : p["first"] + p["windows"] - 1 + length]) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), _KINDS)], names=_NAMES)

    return docs.join(lists, ["kh", "kg"]).select("kh", "kg", "content", "parts").mapInArrow(run, _HELD)


_NAMES = ["kh", "kg", "first", "windows", "place", "seed", "digest", "alone", "content"]
_KINDS = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_(), pa.binary()]


def _sorted_out(held: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows among the stretches that stand alone, by suffix arrays of whole seeds."""

    def solve(items: list[dict]):
        found = repeated_windows([i["content"] for i in items], length)
        out = []
        for i, flags in zip(items, found):
            if i["alone"]:
                out += [(i["kh"], i["kg"], i["first"] + int(s), int(c)) for s, c in zip(*_runs(flags))]
        return out

    def run(batches):
        waiting, size, spans = [], 0, []
        for batch in batches:
            for item in batch.to_pylist():
                if waiting and size > ARRAY and item["seed"] != waiting[-1]["seed"]:
                    spans += solve(waiting)
                    waiting, size = [], 0
                waiting.append(item)
                size += len(item["content"])
            yield _spans(spans)
            spans = []
        yield _spans(solve(waiting) if waiting else [])

    return held.repartition("seed").sortWithinPartitions("seed").mapInArrow(run, _SPAN)


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS)], names=_NAMES[:4])


def _halved(held: DataFrame, size: int, length: int) -> DataFrame:
    """Stretches cut so that the seed's place in the window stays inside one aligned range of `size` places.

    Equal windows have the seed at the same place, so they meet again under the bytes that all windows of the
    range share.
    """

    def run(batches):
        for batch in batches:
            out = []
            for i in batch.to_pylist():
                most, least, start = i["place"], i["place"] - i["windows"] + 1, i["first"]
                for lo in range(least // size * size, most + 1, size):
                    high, low = min(lo + size - 1, most), max(lo, least)
                    text = i["content"][most - high : most - low + length]
                    # Shared by all windows of the range: from `lo` before the seed to length - (lo + size - 1) after.
                    shared = i["content"][most - lo : most - (lo + size - 1) + length]
                    seed = xxhash.xxh3_64_intdigest(shared, seed=lo + 1)
                    digest = xxhash.xxh3_64_intdigest(text)
                    sign = lambda x: x - (1 << 64) if x >> 63 else x
                    out.append((i["kh"], i["kg"], start + most - high, high - low + 1, high, sign(seed), sign(digest), i["alone"], text))
            columns = list(zip(*out)) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS)], names=_NAMES)

    return held.mapInArrow(run, _HELD)


_SAME = ["seed", "digest", "place", "windows"]


def repeat_spans(keyed: DataFrame, length: int = LENGTH, seed: int | None = None, together: int = TOGETHER) -> DataFrame:
    """(kh, kg, first, windows): runs of windows that also start elsewhere, for texts (kh, kg, content)."""
    seed = seed or seed_bytes(length)
    cut = written(_scan(keyed.select("kh", "kg", "content"), length, seed), "stretches")
    # Least and greatest numbers, not structs, which Spark would sort all stretches for.
    same = [F.min(c) == F.max(c) for c in ("digest", "place", "windows")]
    # Written, so that the join with it can split a seed that very many texts share.
    seeds = written(cut.groupBy("seed").agg(F.count("*").alias("n"), (same[0] & same[1] & same[2]).alias("same")).where("n > 1"), "seeds")
    many = written(cut.join(seeds, "seed"), "shared-seeds")
    spans = [many.where("same").select("kh", "kg", "first", "windows")]
    mixed_ = many.where("not same")
    # A stretch that very many share would meet its kind in one task: seeds of many stretches are dealt out in parts,
    # and a kind goes to the parts that hold it, however many there are.
    dealt = mixed_.withColumn("part", F.pmod(F.xxhash64("kh", "first"), F.ceil(F.col("n") / PART)))
    in_parts = dealt.groupBy(*_SAME, "part").agg(F.count("*").alias("copies"), F.max("n").alias("n"), F.min(F.struct("kh", "kg", "first")).alias("rep"))
    in_parts = written(in_parts, "stretch-parts")
    whole, hot = in_parts.where(f"n <= {PART}"), in_parts.where(f"n > {PART}")
    hot_kinds = written(hot.groupBy(*_SAME).agg(F.sum("copies").alias("copies"), F.min("rep").alias("rep")), "stretch-kinds")
    kinds = whole.select(*_SAME, "copies", "rep").unionByName(hot_kinds)
    shared = whole.where("copies > 1").select(*_SAME, "part")
    shared = shared.unionByName(hot.join(hot_kinds.where("copies > 1"), _SAME, "left_semi").select(*_SAME, "part"))
    # Spans are written as they are found: all rounds in one query would plan and run some dozens of joins at once,
    # more than the driver's memory holds.
    spans.append(written(dealt.join(shared, [*_SAME, "part"]).select("kh", "kg", "first", "windows"), "spans"))
    wanted = kinds.select("rep.*", *_SAME, (F.col("copies") == 1).alias("alone"))
    held = written(_cut_out(keyed, wanted, length), "stretch-texts")
    size = 1 << (length - seed).bit_length()
    while True:
        crowds = written(held.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > together).select("seed"), "crowded-seeds")
        spans.append(written(_sorted_out(held.join(crowds, "seed", "left_anti").select(*_NAMES), length), "spans"))
        if size == 1 or crowds.isEmpty():
            break
        size //= 2
        parts = written(_halved(held.join(crowds, "seed").select(*_NAMES), size, length), "split-stretches")
        kinds = parts.groupBy(*_SAME).agg(F.count("*").alias("copies"), F.min(F.struct("kh", "kg", "first", "content", "alone")).alias("rep"))
        kinds = written(kinds, "split-kinds")
        shared = kinds.where("copies > 1").select(*_SAME)
        spans.append(written(parts.where("alone").join(shared, _SAME).select("kh", "kg", "first", "windows"), "spans"))
        company = kinds.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
        lone = (F.col("copies") == 1) & F.col("rep.alone")
        held = kinds.join(company, "seed").select("rep.kh", "rep.kg", "rep.first", "windows", "place", "seed", "digest", lone.alias("alone"), "rep.content")
        held = written(held.select(*_NAMES), "stretch-texts")
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


_REGION = "kh long, kg int, base long, content binary, longest long"


def _regions(rows: DataFrame, spans: DataFrame, length: int, longer: int) -> DataFrame:
    """For each text with spans one row without content that tells its longest run, and each run of `longer` bytes."""
    lists = spans.groupBy("kh", "kg").agg(F.collect_set(F.struct("first", "windows")).alias("runs"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                out: list[tuple] = []
                for kh, kg, text, runs in zip(*(batch.column(c).to_pylist() for c in ("kh", "kg", "content", "runs"))):
                    merged = [(r["first"], r["first"] + r["windows"] - 1 + length) for r in _touching(runs)]
                    out.append((kh, kg, None, None, max(b - a for a, b in merged)))
                    out += [(kh, kg, a, text[a:b], None) for a, b in merged if b - a >= longer]
                cols = [pa.array(list(c), k) for c, k in zip(zip(*out), [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()])]
                yield pa.RecordBatch.from_arrays(cols, names=["kh", "kg", "base", "content", "longest"])

    return rows.join(lists, ["kh", "kg"]).select("kh", "kg", "content", "runs").mapInArrow(run, _REGION)


def _touching(runs: list[dict]) -> list[dict]:
    """Runs of windows, those that follow one another without a gap put together."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: (r["first"], r["windows"])):
        if out and r["first"] <= out[-1]["first"] + out[-1]["windows"]:
            out[-1]["windows"] = max(out[-1]["windows"], r["first"] + r["windows"] - out[-1]["first"])
        else:
            out.append(dict(r))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), report: int | None = None) -> DataFrame:
    """doc_id, kept columns, n_bytes, n_removed, spans (array of start and length), kept (the remaining bytes), longest_run.

    One row for each row of docs. Texts are UTF-8 bytes, null ones empty; windows never cross texts, and are
    judged on the input; of a repeated row both copies are removed; empty tables give no rows; further columns,
    whatever their names, are left out.

    longest_run: bytes of the longest run in which every string of `report` bytes (at most, and by default,
    `length`) also starts elsewhere; 0 if there is none. A smaller `report` finds these runs first, and the
    windows of `length` bytes are then looked for in them alone, since all of them lie there.
    """
    bounded_batches(docs.sparkSession)
    report = min(report or length, length)
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("content"))
    rows = rows.withColumns({"kh": F.xxhash64("doc_id", "content"), "kg": F.hash("content", "doc_id")})
    spans = repeat_spans(rows.where(F.length("content") >= report), report)
    none = F.lit(None).cast("bigint")
    if report < length:
        found = written(_regions(rows, spans, report, length), "regions")
        inner = found.where("base is not null").withColumns({"h": F.xxhash64("kh", "kg", "base"), "g": F.hash("base", "kg", "kh")})
        spans = repeat_spans(inner.select(F.col("h").alias("kh"), F.col("g").alias("kg"), "content"), length)
        back = inner.select("h", "g", F.col("kh").alias("of_kh"), F.col("kg").alias("of_kg"), "base").distinct()
        spans = spans.join(back, (spans["kh"] == back["h"]) & (spans["kg"] == back["g"])).select(F.col("of_kh").alias("kh"), F.col("of_kg").alias("kg"), (F.col("first") + F.col("base")).alias("first"), "windows")
        spans = spans.withColumn("longest", none).unionByName(found.where("base is null").select("kh", "kg", none.alias("first"), none.alias("windows"), "longest"))
    else:
        spans = spans.withColumn("longest", none)
    runs = F.collect_set(F.when(F.col("first").isNotNull(), F.struct("first", "windows")))
    spans = spans.groupBy("kh", "kg").agg(runs.alias("runs"), F.max("longest").alias("longest"))
    names = ["doc_id", *keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    schema += ", n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,length:bigint>>, kept binary, longest_run bigint"
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                out: list[tuple] = []
                for text, runs, longest in zip(*(batch.column(c).to_pylist() for c in ("content", "runs", "longest"))):
                    merged: list[list[int]] = []
                    for first, windows in sorted((r["first"], r["windows"]) for r in runs or ()):
                        end = first + windows - 1 + length
                        if merged and first <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], end)
                        else:
                            merged.append([first, end])
                    if longest is None:
                        longest = max((r["windows"] - 1 + length for r in _touching(runs or [])), default=0)
                    edges = [0, *(x for m in merged for x in m), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    out.append((len(text), len(text) - len(kept), [{"start": a, "length": b - a} for a, b in merged], kept, longest))
                cols = [pa.array(list(c), k) for c, k in zip(zip(*out), [pa.int64(), pa.int64(), span, pa.binary(), pa.int64()])]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *cols], names=[*names, "n_bytes", "n_removed", "spans", "kept", "longest_run"])

    return rows.join(spans, ["kh", "kg"], "left").select(*names, "content", "runs", "longest").mapInArrow(run, schema)
