"""Approximate nearest neighbours by inner product over shifted space-filling curves.

Vectors are lifted so that the largest inner product is the nearest point (one more coordinate brings every
candidate to one length), projected by several random rotations, shifted, and ordered along Hilbert curves by
range partitioning. In every ordering a query meets the candidates within a window of ranks around its own place;
the windows of all orderings are merged on bounds from codes of a byte a component, and the few candidates left
are reranked by the exact product. The window is measured: for a bounded sample of queries the true neighbours are
found by brute force over all candidates, and the window is the one that reaches the wanted recall on them. Where
vectors lie in clusters it is small; where directions are random all around, no ordering spares most of the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import row_key, written


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of cells along a Hilbert curve (Skilling, 2004), all rows at once."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[n - 1] & (1 << level)) != 0, turn ^ ((1 << level) - 1), turn)
    x ^= turn
    key = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


class Curves:
    """Rotations, shifts and cells of all orderings."""

    def __init__(self, size: int, longest: float, curves: int, dims: int, seed: int):
        rng = np.random.default_rng(seed)
        dims = min(dims, size + 1)
        self.longest, self.bits = longest, 60 // dims
        self.planes = [np.linalg.qr(rng.normal(size=(size + 1, dims)))[0] for _ in range(curves)]
        self.shifts = rng.uniform(0, 0.25, size=(curves, dims))

    def keys(self, x: np.ndarray, query: bool) -> np.ndarray:
        """One row for each vector, one column for each curve."""
        norm = np.linalg.norm(x, axis=1)
        if query:
            lifted = np.column_stack([x * (self.longest / norm)[:, None], np.zeros(len(x))])
        else:
            lifted = np.column_stack([x, np.sqrt(np.maximum(self.longest**2 - norm**2, 0))])
        out = np.empty((len(x), len(self.planes)), dtype=np.int64)
        for i, (plane, shift) in enumerate(zip(self.planes, self.shifts)):
            unit = (lifted @ plane / self.longest + 1) / 2.5 + shift * 0.8
            out[:, i] = hilbert_keys(np.clip(unit * (1 << self.bits), 0, (1 << self.bits) - 1), self.bits)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of a row, larger first, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero((scores >= least) & (scores > -np.inf))
    else:
        at = np.flatnonzero(scores > -np.inf)
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def usable(embedding: Column) -> Column:
    ok = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(embedding, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def _length(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, curves: int = 24, dims: int = 15, recall: float = 0.94, sample: int = 200, block: int = 2048, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row its k nearest other rows that were found.

    is_query selects the queries by id_col. Vectors that are null, empty, zero, of another length than most, or
    hold null or non-finite components take no part, nor do rows with a null id. Rows with equal vectors are
    searched once and share the result, whatever their number; ties go to smaller ids; a repeated row counts as
    one candidate. If fewer than k candidates exist, all are returned; empty tables give no rows. The curves need
    no training; the window is set on at most `sample` queries, against all rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    schema = "query_id long, rank int, vec_id long, score double"
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return rows.sparkSession.createDataFrame([], schema)
    size = size["n"]
    rows = rows.where(F.size("v") == size).select("vec_id", "is_query", row_key("v").alias("cls"), "v")

    # One row for each distinct vector with its k + 1 smallest ids; only so many leave a task for any vector.
    few = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("cls").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    asked = rows.where("is_query").select("vec_id", "cls").distinct()
    classes = few.groupBy("cls").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("v").alias("v"))
    classes = classes.join(asked.select("cls").distinct().withColumn("asked", F.lit(True)), "cls", "left")
    classes = written(classes.select(F.col("ids")[0].alias("cid"), "cls", "ids", "v", F.coalesce("asked", F.lit(False)).alias("asked")), "vectors")
    longest = classes.agg(F.max(_length("v"))).first()[0]
    grid = Curves(size, float(longest), curves, dims, seed)

    def place(batches):
        for batch in batches:
            x, cid, asks = _matrix(batch.column("v")), np.asarray(batch.column("cid")), np.array(batch.column("asked").to_pylist(), dtype=bool)
            for which, pick in ((False, slice(None)), (True, asks)):
                if len(cid[pick]):
                    keys = grid.keys(x[pick], which)
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(curves, dtype=np.int32), n)), pa.array(keys.ravel()), pa.array(np.repeat(cid[pick], curves)), pa.array(np.full(n * curves, which))],
                        names=["curve", "key", "cid", "q"],
                    )

    placed = classes.select("cid", "v", "asked").mapInArrow(place, "curve int, key long, cid long, q boolean")
    parts = max(curves, rows.sparkSession.sparkContext.defaultParallelism)
    ordered = placed.repartitionByRange(parts, "curve", "key", "cid", "q").sortWithinPartitions("curve", "key", "cid", "q")

    def number(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            curve, q = np.asarray(batch.column("curve")), np.array(batch.column("q").to_pylist(), dtype=bool)
            local = np.zeros(len(q), dtype=np.int64)
            for c in np.unique(curve):
                at = curve == c
                real = (~q[at]).astype(np.int64)
                local[at] = seen.get(c, 0) + np.cumsum(real) - real
                seen[c] = seen.get(c, 0) + int(real.sum())
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("part", "curve", "cid", "q")] + [pa.array(local)], names=["part", "curve", "cid", "q", "local"])

    ordered = ordered.withColumn("part", F.spark_partition_id()).select("part", "curve", "cid", "q")
    ranked = written(ordered.mapInArrow(number, "part int, curve int, cid long, q boolean, local long"), "curve-ranks")
    # One count for each curve and range partition; their running sums turn local places into ranks.
    ends = ranked.groupBy("curve", "part").agg(F.sum(F.when(F.col("q"), 0).otherwise(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = F.broadcast(ends.select("curve", "part", before.alias("base")))  # at most curves + partitions rows
    ranked = ranked.join(bases, ["curve", "part"]).select("curve", "cid", "q", (F.col("base") + F.col("local")).alias("rank"))

    window = _window(classes, ranked, k, recall, sample, size)
    found = _search(classes, ranked, window, max(block, window), k, size)
    # The curves' hits merge on bounds alone; the few that may be among the k + 1 best get their exact product.
    merged = found.repartition("qid").groupBy("qid", "cid").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    best = Window.partitionBy("qid").orderBy(F.desc("low"), "cid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = F.coalesce(F.nth_value("low", k + 1).over(best), F.lit(float("-inf")))
    pairs = merged.withColumn("least", least).where("high >= least").select("qid", "cid")
    pairs = pairs.join(classes.select("cid", "v"), "cid").join(classes.where("asked").select(F.col("cid").alias("qid"), F.col("v").alias("w")), "qid")
    # Hits are classes; each stands for its k + 1 smallest ids.
    hits = pairs.select("qid", "cid", F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x).alias("score"))
    hits = hits.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    hits = hits.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    lists = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("hits"))
    own = asked.join(classes.where("asked").select("cls", F.col("cid").alias("qid")), "cls").select(F.col("vec_id").alias("query_id"), "qid")
    out = own.join(lists, "qid").select("query_id", F.posexplode(F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)).alias("p", "h"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "h.vec_id", "h.score")


def _window(classes: DataFrame, ranked: DataFrame, k: int, recall: float, sample: int, size: int) -> int:
    """Ranks to look at on either side so that the sampled queries' true neighbours are found at the wanted rate."""
    probes = classes.where("asked").orderBy(F.xxhash64("cid"), "cid").limit(sample).select("cid", "v").collect()
    if not probes:
        return 1
    qid, q = np.array([p["cid"] for p in probes]), np.array([p["v"] for p in probes])

    def brute(batches):
        ids, scores = [np.empty(0, np.int64)] * len(q), [np.empty(0)] * len(q)
        for batch in batches:
            cid = np.asarray(batch.column("cid"))
            product = q @ _matrix(batch.column("v")).T
            for i in range(len(q)):
                product[i, cid == qid[i]] = -np.inf
                at = _best(product[i], cid, k)
                both_i, both_s = np.concatenate([ids[i], cid[at]]), np.concatenate([scores[i], product[i, at]])
                keep = _best(both_s, both_i, k)
                ids[i], scores[i] = both_i[keep], both_s[keep]
        n = [len(i) for i in ids]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, n)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], names=["qid", "cid", "score"])

    true = classes.select("cid", "v").mapInArrow(brute, "qid long, cid long, score double")
    true = true.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid"))).where(F.col("n") <= k).select("qid", "cid")
    ids = F.broadcast(true)  # at most sample * k rows
    spots = ranked.where("not q").join(ids, "cid").select("qid", "cid", "curve", "rank")
    mine = F.broadcast(ranked.where(F.col("q") & F.col("cid").isin(qid.tolist())).select(F.col("cid").alias("qid"), "curve", F.col("rank").alias("mine")))  # at most sample * curves rows
    gaps = spots.join(mine, ["qid", "curve"]).groupBy("qid", "cid").agg(F.min(F.abs(F.col("rank") - F.col("mine"))).alias("gap"))
    got = [r["gap"] for r in gaps.select("gap").collect()]
    return int(np.ceil(np.quantile(got, recall))) + 1 if got else 1


def _codes(classes: DataFrame, size: int) -> DataFrame:
    """cid, code (a byte for each component), scale and slack: slack is the length of what the code leaves out."""

    def code(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            if len(x):
                scale = np.abs(x).max(axis=1) / 127
                codes = np.rint(x / scale[:, None]).astype(np.int8)
                slack = np.linalg.norm(x - codes * scale[:, None], axis=1)
                raw = codes.tobytes()
                cut = pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("cid"), cut, pa.array(scale), pa.array(slack)], names=["cid", "code", "scale", "slack"])

    return classes.select("cid", "v").mapInArrow(code, "cid long, code binary, scale double, slack double")


HITS = "qid long, cid long, low double, high double"
#: Queries scored together; they lie side by side on a curve, so they share most of their windows.
TOGETHER = 16


def _search(classes: DataFrame, ranked: DataFrame, window: int, width: int, k: int, size: int) -> DataFrame:
    """For each query and block of `width` ranks of each curve, the candidates in the query's window that may be among its k + 1 best.

    Blocks hold codes of a byte a component. A code and its slack bound the true product on both sides, so no
    candidate is left out whose product reaches the k + 1 best of the window.
    """
    cands = ranked.where("not q").join(_codes(classes, size), "cid").select("curve", F.floor(F.col("rank") / width).alias("block"), "cid", "rank", "code", "scale", "slack")
    spans = F.sequence(F.floor(F.greatest(F.col("rank") - window, F.lit(0)) / width), F.floor((F.col("rank") + window) / width))
    places = ranked.where("q").select(F.col("curve").alias("q_curve"), F.col("cid").alias("qid"), F.col("rank").alias("place"), F.explode(spans).alias("q_block"))
    asks = places.join(classes.where("asked").select(F.col("cid").alias("qid"), F.transform("v", lambda x: x.cast("float")).alias("w"), _length("v").alias("len")), "qid")
    asks = asks.select("q_curve", "q_block", "qid", "place", "w", "len")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0)]]
        if left.num_rows and right.num_rows:
            left, right = left.sort_by("rank"), right.sort_by("place")
            rank, cid, slack = (np.asarray(left.column(n)) for n in ("rank", "cid", "slack"))
            x = np.frombuffer(b"".join(left.column("code").to_pylist()), np.int8).reshape(len(rank), size) * np.asarray(left.column("scale"))[:, None]
            y, place, qid, length = _matrix(right.column("w")), *(np.asarray(right.column(n)) for n in ("place", "qid", "len"))
            # What rounding the query to 32 bits and the summing may add to the error.
            slack = slack + 1e-6 * (np.linalg.norm(x, axis=1) + slack)
            for at in range(0, len(y), TOGETHER):
                near = slice(np.searchsorted(rank, place[at] - window), np.searchsorted(rank, place[min(at + TOGETHER, len(y)) - 1] + window, "right"))
                scores = y[at : at + TOGETHER] @ x[near].T
                for i, row in enumerate(scores, at):
                    inside = np.flatnonzero(np.abs(rank[near] - place[i]) <= window)
                    low = row[inside] - length[i] * slack[near][inside]
                    if len(low) > k + 1:
                        inside = inside[row[inside] + length[i] * slack[near][inside] >= np.partition(low, len(low) - k - 1)[len(low) - k - 1]]
                    at_row = inside + near.start
                    # Summed anew, vector by vector: a matrix product's last bit depends on the block.
                    score, error = (x[at_row] * y[i]).sum(axis=1), length[i] * slack[at_row]
                    for column, part in zip(out, (np.full(len(at_row), qid[i]), cid[at_row], score - error, score + error)):
                        column.append(part)
        return pa.table([pa.array(np.concatenate(column)) for column in out], names=["qid", "cid", "low", "high"])

    return cands.groupBy("curve", "block").cogroup(asks.groupBy("q_curve", "q_block")).applyInArrow(meet, HITS)
