"""Whitening of embeddings by a compensated covariance.

Vectors become whole numbers first. Each different vector counts once. Their mean is subtracted before anything is
multiplied, and centred values, products and sums are held as pairs of doubles whose sum is exact far beyond a double
(sums and products with their rounding errors, which doubles hold exactly). Every task adds up its own outer products;
the pairs of all tasks are then merged, high and low parts together, first within groups of tasks, then over the
groups. The sums for one dimension are one row, so what is merged, sent and held by the driver depends on the number
of dimensions alone, not on the number of vectors. The eigen-solve reduces the covariance to a tridiagonal matrix and
divides and conquers that (LAPACK's syevd, which numpy calls).
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Sums of tasks are merged in so many groups first.
FAN = 64
#: Rows of a block of outer products.
BLOCK = 512
LONG = 1 << 63


def two_sum(a, b):
    """(s, e): s is the rounded sum, s + e the exact one."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a):
    """a as a sum of two doubles of at most 26 bits each."""
    t = a * 134217729.0  # 2 ** 27 + 1
    high = t - (t - a)
    return high, a - high


def two_product(a, b, a_halves, b_halves):
    """(p, e): p is the rounded product, p + e the exact one."""
    (ah, al), (bh, bl), p = a_halves, b_halves, a * b
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def pair_sum(ah, al, bh, bl):
    """The sum of two pairs as a pair."""
    s, e = two_sum(ah, bh)
    e = e + (al + bl)
    high = s + e
    return high, e - (high - s)


def pair_total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of pairs along the first axis, halving it again and again."""
    while len(high) > 1:
        half = len(high) // 2
        h, l = pair_sum(high[:half], low[:half], high[half : 2 * half], low[half : 2 * half])
        if len(high) % 2:
            h, l = np.concatenate([h, high[-1:]]), np.concatenate([l, low[-1:]])
        high, low = h, l
    return high[0], low[0]


def whole_pairs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit integers as pairs of doubles, exactly: both 32-bit halves are doubles."""
    return two_sum((x >> 32).astype(np.float64) * 4294967296.0, (x & 0xFFFFFFFF).astype(np.float64))


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    high, low = whole_pairs(x)
    return pair_sum(high, low, -mean[0], -mean[1])


def outer_sums(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray], sums: list[tuple[np.ndarray, np.ndarray]] | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Adds the outer products of the centred rows to sums; item i holds the products of dimension i with i, i+1, ..."""
    for at in range(0, len(x), BLOCK):
        high, low = centred(x[at : at + BLOCK], mean)
        parts, out = halves(high), []
        for i in range(x.shape[1]):
            a, b = high[:, i : i + 1], high[:, i:]
            p, e = two_product(a, b, tuple(h[:, i : i + 1] for h in parts), tuple(h[:, i:] for h in parts))
            e = e + (a * low[:, i:] + low[:, i : i + 1] * b)
            out.append(pair_total(*two_sum(p, e)))
        sums = out if sums is None else [pair_sum(*s, *o) for s, o in zip(sums, out)]
    return sums or []


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass(frozen=True)
class Whitening:
    """What a fit found. sums are exact; eigenvalues fall; components are rows, their largest entry positive."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    rank: int

    @property
    def dims(self) -> int:
        return len(self.sums)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exactly: as 64-bit integers, or Python's where those are too small."""
        largest = self.n * int(max(abs(int(x.min())), abs(int(x.max())))) if x.size else 0
        if largest + max(map(abs, self.sums), default=0) < LONG:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def squares(self, d: np.ndarray) -> list[int | None]:
        """Sums of squares of each row; null beyond a long."""
        if d.dtype != object and (not d.size or int(np.abs(d).max()) ** 2 * self.dims < LONG):
            return (d * d).sum(axis=1).tolist()
        return [s if s < LONG else None for s in (int(sum(int(v) ** 2 for v in row)) for row in d)]

    def projected(self, d: np.ndarray, k: int) -> np.ndarray:
        """The first k whitened values of each row; not a number for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(np.arange(k) < self.rank, 1 / (self.n * np.sqrt(np.maximum(self.eigenvalues[:k], 0))), np.nan)
        return (d.astype(np.float64) @ self.components[:k].T) * scale


def whole_vectors(rows: DataFrame, vector: Column, factor: int = 256) -> DataFrame:
    """rows with x, the vector's entries as floor(factor * entry), without rows whose vector is null, empty or holds
    null or non-finite entries."""
    entry = lambda c: c.cast("double")
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) < float("inf")))
    rows = rows.where(vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)))
    return rows.withColumn("x", F.transform(vector, lambda c: F.floor(entry(c) * factor) + F.lit(0)))


def fit_whitening(fit: DataFrame, dims: int) -> Whitening:
    """fit: different vectors x (arrays of dims longs) in a table that is read several times."""

    def parts(batches):
        high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = rows_of(batch.column("x"), dims)
            high, low = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    totals = fit.mapInArrow(parts, "i int, high bigint, low bigint").groupBy("i").agg(exact("high").alias("high"), exact("low").alias("low")).collect()  # one row for each dimension
    n, sums = fit.count(), [(int(r["high"]) << 32) + int(r["low"]) for r in sorted(totals)]
    means = [Fraction(s, max(n, 1)) for s in sums]
    high = np.array([float(m) for m in means])
    mean = high, np.array([float(m - Fraction(h)) for m, h in zip(means, high.tolist())])

    def outer(batches):
        found = None
        for batch in batches:
            found = outer_sums(rows_of(batch.column("x"), dims), mean, found)
        if found:
            group = TaskContext.get().partitionId() % FAN
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array([group] * dims, pa.int32()), *(pa.array([s[k].tolist() for s in found], pa.list_(pa.float64())) for k in (0, 1))], names=["i", "part", "high", "low"]
            )

    def merged(table: pa.Table) -> pa.Table:
        pair = pair_total(*(np.array(table.column(c).to_pylist()) for c in ("high", "low")))
        held = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in pair]
        return pa.table([table.column("i").slice(0, 1), table.column("part").slice(0, 1), *held], names=["i", "part", "high", "low"])

    schema = "i int, part int, high array<double>, low array<double>"
    tasks = fit.mapInArrow(outer, schema)
    groups = tasks.groupBy("i", "part").applyInArrow(merged, schema)
    one = groups.groupBy("i").applyInArrow(merged, schema).collect()  # one row for each dimension
    v, trace = np.zeros((dims, dims)), Fraction(0)
    for r in one:
        i = r["i"]
        entries = [(Fraction(h) + Fraction(l)) / n for h, l in zip(r["high"], r["low"])]
        v[i, i:] = v[i:, i] = [float(e) for e in entries]
        trace += entries[0]
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1].copy(), vectors.T[::-1].copy()
    largest = vectors[np.arange(dims), np.abs(vectors).argmax(axis=1)]
    rank = int((values > dims * np.finfo(float).eps * max(values[0], 0)).sum())
    return Whitening(n, sums, values, vectors * np.sign(largest)[:, None], float(trace), rank)


def whiten(embeddings: DataFrame, components: int = 4, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every usable row.

    Rows whose vector is null, empty or holds null or non-finite entries take no part; nor do those whose number of
    entries isn't the most frequent one (the longer of two equally frequent). Vectors become floor(factor * entry).
    The fit counts every different vector once, however often it occurs; each row gets its own output, repeated rows
    and null ids too. deviation is the exact sum of (n*x - S)^2, null where it passes a long. A component without
    variance (a table of one different vector, too few dimensions) has null whitened values, and explained is null
    where nothing varies at all. identity_error, one value, is null then. Empty tables give no rows; further columns,
    whatever their names, are left out.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema[id_col].dataType.simpleString()
    rows = whole_vectors(embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")), F.col("vector"), factor).select("vec_id", "x")
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    columns = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if size is None:
        return spark.createDataFrame([], columns)
    dims = size["d"]
    bounded_batches(spark, rows=4096)
    rows = rows.where(F.size("x") == dims)
    fit = written(rows.select("x").distinct(), "whitening-fit")
    model = fit_whitening(fit, dims)
    k = min(components, dims)

    def project(with_id):
        def run(batches):
            for batch in batches:
                d = model.deviations(rows_of(batch.column("x"), dims))
                w = pa.array(model.projected(d, k).ravel(), pa.float64(), from_pandas=True)
                w = pa.ListArray.from_arrays(pa.array(range(0, len(d) * k + 1, k), pa.int32()), w)
                cols = {"vec_id": batch.column("vec_id"), "deviation": pa.array(model.squares(d), pa.int64())} if with_id else {}
                yield pa.RecordBatch.from_arrays([*cols.values(), w], names=[*cols, "w"])

        return run

    # Spark's covariance is centred as well, and merged over tasks.
    white = fit.mapInArrow(project(False), "w array<double>")
    entries = [F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"v{i}_{j}") for i in range(min(k, model.rank)) for j in range(i + 1)]
    found = white.agg(*entries).first().asDict() if entries else {}
    error = max((abs(v - (a == b)) for name, v in found.items() for a, b in [name[1:].split("_")]), default=None)
    shares = [float(e / model.trace) if model.trace > 0 else None for e in np.maximum(model.eigenvalues[:k], 0)]
    out = rows.mapInArrow(project(True), f"vec_id {kind}, deviation bigint, w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(s).cast("double") for s in shares]), F.col("at"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
