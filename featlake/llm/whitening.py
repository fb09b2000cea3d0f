"""Whitening of embeddings: their principal components, scaled to unit variance.

Three passes over the vectors, which stay on the executors. The first adds up
exact integer sums per dimension. The second adds up products of the centred
vectors, a block of rows at a time, into one covariance matrix, whose rows are
summed on the executors; the driver gets as many rows as there are dimensions.
The driver brings that matrix into tridiagonal form by Householder reflections,
finds its leading eigenvalues by bisection on Sturm counts, and their vectors by
inverse iteration; vectors of a cluster of close eigenvalues are kept orthogonal
to each other. The third pass projects every vector on the components.

Entries are fixed-point numbers: c becomes floor(SCALE * c) + SHIFT, so sums and
deviations are exact at every order of adding up.

Defined cases: a vector that is null, empty, or holds an entry that is null, not
finite or beyond MOST (where floor(SCALE * c) is no exact integer) is left out,
and so is one whose length is not the most frequent one (of equally frequent
ones the least); repeated rows and repeated or null ids are rows of their own,
as each takes part in the fit; components without variance (fewer distinct
vectors than dimensions, a constant dimension, a single row) are left out, as
they cannot be scaled; a deviation beyond the range of a long is an error;
columns besides id and vector take no part, whatever their names; an empty
table gives no rows. A matrix of d dimensions takes 8 * d * d bytes in a task
and on the driver; more than MOST_DIMENSIONS are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import written

SCALE, SHIFT = 1024, 100_000
#: Entries from here on, in absolute value, have no exact fixed-point form.
MOST = 2.0**40
MOST_DIMENSIONS = 8192
#: Vectors that are centred and multiplied at a time.
BLOCK = 4096
#: A component's variance is above this share of the largest one, times the number of dimensions.
LEAST = 2.0**-46


# Eigenvectors of a symmetric matrix.


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, float]]]:
    """Diagonal, off-diagonal and reflections (v, 2 / v.v) of a symmetric matrix, by Householder's method."""
    a = np.array(a, np.float64)
    n = len(a)
    reflections = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0 or not np.any(v[1:]):
            reflections.append((v, 0.0))
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.abs(v).max()
        beta = 2.0 / (v @ v)
        rest = a[k + 1 :, k + 1 :]
        p = beta * (rest @ v)
        w = p - (beta / 2) * (p @ v) * v
        rest -= np.outer(v, w) + np.outer(w, v)
        first = a[k + 1 :, k] - beta * (v @ a[k + 1 :, k]) * v
        a[k + 1 :, k] = a[k, k + 1 :] = first
        reflections.append((v, beta))
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def sturm_counts(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are below each of ``x``."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count = np.zeros(len(x), np.int64)
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)  # a zero counts as negative, here and in the next step
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling, all bisected side by side."""
    n = len(d)
    k = min(most, n)
    radius = np.abs(np.append(e, 0)) + np.abs(np.append(0, e))
    low, high = (d - radius).min(), (d + radius).max()
    slack = np.finfo(float).eps * max(abs(low), abs(high), np.finfo(float).tiny) * n
    lo, hi = np.full(k, low - slack), np.full(k, high + slack)
    below = n - 1 - np.arange(k)  # as many are below the j-th largest
    while True:
        mid = (lo + hi) / 2
        if np.all((mid <= lo) | (mid >= hi)):
            return mid
        under = sturm_counts(d, e, mid) > below
        hi, lo = np.where(under, mid, hi), np.where(under, lo, mid)


def _solver(d: np.ndarray, e: np.ndarray, shift: float):
    """A function that solves (T - shift) x = b, by elimination with row exchanges."""
    n = len(d)
    small = np.finfo(float).eps * max(np.abs(d).max(), np.abs(e).max() if n > 1 else 0.0, np.finfo(float).tiny)
    u0, u1, u2 = d - shift, np.append(e, 0.0), np.zeros(n)
    swapped, factor = np.zeros(n, bool), np.zeros(n)
    for i in range(n - 1):
        if abs(e[i]) > abs(u0[i]):
            swapped[i] = True
            u0[i], u1[i], u2[i], next0, next1 = e[i], u0[i + 1], u1[i + 1], u0[i], u1[i]
        else:
            next0, next1 = e[i], u0[i + 1]
            u0[i] = u0[i] if u0[i] else small
        factor[i] = next0 / u0[i]
        if swapped[i]:
            u0[i + 1], u1[i + 1] = next1 - factor[i] * u1[i], -factor[i] * u2[i]
        else:
            u0[i + 1] = next1 - factor[i] * u1[i]
    if abs(u0[-1]) < small:
        u0[-1] = small

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for i in range(n - 1):
            if swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor[i] * x[i]
        for i in range(n - 1, -1, -1):
            if i + 1 < n:
                x[i] -= u1[i] * x[i + 1]
            if i + 2 < n:
                x[i] -= u2[i] * x[i + 2]
            x[i] /= u0[i] if abs(u0[i]) > small * 1e-3 else np.copysign(small, u0[i])
            if abs(x[i]) > 1e150:  # only the direction matters
                x /= 1e150
        return x

    return solve


def tridiagonal_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector (column) for each of the falling ``values``.

    Values closer than a thousandth of the norm are one cluster: their
    iterates are made orthogonal to the vectors already found, in every step.
    """
    n = len(d)
    norm = max(np.abs(d).max() + (2 * np.abs(e).max() if n > 1 else 0.0), np.finfo(float).tiny)
    rng = np.random.default_rng(13)
    out = np.zeros((n, len(values)))
    first, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            first = j
        # Equal values need shifts of their own, or elimination gives the same direction again.
        shift = min(value, shift - 4 * np.finfo(float).eps * norm) if j > first else value
        solve = _solver(d, e, shift)
        x = rng.uniform(0.5, 1.0, n) * rng.choice([-1.0, 1.0], n)
        for _ in range(6):
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.linalg.norm(x)
            x = solve(x)
            x /= np.abs(x).max()
        for _ in range(2):
            x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading_components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` eigenvalues, falling, that are above rounding, and their unit eigenvectors as columns."""
    size = np.abs(covariance).max() if len(covariance) else 0.0
    if size == 0:
        return np.zeros(0), np.zeros((len(covariance), 0))
    d, e, reflections = tridiagonal(covariance / size)
    values = leading_values(d, e, most)
    values = values[values > LEAST * len(d) * values[0]]
    vectors = tridiagonal_vectors(d, e, values)
    for k in range(len(reflections) - 1, -1, -1):
        v, beta = reflections[k]
        vectors[k + 1 :] -= np.outer(beta * v, v @ vectors[k + 1 :])
    return values * size, vectors / np.linalg.norm(vectors, axis=0)


# Passes over the vectors.


def fixed_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id`` and ``x`` (array of long) of the vectors that take part."""
    v = rows[vector].cast("array<double>")
    sound = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < MOST)), F.lit(False))
    sound = F.when(v.isNull(), F.lit(False)).otherwise(sound)
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT))
    rows = rows.select(rows[key].cast("long").alias("vec_id"), F.when(sound, x).alias("x")).where("x is not null")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("x") == (lengths["d"] if lengths else 0))


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sums(fixed: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension; each task gives a row per dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for _, x in _blocks(batches, d):
            n += len(x)
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": [str(t) for t in total]})

    parts = fixed.select("x").mapInArrow(work, "i int, n long, s string")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return rows[0]["n"], [int(r["s"]) for r in rows]


def _matrix(parts: DataFrame, d: int) -> np.ndarray:
    """The sum of matrices that tasks gave as rows (i, v); equal rows are added on the executors, in the order of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), batch.column("v"), strict=True):
                total[i] = total.get(i, 0.0) + np.frombuffer(v.as_py(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["i", "v"])

    out = np.zeros((d, d))
    for r in parts.repartition("i").sortWithinPartitions("i", "task").select("i", "v").mapInArrow(add, "i int, v binary").collect():  # d rows
        out[r["i"]] = np.frombuffer(r["v"], np.float64)
    return out


def covariance(rows: DataFrame, column: str, d: int, n: int, mean: np.ndarray) -> np.ndarray:
    """Covariance with divisor ``n``: every vector is centred by ``mean`` before it is multiplied."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, seen = np.zeros((d, d)), False
        for _, x in _blocks(batches, d):
            y = x - mean
            total += y.T @ y
            seen = True
        if seen:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "task": pa.array([task] * d, pa.int32()), "v": [r.tobytes() for r in total]})

    return _matrix(rows.select(F.col(column).alias("x")).mapInArrow(work, "i int, task int, v binary"), d) / n


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """``vec_id``, ``n``, ``deviation``, ``whitened`` (an array, one entry per component), ``explained`` (likewise) and ``identity_error``.

    ``deviation`` is the exact sum over dimensions of (n * x - sum)^2.
    ``identity_error`` is the largest absolute entry of the covariance of what
    comes out minus the identity, measured on all rows.
    """
    spark = rows.sparkSession
    fixed = written(fixed_vectors(rows, key, vector), "fixed-vectors")
    first = fixed.select(F.size("x")).first()
    schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if first is None:
        return spark.createDataFrame([], schema)
    d = first[0]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; at most {MOST_DIMENSIONS} are supported")
    n, total = sums(fixed, d)
    whole = [s // n for s in total]  # x - whole is small and exact, so the mean of it loses nothing that matters
    rest = np.array([(s - w * n) / n for s, w in zip(total, whole, strict=True)])
    base = np.array(whole, np.int64)
    v = covariance(fixed.select(F.zip_with("x", F.array(*[F.lit(w).cast("long") for w in whole]), lambda a, b: a - b).alias("x")), "x", d, n, rest)
    values, components = leading_components(v, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    explained = (values / np.trace(v)).tolist()
    shared = spark.sparkContext.broadcast(components / np.sqrt(values))  # d x most numbers
    remainder = np.array([s - w * n for s, w in zip(total, whole, strict=True)], np.int64)  # under n
    k = len(values)

    def deviations(y: np.ndarray) -> list[int]:
        far = n * int(np.abs(y).max(initial=0)) + n
        if far < 1 << 31 or d * far * far < 1 << 63:
            z = n * y - remainder
            return (z * z).sum(axis=1).tolist()
        return [sum((n * a - b) ** 2 for a, b in zip(row, remainder.tolist(), strict=True)) for row in y.tolist()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, d):
            y = x - base
            z = (y - rest) @ shared.value
            flat = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(deviations(y), pa.int64()), flat], names=["vec_id", "deviation", "whitened"])

    out = written(fixed.mapInArrow(work, "vec_id long, deviation long, whitened array<double>"), "whitened")
    means = out.agg(*[F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(k)]).first()
    c = covariance(out, "whitened", k, n, np.array(list(means)))
    error = float(np.abs(c - np.eye(k)).max())
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*[F.lit(x) for x in explained]).alias("explained"), F.lit(error).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the eight leading components, a row each."""
    df = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "at")
    df = df.select("vec_id", "n", "deviation", "identity_error", each)
    return df.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", F.col("at.whitened").alias("whitened"), F.col("at.explained").alias("explained"), "identity_error")
