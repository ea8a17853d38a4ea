"""Operator 13: embedding whitening by spectrum slicing.

Embeddings become integers. The fit list, each distinct vector once, gives exact sums in a first pass and, centred by them, the covariance in
a second one; tasks add up their own part, so sums and a matrix of dimensions by dimensions are all that leaves them.

The leading eigenvalues of the covariance V come from slicing: an LDL' factorisation of V - s I has as many positive pivots as V has eigenvalues above
s. Bisection by these counts isolates each of the leading ones; Rayleigh quotient iteration from inside its interval converges
cubically to eigenvalue and vector; and counts on both sides of what it found certify its number. Eigenvalues that no shift can part get an orthonormal
basis of their common space. A last pass projects all rows.

Defined results: vectors that are null or hold null or non-finite entries are left out; shorter vectors are taken as padded with zeros; entries beyond
what a long holds are held at 9e18; rows that repeat are returned each, and fitted once; a deviation beyond a long is null; components
whose eigenvalue is zero to double precision have no whitened value and are not returned, so equal vectors give no rows; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, small_batches, table

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
MOST = 9e18
EPS = float(np.finfo(np.float64).eps)
#: Bunch and Kaufman's bound on the growth of entries.
ALPHA = (1 + 17**0.5) / 8


def quantised(rows: DataFrame) -> DataFrame:
    """rows(vec_id, embedding) to (vec_id, x), without what can't be used."""
    own = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(own, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(own, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(MOST)), F.lit(-MOST))).cast("long") + SHIFT)
    return rows.where(F.col("embedding").isNotNull()).where(finite).select("vec_id", x.alias("x"))


def matrix(lists: pa.Array, d: int) -> np.ndarray:
    """The vectors as rows of d integers."""
    sizes = np.diff(np.asarray(lists.offsets, np.int64))
    out = np.full((len(lists), d), SHIFT, np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def differences(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - s, exactly: as longs where these and the sum of their squares fit, else as Python's integers."""
    most = n * max(int(x.max()), -int(x.min())) + max(map(abs, s)) if x.size else 0
    if most**2 * len(s) < 1 << 63:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def fit_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = matrix(batch.column(0), d)
            n += len(x)
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total = [t + (int(a) << 32) + int(b) for t, a, b in zip(total, high, low, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))], names=["dimension", "s"])

    found = dict(fit.mapInArrow(add, "dimension int, s decimal(38,0)").groupBy("dimension").agg(F.sum("s")).collect())
    return int(found.get(-1, 0)), [int(found.get(i, 0)) for i in range(d)]


def fit_products(fit: DataFrame, of: Callable[[pa.Array], np.ndarray], k: int) -> np.ndarray:
    """The sum over all vectors of the outer product of of(vectors), a row of k values each. Parts are added in the order of the tasks."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            y = of(batch.column(0))
            total += y.T @ y
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([part] * k, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                totals[i] = totals.get(i, 0) + row.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.int32()), pa.array(list(totals.values()), pa.list_(pa.float64()))], names=["i", "sums"])

    parts = fit.mapInArrow(multiply, "i int, part int, sums array<double>").repartition("i").sortWithinPartitions("i", "part")
    out = np.zeros((k, k))
    for i, row in parts.select("i", "sums").mapInArrow(add, "i int, sums array<double>").collect():
        out[i] = row
    return (out + out.T) / 2


def positives(m: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are above zero: the positive pivots of its LDL' factorisation. Pivots are of one or two rows, so
    that entries don't grow; a pivot of two rows has one eigenvalue of either sign."""
    a, n, k, found = m.copy(), len(m), 0, 0

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j], :] = a[[j, i], :]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        pivot, below = abs(a[k, k]), np.abs(a[k + 1 :, k])
        r = k + 1 + int(below.argmax()) if len(below) else k
        most = below[r - k - 1] if len(below) else 0.0
        two = False
        if most > 0 and pivot < ALPHA * most:
            other = np.abs(a[k:, r])
            other[r - k] = 0
            far = other.max()
            if pivot * far < ALPHA * most**2:
                if abs(a[r, r]) >= ALPHA * far:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    two = True
        if two:
            c = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(a[k : k + 2, k : k + 2], c.T)
            found += 1
            k += 2
        else:
            if a[k, k] != 0:
                found += bool(a[k, k] > 0)
                c = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(c / a[k, k], c)
            k += 1
    return found


class Slices:
    """Counts of the eigenvalues of v above shifts, each made once."""

    def __init__(self, v: np.ndarray):
        self.v, self.one = v, np.eye(len(v))
        self.scale = max(float(np.abs(v).sum(axis=1).max()), np.finfo(float).tiny)
        self.known = {-self.scale * (1 + 1e-9): len(v), self.scale * (1 + 1e-9): 0}

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = positives(self.v - shift * self.one)
        return self.known[shift]

    def interval(self, k: int, least: float) -> tuple[float, float]:
        """low < e_k <= high with no other eigenvalue between them, if that takes no interval narrower than `least`."""
        while True:
            low = max(s for s, c in self.known.items() if c >= k)
            high = min(s for s, c in self.known.items() if c < k)
            if high - low <= least or (self.known[low] == k and self.known[high] == k - 1):
                return low, high
            self.above((low + high) / 2)


def solved(v: np.ndarray, shift: float, x: np.ndarray, scale: float) -> np.ndarray:
    """The unit vector of (v - shift)^-1 x; a shift that is an eigenvalue to the last bit moves by as much."""
    for step in range(8):
        try:
            y = np.linalg.solve(v - (shift + step * EPS * scale) * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all() and (size := np.linalg.norm(y)):
            return y / size
    raise ArithmeticError("no shift near the eigenvalue can be solved for")


def spectrum(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues above zero, falling, and their unit vectors as columns."""
    d = len(v)
    cuts, random = Slices(v), np.random.default_rng(13)
    tiny = 4 * EPS * cuts.scale
    values, vectors = [], np.zeros((d, 0))
    apart = lambda x: x - vectors @ (vectors.T @ x)
    slack = 64 * d * EPS * cuts.scale
    for k in range(1, min(most, d, cuts.above(d * tiny)) + 1):
        for _ in range(128):
            low, high = cuts.interval(k, tiny)
            alone = cuts.above(low) == k and cuts.above(high) == k - 1
            x = apart(random.standard_normal(d))
            for _ in range(3):
                x = solved(v, (low + high) / 2, apart(x), cuts.scale)
            rest = np.inf
            while True:
                e = float(x @ v @ x)
                residual = np.linalg.norm(v @ x - e * x)
                if alone and not low < e <= high or residual <= EPS * cuts.scale / 8 or residual > rest * 0.9:
                    break
                rest = residual
                x = solved(v, e, x, cuts.scale)
            # exact eigenvectors are orthogonal already; within a cluster this makes them so
            for _ in range(2):
                x = apart(x)
                x /= np.linalg.norm(x)
            e = float(x @ v @ x)
            if np.linalg.norm(v @ x - e * x) <= slack and cuts.above(e + slack) < k <= cuts.above(e - slack):
                break
            cuts.above((low + high) / 2)  # drawn to a neighbour: start again in a part of the interval
        else:
            raise ArithmeticError(f"counts don't certify eigenvalue {k}")
        values.append(e)
        vectors = np.column_stack([vectors, x])
    return np.array(values), vectors


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of rows(vec_id, embedding)."""
    spark = rows.sparkSession
    work = Work(spark)
    small_batches(spark)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, {OUT}"
    given = work.store(quantised(rows.select("vec_id", "embedding")), "vectors", codec="zstd")
    d = given.agg(F.max(F.size("x"))).first()[0] or 0
    if not d:
        return spark.createDataFrame([], schema)
    # vectors of other lengths may be equal once they are padded
    padded = F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(d) - F.size("x")))
    fit = work.store(given.select(padded.alias("x")).distinct(), "fit", codec="zstd")
    n, s = fit_sums(fit, d)
    centred = lambda lists: differences(matrix(lists, d), n, s).astype(np.float64) / n
    v = fit_products(fit, centred, d) / n
    values, vectors = spectrum(v, most)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    project = vectors / np.sqrt(values)
    # the mean of what is whitened is that of n x - S, which is zero exactly
    error = float(np.abs(fit_products(fit, lambda lists: centred(lists) @ project, k) / n - np.eye(k)).max())
    explained = values / np.trace(v)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = differences(matrix(batch.column(1), d), n, s)
            far = [x if x < 1 << 63 else None for x in (apart * apart).sum(axis=1).tolist()]
            white = (apart.astype(np.float64) / n) @ project
            m = batch.num_rows
            each = lambda x: np.tile(x, m)
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(each(np.arange(1, k + 1)), pa.int32()), pa.array(np.full(m * k, n), pa.int64())]
            columns += [pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(white.ravel()), pa.array(each(explained)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", *(c.split()[0] for c in OUT.split(", "))])

    return given.select("vec_id", "x").mapInArrow(write, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
