"""Embedding whitening: leading eigenpairs of an exact integer covariance by spectrum slicing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LIMB = 1 << 64
EXACT = 1 << 53
LARGEST = float(1 << 62)
EPS = float(np.finfo(float).eps)
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- symmetric factors and spectrum slicing (driver; matrices of dims x dims) ----------------------------------------


class Factor:
    """L D Lᵀ of a symmetric matrix, with row exchanges and pivots of one or two rows (diagonal pivoting).

    ``positive`` is the number of positive eigenvalues: by the law of inertia the number of positive pivots, where a pivot of two rows has one of each sign.
    """

    def __init__(self, matrix: np.ndarray, size: float):
        a, n = matrix.copy(), len(matrix)
        order, pivots, positive, k = np.arange(n), [], 0, 0
        tiny, share = EPS * max(size, np.finfo(float).tiny / EPS), (1 + np.sqrt(17)) / 8

        def exchange(i: int, j: int) -> None:
            if i != j:
                a[[i, j]] = a[[j, i]]
                a[:, [i, j]] = a[:, [j, i]]
                order[[i, j]] = order[[j, i]]

        while k < n:
            two = False
            if k + 1 < n:
                r = k + 1 + int(np.argmax(np.abs(a[k + 1 :, k])))
                below = abs(a[r, k])
                if abs(a[k, k]) < share * below:
                    row = np.abs(a[r, k:])
                    row[r - k] = 0
                    most = row.max()
                    if abs(a[k, k]) * most < share * below * below:
                        if abs(a[r, r]) >= share * most:
                            exchange(k, r)
                        else:
                            exchange(k + 1, r)
                            two = True
            step = 2 if two else 1
            block = a[k : k + step, k : k + step].copy()
            if two:
                positive += 1
            else:
                positive += block[0, 0] > 0
                if abs(block[0, 0]) < tiny:
                    block[0, 0] = tiny if block[0, 0] > 0 else -tiny
            rest = a[k + step :, k : k + step].copy()
            lower = rest @ np.linalg.inv(block)
            a[k + step :, k + step :] -= lower @ rest.T
            a[k + step :, k : k + step] = lower
            pivots.append((k, step, block))
            k += step
        self.lower, self.order, self.pivots, self.positive = a, order, pivots, int(positive)

    def solve(self, right: np.ndarray) -> np.ndarray:
        x = right[self.order].astype(float)
        for k, step, _ in self.pivots:
            x[k + step :] -= self.lower[k + step :, k : k + step] @ x[k : k + step]
        for k, step, block in reversed(self.pivots):
            x[k : k + step] = np.linalg.solve(block, x[k : k + step]) - self.lower[k + step :, k : k + step].T @ x[k + step :]
        out = np.empty_like(x)
        out[self.order] = x
        return out


class Spectrum:
    """Leading eigenpairs of a symmetric matrix.

    The number of eigenvalues above a shift is an inertia count. Counts halve the interval of eigenvalue k until it holds no other (or has the width of
    the rounding error: equal eigenvalues); Rayleigh quotient iteration runs from its middle, and must stay in it; counts on both sides of the result certify its number.
    """

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        reach = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))  # row discs hold all eigenvalues
        self.size = float(np.abs(matrix).sum(axis=1).max())
        self.fuzz = 64 * EPS * self.size
        margin = self.fuzz * len(matrix)
        self.counts = {float((np.diag(matrix) - reach).min()) - margin: len(matrix), float((np.diag(matrix) + reach).max()) + margin: 0}

    def factor(self, shift: float) -> Factor:
        shifted = self.matrix.copy()
        shifted[np.diag_indices_from(shifted)] -= shift
        return Factor(shifted, self.size)

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = self.factor(shift).positive
        return self.counts[shift]

    def bounds(self, k: int) -> tuple[float, float]:
        return max(s for s, c in self.counts.items() if c >= k), min(s for s, c in self.counts.items() if c < k)

    def isolated(self, k: int) -> tuple[float, float]:
        low, high = self.bounds(k)
        while (self.above(low) > k or self.above(high) < k - 1) and high - low > self.fuzz:
            self.above((low + high) / 2)
            low, high = self.bounds(k)
        return low, high

    def leading(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``count`` largest eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
        n = len(self.matrix)
        values, vectors = np.zeros(count), np.zeros((n, count))
        if self.size == 0:
            return values, np.eye(n)[:, :count]
        for k in range(1, count + 1):
            value, vector = self.pair(k, vectors[:, : k - 1])
            values[k - 1], vectors[:, k - 1] = value, vector * np.sign(vector[np.argmax(np.abs(vector))])
        return values, vectors

    def pair(self, k: int, known: np.ndarray) -> tuple[float, np.ndarray]:
        rng = np.random.default_rng(k)

        def cleaned(x: np.ndarray) -> np.ndarray:
            x = x / np.abs(x).max()
            for _ in range(2):  # known directions go; twice, for rounding
                x = x - known @ (known.T @ x)
            return x / np.linalg.norm(x)

        low, high = self.isolated(k)
        while True:
            middle = self.factor((low + high) / 2)
            x = cleaned(rng.standard_normal(len(self.matrix)))
            for _ in range(3):
                x = cleaned(middle.solve(x))
            for _ in range(12):
                image = self.matrix @ x
                value = float(x @ image)
                left = float(np.linalg.norm(image - value * x))
                if left <= self.fuzz / 16 or not low <= value <= high:
                    break
                x = cleaned(self.factor(value).solve(x))
            value = float(x @ (self.matrix @ x))
            if low - self.fuzz <= value <= high + self.fuzz and left <= self.fuzz:
                break
            if high - low <= self.fuzz:
                value = (low + high) / 2  # equal eigenvalues: the middle is as close as the matrix is
                break
            self.above((low + high) / 2)
            low, high = self.bounds(k)
        around = self.fuzz * len(self.matrix)
        if self.above(value - around) < k or self.above(value + around) >= k:
            raise ArithmeticError(f"eigenvalue {k} has no certificate")
        return value, x


# --- exact sums over all rows ----------------------------------------------------------------------------------------


def _valid(batch: pa.RecordBatch, at: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows with whole vectors, by length: length, places in the batch, and entries x as longs."""
    lists = batch.column(at)
    values = np.asarray(lists.values.to_numpy(zero_copy_only=False), float) if len(lists.values) else np.zeros(0)  # NULL becomes NaN
    offsets = lists.offsets.to_numpy().astype(np.int64)
    sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(values[offsets[rows][:, None] + np.arange(size)] * SCALE)
            whole = (np.abs(scaled) < LARGEST).all(axis=1)  # false for NaN, too
        yield size, rows[whole], scaled[whole].astype(np.int64) + SHIFT


def _large(numbers: np.ndarray, factor: int = 1) -> np.ndarray:
    """The numbers as such, or as Python integers where products or sums of so many would leave 63 bits."""
    most = max(abs(int(numbers.max(initial=0))), abs(int(numbers.min(initial=0))))
    return numbers if most * factor < 1 << 62 else numbers.astype(object)


def _decimals(numbers) -> pa.Array:
    return pa.array([Decimal(int(x)) for x in numbers], pa.decimal128(38, 0))


def totals(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """Commonest length of a whole vector (0 if there is none; of ties the smallest), number of such vectors, and sums of x per dimension."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in rows:
            for size, _, x in _valid(batch):
                if not len(x):
                    continue
                n, total = held.get(size, (0, np.zeros(size, object)))
                held[size] = (n + len(x), total + _large(x, len(x)).sum(axis=0).astype(object))
        for size, (n, total) in held.items():
            columns = [pa.array([size] * (size + 1), pa.int32()), pa.array(range(-1, size), pa.int32()), _decimals([n, *total])]
            yield pa.RecordBatch.from_arrays(columns, names=["size", "dim", "total"])

    sums = vectors.mapInArrow(run, "size int, dim int, total decimal(38,0)").groupBy("size", "dim").agg(F.sum("total").alias("total"))
    found: dict[int, dict[int, int]] = {}
    for row in sums.collect():  # (dims + 1) rows per length that occurs
        found.setdefault(row["size"], {})[row["dim"]] = int(row["total"])
    if not found:
        return 0, 0, []
    size = min(found, key=lambda s: (-found[s][-1], s))
    return size, found[size][-1], [found[size][d] for d in range(size)]


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of x (divisor n), exact up to its last rounding: products of whole numbers, centred by the whole number next to the mean."""
    dims, centre, rest = len(sums), *centred(n, sums)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for batch in rows:
            for size, _, x in _valid(batch):
                if size == dims and len(x):
                    y = x - centre
                    most = int(np.abs(y).max())
                    if most * most * len(y) < EXACT:
                        y = y.astype(float)  # sums below 2^53 are exact, in any order
                        total += (y.T @ y).astype(np.int64).astype(object)
                    else:
                        y = _large(y, most * len(y))
                        total += (y.T @ y).astype(object)
        i, j = np.triu_indices(dims)
        flat = [int(v) for v in total[i, j]]
        columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), _decimals([v // LIMB for v in flat]), _decimals([v % LIMB for v in flat])]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "high", "low"])

    parts = vectors.mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    out = np.zeros((dims, dims))
    for row in parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():  # dims * (dims + 1) / 2 rows
        i, j = row["i"], row["j"]
        product = int(row["high"]) * LIMB + int(row["low"])
        out[i, j] = out[j, i] = (n * product - rest[i] * rest[j]) / (n * n)
    return out


def centred(n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """The whole number next to each mean, and what is left of the sums: sum of (x - centre)."""
    centre = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(centre, np.int64), [s - n * c for s, c in zip(sums, centre)]


# --- the operator ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What was fitted: rows, sums per dimension, eigenvalues (falling), unit eigenvectors (columns), trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def rows(self, batch: pa.RecordBatch, at: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, list[int | None]]]:
        """Places in the batch, whitened entries (NaN where a component has no variance) and exact deviations (None beyond a long)."""
        centre, rest = centred(self.n, self.sums)
        spread = self.values > 64 * EPS * len(self.sums) * max(self.trace, 0.0)
        scale = np.where(spread, 1 / np.sqrt(np.where(spread, self.values, 1.0)), np.nan)
        for size, places, x in _valid(batch, at):
            if size != len(self.sums) or not len(x):
                continue
            y = x - centre
            whitened = ((y.astype(float) - np.array([r / self.n for r in rest])) @ self.vectors) * scale
            most = self.n * int(np.abs(y).max()) + max(abs(r) for r in rest)
            exact = (y if most * most * size < 1 << 62 else y.astype(object)) * self.n - np.array(rest, object if most * most * size >= 1 << 62 else np.int64)
            yield places, whitened, [int(d) if d < 1 << 63 else None for d in (exact * exact).sum(axis=1)]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Two passes over a frame of one array column; None if no vector is whole."""
    dims, n, sums = totals(vectors)
    if not dims:
        return None
    matrix = covariance(vectors, n, sums)
    values, directions = Spectrum(matrix).leading(min(components, dims))
    return Whitening(n, sums, values, directions, float(np.trace(matrix)))


def identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity (components without variance left out).

    Tasks hold count, means and centred products; two such summaries merge exactly as one over all their rows, so nothing is multiplied before it is centred.
    """
    kept = np.flatnonzero(np.isfinite(fitted.values) & (fitted.values > 64 * EPS * len(fitted.sums) * max(fitted.trace, 0.0)))
    size = len(kept)
    if not size:
        return 0.0

    def merged(a, b):
        if a is None:
            return b
        n = a[0] + b[0]
        apart = b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)

    def packed(state, part: int) -> pa.RecordBatch:
        flat = np.concatenate([[float(state[0])], state[1], state[2].ravel()])
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["part", "state"])

    def opened(flat: np.ndarray):
        return flat[0], flat[1 : size + 1], flat[size + 1 :].reshape(size, size)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in rows:
            for _, white, _ in fitted.rows(batch):
                w = white[:, kept]
                mean = w.mean(axis=0)
                state = merged(state, (float(len(w)), mean, (w - mean).T @ (w - mean)))
        if state is not None:
            yield packed(state, int(state[0]) % 64)

    def folded(table: pa.Table) -> pa.Table:
        state = None
        for flat in sorted(table["state"].to_pylist()):  # one order, whatever the order of arrival
            state = merged(state, opened(np.array(flat)))
        return pa.Table.from_batches([packed(state, 0)])

    kind = "part int, state array<double>"
    state = None
    for row in sorted(vectors.mapInArrow(run, kind).groupBy("part").applyInArrow(folded, kind).collect()):  # at most 64 rows
        state = merged(state, opened(np.array(row["state"])))
    return float(np.abs(state[2] / state[0] - np.eye(size)).max())


def whiten(table: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Whitened entries of all vectors, one row per vector and component.

    Entry c becomes x = floor(64 c) + 1000000. Columns: vec_id, component (from 1, by falling eigenvalue), n (vectors fitted), deviation (sum over the
    dimensions of (n x - S)^2, exact), whitened ((x - S / n) on the component, over the root of its eigenvalue), explained, identity_error (one value).

    NULL vectors, empty ones, those with a NULL or non-finite entry or with an x beyond a long take no part, nor do those of another length than the
    commonest (ties: the shorter). Rows with NULL or repeated vec_id are rows like others. A component without variance has whitened NULL and is left out of
    identity_error; a deviation beyond a long is NULL. A trace of 0 gives explained 0. No whole vector, no row. Other columns of the table are not read.

    Only sums per dimension and the covariance (dims * dims) reach the driver, which slices its spectrum; every task sends one such summary.
    """
    spark: SparkSession = table.sparkSession
    chosen = table.select(F.col(column).cast("array<double>").alias("vector"))
    fitted = fit(chosen, components)
    if fitted is None:
        return spark.createDataFrame([], OUT)
    error = identity_error(chosen, fitted)
    count = len(fitted.values)
    explained = fitted.values / fitted.trace if fitted.trace > 0 else np.zeros(count)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for places, white, deviation in fitted.rows(batch, 1):
                n = len(places)
                flat = white.ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(places, count))),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * count, fitted.n, np.int64)),
                        pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(n), count))),
                        pa.array(flat, mask=np.isnan(flat)),
                        pa.array(np.tile(explained, n)),
                        pa.array(np.full(n * count, error)),
                    ],
                    names=[c.split()[0] for c in OUT.split(", ")],
                )

    return table.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector")).mapInArrow(run, OUT)
