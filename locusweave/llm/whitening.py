"""Embedding whitening by the leading components of the exact centred covariance.

Entries become whole numbers x = floor(scale * c) + shift. Two passes give the covariance: the first adds up x (exact), the second
subtracts the nearest whole number to each mean before anything is multiplied and adds up the products; what the rounding of the
means leaves is taken off by its exact formula. Sums of products are whole numbers too, exact up to 2^53 whatever the order of
tasks. Each task sends one row for each pair of dimensions, so what reaches the driver is bounded by the square of their number.

The symmetric matrix is made tridiagonal by Householder reflections; bisection on the Sturm count (eigenvalues below a number, from the
signs of the pivots) gives the leading eigenvalues; inverse iteration gives their vectors, and within a cluster of close eigenvalues
each vector is kept orthogonal to those before it; the reflections take them back. The components, at most ``most`` vectors, are
broadcast and every row is projected on them. A third pass measures the covariance of what comes out.

Rows: a vector that is null, empty, or holds a null or non-finite entry, or one whose scaled size reaches 2^40 (no whole number of its
own is left to it), is dropped; vectors of different lengths are separate fits, each with its own n; a row without an id is kept;
repeated rows count, and are returned, as often as they stand there; components without variance (beyond double precision of
the largest) are left out, so a fit of equal vectors gives no rows; close or equal eigenvalues give orthogonal vectors of their space;
a vector's largest entry is positive, so ties in sign do not occur; an empty table gives an empty table; other columns are not read.
``deviation`` is null where it does not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most dimensions of a vector: their square is what a task and the driver hold.
DIMENSIONS = 4096
_LARGEST = float(1 << 40)
_EPS = float(np.finfo(float).eps)


# ---- eigenvectors of a symmetric matrix --------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the Householder vectors that make a symmetric matrix tridiagonal."""
    a = a.copy()
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.sqrt(v @ v)
        v[0] += np.copysign(length, v[0])
        size = np.sqrt(v @ v)
        if size:
            v /= size
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            column = a[k + 1 :, k]
            column -= 2 * v * (v @ column)
            a[k, k + 1 :] = column
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues are smaller than each of ``x``: negative pivots of the shifted matrix."""
    least = _EPS * max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0), np.finfo(float).tiny / _EPS)
    pivot = diagonal[0] - x
    count = (pivot < 0).astype(int)
    for d, e in zip(diagonal[1:], off, strict=True):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = d - x - e * e / pivot
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The largest eigenvalues, falling, by bisection on the Sturm count."""
    n = len(diagonal)
    padded = np.abs(np.concatenate([[0], off, [0]]))
    reach = padded[:-1] + padded[1:]
    low = np.full(most, (diagonal - reach).min())
    high = np.full(most, (diagonal + reach).max())
    high += _EPS * np.maximum(np.abs(high), np.abs(low)) * n + np.finfo(float).tiny
    keep = n - 1 - np.arange(most)  # eigenvalues below the one that is sought
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high) & (high - low > _EPS * np.maximum(np.abs(low), np.abs(high)))).any():
            return middle
        right = below(diagonal, off, middle) <= keep
        low, high = np.where(right, middle, low), np.where(right, high, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, value: float):
    """Solves (T - value) z = b again and again: elimination with row exchanges, done once."""
    n = len(diagonal)
    least = _EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0), np.finfo(float).tiny / _EPS)
    upper = np.zeros((n, 3))
    steps: list[tuple[bool, float]] = []
    row = np.array([diagonal[0] - value, off[0] if n > 1 else 0.0, 0.0])
    for i in range(n - 1):
        following = np.array([off[i], diagonal[i + 1] - value, off[i + 1] if i + 2 < n else 0.0])
        exchange = abs(following[0]) > abs(row[0])
        if exchange:
            row, following = following, row
        if abs(row[0]) < least:
            row[0] = np.copysign(least, row[0] or 1.0)
        factor = following[0] / row[0]
        upper[i] = row
        row = np.array([following[1] - factor * row[1], following[2] - factor * row[2], 0.0])
        steps.append((exchange, factor))
    if abs(row[0]) < least:
        row[0] = np.copysign(least, row[0] or 1.0)
    upper[n - 1] = row

    def solve(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for i, (exchange, factor) in enumerate(steps):
            if exchange:
                b[i], b[i + 1] = b[i + 1], b[i]
            b[i + 1] -= factor * b[i]
        z = np.zeros(n + 2)
        for i in range(n - 1, -1, -1):
            z[i] = (b[i] - upper[i, 1] * z[i + 1] - upper[i, 2] * z[i + 2]) / upper[i, 0]
        return z[:n]

    return solve


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector of the tridiagonal matrix in each column, by inverse iteration."""
    n = len(diagonal)
    scale = max(np.abs(diagonal).max(), np.abs(off).max(initial=0))
    out = np.zeros((n, len(values)))
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * scale:
            first = k
        # Equal eigenvalues are told apart by a few units in the last place.
        solve = _solver(diagonal, off, value - (k - first) * 4 * _EPS * scale)
        z = np.random.default_rng(k).normal(size=n)
        for _ in range(5):
            for _ in range(2):
                for j in range(first, k):
                    z -= (out[:, j] @ z) * out[:, j]
                z /= np.sqrt(z @ z)
            z = solve(z)
            z /= np.abs(z).max()
        for _ in range(2):
            for j in range(first, k):
                z -= (out[:, j] @ z) * out[:, j]
            z /= np.sqrt(z @ z)
        out[:, k] = z
    return out


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns; those without variance are left out."""
    if len(matrix) == 1:
        values, vectors = matrix[0].copy(), np.ones((1, 1))
    else:
        diagonal, off, mirrors = tridiagonal(matrix)
        values = leading_values(diagonal, off, min(most, len(matrix)))
        vectors = vectors_of(diagonal, off, values)
        for k in range(len(mirrors) - 1, -1, -1):
            vectors[k + 1 :] -= 2 * np.outer(mirrors[k], mirrors[k] @ vectors[k + 1 :])
    some = values > max(values.max(initial=0), 0) * 1000 * _EPS * len(matrix)
    values, vectors = values[some], vectors[:, some]
    peak = np.abs(vectors).argmax(0)
    return values, vectors * np.sign(vectors[peak, np.arange(len(values))])


# ---- passes over the rows --------------------------------------------------------------------------------------


@dataclass
class Fit:
    """What whitens the vectors of one length; ``sums`` are exact."""

    n: int
    sums: list[int]
    centre: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(float) - self.rest) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact."""
        apart = x - self.centre
        left = [self.n * int(c) - s for c, s in zip(self.centre, self.sums, strict=True)]
        most = self.n * int(np.abs(apart).max(initial=0)) + max(map(abs, left))
        if most * most * len(left) < 1 << 63:
            d = self.n * apart + np.array(left, np.int64)
            return (d * d).sum(1).tolist()
        exact = [sum((self.n * int(y) + r) ** 2 for y, r in zip(row, left, strict=True)) for row in apart]
        return [e if e < 1 << 63 else None for e in exact]


def usable(vector: Column, scale: float) -> Column:
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * F.lit(scale)) < F.lit(_LARGEST)))
    return F.coalesce(good & (F.size(vector) > 0), F.lit(False))


def _by_length(column: pa.Array, scale: float, shift: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places of the rows with it, and their whole numbers."""
    length = column.value_lengths().to_numpy()
    for size in np.unique(length):
        at = np.flatnonzero(length == size)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float)
        yield int(size), at, np.floor(scale * flat).astype(np.int64).reshape(-1, int(size)) + shift


def _sums(scale: float, shift: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part in parts:
            for size, _, x in _by_length(part.column(0), scale, shift):
                own = np.concatenate([[len(x)], x.sum(0)]).astype(object)  # a batch of 2^22 rows stays below 2^63
                total[size] = total[size] + own if size in total else own
        for size, own in total.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(size + 1, size, np.int32)), pa.array(np.arange(-1, size, dtype=np.int32)), pa.array([Decimal(int(s)) for s in own], pa.decimal128(38, 0)),
            ], ["d", "i", "s"])

    return run


def _products(maps: dict):
    """Sums (j = -1) and products of what ``maps`` makes of the rows of each length."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        scale, shift, of = maps["scale"], maps["shift"], maps["of"]
        for part in parts:
            for size, _, x in _by_length(part.column(0), scale, shift):
                if size in of:
                    y = of[size](x)
                    had = total.get(size, (0.0, 0.0))
                    total[size] = had[0] + y.sum(0), had[1] + y.T @ y
        for size, (sums, products) in total.items():
            i, j = np.triu_indices(len(sums))
            k = np.arange(len(sums))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(i) + len(k), size, np.int32)), pa.array(np.concatenate([i, k]).astype(np.int32)),
                pa.array(np.concatenate([j, np.full(len(k), -1)]).astype(np.int32)), pa.array(np.concatenate([products[i, j], sums])),
            ], ["d", "i", "j", "v"])

    return run


def _moments(vectors: DataFrame, maps: dict, counts: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and mean products for each length."""
    rows = vectors.mapInArrow(_products(maps), "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect()  # bounded by the square of the dimensions
    width = {d: 1 + max(r["i"] for r in rows if r["d"] == d) for d in {r["d"] for r in rows}}
    out = {d: (np.zeros(w), np.zeros((w, w))) for d, w in width.items()}
    for r in rows:
        mean, products = out[r["d"]]
        if r["j"] < 0:
            mean[r["i"]] = r["v"] / counts[r["d"]]
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = r["v"] / counts[r["d"]]
    return out


def fit(vectors: DataFrame, most: int = 8, scale: float = 1024.0, shift: int = 100_000) -> dict[int, Fit]:
    """A fit for each length of the one column of usable ``vectors``, with its identity error measured."""
    found = vectors.mapInArrow(_sums(scale, shift), "d int, i int, s decimal(38,0)").groupBy("d", "i").agg(F.sum("s").alias("s")).collect()  # a row for each dimension
    sums: dict[int, dict[int, int]] = {}
    for r in found:
        sums.setdefault(r["d"], {})[r["i"]] = int(r["s"])
    if max(sums, default=0) > DIMENSIONS:
        raise ValueError(f"vectors of {max(sums)} entries: at most {DIMENSIONS} can be whitened")
    counts = {d: s[-1] for d, s in sums.items()}
    centres = {d: np.array([round(Fraction(s[i], s[-1])) for i in range(d)], np.int64) for d, s in sums.items()}
    centred = {d: lambda x, c=c: (x - c).astype(float) for d, c in centres.items()}
    fits = {}
    for d, (_, products) in _moments(vectors, {"scale": scale, "shift": shift, "of": centred}, counts).items():
        own = [sums[d][i] for i in range(d)]
        rest = np.array([float(Fraction(s, counts[d]) - int(c)) for s, c in zip(own, centres[d], strict=True)])
        covariance = products - np.outer(rest, rest)
        values, components = leading(covariance, most)
        fits[d] = Fit(counts[d], own, centres[d], rest, values, components, float(np.trace(covariance)))
    for d, (mean, products) in _moments(vectors, {"scale": scale, "shift": shift, "of": {d: f.whitened for d, f in fits.items() if len(f.values)}}, counts).items():
        fits[d].error = float(np.abs(products - np.outer(mean, mean) - np.eye(len(mean))).max())
    return fits


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = 8, scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component."""
    good = rows.where(usable(F.col(vector), scale)).select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vec"))
    fits = rows.sparkSession.sparkContext.broadcast(fit(good.select("vec"), most, scale, shift))  # a few vectors for each length

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for size, at, x in _by_length(part.column("vec"), scale, shift):
                own = fits.value[size]
                k = len(own.values)
                if not k:
                    continue
                which, number = np.repeat(np.arange(len(x)), k), np.tile(np.arange(k), len(x))
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(at[which])), pa.array((number + 1).astype(np.int32)), pa.array(np.full(len(which), own.n, np.int64)),
                    pa.array(own.deviations(x), pa.int64()).take(pa.array(which)), pa.array(own.whitened(x).ravel()), pa.array((own.values / own.trace)[number]),
                    pa.array(np.full(len(which), own.error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.mapInArrow(run, f"vec_id {dict(good.dtypes)['vec_id']}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
