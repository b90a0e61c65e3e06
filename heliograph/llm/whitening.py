"""Whitening of embeddings by cyclic Jacobi rotations.

Entries c become integers x = floor(256 c), so that counts, sums and distances are exact. The fit list holds
every distinct x vector once. One pass sums it in whole numbers, a second one adds up the centred scatter
matrix: each task reduces its rows to a d x d matrix, and the cells of those meet in a grouped sum. The driver
sees d x d numbers, whatever the table's size, and rotates them until nothing is left beside the diagonal.
The sorted matrix (``keep`` x d) goes out to the tasks with the functions that use it.

Jacobi rotations stop by |a_ij| <= eps * sqrt(a_ii * a_jj), which leaves small eigenvalues their own relative
accuracy. A sweep visits all pairs in d - 1 rounds of d / 2 disjoint pairs, so a round is a few array operations.

Edge cases:

* Vectors null, or with null, NaN or infinite entries, take no part. Nor do vectors whose length is not the
  table's (the length of most valid vectors; of equally frequent ones the larger), nor such with an entry of
  |256 c| >= 2^53, where doubles no longer tell neighbouring integers apart.
* Repeated rows give repeated results; the fit list has their vector once.
* Components whose eigenvalue is zero (no more than d * eps * trace, rounding alone) cannot be whitened:
  ``whitened`` is null for them, and ``identity_error`` covers the others. If there are none it is null.
* ``deviation`` is null where it does not fit in 64 bits.
* An empty table, or one without valid vectors, gives no rows. Ids may be null or repeat. Other columns are
  not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

EPS = float(np.finfo(np.float64).eps)
SCALE, EXACT = 256.0, float(1 << 53)
#: Components returned for each row.
KEEP = 4
#: Sweeps that are enough for any matrix in practice; six to ten are usual.
SWEEPS = 60
RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d indices as rounds of disjoint pairs (round-robin)."""
    ring = list(range(d)) + ([-1] if d % 2 else [])
    out = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(min(p), max(p)) for p in zip(ring[:half], reversed(ring[half:]), strict=True) if -1 not in p]
        if pairs:
            out.append(tuple(np.array(side) for side in zip(*pairs, strict=True)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (as rows) of a symmetric positive semidefinite matrix."""
    a = np.array(matrix, dtype=np.float64)
    d = len(a)
    v = np.eye(d)
    rounds = _rounds(d)
    for _ in range(SWEEPS):
        turned = False
        for i, j in rounds:
            off, ai, aj = a[i, j], a[i, i], a[j, j]
            todo = np.abs(off) > EPS * np.sqrt(np.abs(ai * aj))
            if not todo.any():
                continue
            turned = True
            i, j, off, ai, aj = i[todo], j[todo], off[todo], ai[todo], aj[todo]
            with np.errstate(over="ignore"):
                theta = (aj - ai) / (2.0 * off)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1.0 / np.hypot(t, 1.0)
            s = t * c
            left, right = a[:, i].copy(), a[:, j].copy()
            a[:, i], a[:, j] = c * left - s * right, s * left + c * right
            left, right = a[i].copy(), a[j].copy()
            a[i], a[j] = c[:, None] * left - s[:, None] * right, s[:, None] * left + c[:, None] * right
            a[i, i], a[j, j] = ai - t * off, aj + t * off
            a[i, j] = a[j, i] = 0.0
            left, right = v[:, i].copy(), v[:, j].copy()
            v[:, i], v[:, j] = c * left - s * right, s * left + c * right
        if not turned:
            break
    else:
        raise ArithmeticError(f"no convergence in {SWEEPS} sweeps")
    values = np.maximum(np.diag(a), 0.0)
    order = np.argsort(-values, kind="stable")
    vectors = v.T[order]
    return values[order], vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@dataclass(frozen=True)
class Whitening:
    """What a fit found: d numbers and ``keep`` x d numbers, independent of the table's size."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def usable(self) -> np.ndarray:
        """Which eigenvalues are more than rounding."""
        return self.values > len(self.sums) * EPS * self.trace

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers in the whitened basis, NaN where a component has no variance."""
        scale = np.full(len(self.values), np.nan)
        scale[self.usable] = 1.0 / np.sqrt(self.values[self.usable])
        return centred(x, self.n, self.sums) @ self.vectors.T * scale


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S / n; the whole part of S / n is taken off exactly first."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly; None where 64 bits do not hold it."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * len(sums) < 1 << 63:
        return (((n * x) - np.array(sums, dtype=np.int64)) ** 2).sum(1).tolist()
    exact = (((n * x.astype(object)) - np.array(sums, dtype=object)) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the valid vectors as integers, all of the table's length."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE >= EXACT))
    valid = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~bad)
    lengths = valid.groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return valid.select(F.col(id_col).cast("long").alias("vec_id"), F.array().cast("array<long>").alias("x"))
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("long"))
    return valid.where(F.size(vec_col) == lengths["d"]).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def fit(x: DataFrame, keep: int = KEEP) -> tuple[Whitening, DataFrame] | None:
    """The whitening of (x) rows and the fit list it is from; None without rows."""
    points = written(x.select("x").distinct(), "whitening-points")
    first = points.first()
    if first is None:
        return None
    d = len(first["x"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for b in batches:
            m = _matrix(b.column(0), d)
            n += len(m)
            top = int(np.abs(m).max(initial=0)) * len(m)
            part = m.sum(0) if top < 1 << 62 else m.astype(object).sum(0)
            sums = [a + int(p) for a, p in zip(sums, part, strict=True)]
        places = pa.array(range(d + 1), pa.int32())
        yield pa.RecordBatch.from_arrays([places, pa.array([str(s) for s in [n, *sums]])], names=["i", "s"])

    parts = points.mapInArrow(add_up, "i int, s string")
    rows = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    totals = [int(s) for _, s in sorted((r["i"], r["s"]) for r in rows)]
    n, sums = totals[0], tuple(totals[1:])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            z = centred(_matrix(b.column(0), d), n, sums)
            total += z.T @ z
        i, j = np.triu_indices(d)
        cells = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])]
        yield pa.RecordBatch.from_arrays(cells, names=["i", "j", "v"])

    cells = points.mapInArrow(scatter, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    cov = np.zeros((d, d))
    for i, j, v in cells:
        cov[i, j] = cov[j, i] = v / n
    values, vectors = jacobi(cov)
    keep = min(keep, d)
    return Whitening(n, sums, float(np.trace(cov)), values[:keep], vectors[:keep]), points


def identity_error(model: Whitening, points: DataFrame) -> float | None:
    """Largest absolute entry of the fit list's whitened covariance minus the identity."""
    on, k = model.usable, int(model.usable.sum())
    if not k:
        return None
    d = len(model.sums)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            y = model.project(_matrix(b.column(0), d))[:, on]
            first += y.sum(0)
            second += y.T @ y
        i, j = (np.append(side, np.full(k, -1)) for side in np.triu_indices(k))
        j[-k:] = np.arange(k)
        v = np.append(second[np.triu_indices(k)], first)
        cells = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(v)]
        yield pa.RecordBatch.from_arrays(cells, names=["i", "j", "v"])

    cells = points.mapInArrow(scatter, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean, cov = np.zeros(k), np.zeros((k, k))
    for i, j, v in cells:
        if i < 0:
            mean[j] = v / model.n
        else:
            cov[i, j] = cov[j, i] = v / model.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: int = KEEP) -> DataFrame:
    """Each valid vector's first ``keep`` whitened components, with the fit's figures; see the module's text."""
    x = integers(vectors, id_col, vec_col)
    fitted = fit(x, keep)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    model, points = fitted
    error = identity_error(model, points)
    d, k = len(model.sums), len(model.values)
    explained = model.values / model.trace if model.trace > 0 else np.zeros(k)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1), d)
            size = len(m)
            y = model.project(m).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(size), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, model.n, dtype=np.int64)),
                    pa.array([v for v in deviation(m, model.n, model.sums) for _ in range(k)], pa.int64()),
                    pa.array(y, mask=np.isnan(y)),
                    pa.array(np.tile(explained, size)),
                    pa.array([error] * (size * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(emit, RESULT)
