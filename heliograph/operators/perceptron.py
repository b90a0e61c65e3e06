"""A perceptron with one hidden layer of rectified units, an L2 penalty and row weights.

The objective is the weighted mean of the log losses plus ``alpha`` / 2 times the sum of squared connection weights
(not of the offsets) over the summed row weights. A step of the optimiser (limited-memory BFGS with a backtracking
line search, on the driver) needs one sum of losses and gradients: tasks go through their rows in Arrow batches and
emit one gradient each, further tasks add those up, and ``GROUPS`` of them reach the driver, whatever the number
of rows. A gradient has hidden * (dim + 2) + 1 numbers.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import drop, written

#: Partial gradients that reach the driver.
GROUPS = 8
PARTIAL = "loss double, weight double, grad binary"


@dataclass(frozen=True)
class Shape:
    dim: int
    hidden: int

    @property
    def size(self) -> int:
        return self.hidden * (self.dim + 2) + 1

    def split(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Input weights (dim x hidden), hidden offsets, output weights, output offset."""
        d, h = self.dim, self.hidden
        return p[: d * h].reshape(d, h), p[d * h : d * h + h], p[d * h + h : -1], p[-1]

    def penalised(self) -> np.ndarray:
        mask = np.ones(self.size)
        mask[self.dim * self.hidden : self.dim * self.hidden + self.hidden] = 0.0
        mask[-1] = 0.0
        return mask

    def start(self, seed: int) -> np.ndarray:
        """Uniform within sqrt(6 / (units in + units out)), scaled for logistic units at the output."""
        rng = np.random.default_rng(seed)
        inner, outer = (6.0 / (self.dim + self.hidden)) ** 0.5, (2.0 / (self.hidden + 1)) ** 0.5
        first = rng.uniform(-inner, inner, self.hidden * (self.dim + 1))
        return np.concatenate([first, rng.uniform(-outer, outer, self.hidden + 1)])


def margins(shape: Shape, p: np.ndarray, x: np.ndarray) -> np.ndarray:
    w, b, v, c = shape.split(p)
    return np.maximum(x @ w + b, 0.0) @ v + c


def loss_and_gradient(
    shape: Shape, p: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray
) -> tuple[float, np.ndarray]:
    """Summed weighted log loss and its gradient by back-propagation, without the penalty."""
    w, b, v, c = shape.split(p)
    inner = np.maximum(x @ w + b, 0.0)
    z = inner @ v + c
    # log(1 + exp(-z)) for y = 1 and log(1 + exp(z)) for y = 0, without overflow
    loss = float(weight @ (np.maximum(z, 0.0) - z * y + np.log1p(np.exp(-np.abs(z)))))
    odds = np.exp(-np.abs(z))
    probability = np.where(z >= 0, 1.0, odds) / (1.0 + odds)
    out = weight * (probability - y)
    back = out[:, None] * v * (inner > 0)
    return loss, np.concatenate([(x.T @ back).ravel(), back.sum(0), inner.T @ out, [out.sum()]])


def minimise(
    f: Callable[[np.ndarray], tuple[float, np.ndarray]], p: np.ndarray, steps: int, tolerance: float, memory: int = 10
) -> tuple[np.ndarray, float, int]:
    """Limited-memory BFGS: (parameters, value, steps taken); ends when no entry of the gradient exceeds ``tolerance``."""
    value, grad = f(p)
    past: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=memory)
    for step in range(steps):
        if np.abs(grad).max() <= tolerance:
            return p, value, step
        way, factors = grad.copy(), []
        for s, y, r in reversed(past):
            a = r * (s @ way)
            way -= a * y
            factors.append(a)
        if past:
            s, y, r = past[-1]
            way *= 1.0 / (r * (y @ y))
        else:
            way /= max(1.0, float(np.linalg.norm(grad)))
        for (s, y, r), a in zip(past, reversed(factors), strict=True):
            way += s * (a - r * (y @ way))
        slope, length = float(grad @ way), 1.0
        if slope <= 0:  # curvature was lost; start again along the gradient
            past.clear()
            way, slope = grad / max(1.0, float(np.linalg.norm(grad))), float(grad @ grad) / max(1.0, float(np.linalg.norm(grad)))
        while True:
            new = p - length * way
            new_value, new_grad = f(new)
            if new_value <= value - 1e-4 * length * slope:
                break
            length /= 2.0
            if length < 1e-10:
                return p, value, step
        s, y = new - p, new_grad - grad
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            past.append((s, y, 1.0 / float(s @ y)))
        p, value, grad = new, new_value, new_grad
    return p, value, steps


@dataclass(frozen=True)
class Perceptron:
    shape: Shape
    parameters: np.ndarray
    loss: float
    steps: int

    def predict(self, rows: DataFrame, into: str = "p", vec: str = "vec") -> DataFrame:
        """``rows`` with the probability of class 1; all columns stay. Rows without vector get null."""
        shape, p, at = self.shape, self.parameters, rows.columns.index(vec)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                known = np.array(b.column(at).is_valid().to_pylist(), dtype=bool)
                x = b.column(at).drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int(known.sum()), shape.dim)
                out = np.zeros(len(b))
                z = margins(shape, p, x.astype(float))
                odds = np.exp(-np.abs(z))
                out[known] = np.where(z >= 0, 1.0, odds) / (1.0 + odds)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, mask=~known)], names=[*b.schema.names, into])

        fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
        return rows.mapInArrow(run, f"{fields}, `{into}` double")

    def save(self, spark: SparkSession, path: str) -> None:
        about = {"dim": self.shape.dim, "hidden": self.shape.hidden, "loss": self.loss, "steps": self.steps}
        row = [(json.dumps(about), self.parameters.tolist())]
        spark.createDataFrame(row, "about string, parameters array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Perceptron:
        row = spark.read.parquet(path).first()
        about = json.loads(row.about)
        return Perceptron(Shape(about["dim"], about["hidden"]), np.array(row.parameters), about["loss"], about["steps"])


def _summed(rows: DataFrame, shape: Shape, p: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Loss, weight and gradient over all (vec, label, w) rows."""

    def per_task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        loss, total, grad = 0.0, 0.0, np.zeros(shape.size)
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            y, w = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            part, g = loss_and_gradient(shape, p, x, y, w)
            loss, total, grad = loss + part, total + float(w.sum()), grad + g
        yield pa.RecordBatch.from_pylist([{"loss": loss, "weight": total, "grad": grad.tobytes()}])

    def per_group(batches: Iterator) -> Iterator:
        import pyarrow as pa

        loss, total, grad = 0.0, 0.0, np.zeros(shape.size)
        for b in batches:
            for r in b.to_pylist():
                loss, total, grad = loss + r["loss"], total + r["weight"], grad + np.frombuffer(r["grad"])
        yield pa.RecordBatch.from_pylist([{"loss": loss, "weight": total, "grad": grad.tobytes()}])

    partial = rows.mapInArrow(per_task, PARTIAL)
    if rows.rdd.getNumPartitions() > GROUPS:
        partial = partial.repartition(GROUPS).mapInArrow(per_group, PARTIAL)
    found = partial.collect()
    return (
        sum(r.loss for r in found), sum(r.weight for r in found), sum((np.frombuffer(r.grad) for r in found), np.zeros(shape.size))
    )


def fit(
    rows: DataFrame, hidden: int = 128, alpha: float = 1e-3, weight: str | None = None, seed: int = 0, steps: int = 200,
    tolerance: float = 1e-4,
) -> Perceptron:
    """Trained on (vec, label 0 or 1, and a column of row weights, null counting as 1).

    Rows without vector or label, or with a weight that is not positive, take no part; both classes have to be
    there. The result depends on the seed and, by the order of sums, in the last digits on the partitions.
    """
    own = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    data = rows.select(F.col("vec").cast("array<double>").alias("vec"), F.col("label").cast("double").alias("label"), own.alias("w"))
    data = written(data.where("vec IS NOT NULL AND label IN (0, 1) AND w > 0"), "perceptron")
    pos, neg, total, dim = data.agg(
        F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0), F.sum("w"), F.max(F.size("vec"))
    ).first()
    if not pos or not neg:
        raise ValueError("training needs positive and negative rows")
    shape = Shape(dim, hidden)
    mask = shape.penalised()

    def objective(p: np.ndarray) -> tuple[float, np.ndarray]:
        loss, _, grad = _summed(data, shape, p)
        return (loss + alpha / 2 * float(mask @ (p * p))) / total, (grad + alpha * mask * p) / total

    p, value, taken = minimise(objective, shape.start(seed), steps, tolerance)
    drop(data)
    return Perceptron(shape, p, value, taken)
