"""Small dense-matrix regressions that the classifiers fit on the driver, on samples of a stated size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def balanced_sample(rows: DataFrame, label: str, key: Column, most: int) -> DataFrame:
    """About ``most`` rows of each label (all, if fewer) with ``share``, the part of its label's rows taken.

    Rows are taken by hash of ``key``, the same ones in every run.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    shares = {k: min(1.0, most / n) for k, n in sizes.items() if k is not None}
    share = F.lit(None).cast("double")
    for k, s in shares.items():
        share = F.when(F.col(label) == k, s).otherwise(share)
    return rows.withColumn("share", share).where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000)) < F.col("share") * 1_000_000)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 60) -> np.ndarray:
    """Weights and a last intercept by Newton steps on the weighted log-loss; the ridge acts on standardised columns."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6) * weight.sum()
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    w[:-1] /= scale
    w[-1] -= w[:-1] @ centre
    return w
