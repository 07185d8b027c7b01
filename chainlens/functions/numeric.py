"""Functions Spark SQL lacks, as Arrow-batched UDFs, and a small curve fit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0: Stirling's series from x >= 10 on, below by the recurrence; inf for x <= 0."""
    x = np.asarray(x, float)
    moved, below = x.copy(), np.zeros_like(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(10):
            small = moved < 10
            below += np.where(small, np.log(np.where(small, moved, 1.0)), 0.0)
            moved = np.where(small, moved + 1, moved)
        r = 1 / (moved * moved)
        # 1/12, 1/360, 1/1260, 1/1680, 1/1188, 691/360360, 1/156 of the published series.
        series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (
            1 / 1188 - r * (691 / 360360 - r / 156)))))) / moved
        out = (moved - 0.5) * np.log(moved) - moved + 0.5 * np.log(2 * np.pi) + series - below
    return np.where(x > 0, out, np.inf)


@F.pandas_udf(DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    return pd.Series(log_gamma(x.to_numpy()))


@F.pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    """Lower-tail probability of a standard normal."""
    return pd.Series([0.5 * math.erfc(-v / math.sqrt(2.0)) for v in z], dtype=float)


def fit_curve(model, start, x, y, sigma, low, high, steps: int = 200):
    """Bounded least squares by damped Gauss-Newton on at most a few 10^4 points.

    Returns the parameters and whether the cost came to rest within ``steps``.
    """
    low, high = np.asarray(low, float), np.asarray(high, float)
    p = np.clip(np.asarray(start, float), low, high)

    def residual(q):
        return (model(x, q) - y) / sigma

    r = residual(p)
    cost, damping, rests = float(r @ r), 1e-3, False
    for _ in range(steps):
        jac = np.empty((len(x), len(p)))
        for k in range(len(p)):
            h = 1e-6 * max(abs(p[k]), 1e-6)
            q = p.copy()
            q[k] += h
            jac[:, k] = (residual(q) - r) / h
        normal = jac.T @ jac
        scale = np.maximum(np.diag(normal), 1e-12)
        try:
            move = np.linalg.solve(normal + damping * np.diag(scale), -jac.T @ r)
        except np.linalg.LinAlgError:
            break
        trial = np.clip(p + move, low, high)
        r_trial = residual(trial)
        new_cost = float(r_trial @ r_trial)
        if np.isfinite(new_cost) and new_cost <= cost:
            done = cost - new_cost <= 1e-12 * max(cost, 1e-300)
            p, r, cost, damping = trial, r_trial, new_cost, max(damping / 5, 1e-12)
            if done:
                rests = True
                break
        else:
            damping *= 5
            if damping > 1e12:
                rests = True  # no step lowers the cost
                break
    return p, rests
