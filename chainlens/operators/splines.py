"""Spline responses: building coefficients, finding segments, matching events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.operators.binning import axis_bin, join_hot

FLAT_TOLERANCE = 1e-5
METHODS = ("linear", "cubic", "akima", "monotonic", "kochanek_bartels")


def pack_knots(knots: DataFrame, keys: Sequence[str] = ("spline_id",), low: float | None = None,
               high: float | None = None, drop_flat: bool = True) -> DataFrame:
    """One row per spline with sorted knot arrays; values capped, flat splines dropped."""
    y = F.col("y").cast("double")
    if high is not None:
        y = F.least(y, F.lit(float(high)))
    if low is not None:
        y = F.greatest(y, F.lit(float(low)))
    packed = knots.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), y.alias("y")))).alias("_k"))
    flat = F.forall("_k", lambda k: F.abs(k["y"] - 1) <= FLAT_TOLERANCE)
    kept = packed.filter(~flat) if drop_flat else packed
    return kept.select(*keys, F.col("_k.x").alias("xs"), F.col("_k.y").alias("ys"))


def _slopes(x: np.ndarray, y: np.ndarray, method: str) -> np.ndarray:
    """Derivative at each knot of many splines with the same number of knots."""
    dx, dy = np.diff(x, axis=1), np.diff(y, axis=1)
    secant = dy / dx
    n = x.shape[1]
    if method == "akima":
        if n == 2:
            return np.repeat(secant, 2, axis=1)
        left = 2 * secant[:, :1] - secant[:, 1:2]
        right = 2 * secant[:, -1:] - secant[:, -2:-1]
        m = np.hstack([2 * left - secant[:, :1], left, secant, right, 2 * right - secant[:, -1:]])
        after, before = np.abs(m[:, 3:] - m[:, 2:-1]), np.abs(m[:, 1:-2] - m[:, :-3])
        weight = after + before
        mixed = (after * m[:, 1:-2] + before * m[:, 2:-1]) / np.where(weight == 0, 1, weight)
        return np.where(weight == 0, m[:, 2:-1], mixed)
    slope = np.empty_like(x)
    slope[:, 0], slope[:, -1] = secant[:, 0], secant[:, -1]
    middle = (secant[:, :-1] + secant[:, 1:]) / 2
    if method == "kochanek_bartels":
        slope[:, 1:-1] = middle
        return slope
    # Monotonic: flat where secants change sign, then shrink into the circle of radius 3.
    slope[:, 1:-1] = np.where((secant[:, :-1] >= 0) == (secant[:, 1:] >= 0), middle, 0.0)
    for i in range(n - 1):
        s = secant[:, i]
        safe = np.where(s == 0, 1.0, s)
        a, b = slope[:, i] / safe, slope[:, i + 1] / safe
        radius = np.hypot(a, b)
        shrink = np.where(radius > 3, 3 / np.maximum(radius, 1e-300), 1.0)
        slope[:, i] = np.where(s == 0, 0.0, np.where(a < 0, 0.0, slope[:, i]) * shrink)
        slope[:, i + 1] = np.where(s == 0, 0.0, np.where(b < 0, 0.0, slope[:, i + 1]) * shrink)
    return slope


def _second_derivatives(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives of not-a-knot cubic splines, one per row."""
    n = x.shape[1]
    h = np.diff(x, axis=1)
    s = np.diff(y, axis=1) / h
    if n == 3:
        return np.repeat(2 * (s[:, 1:] - s[:, :1]) / (x[:, 2:] - x[:, :1]), 3, axis=1)
    system, right = np.zeros((len(x), n, n)), np.zeros((len(x), n))
    i = np.arange(1, n - 1)
    system[:, i, i - 1], system[:, i, i + 1] = h[:, :-1], h[:, 1:]
    system[:, i, i] = 2 * (h[:, :-1] + h[:, 1:])
    right[:, 1:-1] = 6 * np.diff(s, axis=1)
    # The third derivative is continuous at the second and the last but one knot.
    system[:, 0, 0], system[:, 0, 1], system[:, 0, 2] = h[:, 1], -(h[:, 0] + h[:, 1]), h[:, 0]
    system[:, -1, -3], system[:, -1, -2], system[:, -1, -1] = h[:, -1], -(h[:, -2] + h[:, -1]), h[:, -2]
    return np.linalg.solve(system, right[..., None])[..., 0]


def _coefficients(x: np.ndarray, y: np.ndarray, method: str):
    dx = np.diff(x, axis=1)
    secant = np.diff(y, axis=1) / dx
    if method == "cubic":
        m = _second_derivatives(x, y)
        return secant - dx * (2 * m[:, :-1] + m[:, 1:]) / 6, m[:, :-1] / 2, np.diff(m, axis=1) / (6 * dx)
    slope = _slopes(x, y, method)
    left, right = slope[:, :-1], slope[:, 1:]
    return left, (3 * secant - 2 * left - right) / dx, (left + right - 2 * secant) / (dx * dx)


def build_splines(packed: DataFrame, method: str = "linear", keys: Sequence[str] = ("spline_id",)) -> DataFrame:
    """Add coefficient arrays b, c, d with one entry per segment.

    Linear splines stay in the JVM.  For the others a batch of splines is
    solved at once per number of knots; splines are independent rows, so no
    shuffle is needed.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if method == "linear":
        segments = F.sequence(F.lit(0), F.size("xs") - 2)
        slope = F.transform(segments, lambda i: (F.get("ys", i + 1) - F.get("ys", i)) / (F.get("xs", i + 1) - F.get("xs", i)))
        zero = F.transform(segments, lambda i: F.lit(0.0))
        return packed.select("*", slope.alias("b"), zero.alias("c"), zero.alias("d"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {name: [None] * len(pdf) for name in "bcd"}
            size = pdf["xs"].str.len().to_numpy()
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                x = np.stack(pdf["xs"].to_numpy()[rows]).astype(float)
                y = np.stack(pdf["ys"].to_numpy()[rows]).astype(float)
                how = method if n > 2 else "kochanek_bartels"
                for name, values in zip("bcd", _coefficients(x, y, how)):
                    for row, value in zip(rows, values):
                        out[name][row] = value
            yield pdf.assign(**out)

    types = dict(packed.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in packed.columns] + [f"{n} array<double>" for n in "bcd"])
    return packed.mapInPandas(solve, schema)


def spline_segment(xs: Column, x: Column) -> Column:
    """Largest knot <= x; 0 below the first, second to last above the last."""
    below = F.size(F.filter(xs, lambda k: k <= x)) - 1
    return F.greatest(F.lit(0), F.least(below, F.size(xs) - 2))


def spline_value(x: Column, clip: bool = True) -> Column:
    """Value of the spline row (xs, ys, b, c, d, segment) at x; negative weights become 0."""
    s = F.col("segment")
    dx = x - F.get("xs", s)
    value = F.get("ys", s) + dx * (F.get("b", s) + dx * (F.get("c", s) + dx * F.get("d", s)))
    return F.greatest(value, F.lit(0.0)) if clip else value


def evaluate_splines(splines: DataFrame, points: DataFrame, clip: bool = True) -> DataFrame:
    """Weight of every spline at every point: an equi-join on the parameter.

    All splines of a parameter share its key, so they are spread over the salts of
    ``join_hot``. The segment search runs once per (point, spline), never per event.
    """
    joined = join_hot(splines, points, ["param"]).withColumn("segment", spline_segment(F.col("xs"), F.col("value")))
    return joined.select("point", "spline_id", "param", "segment", spline_value(F.col("value"), clip).alias("weight"))


def evaluate_lines(lines: DataFrame, points: DataFrame, clip: bool = True) -> DataFrame:
    """Weight a x + b of every straight-line response (spline_id, param, a, b) at every point."""
    value = F.col("a") * F.col("value") + F.col("b")
    return join_hot(lines, points, ["param"]).select(
        "point", "spline_id", "param", (F.greatest(value, F.lit(0.0)) if clip else value).alias("weight"))


def match_splines(events: DataFrame, splines: DataFrame, axes: Sequence[tuple[str, Sequence[float]]],
                  name: str = "spline_ids") -> DataFrame:
    """Add the ids of the splines of each event's (sample, channel, mode, spline bins).

    ``axes`` are (variable, edges) per spline dimension; outside means none.
    Splines are grouped per key first, so the join keeps one row per event.
    """
    bins = [f"b{d + 1}" for d in range(len(axes))]
    keys = ["sample_id", "channel", "mode", *bins]
    lists = splines.groupBy(*keys).agg(F.sort_array(F.collect_set("spline_id")).alias(name))
    binned = events
    for b, (var, edges) in zip(bins, axes):
        binned = binned.withColumn(b, axis_bin(F.col(var), edges))
    joined = join_hot(binned, lists, keys, "left").drop(*bins)
    empty = F.array().cast(dict(lists.dtypes)[name])
    return joined.withColumn(name, F.coalesce(F.col(name), empty))
