"""Values between scattered points of a plane: Delaunay triangles, a cell index, linear interpolation."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.operators.binning import broadcast_if_small

OUTER = -1  # stands for the point at infinity: (a, b, OUTER) is the half plane left of a hull edge a -> b
EPS = 1e-13


def _turn(a, b, c) -> int:
    """1 where a -> b -> c turns left, -1 right, 0 on a line; exact."""
    value = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    if abs(value) > EPS:
        return 1 if value > 0 else -1
    a, b, c = ([Fraction(float(v)) for v in p] for p in (a, b, c))
    value = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (value > 0) - (value < 0)


def _circle(rows: np.ndarray) -> np.ndarray:
    """Determinant of points relative to the one asked for (n, 3, 2): above 0 if that is inside their circle."""
    square = (rows ** 2).sum(2)
    (ax, ay), (bx, by), (cx, cy) = (rows[:, k].T for k in range(3))
    return square[:, 0] * (bx * cy - by * cx) - square[:, 1] * (ax * cy - ay * cx) + square[:, 2] * (ax * by - ay * bx)


def _exact_circle(points, p) -> int:
    rows = [[Fraction(float(v)) - Fraction(float(w)) for v, w in zip(q, p)] for q in points]
    s = [x * x + y * y for x, y in rows]
    (ax, ay), (bx, by), (cx, cy) = rows
    value = s[0] * (bx * cy - by * cx) - s[1] * (ax * cy - ay * cx) + s[2] * (ax * by - ay * bx)
    return (value > 0) - (value < 0)


def triangulate(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles (n, 3) of different points (m, 2), each turning left.

    Points are put in one after the other; triangles whose circle holds the new point, and half planes
    outside hull edges that it lies in, are replaced by those between their border and the
    point. Tests that are too close in floating point are done in fractions, so points on a line
    or a circle do no harm. Fewer than three points, or points on one line, have no triangles.
    """
    points = np.asarray(points, float)
    start = None
    for k in range(2, len(points)):
        turn = _turn(points[0], points[1], points[k])
        if turn:
            start = (0, 1, k) if turn > 0 else (1, 0, k)
            break
    if start is None:
        return np.zeros((0, 3), int)
    a, b, c = start
    found = [(a, b, c), (b, a, OUTER), (c, b, OUTER), (a, c, OUTER)]
    for p in (i for i in range(len(points)) if i not in start):
        here, table = points[p], np.array(found)
        bad = np.zeros(len(found), bool)
        inner = np.flatnonzero(table[:, 2] != OUTER)
        value = _circle(points[table[inner]] - here)
        bad[inner] = value > EPS
        for t in inner[np.abs(value) <= EPS]:
            bad[t] = _exact_circle(points[table[t]], here) > 0
        for t in np.flatnonzero(table[:, 2] == OUTER):
            u, v = points[table[t, 0]], points[table[t, 1]]
            turn = _turn(u, v, here)
            bad[t] = turn > 0 or (turn == 0 and ((here - u) @ (here - v)) < 0)
        edges = {e for t in table[bad].tolist() for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
        found = [t for t, gone in zip(found, bad) if not gone]
        for u, v in edges:
            if (v, u) not in edges:
                new = (u, v, p)
                while OUTER in new and new[2] != OUTER:
                    new = new[1:] + new[:1]
                found.append(new)
    return np.array([t for t in found if t[2] != OUTER], int).reshape(-1, 3)


def planes(graph: Sequence[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(corners (n, 3, 2), coefficients (n, 3)) of the triangles: value = c0 + c1 (x - x of the first corner) + c2 (y - ...).

    Both axes are scaled to the unit interval before points are joined. Points given several times have their mean value.
    """
    values: dict[tuple[float, float], list[float]] = {}
    for x, y, z in graph:
        values.setdefault((float(x), float(y)), []).append(float(z))
    points = np.array(list(values)).reshape(-1, 2)
    z = np.array([sum(v) / len(v) for v in values.values()])
    if not len(points):
        return np.zeros((0, 3, 2)), np.zeros((0, 3))
    width = np.ptp(points, axis=0)
    triangles = triangulate((points - points.min(0)) / np.where(width > 0, width, 1.0))
    corners, height = points[triangles], z[triangles]
    slopes = np.linalg.solve(corners[:, 1:] - corners[:, :1], (height[:, 1:] - height[:, :1])[..., None])[..., 0]
    return corners, np.column_stack([height[:, 0], slopes]) if len(corners) else np.zeros((0, 3))


def triangle_cells(corners: np.ndarray, coefficients: np.ndarray, cells: int | None = None):
    """(origin, width, cells per axis, rows (cell, triangles)): the triangles that may touch each cell of a grid."""
    n = cells or max(1, int(np.sqrt(len(corners))))
    low, high = corners.min((0, 1)), corners.max((0, 1))
    width = (high - low) / n
    index = lambda p: np.clip(np.floor((p - low) / width), 0, n - 1).astype(int)
    lists: dict[int, list] = {}
    for corner, c in zip(corners, coefficients):
        (i0, j0), (i1, j1) = index(corner.min(0)), index(corner.max(0))
        # Bounds widened by a cell's rounding: a point on a cell's edge may be put on either side.
        for i in range(max(0, i0 - 1), min(n, i1 + 2)):
            for j in range(max(0, j0 - 1), min(n, j1 + 2)):
                lists.setdefault(i * n + j, []).append((*map(float, corner.ravel()), *map(float, c)))
    return low, width, n, sorted(lists.items())


FIELDS = ("x0", "y0", "x1", "y1", "x2", "y2", "c0", "c1", "c2")


def _value(t: Column, x: Column, y: Column) -> Column:
    return t["c0"] + t["c1"] * (x - t["x0"]) + t["c2"] * (y - t["y0"])


def _holds(t: Column, x: Column, y: Column) -> Column:
    """Inside or on an edge, where neighbours have the same value; edges a rounding error wide."""
    area = (t["x1"] - t["x0"]) * (t["y2"] - t["y0"]) - (t["x2"] - t["x0"]) * (t["y1"] - t["y0"])
    out = F.lit(True)
    for a, b in ((0, 1), (1, 2), (2, 0)):
        turn = (t[f"x{b}"] - t[f"x{a}"]) * (y - t[f"y{a}"]) - (t[f"y{b}"] - t[f"y{a}"]) * (x - t[f"x{a}"])
        out = out & (turn >= -1e-12 * area)
    return out


def interpolated(df: DataFrame, x: Column, y: Column, graph: Sequence[tuple[float, float, float]], name: str,
                 outside: float | None = None) -> DataFrame:
    """Add ``name``, the value of the scattered graph (x, y, value) at (x, y), linear in each Delaunay triangle.

    ``outside`` is the value beyond the hull. A row meets the triangles of one cell by an equi-join with
    the cell table, which follows the points of the graph. Null and NaN have no value.
    """
    rest = F.lit(None if outside is None else float(outside)).cast("double")
    known = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    corners, coefficients = planes(graph)
    if not len(corners):
        return df.withColumn(name, F.when(known, rest))
    low, width, n, rows = triangle_cells(corners, coefficients)
    kind = ", ".join(f"{f}: double" for f in FIELDS)
    table = df.sparkSession.createDataFrame(rows, f"_cell int, _t array<struct<{kind}>>")
    index = [F.least(F.greatest(F.floor((v - float(low[d])) / float(width[d])), F.lit(0)), F.lit(n - 1)) for d, v in enumerate((x, y))]
    inside = known & (x >= float(low[0])) & (x <= float(low[0] + n * width[0])) & (y >= float(low[1])) & (y <= float(low[1] + n * width[1]))
    keyed = df.withColumn("_cell", F.when(inside, index[0] * n + index[1]).cast("int"))
    joined = keyed.join(broadcast_if_small(table), "_cell", "left")
    hit = F.get(F.filter("_t", lambda t: _holds(t, x, y)), F.lit(0))
    return joined.withColumn(name, F.when(known, F.coalesce(_value(hit, x, y), rest))).select(*df.columns, name)
