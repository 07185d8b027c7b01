import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlens.operators import chain, scattered


def area(p):
    return 0.5 * ((p[1][0] - p[0][0]) * (p[2][1] - p[0][1]) - (p[1][1] - p[0][1]) * (p[2][0] - p[0][0]))


@pytest.mark.parametrize("seed", range(4))
def test_circles_of_triangles_are_empty(seed):
    points = np.random.default_rng(seed).uniform(0, 1, (18, 2))
    want = set()
    for t in itertools.combinations(range(18), 3):
        t = t if area(points[list(t)]) > 0 else (t[0], t[2], t[1])
        rest = [p for p in range(18) if p not in t]
        if all(scattered._circle(points[list(t)][None] - points[p])[0] <= 0 for p in rest):
            want.add(frozenset(t))
    got = scattered.triangulate(points)
    assert {frozenset(t) for t in got.tolist()} == want and all(area(points[t]) > 0 for t in got)


@pytest.mark.parametrize("order", [0, 1, 2])
def test_points_on_lines_and_circles(order):
    grid = np.array(list(itertools.product(np.arange(5) / 4, np.arange(4) / 3)))
    ring = np.array([(0.5 + 0.5 * math.cos(k), 0.5 + 0.5 * math.sin(k)) for k in np.arange(12) * math.pi / 6])
    for points, whole in ((grid, 1.0), (ring, 0.75)):
        points = points[np.random.default_rng(order).permutation(len(points))]
        triangles = scattered.triangulate(points)
        assert sum(area(points[t]) for t in triangles) == pytest.approx(whole)
        assert min(area(points[t]) for t in triangles) > 1e-6
    assert len(scattered.triangulate(grid)) == 24
    for few in (grid[:0], grid[:1], grid[:2], grid[:4]):  # the last lie on one line
        assert len(scattered.triangulate(few)) == 0


def test_values_between_points(spark):
    rng = np.random.default_rng(3)
    graph = [(float(x), float(y) * 1e-3, 2 + 3 * float(x) - 500 * float(y) * 1e-3) for x, y in rng.uniform(0, 1, (60, 2))]
    graph += [(x, y * 1e-3, 2 + 3 * x - 500 * y * 1e-3) for x in (0.0, 1.0) for y in (0.0, 1.0)] * 2  # repeated points
    rows = [(float(x), float(y) * 1e-3) for x, y in rng.uniform(0, 1, (300, 2))] + [g[:2] for g in graph]
    df = spark.createDataFrame(rows, "x double, y double").withColumn("_b", F.lit(1))
    out = scattered.interpolated(df, F.col("x"), F.col("y"), graph, "z").collect()
    assert len(out) == len(rows)
    for r in out:  # a plane is kept by linear interpolation
        assert r.z == pytest.approx(2 + 3 * r.x - 500 * r.y, abs=1e-9) and r["_b"] == 1


def test_odd_points_and_graphs(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(None, 1.0), (nan, 0.5), (0.5, nan), (inf, 0.5), (9.0, 9.0), (0.5, 0.25)], "x double, y double")
    corner = [(0.0, 0.0, 1.0), (1.0, 0.0, 2.0), (0.0, 1.0, 3.0)]
    z = lambda graph, **o: [r.z for r in scattered.interpolated(df, F.col("x"), F.col("y"), graph, "z", **o).collect()]
    assert z(corner) == [None, None, None, None, None, 2.0]
    assert z(corner, outside=7.0) == [None, None, None, 7.0, 7.0, 2.0]
    assert z([]) == [None] * 6 and z(corner[:2], outside=0.0) == [None, None, None, 0.0, 0.0, 0.0]


def test_weights_by_sign_of_the_splitting(spark):
    normal = [(0.0, 0.0, 0.0), (1.0, 0.0, 2.0), (0.0, 1.0, 0.0), (1.0, 1.0, 2.0)]
    inverted = [(0.0, 0.0, 4.0), (1.0, 0.0, 4.0), (0.0, 1.0, 4.0)]
    rows = [(0.5, 0.5), (0.25, -0.25), (0.9, -0.9), (0.0, 0.5), (2.0, 0.5), (None, 0.5), (0.5, None)]
    df = spark.createDataFrame(rows, "x double, dm2 double")
    got = [r.Weight for r in chain.reweight_scattered_2d(df, "x", "dm2", normal, inverted).collect()]
    # Beyond the hull but within the range chi2 is 0; the range is open.
    assert got == pytest.approx([math.exp(-0.5), math.exp(-2.0), 1.0, 0.0, 0.0, 0.0, 0.0])
