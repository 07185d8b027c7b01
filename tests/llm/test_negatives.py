import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlens.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def rows_of(n, dims=6, seed=1, same=False):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    out = []
    for i in range(n):
        label = rng.randrange(4)
        out.append((i, label, centres[label] if same else [c + rng.gauss(0, .7) for c in centres[label]]))
    return out


def by_hand(rows, scale=256):
    whole = [(i, y, [int(np.floor(scale * np.float64(np.float32(x)))) for x in v]) for i, y, v in rows]
    width = max((len(v) for _, _, v in whole), default=0)
    whole = [(i, y, np.array(v + [0] * (width - len(v)), object)) for i, y, v in whole]
    out = []
    for i, y, v in (r for r in whole if r[0] % 10 == 0):
        scored = sorted(((-int((v * w).sum()), j, label) for j, label, w in whole if j != i))
        for p, j, _ in [s for s in scored if s[2] == y][:5]:
            fits = [s for s in scored if s[2] != y and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(i, j, k + 1, other, -p, -s) for k, (s, other, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **options):
    df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in negatives.mine(negatives.quantised(df, 256), F.col("vec_id") % 10 == 0, **options).collect())


@pytest.mark.parametrize("block, tile", [(256, 64), (7, 3)])
def test_mine_matches_all_scores(spark, block, tile):
    rows = rows_of(240)
    assert mined(spark, rows, block=block, tile=tile) == by_hand(rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = rows_of(150, same=True)
    assert mined(spark, rows, block=8, tile=4) == by_hand(rows)


def test_odd_vectors(spark):
    rows = rows_of(60)
    odd = [(None, 1, [1.0] * 6), (500, None, [1.0] * 6), (501, 1, None), (502, 1, [1.0, None]), (503, 1, [float("nan")] * 6),
           (504, 2, [float("inf")] + [0.0] * 5)]
    short = [(510, 1, []), (511, 2, [2.0, 1.0]), (512, 0, [-1.0])]
    df = spark.createDataFrame(rows + odd + short, SCHEMA).withColumn("block", F.lit("own")).withColumn("place", F.lit(1))
    assert mined(spark, df, block=16, tile=4) == by_hand(rows + short)
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0]), (3, 2, [1.0])]) == []
    large = [(i, i % 2, [1e30, float(i)]) for i in range(30)]
    assert all(abs(r[4]) <= 9.3e18 for r in mined(spark, large))


def test_repeated_rows_each_count(spark):
    rows = rows_of(40) + [(77, 1, rows_of(40)[3][2])] * 3
    got = mined(spark, rows, block=8, tile=4)
    assert got == by_hand(rows)


def test_neighbours_on_the_curve_differ_by_one_cell():
    for dims, bits in ((2, 3), (3, 2), (4, 1)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        places = negatives.hilbert(grid, bits)
        assert len(set(places)) == len(grid)
        path = grid[sorted(range(len(grid)), key=places.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_leave_blocks_unread(spark):
    """Clusters far apart: a window does not read the blocks of most of them."""
    rng = random.Random(4)
    rows = [(i, i % 2, [10.0 * (i % 16 == k) + rng.gauss(0, .1) for k in range(16)]) for i in range(800)]
    placed, dims = negatives.along_curve(negatives.quantised(spark.createDataFrame(rows, SCHEMA), 256))
    blocks = negatives.blocked(placed, dims, 20).cache()
    tiles = negatives.blocked(placed.where("vec_id % 100 = 0"), dims, 1).withColumnRenamed("block", "tile")
    asked = tiles.select("tile", "ids", "labels", "m", F.array(F.struct(
        F.lit(0).cast("long").alias("query"), F.lit(0).cast("long").alias("anchor"), F.lit(3.0e6).alias("lo"),
        F.lit(float("inf")).alias("hi"), F.lit(float("-inf")).alias("worst"), F.lit(1 << 62).alias("worst_id"))).alias("q"))
    pairs = negatives._to_read(asked, negatives.zone_maps(blocks), dims, True, False).count()
    assert 0 < pairs < 0.3 * 8 * blocks.count()
