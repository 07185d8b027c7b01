"""Assigning events to analysis bins, and checks of a binning."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.functions.expr import edge_bin, inner_bin, is_equal_width
from chainlens.session import stored

# A side is broadcast only after its rows and their bytes were counted.
BROADCAST_BYTES = 32 << 20
# A key with more rows than this is dealt out; equal rows go in shares, small enough to reach every salt.
HEAVY_ROWS, SHARE, HEAVY_BYTES = 50_000, 1_000, 32 << 20


def _bytes_of(df: DataFrame) -> Column:
    """Rough bytes of a row: fixed columns by their width, others by their text form."""
    wide = [F.length(F.to_json(F.struct(F.col(f"`{c}`").alias("v")))) if t.startswith(("array", "struct", "map"))
            else F.length(F.col(f"`{c}`")) for c, t in df.dtypes if t in ("string", "binary") or t.startswith(("array", "struct", "map"))]
    total = F.lit(16 + 8 * len(df.columns))
    for w in wide:
        total = total + F.coalesce(w, F.lit(0))
    return total


def broadcast_if_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """Broadcast hint for a side whose bytes were counted; else it is left to the planner.

    A row has 16 bytes at least, so rows beyond the limit are not even counted.
    """
    most = BROADCAST_BYTES if most is None else most
    return F.broadcast(df) if _size(df, most) <= most else df


def _size(df: DataFrame, most: int) -> int:
    """Bytes of the table, or of as many rows as surely exceed ``most``."""
    return df.limit(most // 16 + 1).agg(F.sum(_bytes_of(df))).first()[0] or 0


def heavy_keys(big: DataFrame, keys: Sequence[str], most: int | None = None) -> DataFrame:
    """The keys that more than ``most`` rows have, and how many (``_n``)."""
    most = HEAVY_ROWS if most is None else most
    return big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)


def _marked(df: DataFrame, heavy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_heavy``, whether the row has a heavy key; null is a key like any other."""
    other = heavy.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(True).alias("_hit"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(F.broadcast(other), same, "left").withColumn("_heavy", F.coalesce("_hit", F.lit(False))).drop(
        "_hit", *[f"_k_{k}" for k in keys])


def dealt(marked: DataFrame, salts: int) -> DataFrame:
    """Replace ``_heavy`` by ``_salt`` and ``_copies``: rows with heavy keys are dealt to the salts.

    The salt follows from the row's own values. Equal rows are counted first and dealt in
    shares, so they spread as well, and a task that is repeated, with its rows in
    another order, deals them alike.
    """
    columns = [c for c in marked.columns if c != "_heavy"]
    light = marked.where(~F.col("_heavy")).drop("_heavy").withColumns(
        {"_salt": F.lit(0).cast("long"), "_copies": F.lit(1).cast("long")})
    n = F.col("_n")
    shares = F.ceil(n / SHARE).cast("long")
    rows = marked.where("_heavy").groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
    return light.unionByName(rows.select(
        *columns, F.pmod(F.xxhash64(*columns) + F.col("_share"), F.lit(salts)).alias("_salt"),
        F.least(F.lit(SHARE).cast("long"), n - F.col("_share") * SHARE).alias("_copies")))


def join_hot(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """Equi-join of events to a lookup table whose keys may be very unevenly hit.

    A lookup table of checked size is broadcast. For a larger one the rows per key are counted;
    only those of heavy keys are dealt to salts (:func:`dealt`), and only these keys of the
    lookup table are repeated per salt. If these are too many to broadcast, keys count as
    heavy from more rows on, until they are not.
    """
    keys = list(keys)
    hinted = broadcast_if_small(small)
    if hinted is not small:
        return big.join(hinted, keys, how)
    found = heavy = stored(heavy_keys(big, keys), "heavy")
    if found.isEmpty():
        return big.join(small, keys, how)
    most = HEAVY_ROWS
    while _size(heavy, HEAVY_BYTES) > HEAVY_BYTES:
        most *= 64
        heavy = found.where(F.col("_n") > most)
    last = F.when(F.col("_heavy"), F.lit(salts - 1)).otherwise(F.lit(0)).cast("long")
    repeated = _marked(small, heavy, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("_heavy")
    joined = dealt(_marked(big, heavy, keys), salts).join(repeated, [*keys, "_salt"], how).drop("_salt")
    return joined.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copies")


def axis_bin(x: Column, edges: Sequence[float]) -> Column:
    """Bin with edge <= x < next edge, null outside, by comparison with the edges as they are given.

    On a long axis of equal widths the bin is worked out and then corrected by its edges,
    which gives the same bin without a search.
    """
    edges = [float(e) for e in edges]
    n = len(edges) - 1
    if n <= 256 or not is_equal_width(edges):
        return edge_bin(x, edges)
    table, place = F.lit(edges), F.coalesce(inner_bin(x, edges[0], edges[-1], n), F.lit(0))
    place = F.when(x < F.get(table, place), place - 1).when(x >= F.get(table, place + 1), place + 1).otherwise(place)
    return F.when((x >= edges[0]) & (x < edges[-1]), place)


def every_bin(spark: SparkSession, axes: Sequence[dict]) -> DataFrame:
    """All bins (sample_id, bin) of the axes; the records are configuration."""
    sizes: dict[int, int] = {}
    for axis in axes:
        sizes[axis["sample_id"]] = sizes.get(axis["sample_id"], 1) * (len(axis["edges"]) - 1)
    rows = spark.createDataFrame(sorted(sizes.items()), "sample_id int, n int")
    return rows.select("sample_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"))


def sample_offsets(axes: Sequence[dict]) -> dict[int, int]:
    """First global bin of each sample, in order of sample number."""
    sizes: dict[int, int] = {}
    for axis in axes:
        s = axis["sample_id"]
        sizes[s] = sizes.get(s, 1) * (len(axis["edges"]) - 1)
    offsets, start = {}, 0
    for s in sorted(sizes):
        offsets[s] = start
        start += sizes[s]
    return offsets


def assign_bin_uniform(events: DataFrame, axes: Sequence[dict]) -> DataFrame:
    """Add ``bin`` and ``global_bin``; events outside any axis are dropped.

    ``axes`` are configuration records (sample_id, dim, var, edges).  The first
    dimension runs fastest.  No join is made: edges become comparisons.
    """
    offsets = sample_offsets(axes)
    local, shifted = F.lit(None).cast("int"), F.lit(None).cast("int")
    for s in sorted(offsets):
        own = sorted((a for a in axes if a["sample_id"] == s), key=lambda a: a["dim"])
        index, stride = F.lit(0), 1
        for axis in own:
            index = index + axis_bin(F.col(axis["var"]), axis["edges"]) * stride
            stride *= len(axis["edges"]) - 1
        here = F.col("sample_id") == s
        local = F.when(here, index).otherwise(local)
        shifted = F.when(here, F.lit(offsets[s])).otherwise(shifted)
    return (
        events.withColumn("bin", local.cast("int"))
        .filter("bin is not null")
        .withColumn("global_bin", F.col("bin") + shifted)
    )


def fine_grid(boxes: DataFrame, dims: int, most: int = 32) -> int:
    """Cells per dimension that leave about one box in a cell: two per box along a side, ``most`` at most."""
    n = boxes.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    return max(2, min(most, math.ceil(2 * n ** (1 / dims))))


def _cells(boxes: DataFrame, dims: int, grid: int):
    """Extent and cell width per sample and dimension, as columns of the boxes."""
    extent = boxes.groupBy("sample_id").agg(*[
        e for d in range(dims) for e in (
            F.min(F.element_at("lo", d + 1)).alias(f"_min{d}"), F.max(F.element_at("hi", d + 1)).alias(f"_max{d}"))])

    def cell(x: Column, d: int) -> Column:
        raw = F.floor((x - F.col(f"_min{d}")) / (F.col(f"_max{d}") - F.col(f"_min{d}")) * grid)
        return F.greatest(F.lit(0), F.least(F.lit(grid - 1), raw)).cast("int")

    return extent, cell


def box_cells(boxes: DataFrame, dims: int, grid: int = 32) -> DataFrame:
    """Boxes that touch each cell of a coarse grid: (sample_id, cells, boxes array).

    A cell's list is bounded by the number of boxes of one sample.
    """
    extent, cell = _cells(boxes, dims, grid)
    spread = boxes.join(extent, "sample_id")
    for d in range(dims):
        spread = spread.withColumn(f"_c{d}", F.explode(F.sequence(
            cell(F.element_at("lo", d + 1), d), cell(F.element_at("hi", d + 1), d))))
    return spread.groupBy("sample_id", *[f"_c{d}" for d in range(dims)]).agg(
        F.sort_array(F.collect_list(F.struct("bin", "lo", "hi"))).alias("_boxes"))


def assign_bin_boxes(events: DataFrame, boxes: DataFrame, variables: Sequence[str],
                     grid: int | None = None, keep_outside: bool = False) -> DataFrame:
    """Add ``bin``: the first box with lo < x <= hi on every axis.

    An event meets one coarse cell by an equi-join and is tested only against
    the boxes of that cell, so no event is duplicated. The cells are written once; their
    number follows the number of boxes unless ``grid`` gives it per dimension.
    """
    dims = len(variables)
    grid = grid or fine_grid(boxes, dims)
    extent, cell = _cells(boxes, dims, grid)
    cells = stored(box_cells(boxes, dims, grid), "cells")
    keyed = events.join(F.broadcast(extent), "sample_id", "left")  # one row per sample
    for d, v in enumerate(variables):
        keyed = keyed.withColumn(f"_c{d}", cell(F.col(v), d))
    keyed = keyed.drop(*[f"_{m}{d}" for d in range(dims) for m in ("min", "max")])
    keys = ["sample_id", *[f"_c{d}" for d in range(dims)]]
    joined = join_hot(keyed, cells, keys, "left")

    def inside(box: Column) -> Column:
        tests = [(F.col(v) > F.element_at(box["lo"], d + 1)) & (F.col(v) <= F.element_at(box["hi"], d + 1))
                 for d, v in enumerate(variables)]
        return reduce(lambda a, b: a & b, tests)

    found = joined.withColumn("bin", F.get(F.filter("_boxes", inside), F.lit(0))["bin"]).drop(
        "_boxes", *[f"_c{d}" for d in range(dims)])
    return found if keep_outside else found.filter("bin is not null")


def overlapping_bins(boxes: DataFrame, dims: int, grid: int = 32) -> DataFrame:
    """Pairs of boxes of a sample that overlap in all dimensions.

    Candidates share a coarse cell, so boxes are not compared all with all.
    """
    extent, cell = _cells(boxes, dims, grid)
    spread = boxes.select("sample_id", "bin", "lo", "hi").join(extent, "sample_id")
    for d in range(dims):
        spread = spread.withColumn(f"_c{d}", F.explode(F.sequence(
            cell(F.element_at("lo", d + 1), d), cell(F.element_at("hi", d + 1), d))))
    keys = ["sample_id", *[f"_c{d}" for d in range(dims)]]
    a = spread.select(*keys, F.col("bin").alias("bin_i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"))
    b = spread.select(*keys, F.col("bin").alias("bin_j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"))
    tests = [(F.element_at("lo_i", d + 1) < F.element_at("hi_j", d + 1))
             & (F.element_at("lo_j", d + 1) < F.element_at("hi_i", d + 1)) for d in range(dims)]
    return a.join(b, keys).filter(F.col("bin_i") < F.col("bin_j")).filter(
        reduce(lambda x, y: x & y, tests)).select("sample_id", "bin_i", "bin_j").distinct()


def gap_points(boxes: DataFrame, dims: int, points: int = 100, grid: int = 32) -> DataFrame:
    """Midpoints of a regular grid over a sample's extent that no box covers."""
    extent, _ = _cells(boxes, dims, grid)
    samples = [r.asDict() for r in extent.collect()]  # one row per sample
    # Points are numbered, so that they are made in parallel and not from one row per sample.
    mesh = boxes.sparkSession.range(points ** dims).withColumn("_e", F.explode(F.array(*[
        F.struct(F.lit(e["sample_id"]).cast(dict(boxes.dtypes)["sample_id"]).alias("sample_id"), *[
            F.lit(float(e[f"_{m}{d}"])).alias(f"_{m}{d}") for d in range(dims) for m in ("min", "max")]) for e in samples]))).select(
        "id", "_e.*")
    names = []
    for d in range(dims):
        i, width = F.floor(F.col("id") / points ** d) % points, (F.col(f"_max{d}") - F.col(f"_min{d}")) / points
        mesh = mesh.withColumn(f"x{d}", 0.5 * ((F.col(f"_min{d}") + i * width) + (F.col(f"_min{d}") + (i + 1) * width)))
        names.append(f"x{d}")
    mesh = mesh.select("sample_id", *names)
    return assign_bin_boxes(mesh, boxes, names, grid, keep_outside=True).filter("bin is null").drop("bin")


def check_bins(boxes: DataFrame, dims: int, points: int = 100, grid: int = 32) -> None:
    """Refuse boxes that overlap or leave a gap at a midpoint of a regular grid."""
    overlap = overlapping_bins(boxes, dims, grid).take(1)
    if overlap:
        raise ValueError(f"bins overlap: {tuple(overlap[0])}")
    gap = gap_points(boxes, dims, points, grid).take(1)
    if gap:
        raise ValueError(f"no bin covers the point {tuple(gap[0])}")
