"""Row-wise work on a chain: cuts, thinning, draws, derived columns, reweighting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlens.functions.expr import edge_bin, normal, product, row_keys, starts_with_any, uniform
from chainlens.operators.scattered import interpolated

ENTRY_BLOCK = 1 << 20


def last_step(chain: DataFrame) -> int:
    return chain.agg(F.max("step")).first()[0]


def burn_in(chain: DataFrame, cut: int | None = None) -> DataFrame:
    """Keep step > cut; by default the first fifth of the steps is dropped.

    The cut is a literal, so it is pushed to the Parquet scan.
    """
    end = last_step(chain)
    if cut is None:
        cut = end // 5
    if cut > end:
        raise ValueError(f"burn-in cut {cut} is beyond the last step {end}")
    return chain.filter(F.col("step") > F.lit(cut))


def posterior_cut(chain: DataFrame, condition: Column | str) -> DataFrame:
    return chain.filter(condition)


def exclude(params: DataFrame, types: Sequence[str] = (), names: Sequence[str] = (),
            groups: Sequence[str] = ()) -> DataFrame:
    """Drop parameters by branch prefix, name prefix or group."""
    return params.filter(
        ~starts_with_any(F.col("branch"), types)
        & ~starts_with_any(F.col("name"), names)
        & ~F.coalesce(F.col("grp").isin(list(groups)), F.lit(False))
    )



def with_entry_index(chain: DataFrame, contiguous: bool = False, block: int = ENTRY_BLOCK,
                     per_chain: dict[str, Column] | None = None) -> DataFrame:
    """Add ``entry``, the position of a row within its chain, from 0.

    A chain without gaps, which is checked, needs only its first step.  Otherwise rows are counted
    per block of steps, block offsets are cumulated (one row per block), and
    rows are numbered inside a block, which holds at most ``block`` rows
    because a step occurs once per chain.  ``per_chain`` are aggregates to
    attach to each row; they share the first pass of a chain without gaps.
    """
    extra = [column.alias(name) for name, column in (per_chain or {}).items()]
    if contiguous:
        first = chain.groupBy("chain_id").agg(
            F.min("step").alias("_first"),
            (F.max("step") - F.min("step") + 1 == F.count(F.lit(1))).alias("_whole"), *extra)
        gap = F.raise_error(F.lit("chain has step gaps; use contiguous=False"))
        # One row per chain file.
        return (
            chain.join(F.broadcast(first), "chain_id")
            .withColumn("entry", F.when(F.col("_whole"), F.col("step") - F.col("_first")).otherwise(gap.cast("long")))
            .drop("_first", "_whole")
        )
    keyed = chain.withColumn("_block", F.floor(F.col("step") / block))
    counts = keyed.groupBy("chain_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("chain_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "chain_id", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("chain_id", "_block").orderBy("step")
    indexed = (
        keyed.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, ["chain_id", "_block"])
        .withColumn("entry", F.col("_offset") + F.col("_rank") - 1)
        .drop("_block", "_rank", "_offset")
    )
    if not extra:
        return indexed
    # One row per chain file.
    return indexed.join(F.broadcast(chain.groupBy("chain_id").agg(*extra)), "chain_id")


def thin(chain: DataFrame, k: int, contiguous: bool = False) -> DataFrame:
    """Keep every k-th entry of each chain."""
    return with_entry_index(chain, contiguous).filter(F.col("entry") % k == 0).drop("entry")


def max_entries(chain: DataFrame, n: int, contiguous: bool = False) -> DataFrame:
    """Keep the first n entries of each chain."""
    return with_entry_index(chain, contiguous).filter(F.col("entry") < n).drop("entry")


def random_draws(chain: DataFrame, n: int, cut: int | None = None, seed: int = 1) -> DataFrame:
    """n chain rows after burn-in, with replacement, for chains without step gaps.

    A draw is a seeded position; positions become (chain_id, step) through the
    per-chain ranges, and an equi-join fetches the rows.  The chain itself is
    neither sorted nor numbered.
    """
    kept = burn_in(chain, cut)
    ranges = kept.groupBy("chain_id").agg(
        F.min("step").alias("first"), F.count(F.lit(1)).alias("n"), F.max("step").alias("last")
    ).orderBy("chain_id").collect()  # one row per chain file
    if any(r["last"] - r["first"] + 1 != r["n"] for r in ranges):
        raise ValueError("chain has step gaps; add an entry index and use it as the step")
    edges = [0]
    for r in ranges:
        edges.append(edges[-1] + r["n"])
    position = F.least(F.floor(uniform(seed, "id") * edges[-1]).cast("long"), F.lit(edges[-1] - 1))
    slot = edge_bin(F.col("_pos"), edges).cast("int")

    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_slot") + 1)

    draws = (
        chain.sparkSession.range(n)
        .select(F.col("id").alias("draw"), position.alias("_pos"))
        .withColumn("_slot", slot)
        .select("draw", pick([r["chain_id"] for r in ranges]).alias("chain_id"),
                (pick([r["first"] for r in ranges]) + F.col("_pos") - pick(edges[:-1])).alias("step"))
    )
    return kept.join(draws, ["chain_id", "step"])


def select_by_tags(table: DataFrame, tags: Sequence[str], how: str = "all", column: str = "tags") -> DataFrame:
    """Rows whose tag set holds all of, any of, or exactly the given tags."""
    wanted = F.array(*[F.lit(t) for t in sorted(set(tags))])
    shared = F.size(F.array_intersect(F.col(column), wanted))
    n = len(set(tags))
    if how == "any":
        return table.filter(shared > 0)
    if how == "all":
        return table.filter(shared == n)
    return table.filter((shared == n) & (F.size(F.array_distinct(F.col(column))) == n))


def jarlskog(sin2_12: Column, sin2_23: Column, sin2_13: Column, delta: Column) -> Column:
    """Jarlskog invariant from squared sines of the mixing angles and the phase."""
    s12, s23, s13 = F.sqrt(sin2_12), F.sqrt(sin2_23), F.sqrt(sin2_13)
    c12, c23 = F.sqrt(1 - sin2_12), F.sqrt(1 - sin2_23)
    return s13 * (1 - sin2_13) * s12 * c12 * s23 * c23 * F.sin(delta)


def add_jarlskog(chain: DataFrame, sin2_12: str, sin2_23: str, sin2_13: str, delta: str,
                 name: str = "J") -> DataFrame:
    return chain.withColumn(name, jarlskog(*[F.col(c) for c in (sin2_12, sin2_23, sin2_13, delta)]))


def smear_chain(chain: DataFrame, errors: dict[str, float], keep: bool = False, seed: int = 1) -> DataFrame:
    """Add Gaussian noise to the named parameters, optionally keeping the old value.

    The noise of a step is a function of the seed, the parameter and the row's keys.
    """
    smeared = {
        p: F.col(p) + normal(seed + i, *row_keys(chain)) * float(e) for i, (p, e) in enumerate(errors.items())
    }
    old = {f"{p}_unsmeared": F.col(p) for p in errors} if keep else {}
    return chain.withColumns({**old, **smeared})


def reweight_gaussian(chain: DataFrame, new: dict[str, tuple[float, float]],
                      old: dict[str, tuple[float, float] | None], name: str = "Weight") -> DataFrame:
    """Weight = product of new prior over old prior; an old prior of None is flat."""

    def shape(column: str, prior) -> Column:
        z = (F.col(column) - float(prior[0])) / float(prior[1])
        return F.exp(-0.5 * z * z)

    ratios = []
    for column, prior in new.items():
        ratio = shape(column, prior)
        if old.get(column) is not None:
            ratio = ratio / shape(column, old[column])
        ratios.append(ratio)
    return chain.withColumn(name, product(ratios))


def attach_params(long: DataFrame, params: DataFrame, key: str = "param") -> DataFrame:
    """Add prior, error, flat flag and group of each parameter."""
    model = params.select(F.col("branch").alias(key), "prior", "error", "flat", "grp")
    # One row per model parameter.
    return long.join(F.broadcast(model), key)


def reweight_graph_1d(chain: DataFrame, column: str, graph: Sequence[tuple[float, float]],
                      name: str = "Weight") -> DataFrame:
    """exp(-chi2/2) with chi2 interpolated linearly; 0 outside the open range.

    The graph is a configuration record; the segment search is a CASE tree.
    """
    graph = sorted(graph)
    xs = [float(x) for x, _ in graph]
    ys = [float(y) for _, y in graph]
    x = F.col(column)
    segment = edge_bin(x, xs)
    slopes = [(ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) for i in range(len(xs) - 1)]
    at = F.col("_seg") + 1
    chi2 = F.element_at(F.lit(ys), at) + F.element_at(F.lit(slopes), at) * (
        x - F.element_at(F.lit(xs), at)
    )
    inside = (x > xs[0]) & (x < xs[-1])
    return (
        chain.withColumn("_seg", segment)
        .withColumn(name, F.when(inside, F.exp(-0.5 * chi2)).otherwise(0.0))
        .drop("_seg")
    )


def grid_cells(xs: Sequence[float], ys: Sequence[float], chi2: Sequence[Sequence[float]]) -> list[tuple]:
    """Corner and bilinear coefficients of every grid cell, x-major."""
    cells = []
    for i in range(len(xs) - 1):
        for j in range(len(ys) - 1):
            dx, dy = xs[i + 1] - xs[i], ys[j + 1] - ys[j]
            a, b, c, d = chi2[i][j], chi2[i + 1][j], chi2[i][j + 1], chi2[i + 1][j + 1]
            cells.append((xs[i], ys[j], a, (b - a) / dx, (c - a) / dy, (a - b - c + d) / (dx * dy)))
    return cells


def reweight_graph_2d(chain: DataFrame, x: str, dm2: str, normal: dict, inverted: dict,
                      name: str = "Weight") -> DataFrame:
    """2D graph chosen by the sign of the mass splitting; its absolute value is used.

    ``normal`` and ``inverted`` are dicts of ``xs``, ``ys`` and ``chi2`` on a
    rectangular grid, interpolated bilinearly.  The cell of a row is found once
    and names the coefficients of both graphs, which are kept in one list.
    """
    cells, place, offset = [], F.lit(None).cast("int"), 0
    u, v = F.col(x), F.abs(F.col(dm2))
    for graph, chosen in ((inverted, F.col(dm2) <= 0), (normal, F.col(dm2) > 0)):
        xs, ys = [float(e) for e in graph["xs"]], [float(e) for e in graph["ys"]]
        own = grid_cells(xs, ys, graph["chi2"])
        # The range is open: the first edges lie outside too.
        inside = chosen & (u > xs[0]) & (v > ys[0])
        place = F.when(inside, edge_bin(u, xs) * (len(ys) - 1) + edge_bin(v, ys) + offset).otherwise(place)
        cells += own
        offset += len(own)
    x0, y0, a, b, c, d = [F.get(F.lit([float(cell[k]) for cell in cells]), F.col("_cell")) for k in range(6)]
    dx, dy = u - x0, v - y0
    chi2 = a + b * dx + c * dy + d * dx * dy
    return chain.withColumn("_cell", place).withColumn(
        name, F.coalesce(F.exp(-0.5 * chi2), F.lit(0.0))).drop("_cell")


def reweight_scattered_2d(chain: DataFrame, x: str, dm2: str, normal: Sequence[tuple[float, float, float]],
                          inverted: Sequence[tuple[float, float, float]], name: str = "Weight",
                          beyond_hull: float = 0.0) -> DataFrame:
    """exp(-chi2/2) of 2D graphs of scattered points (x, abs(dm2), chi2), chosen by the sign of the mass splitting.

    chi2 is linear in each Delaunay triangle. Outside the open range of a graph's points the weight
    is 0; within it but beyond their hull chi2 is ``beyond_hull``. A row without x or dm2 weighs 0.
    """
    u, v, out = F.col(x), F.abs(F.col(dm2)), chain
    weight = F.lit(0.0)
    for column, graph, chosen in (("_chi2_i", inverted, F.col(dm2) <= 0), ("_chi2_n", normal, F.col(dm2) > 0)):
        if not graph:
            continue
        xs, ys = [float(p[0]) for p in graph], [float(p[1]) for p in graph]
        out = interpolated(out, u, v, graph, column, beyond_hull)
        inside = chosen & (u > min(xs)) & (u < max(xs)) & (v > min(ys)) & (v < max(ys))
        weight = F.when(inside, F.exp(-0.5 * F.col(column))).otherwise(weight)
    return out.withColumn(name, weight).drop("_chi2_i", "_chi2_n")
