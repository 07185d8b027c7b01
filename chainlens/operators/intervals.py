"""Intervals read off histograms.  A window partition holds the bins of one histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.functions.expr import SIGMA_COVERAGE, finite_or


def coverages(levels: Sequence[float], in_sigmas: bool = False) -> list[float]:
    """Coverage of each level; percentages must be given in descending order."""
    if in_sigmas:
        return [SIGMA_COVERAGE[abs(round(level))] for level in levels]
    levels = [float(v) for v in levels]
    if any(not 0 <= v <= 1 for v in levels):
        raise ValueError("levels must lie between 0 and 1")
    if any(a < b for a, b in zip(levels, levels[1:])):
        raise ValueError("levels must be descending")
    return levels


def _kept_bins(hist: DataFrame, levels, order, keys) -> DataFrame:
    """Bins taken in falling content until the coverage is reached, once per level."""
    above = Window.partitionBy(*keys).orderBy(F.desc("content"), *order)
    ranked = hist.filter("content > 0").withColumn(
        "_before", F.coalesce(F.sum("content").over(above.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ).withColumn("_total", F.sum("content").over(Window.partitionBy(*keys)))
    spread = ranked.withColumn("level", F.explode(F.lit([float(v) for v in levels])))
    return spread.filter(F.try_divide("_before", "_total") < F.col("level")).drop("_before", "_total")


def credible_bins(hist: DataFrame, levels: Sequence[float] = (0.99, 0.90, 0.68),
                  keys: Sequence[str] = ("param",), in_sigmas: bool = False) -> DataFrame:
    return _kept_bins(hist, coverages(levels, in_sigmas), ["bin"], keys)


def credible_interval(hist: DataFrame, levels: Sequence[float] = (0.99, 0.90, 0.68),
                      keys: Sequence[str] = ("param",), in_sigmas: bool = False) -> DataFrame:
    """Outer edges, bin count and content of each credible interval."""
    return credible_bins(hist, levels, keys, in_sigmas).groupBy(*keys, "level").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.count(F.lit(1)).alias("n_bins"), F.sum("content").alias("content"),
    )


def credible_region(hist2d: DataFrame, levels: Sequence[float] = (0.99, 0.90, 0.68),
                    keys: Sequence[str] = ("param_x", "param_y"), in_sigmas: bool = False) -> DataFrame:
    """Contour height (last content added) and size of each 2D region."""
    kept = _kept_bins(hist2d, coverages(levels, in_sigmas), ["bin_x", "bin_y"], keys)
    return kept.groupBy(*keys, "level").agg(
        F.min("content").alias("height"), F.count(F.lit(1)).alias("n_cells"))


def _with_peak(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    whole = Window.partitionBy(*keys)
    return (
        hist.withColumn("_top", F.max(F.struct("content", (-F.col("bin")).alias("neg"))).over(whole))
        .withColumn("_peak", -F.col("_top.neg"))
        .withColumn("_peak_content", F.col("_top.content"))
        .withColumn("_last", F.max("bin").over(whole))
        .withColumn("_total", F.sum("content").over(whole))
        .drop("_top")
        .filter("_total > 0")
    )


def _widened(peaked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the share inside each bin's distance from the peak, and both sides' content at it.

    Bins at equal distance are peers of one range frame, so no join is needed.
    """
    by_distance = Window.partitionBy(*keys).orderBy("_d")
    inside = by_distance.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = by_distance.rangeBetween(0, 0)
    side = F.col("bin") - F.col("_peak")
    return peaked.withColumn("_d", F.abs(side)).withColumns({
        "_share": F.try_divide(F.sum("content").over(inside), F.col("_total")),
        "_low": F.sum(F.when(side < 0, F.col("content")).otherwise(0.0)).over(here),
        "_high": F.sum(F.when(side > 0, F.col("content")).otherwise(0.0)).over(here),
    })


def _two_sided_stop(coverage: float):
    """Aggregate: the distance at which widening by one bin on both sides covers enough."""
    reached = F.col("_share") >= coverage
    return F.min_by(F.struct("_d", (F.col("_low") > F.col("_high")).alias("low_side")), F.when(reached, F.col("_d")))


def _bin_map(column):
    return F.map_from_entries(F.collect_list(F.struct(F.col("bin"), column)))


def _reached_bin():
    """Bin at the stop distance, on the side that held more; clipped to the histogram."""
    return F.when(F.col("_s.low_side"), F.greatest(F.lit(0), F.col("_peak") - F.col("_s._d"))).otherwise(
        F.least(F.col("_last"), F.col("_peak") + F.col("_s._d")))


def hpd(hist: DataFrame, coverage: float = 0.6827, keys: Sequence[str] = ("param",)) -> DataFrame:
    """Highest density value with one-sided and two-sided errors.

    Upward the error ends at the upper edge of the last bin; downward it is the
    distance from the centre of the last bin to the low edge of the peak bin.
    The histogram is read once: windows over its bins, then one row per key.
    """
    keys = list(keys)
    wide = _widened(_with_peak(hist, keys), keys)
    at_peak = F.col("bin") == F.col("_peak")
    half = F.col("_peak_content") / 2
    up = F.when(at_peak, half).when(F.col("bin") > F.col("_peak"), F.col("content")).otherwise(0.0)
    down = F.when(at_peak, half).when(F.col("bin") < F.col("_peak"), F.col("content")).otherwise(0.0)
    whole = Window.partitionBy(*keys)
    rising = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    falling = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = wide.withColumns({"_up": up, "_down": down}).withColumns({
        "_fu": F.try_divide(F.sum("_up").over(rising), F.sum("_up").over(whole)),
        "_fd": F.try_divide(F.sum("_down").over(falling), F.sum("_down").over(whole))})
    row = walked.groupBy(*keys, "_peak", "_last").agg(
        _two_sided_stop(coverage).alias("_s"),
        F.min(F.when((F.col("bin") >= F.col("_peak")) & (F.col("_fu") >= coverage), F.col("bin"))).alias("_bu"),
        F.max(F.when((F.col("bin") <= F.col("_peak")) & (F.col("_fd") >= coverage), F.col("bin"))).alias("_bd"),
        _bin_map(F.struct("lo", "hi")).alias("_edges"),
    )

    def edge(place, name: str):
        return F.element_at("_edges", place)[name]

    peak_lo, peak_hi = edge(F.col("_peak"), "lo"), edge(F.col("_peak"), "hi")
    centre = (peak_lo + peak_hi) / 2
    up_bin, down_bin = F.coalesce("_bu", "_last"), F.coalesce("_bd", F.lit(0))
    return row.select(
        *keys, centre.alias("peak"),
        F.abs(F.when(F.col("_s.low_side"), edge(_reached_bin(), "lo")).otherwise(edge(_reached_bin(), "hi"))
              - centre).alias("hpd_error"),
        F.abs(edge(up_bin, "hi") - centre).alias("error_up"),
        F.abs((edge(down_bin, "lo") + edge(down_bin, "hi")) / 2 - peak_lo).alias("error_down"),
    )


def mode_error(hist: DataFrame, keys: Sequence[str] = ("param",), coverage: float = 0.6827) -> DataFrame:
    """Half-width of the central coverage around the mode, centre to centre."""
    keys = list(keys)
    row = _widened(_with_peak(hist, keys), keys).groupBy(*keys, "_peak", "_last").agg(
        _two_sided_stop(coverage).alias("_s"), _bin_map((F.col("lo") + F.col("hi")) / 2).alias("_centres"))
    mode = F.element_at("_centres", F.col("_peak"))
    return row.select(*keys, mode.alias("mode"),
                      F.abs(F.element_at("_centres", _reached_bin()) - mode).alias("mode_error"))


def cumulative(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Normalised cumulative distribution."""
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.withColumn("cdf", F.try_divide(F.sum("content").over(upto), F.sum("content").over(whole)))


def _beside_first(hist: DataFrame, column: str, first: int) -> DataFrame:
    """Add the column's value in the first chain; a window partition holds one row per chain."""
    per_bin = Window.partitionBy("param", "bin")
    mine = F.when(F.col("chain_id") == first, F.col(column))
    return hist.withColumn(f"first_{column}", F.max(mine).over(per_bin)).filter(
        (F.col("chain_id") != first) & F.col(f"first_{column}").isNotNull())


def compare_chains(hist: DataFrame, first: int = 0) -> DataFrame:
    """Each chain's bins next to those of the first chain; parameters both have.

    ``hist`` is keyed by chain_id and binned on edges shared by all chains.
    """
    return _beside_first(hist, "content", first)


def ks_distance(hist: DataFrame, first: int = 0) -> DataFrame:
    """Largest distance of the cumulative distributions to the first chain and its place."""
    gap = _beside_first(cumulative(hist, ["chain_id", "param"]), "cdf", first).withColumn(
        "d", F.abs(F.col("cdf") - F.col("first_cdf")))
    best = F.max_by(F.struct("d", ((F.col("lo") + F.col("hi")) / 2).alias("at")),
                    F.struct("d", -F.col("bin")))
    return gap.groupBy("chain_id", "param").agg(best.alias("_b")).select("chain_id", "param", "_b.*")


def anderson_darling_curve(data: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """abs(F_d - F_m) / sqrt(F_j (1 - F_j)) per bin; 0 where not finite.

    F_j is the distribution of both histograms together.
    """
    both = data.select(*keys, "bin", F.col("content").alias("d")).join(
        model.select(*keys, "bin", F.col("content").alias("m")), [*keys, "bin"])
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def cdf(value):
        return F.try_divide(F.sum(value).over(upto), F.sum(value).over(whole))

    joint = cdf(F.col("d") + F.col("m"))
    stat = F.try_divide(F.abs(F.col("f_d") - F.col("f_m")), F.sqrt(F.col("f_j") * (1 - F.col("f_j"))))
    return both.select(*keys, "bin", cdf(F.col("d")).alias("f_d"), cdf(F.col("m")).alias("f_m"),
                       joint.alias("f_j")).withColumn(
        "ad", F.when(F.col("f_j") * (1 - F.col("f_j")) > 0, finite_or(stat, 0.0)).otherwise(0.0))
