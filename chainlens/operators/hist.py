"""Histograms as tidy tables (keys, param, bin, lo, hi, content) and work on them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlens.functions.expr import edge_bin, inner_bin, normal, number, row_keys, weight_column
from chainlens.functions.numeric import fit_curve


def column_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Min and max per column from one scan, NaN and infinite values left out; two numbers per parameter reach the driver."""
    row = df.agg(*[f(number(c)).alias(f"{n}_{i}") for i, c in enumerate(columns)
                   for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (float(row[f"lo_{i}"]), float(row[f"hi_{i}"])) for i, c in enumerate(columns)
            if row[f"lo_{i}"] is not None}


def value_problems(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(param, n, n_null, n_nan) of each column: values that no histogram or range counts.

    An infinite value is one that is not a number, too.
    """
    count = lambda test: F.sum(F.when(test, 1).otherwise(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), *[e for i, c in enumerate(columns) for e in (
        count(F.col(c).isNull()).alias(f"u{i}"), count(F.col(c).isNotNull() & number(c).isNull()).alias(f"a{i}"))])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("param"), F.col("n"), F.col(f"u{i}").alias("n_null"), F.col(f"a{i}").alias("n_nan"))
        for i, c in enumerate(columns)])))


def fill_gaps(counts: DataFrame, keys: Sequence[str], last) -> DataFrame:
    """Add the empty bins of each histogram; ``last`` is its last bin number.

    Each filled bin also emits the empty ones up to the next, so a window
    partition and its output are bounded by the bins of one histogram.
    """
    order = Window.partitionBy(*keys).orderBy("bin")
    start = F.when(F.lag("bin").over(order).isNull(), 0).otherwise(F.col("bin"))
    stop = F.coalesce(F.lead("bin").over(order) - 1, last)
    kept = [c for c in counts.columns if c not in ("bin", "content")]
    spread = counts.withColumns({"_from": start, "_to": stop}).select(
        *kept, "bin", "content", F.explode(F.sequence("_from", "_to")).alias("_b"))
    return spread.select(
        *kept, F.col("_b").alias("bin"), F.when(F.col("_b") == F.col("bin"), F.col("content")).otherwise(0.0).alias("content"))


def posterior_hist(chain: DataFrame, columns: Sequence[str], nbins: int = 70,
                   ranges: dict[str, tuple[float, float]] | None = None,
                   edges: dict[str, Sequence[float]] | None = None,
                   weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted histogram of every parameter in one scan.

    Automatic ranges run from the minimum to the maximum of the chain, so the
    maximum itself is overflow; a constant parameter gets an axis of width 1 about its
    value. Null, NaN and infinite values are in no bin (``value_problems`` counts them), and a parameter
    without any other value has no bins.  Values are binned in wide form; only small
    integers are unpivoted, and partial sums of at most parameters x bins rows
    per task are shuffled.
    """
    edges = {c: [float(e) for e in v] for c, v in (edges or {}).items()}
    auto = [c for c in columns if c not in edges]
    if ranges is None and auto:
        ranges = column_ranges(chain, auto)
    bins, layout = [], []
    for c in columns:
        if c in edges:
            bins.append(edge_bin(F.col(c), edges[c]).alias(c))
            layout.append((c, 0.0, 0.0, len(edges[c]) - 1, edges[c]))
        elif c in ranges and ranges[c][0] <= ranges[c][1]:
            lo, hi = ranges[c]
            if lo == hi:
                lo, hi = lo - 0.5, hi + 0.5
            bins.append(inner_bin(F.col(c), lo, hi, nbins).alias(c))
            layout.append((c, lo, (hi - lo) / nbins, nbins, None))
    names = [row[0] for row in layout]
    axis = chain.sparkSession.createDataFrame(
        layout, "param string, _first double, _width double, _nbins int, _edges array<double>")
    by = [*keys, "param"]
    counts = (
        chain.select(*keys, weight_column(weight).alias("_w"), *bins)
        .unpivot([*keys, "_w"], names, "param", "bin")
        .filter("bin is not null")
        .groupBy(*by, "bin")
        .agg(F.sum("_w").alias("content"))
    )
    # The axis has one row per parameter.
    dense = fill_gaps(counts.join(F.broadcast(axis), "param"), by, F.col("_nbins") - 1)

    def edge(offset: int):
        place = F.col("bin") + offset
        return F.coalesce(F.get("_edges", place), F.col("_first") + place * F.col("_width"))

    return dense.select(*by, "bin", edge(0).alias("lo"), edge(1).alias("hi"), "content")


def posterior_hist_2d(chain: DataFrame, pairs: Sequence[tuple[str, str]], nbins: int = 70,
                      ranges: dict[str, tuple[float, float]] | None = None,
                      weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted 2D histograms of the requested pairs; empty cells are left out."""
    names = sorted({c for pair in pairs for c in pair})
    ranges = ranges or column_ranges(chain, names)

    def cell(c):
        lo, hi = ranges[c]
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        return inner_bin(F.col(c), lo, hi, nbins)

    binned = chain.select(*keys, weight_column(weight).alias("_w"), *[cell(c).alias(f"b_{c}") for c in names])
    cells = F.array(*[
        F.struct(F.lit(x).alias("param_x"), F.lit(y).alias("param_y"),
                 F.col(f"b_{x}").alias("bin_x"), F.col(f"b_{y}").alias("bin_y"))
        for x, y in pairs
    ])
    return (
        binned.select(*keys, "_w", F.inline(cells))
        .filter("bin_x is not null and bin_y is not null")
        .groupBy(*keys, "param_x", "param_y", "bin_x", "bin_y")
        .agg(F.sum("_w").alias("content"))
    )


def postfit_summary(chain: DataFrame, columns: Sequence[str], weight: str | None = None,
                    params: DataFrame | None = None) -> DataFrame:
    """Weighted mean and population RMS; a constant parameter keeps its prior.

    Sums are taken about a first, unweighted mean so that they do not cancel.
    """
    first = chain.agg(*[F.avg(c).alias(c) for c in columns]).first()
    w = weight_column(weight)
    sums = [F.sum(w).alias("_w")]
    for i, c in enumerate(columns):
        d = F.col(c) - F.lit(first[c])
        sums += [F.sum(w * d).alias(f"s_{i}"), F.sum(w * d * d).alias(f"q_{i}"),
                 F.min(c).alias(f"lo_{i}"), F.max(c).alias(f"hi_{i}")]
    rows = F.array(*[
        F.struct(F.lit(c).alias("param"),
                 (F.lit(first[c]) + F.col(f"s_{i}") / F.col("_w")).alias("mean"),
                 F.sqrt(F.greatest(F.lit(0.0), F.col(f"q_{i}") / F.col("_w")
                        - F.pow(F.col(f"s_{i}") / F.col("_w"), 2))).alias("rms"),
                 (F.col(f"lo_{i}") == F.col(f"hi_{i}")).alias("is_fixed"))
        for i, c in enumerate(columns)
    ])
    table = chain.agg(*sums).select(F.inline(rows))
    if params is None:
        return table
    model = params.select(F.col("branch").alias("param"), "prior", "error")
    return table.join(F.broadcast(model), "param", "left").select(
        "param", "prior", "error",
        F.when(F.col("is_fixed"), F.coalesce("prior", "mean")).otherwise(F.col("mean")).alias("mean"),
        F.when(F.col("is_fixed"), F.coalesce("error", "rms")).otherwise(F.col("rms")).alias("rms"),
        "is_fixed",
    )


def _gauss_fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("bin")
    x = ((pdf["lo"] + pdf["hi"]) / 2).to_numpy()
    y = pdf["content"].to_numpy()
    sum_y = y.sum()
    out = {"param": [pdf["param"].iloc[0]], "gauss_mean": [np.nan], "gauss_sigma": [np.nan],
           "converged": [False]}
    if sum_y > 0:
        mean = (x * y).sum() / sum_y
        rms = float(np.sqrt(max((y * (x - mean) ** 2).sum() / sum_y, 0.0)))
        use = (np.abs(x - mean) <= 1.5 * rms) & (y > 0)
        if use.sum() >= 3:
            span = x[-1] - x[0]
            p, done = fit_curve(
                lambda v, q: q[0] * np.exp(-0.5 * ((v - q[1]) / q[2]) ** 2),
                [y.max(), x[int(y.argmax())], rms], x[use], y[use], np.sqrt(y[use]),
                [0.0, x[0] - span, span * 1e-6], [np.inf, x[-1] + span, span * 100],
            )
            out["gauss_mean"], out["gauss_sigma"], out["converged"] = [p[1]], [p[2]], [done]
    return pd.DataFrame(out)


def postfit_gauss(hist: DataFrame) -> DataFrame:
    """Gaussian fit within mean +- 1.5 RMS, and whether it converged; a group is one histogram."""
    return hist.groupBy("param").applyInPandas(
        _gauss_fit, "param string, gauss_mean double, gauss_sigma double, converged boolean"
    )


def step_bucket(n_intervals: int, end: int):
    """Number of whole intervals a step lies beyond; step > k * size means bucket >= k."""
    size = max(end // n_intervals, 1)
    bucket = F.floor((F.col("step") - 1) / F.lit(size))
    return F.least(bucket, F.lit(n_intervals)).cast("int")


def parameter_evolution(chain: DataFrame, columns: Sequence[str], n: int, end: int,
                        nbins: int = 70, weight: str | None = None) -> DataFrame:
    """Normalised histograms of step > (i + 1) * end / n for i = 0..n-1.

    One scan counts per step bucket; suffix sums run over buckets.
    """
    ranges = column_ranges(chain, columns)
    counts = posterior_hist(
        chain.withColumn("bucket", step_bucket(n, end)), columns, nbins, ranges,
        weight=weight, keys=("bucket",),
    )
    suffix = Window.partitionBy("param", "bin").orderBy(F.desc("bucket")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("param", "bucket")
    return (
        counts.withColumn("content", F.sum("content").over(suffix))
        .filter("bucket >= 1")
        .withColumn("density", F.try_divide("content", F.sum("content").over(whole)))
        .select((F.col("bucket") - 1).alias("interval"), "param", "bin", "lo", "hi", "content", "density")
    )


def violin(chain: DataFrame, columns: Sequence[str], per_unit: int = 25,
           weight: str | None = None, scale: float = 1.0,
           ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Counts of every parameter on one common axis with 25 bins per unit.

    The axis runs from the smallest to the largest value of all parameters,
    times ``scale`` (prior draws use 4).
    """
    ranges = ranges or column_ranges(chain, columns)
    lo, hi = min(r[0] for r in ranges.values()), max(r[1] for r in ranges.values())
    nbins = max(int(scale * int((hi - lo) * per_unit)), 1)
    common = {c: (scale * lo, scale * hi) for c in ranges}
    return posterior_hist(chain, list(ranges), nbins, common, weight=weight)


def prior_violin(chain: DataFrame, priors: dict[str, tuple[float, float]], seed: int = 1) -> DataFrame:
    """Same for one Gaussian prior draw per entry and parameter, on a four times wider axis."""
    columns = list(priors)
    ranges = column_ranges(chain, columns)
    draws = chain.select(*[
        (F.lit(float(m)) + normal(seed + i, *row_keys(chain)) * float(s)).alias(c)
        for i, (c, (m, s)) in enumerate(priors.items())
    ])
    return violin(draws, columns, scale=4.0, ranges=ranges)


def mode_bin(hist: DataFrame, keys: Sequence[str] = ("param",)) -> DataFrame:
    """Bin with the largest content, the first one on ties."""
    best = F.max_by(F.struct("bin", "lo", "hi", "content"), F.struct("content", -F.col("bin")))
    return hist.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def best_fit_2d(hist2d: DataFrame, keys: Sequence[str] = ("param_x", "param_y")) -> DataFrame:
    """Cell with the largest content, the first in x then y on ties."""
    best = F.max_by(F.struct("bin_x", "bin_y", "content"),
                    F.struct("content", -F.col("bin_x"), -F.col("bin_y")))
    return hist2d.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def measure(hist: DataFrame) -> Column:
    """Width of a bin, or area (volume) of a box whose ``lo`` and ``hi`` are arrays."""
    if not dict(hist.dtypes)["lo"].startswith("array"):
        return F.col("hi") - F.col("lo")
    return F.aggregate(F.zip_with("hi", "lo", lambda a, b: a - b), F.lit(1.0), lambda m, w: m * w)


def normalise(hist: DataFrame, keys: Sequence[str] = ("param",), by_measure: bool = False) -> DataFrame:
    """Content over the integral; with ``by_measure``, density over bins or boxes of any size."""
    whole = Window.partitionBy(*keys)
    if not by_measure:
        return hist.withColumn("density", F.try_divide("content", F.sum("content").over(whole)))
    size = measure(hist)
    total = F.sum(F.col("content") * size).over(whole)
    return hist.withColumn("density", F.try_divide(F.col("content"), size * total))


def scale_by_width(hist: DataFrame, scale: float = 1.0) -> DataFrame:
    """Content per unit of width, or of area for boxes."""
    return hist.withColumn("density", F.try_divide(F.col("content"), measure(hist) * scale))


def integrals(hist: DataFrame, keys: Sequence[str] = ("param",)) -> DataFrame:
    """Integral with and without overflow, and the one weighted by width or area, of each histogram.

    Rows without edges hold what lies outside the axes.
    """
    inside = F.col("lo").isNotNull()
    return hist.groupBy(*keys).agg(
        F.sum(F.when(inside, F.col("content")).otherwise(0.0)).alias("integral"),
        F.sum(F.when(inside, F.col("content") * measure(hist)).otherwise(0.0)).alias("width_integral"),
        F.sum("content").alias("integral_with_overflow"),
    )


def ratio(top: DataFrame, bottom: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bin by bin ratio, null where the denominator is 0, and its error if the numerator has ``err``."""
    below = bottom.select(*keys, F.col("content").alias("below"))
    out = top.join(below, list(keys)).withColumn("ratio", F.try_divide("content", "below"))
    if "err" not in top.columns:
        return out
    return out.withColumn("ratio_err", F.when(F.col("below") > 0, F.try_divide("err", "below")))


def project_axes(spectra: DataFrame, axes: Sequence[dict], keys: Sequence[str] = ("sample_id",),
                 values: Sequence[str] = ("mc", "w2")) -> DataFrame:
    """(keys, dim, bin, values): every dimension's projection of spectra over the bins of ``axes``.

    ``axes`` are configuration records (sample_id, dim, edges), the first dimension
    fastest; keys hold sample_id. Works alike on toys, points, variations and data.
    """
    sizes: dict[int, list[int]] = {}
    for axis in sorted(axes, key=lambda a: (a["sample_id"], a["dim"])):
        sizes.setdefault(axis["sample_id"], []).append(len(axis["edges"]) - 1)
    places = F.array().cast("array<struct<dim:int,bin:int>>")
    for sample, ns in sizes.items():
        strides = [int(np.prod(ns[:d])) for d in range(len(ns))]
        here = F.array(*[F.struct(F.lit(d).alias("dim"), (F.floor(F.col("bin") / s) % n).cast("int").alias("bin"))
                         for d, (n, s) in enumerate(zip(ns, strides))])
        places = F.when(F.col("sample_id") == sample, here).otherwise(places)
    return spectra.select(*keys, *values, F.inline(places)).groupBy(*keys, "dim", "bin").agg(*[
        F.sum(v).alias(v) for v in values])


def hist_iqr(hist: DataFrame, keys: Sequence[str] = ("param",)) -> DataFrame:
    """Distance of the quartiles, interpolated linearly inside a bin; 0 when empty."""
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    cdf = (
        hist.withColumn("_t", F.sum("content").over(whole))
        .withColumn("_c", F.try_divide(F.sum("content").over(upto), F.col("_t")))
        .withColumn("_p", F.try_divide("content", "_t"))
    )

    def quantile(q: float):
        at = F.col("lo") + F.try_divide(
            (F.col("hi") - F.col("lo")) * (q - (F.col("_c") - F.col("_p"))), F.col("_p"))
        return F.min_by(at, F.when((F.col("_c") >= q) & (F.col("_p") > 0), F.col("bin")))

    quartiles = cdf.groupBy(*keys).agg(
        quantile(0.25).alias("q1"), quantile(0.5).alias("median"), quantile(0.75).alias("q3"))
    return quartiles.withColumn("iqr", F.coalesce(F.col("q3") - F.col("q1"), F.lit(0.0)))


def kl_divergence(data: DataFrame, model: DataFrame, keys: Sequence[str], bins: Sequence[str] = ("bin",)) -> DataFrame:
    """Sum of p ln(p/q) over bins with both above 0."""
    whole = Window.partitionBy(*keys)
    p = data.withColumn("p", F.try_divide("content", F.sum("content").over(whole))).select(*keys, *bins, "p")
    q = model.withColumn("q", F.try_divide("content", F.sum("content").over(whole))).select(*keys, *bins, "q")
    both = p.join(q, [*keys, *bins]).filter("p > 0 and q > 0")
    return both.groupBy(*keys).agg(F.sum(F.col("p") * F.log(F.try_divide("p", "q"))).alias("kl"))


def hist_min_in_range(hist: DataFrame, lo: float, hi: float, keys: Sequence[str] = ("param",)) -> DataFrame:
    """Smallest content among bins that lie strictly inside the range."""
    inside = (F.col("lo") > lo) & (F.col("hi") < hi)
    # Fixed value: what is reported when no bin lies inside.
    return hist.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(inside, F.col("content"))), F.lit(1234567890.0)).alias("minimum"))


def project_bins(boxes: DataFrame, dim: int, edges: Sequence[float], keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Project box bins (lo, hi arrays, content, err) on 1D edges by overlap fraction.

    A box touches a run of output bins, found by two edge searches; only that
    run is emitted.
    """
    edges = [float(e) for e in edges]
    lo, hi = F.element_at("lo", dim + 1), F.element_at("hi", dim + 1)
    n = len(edges) - 1
    clipped = boxes.withColumn("_lo", F.greatest(lo, F.lit(edges[0]))).withColumn(
        "_hi", F.least(hi, F.lit(edges[-1]))).filter("_hi > _lo")
    first = edge_bin(F.col("_lo"), edges)
    last = F.coalesce(edge_bin(F.col("_hi"), edges), F.lit(n - 1))
    spread = clipped.withColumn("bin", F.explode(F.sequence(first, last)))
    low_edge = F.element_at(F.lit(edges), F.col("bin") + 1)
    high_edge = F.element_at(F.lit(edges), F.col("bin") + 2)
    overlap = F.least(F.col("_hi"), high_edge) - F.greatest(F.col("_lo"), low_edge)
    share = spread.withColumn("_f", F.try_divide(overlap, hi - lo)).filter("_f > 0")
    return share.groupBy(*keys, "bin").agg(
        F.sum(F.col("_f") * F.col("content")).alias("content"),
        F.sqrt(F.sum(F.pow(F.col("_f") * F.col("err"), 2))).alias("err"),
    )
