"""Convergence diagnostics.  Wide columns are aggregated first and unpivoted after."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.functions.expr import finite_or, number
from chainlens.functions.numeric import fit_curve
from chainlens.session import stored
from chainlens.operators.chain import with_entry_index

# Columns the chain comparison leaves out.
NOT_COMPARED = ("PCA_", "accProb", "stepTime")


def _long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], stats: dict[str, str]) -> DataFrame:
    """(keys, param, stats...) from columns named <prefix>_<index>."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("param"), *[F.col(f"{p}_{i}").alias(name) for p, name in stats.items()])
        for i, c in enumerate(columns)])
    return df.select(*keys, F.inline(rows))


def trace(chain: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value of each parameter or likelihood component at every step, per chain."""
    return chain.select("chain_id", "step", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["chain_id", "step"], list(columns), "param", "value")


def trace_level(chain: DataFrame, columns: Sequence[str], contiguous: bool = False) -> DataFrame:
    """Constant fitted to the second half of each trace, which is its mean."""
    indexed = with_entry_index(chain, contiguous, per_chain={"_n": F.count(F.lit(1))})
    late = indexed.filter(F.col("entry") >= F.floor(F.col("_n") / 2))
    sums = late.groupBy("chain_id").agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)])
    return _long(sums, ["chain_id"], columns, {"m": "level"})


def batched_means(chain: DataFrame, columns: Sequence[str], nb: int = 20, contiguous: bool = False,
                  exact_last: bool = False) -> DataFrame:
    """Mean per batch of N div nb + 1 entries.

    The short last batch is divided by the full length unless ``exact_last``.
    """
    length = F.floor(F.col("_n") / nb) + 1
    indexed = with_entry_index(chain.select("chain_id", "step", *columns), contiguous,
                               per_chain={"_n": F.count(F.lit(1))})
    sums = (
        indexed.withColumn("length", length)
        .withColumn("batch", F.floor(F.col("entry") / F.col("length")).cast("int"))
        .groupBy("chain_id", "batch", "length")
        .agg(F.count(F.lit(1)).alias("filled"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(columns)])
    )
    by = F.col("filled") if exact_last else F.col("length")
    return _long(sums, ["chain_id", "batch", "length", "filled"], columns, {"s": "_s"}).select(
        "chain_id", "param", "batch", "length", (F.col("_s") / by).alias("mean"))


def batch_variance_test(batches: DataFrame, nb: int, integer_division: bool = False) -> DataFrame:
    """Batch variance and the statistic for leftover correlation between batches.

    ``integer_division`` gives the truncated factors of the older form.
    """
    by = Window.partitionBy("chain_id", "param")
    overall = F.sum("mean").over(by) / nb
    dev = batches.withColumn("_d", overall - F.col("mean")).withColumn(
        "_next", F.lead("_d").over(by.orderBy("batch")))
    ends = F.when((F.col("batch") == 0) | (F.col("batch") == nb - 1), F.col("_d") * F.col("_d"))
    sums = dev.groupBy("chain_id", "param").agg(
        F.max("length").alias("_len"), F.sum(F.col("_d") * F.col("_d")).alias("_ss"),
        F.sum(F.col("_d") * F.col("_next")).alias("_lag"), F.sum(ends).alias("_ends"))
    if integer_division:
        factor, root = F.floor(F.col("_len") / (nb - 1)), float((nb * nb - 1) // (nb - 2))
    else:
        factor, root = F.col("_len") / (nb - 1), (nb * nb - 1) / (nb - 2)
    return sums.select(
        "chain_id", "param", (factor * F.col("_ss")).alias("batch_variance"),
        (root**0.5 * F.try_divide(F.col("_lag") + F.col("_ends") / 2, F.col("_ss"))).alias("c_statistic"))


def _slices(columns: Sequence[str], values: Sequence, width: int):
    """Array of (slice, x) structs: the columns cut into short arrays, to bound a group's width."""
    return F.array(*[
        F.struct(F.lit(k // width).alias("slice"), F.array(*values[k:k + width]).alias("x"))
        for k in range(0, len(columns), width)])


def autocorrelation(chain: DataFrame, columns: Sequence[str], nlags: int = 25000,
                    block: int | None = None, contiguous: bool = True, width: int = 8) -> DataFrame:
    """r_k for k < nlags over all entries of each chain.

    Entries are cut into equal blocks; the first nlags entries of a block are
    copied to the block before, so each pair (i, i + k) meets in exactly one
    group.  A group's size is fixed by block and slice, not by the data.
    """
    block = max(block or max(1 << 16, 8 * nlags), nlags)
    columns = list(columns)
    indexed = with_entry_index(chain.select("chain_id", "step", *columns), contiguous,
                               per_chain={f"m{i}": F.avg(c) for i, c in enumerate(columns)})
    centred = [F.col(c) - F.col(f"m{i}") for i, c in enumerate(columns)]
    own = F.floor(F.col("entry") / block)
    homes = F.when((F.col("entry") % block < nlags) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    spread = indexed.select(
        "chain_id", "entry", F.explode(homes).alias("block"), _slices(columns, centred, width).alias("_s")
    ).select("chain_id", "entry", "block", F.inline("_s"))

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry")
        here, k0 = pdf["block"].iloc[0], int(pdf["slice"].iloc[0]) * width
        names = columns[k0:k0 + width]
        own_rows = int((pdf["entry"] // block == here).sum())
        whole = np.stack(pdf["x"].to_numpy())
        first = whole[:own_rows]
        lags = min(nlags, len(whole))
        sums = np.zeros((len(names), nlags))
        size = 1 << int(np.ceil(np.log2(own_rows + len(whole))))
        spec = np.conj(np.fft.rfft(first, size, axis=0)) * np.fft.rfft(whole, size, axis=0)
        sums[:, :lags] = np.fft.irfft(spec, size, axis=0)[:lags].T
        return pd.DataFrame({
            "chain_id": pdf["chain_id"].iloc[0], "param": np.repeat(names, nlags),
            "lag": np.tile(np.arange(nlags, dtype=np.int32), len(names)), "s": sums.ravel()})

    id_type = dict(chain.dtypes)["chain_id"]
    parts = spread.groupBy("chain_id", "block", "slice").applyInPandas(
        partial, f"chain_id {id_type}, param string, lag int, s double")
    sums = parts.groupBy("chain_id", "param", "lag").agg(F.sum("s").alias("s"))
    # A window partition is one curve of nlags rows.
    at_zero = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(Window.partitionBy("chain_id", "param"))
    return sums.select("chain_id", "param", "lag", finite_or(F.try_divide(F.col("s"), at_zero), 0.0).alias("r"))


def effective_sample_size(acf: DataFrame, chain: DataFrame, from_lag: int = 0) -> DataFrame:
    """N / (1 + 2 * sum of r_k), efficiency in percent and a class by N_eff / N."""
    entries = chain.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"))
    sums = acf.filter(F.col("lag") >= from_lag).groupBy("chain_id", "param").agg(
        (1 + 2 * F.sum("r")).alias("_d"))
    share = F.abs(F.try_divide(F.lit(1.0), F.col("_d")))
    # Upper limits of the five classes of N_eff / N.
    limits = [1.0, 0.02, 0.005, 0.001, 0.0001, 0.0]
    label = F.lit(None).cast("int")
    for k in range(5):
        label = F.when((share <= limits[k]) & (share > limits[k + 1]), k).otherwise(label)
    return sums.join(F.broadcast(entries), "chain_id").select(
        "chain_id", "param", F.try_divide("n", "_d").alias("ess"),
        F.try_divide(F.lit(100.0), F.col("_d")).alias("efficiency"), label.alias("ess_class"))


def average_autocorrelation(acf: DataFrame) -> DataFrame:
    """Mean, minimum and maximum of r over parameters, per lag.

    A parameter is left out when its curve is flat (at most 100 lags after the
    first differ from 1 by more than 0.001) or nowhere above 0.
    """
    curve = Window.partitionBy("chain_id", "param")  # nlags rows
    off = F.when((F.col("lag") >= 1) & (F.abs(F.col("r") - 1) > 0.001), 1).otherwise(0)
    marked = acf.withColumn("_off", F.sum(off).over(curve)).withColumn("_top", F.max("r").over(curve))
    return marked.filter("_off > 100 and _top > 0").groupBy("chain_id", "lag").agg(
        F.avg("r").alias("mean_r"), F.min("r").alias("min_r"), F.max("r").alias("max_r"),
        F.count(F.lit(1)).alias("n_params"))


def geweke(chain: DataFrame, columns: Sequence[str], checks: int = 100, end: int | None = None) -> DataFrame:
    """Distance of the mean of step < k/checks*max to that of step > max/2, in joint sigmas.

    One scan gives count, mean and variance per (step bucket, half); prefixes
    are cumulated over buckets.
    """
    if end is None:
        end = chain.agg(F.max("step")).first()[0]
    thresholds = [int((1.0 / checks) * k * end) for k in range(checks + 1)]
    limit = F.lit(thresholds)
    guess = F.ceil((F.col("step") + 1) * checks / F.lit(max(end, 1))).cast("int")

    def below(offset: int):
        return F.col("step") < F.get(limit, guess + offset)

    # Smallest k with step < threshold k; rounding can move the guess by one.
    bucket = F.when((guess > 1) & below(-1), guess - 1).when(below(0), guess).otherwise(guess + 1)
    late = F.col("step") > 0.5 * end
    stats = []
    for i, c in enumerate(columns):
        stats += [F.avg(c).alias(f"m_{i}"), F.var_pop(c).alias(f"v_{i}")]
    sums = chain.groupBy("chain_id", bucket.cast("int").alias("k"), late.alias("late")).agg(
        F.count(F.lit(1)).cast("double").alias("n_0"), *stats)
    table = F.array(*[
        F.struct(F.lit(c).alias("param"), F.col(f"m_{i}").alias("m"), F.col(f"v_{i}").alias("v"))
        for i, c in enumerate(columns)])
    parts = sums.select("chain_id", "k", "late", F.col("n_0").alias("n"), F.inline(table))
    # At most 2 * checks rows per chain and parameter from here on: one window partition.
    whole = Window.partitionBy("chain_id", "param")
    centre = F.try_divide(F.sum(F.col("n") * F.col("m")).over(whole), F.sum("n").over(whole))
    parts = parts.withColumn("_c", centre).withColumn("m", F.col("m") - F.col("_c")).withColumns({
        "s": F.col("n") * F.col("m"), "q": F.col("n") * (F.col("v") + F.col("m") * F.col("m"))})
    upto = whole.orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ("n", "s", "q")
    upper = {f"u{c}": F.sum(F.when(F.col("late"), F.col(c))).over(whole) for c in sums}
    prefix = {f"p{c}": F.sum(c).over(upto) for c in sums}
    cumulated = parts.withColumns({**upper, **prefix}).groupBy("chain_id", "param", "k").agg(
        *[F.max(f"{a}{c}").alias(f"{a}{c}") for a in "up" for c in sums])
    # A bucket's prefix holds up to the next filled bucket; before the first there is none.
    order = whole.orderBy("k")
    first = F.lag("k").over(order).isNull()
    last = F.least(F.coalesce(F.lead("k").over(order) - 1, F.lit(checks)), F.lit(checks))
    start = F.when(first, 1).otherwise(F.col("k"))
    spread = cumulated.withColumns({"_from": start, "_to": last}).filter("_from <= _to").select(
        "*", F.explode(F.sequence("_from", "_to")).alias("_k"))

    def mean_var(n, s, q):
        mean = F.try_divide(s, n)
        return mean, F.try_divide(q, n) - mean * mean

    lm, lv = mean_var(F.col("pn"), F.col("ps"), F.col("pq"))
    um, uv = mean_var(F.col("un"), F.col("us"), F.col("uq"))
    score = F.when(F.col("_k") >= F.col("k"), F.try_divide(F.abs(lm - um), F.sqrt(lv + uv)))
    return spread.select("chain_id", "param", F.col("_k").alias("k"), score.alias("t_score"))


def _bluestein(x: np.ndarray, step: float, count: int) -> np.ndarray:
    """sum_m x_m exp(i * step * j * m) for j < count, along axis 0."""
    n = len(x)
    m = np.arange(max(n, count), dtype=float)
    chirp = np.exp(0.5j * step * m * m)
    size = 1 << int(np.ceil(np.log2(n + count)))
    kernel = np.zeros(size, complex)
    kernel[:count] = np.conj(chirp[:count])
    kernel[size - n + 1:] = np.conj(chirp[1:n][::-1])
    mixed = np.fft.fft(x * chirp[:n, None], size, axis=0) * np.fft.fft(kernel)[:, None]
    return np.fft.ifft(mixed, axis=0)[:count] * chirp[:count, None]


def power_spectrum(chain: DataFrame, columns: Sequence[str], max_coefficients: int = 10000,
                   block: int = 1 << 16, contiguous: bool = True, width: int = 8) -> DataFrame:
    """P(k_j) of each parameter at the lowest frequencies of a chain of even length.

    ``max_coefficients`` bounds the frequencies: higher ones are left out, and so is the
    last entry of a chain of odd length.

    Each block of entries gives its share of every Fourier sum (a chirp
    transform, as the frequencies belong to the whole chain); shares are added
    by (param, j).  Values are real, so negative j repeat the positive ones.
    """
    columns = list(columns)
    indexed = with_entry_index(chain.select("chain_id", "step", *columns), contiguous,
                               per_chain={"_n": F.count(F.lit(1))})
    values = [F.col(c).cast("double") for c in columns]
    rows = indexed.withColumn(
        "n_even", F.col("_n") - F.col("_n") % 2).filter("entry < n_even").select(
        "chain_id", "entry", "_n", "n_even", F.floor(F.col("entry") / block).alias("block"),
        F.inline(_slices(columns, values, width)))

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry")
        n_all, n_even = int(pdf["_n"].iloc[0]), int(pdf["n_even"].iloc[0])
        k0 = int(pdf["slice"].iloc[0]) * width
        names = columns[k0:k0 + width]
        count = min(max_coefficients, n_all) // 2
        start = int(pdf["entry"].iloc[0])
        j = np.arange(count)
        # Phase of the block start, reduced exactly in integers.
        phase = np.exp(2j * np.pi * ((j * start) % n_even) / n_even)
        sums = _bluestein(np.stack(pdf["x"].to_numpy()), 2 * np.pi / n_even, count) * phase[:, None]
        return pd.DataFrame({
            "chain_id": pdf["chain_id"].iloc[0], "param": np.repeat(names, count),
            "j": np.tile(j.astype(np.int32), len(names)), "re": sums.real.T.ravel(),
            "im": sums.imag.T.ravel(), "n_even": n_even, "count": count})

    id_type = dict(chain.dtypes)["chain_id"]
    parts = rows.groupBy("chain_id", "block", "slice").applyInPandas(
        partial, f"chain_id {id_type}, param string, j int, re double, im double, n_even long, count int")
    sums = parts.groupBy("chain_id", "param", "j", "n_even", "count").agg(
        F.sum("re").alias("re"), F.sum("im").alias("im"))
    # j runs over -(count-1) .. count-2, as the upper end is open.
    signed = F.when(F.col("j") == 0, F.array(F.col("j"))).when(
        F.col("j") < F.col("count") - 1, F.array(-F.col("j"), F.col("j"))).otherwise(F.array(-F.col("j")))
    return sums.select(
        "chain_id", "param", F.explode(signed).alias("j"), "n_even",
        ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n_even")).alias("power"),
    ).select("chain_id", "param", "j", (2 * F.pi() * F.col("j") / F.col("n_even")).alias("k"), "power")


def power_spectrum_fit(spectrum: DataFrame) -> DataFrame:
    """Fit P0 (k*/k)^a / ((k*/k)^a + 1) on 0 < k <= 1; a group is one spectrum."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        use = pdf[(pdf["k"] > 0) & (pdf["k"] <= 1)]
        out = {"chain_id": [pdf["chain_id"].iloc[0]], "param": [pdf["param"].iloc[0]]}
        if len(use) < 3:
            return pd.DataFrame({**out, "p0": [np.nan], "k_star": [np.nan], "alpha": [np.nan],
                                 "step_size": [np.nan], "converged": [False]})
        x, y = use["k"].to_numpy(), use["power"].to_numpy()

        def model(v, q):
            r = (q[1] / v) ** q[2]
            return q[0] * r / (r + 1)

        # Start and limits of amplitude, turnover and slope.
        p, done = fit_curve(model, [10.0, 0.1, 2.0], x, y, np.ones(len(x)), [0.0, 0.001, 0.0], [100.0, 1.0, 5.0])
        return pd.DataFrame({**out, "p0": [p[0]], "k_star": [p[1]], "alpha": [p[2]],
                             "step_size": [np.sqrt(p[0] / (0.5 * len(pdf)))], "converged": [done]})

    id_type = dict(spectrum.dtypes)["chain_id"]
    return spectrum.groupBy("chain_id", "param").applyInPandas(
        fit, f"chain_id {id_type}, param string, p0 double, k_star double, alpha double, step_size double, converged boolean")


def after_burn_in(chain: DataFrame) -> DataFrame:
    """Keep step >= (entries of the chain) / 5, per chain."""
    entries = chain.groupBy("chain_id").agg(F.floor(F.count(F.lit(1)) / 5).alias("_cut"))
    # One row per chain.
    return chain.join(F.broadcast(entries), "chain_id").filter("step >= _cut").drop("_cut")


def _rhat_from_moments(moments: DataFrame, keys: Sequence[str], equal_sizes: bool) -> DataFrame:
    """moments: (keys, chain_id, n, m, v); a window partition holds one row per chain."""
    chains = Window.partitionBy(*keys)
    if equal_sizes:
        centre = F.avg("m").over(chains)
    else:
        centre = F.try_divide(F.sum(F.col("n") * F.col("m")).over(chains), F.sum("n").over(chains))
    joined = moments.withColumn("_c", centre).groupBy(*keys).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("chains"), F.avg("v").alias("within"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("_c"), 2)).alias("_b"))
    size = F.floor(F.col("total") / F.col("chains"))
    between = F.when(F.col("chains") > 1, F.try_divide(F.col("_b"), F.col("chains") - 1)).otherwise(0.0)
    table = joined.withColumn("n", size.cast("double")).withColumn("between", between).withColumn(
        "pooled", F.try_divide((F.col("n") - 1) * F.col("within") + F.col("between"), F.col("n")))
    return table.select(
        *keys, "chains", F.col("total").cast("long").alias("total"), "within", "between",
        F.sqrt(F.try_divide("pooled", "within")).alias("rhat"),
        F.when(F.col("chains") > 1, F.col("total") * F.try_divide("pooled", "between")).alias("ess"))


def rhat(chain: DataFrame, columns: Sequence[str], limit: float = 1.1) -> DataFrame:
    """Gelman-Rubin R-hat from per-chain count, mean and population variance."""
    columns = [c for c in columns if not c.startswith(NOT_COMPARED)]
    stats = []
    for i, c in enumerate(columns):
        stats += [F.avg(c).alias(f"m_{i}"), F.var_pop(c).alias(f"v_{i}")]
    sums = chain.groupBy("chain_id").agg(F.count(F.lit(1)).cast("double").alias("n"), *stats)
    moments = _long(sums, ["chain_id", "n"], columns, {"m": "m", "v": "v"})
    return _rhat_from_moments(moments, ["param"], False).withColumn("not_converged", F.col("rhat") > limit)


def exact_medians(df: DataFrame, columns: Sequence[str], bins: int = 4096, leaf: int = 100_000) -> dict[str, float]:
    """Median of each column without collecting values into one group.

    Each round counts values in ``bins`` slices of the bracket that holds the
    middle ranks and narrows the bracket to that slice; a bracket with few
    distinct values is finished by counting (column, value) pairs.  Per round
    only brackets, one per column, and slice counts reach the driver. Null, NaN and infinite
    values are left out; a column without other values has no median. The columns are written to the
    shared folder once, so rounds read them and not the chain.
    """
    df = stored(df.select(*[number(c).alias(c) for c in columns]), "columns")
    spark = df.sparkSession
    state = {}
    row = df.agg(*[e for i, c in enumerate(columns) for e in (
        F.count(c).alias(f"n{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"))]).first()
    medians = {}
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        if n:
            state[(c, 0)] = [(n - 1) // 2, float(row[f"a{i}"]), float(row[f"b{i}"]), 0, n]
            state[(c, 1)] = [n // 2, float(row[f"a{i}"]), float(row[f"b{i}"]), 0, n]
    found = {}
    while state:
        for key in [k for k, s in state.items() if s[1] == s[2]]:
            found[key] = state.pop(key)[1]
        if not state:
            break
        brackets = {}
        for key, s in state.items():
            brackets.setdefault((key[0], s[1], s[2], s[4]), []).append(key)
        ids = list(brackets)
        # Each row lands in at most the two brackets of a column.
        cells = F.array(*[
            F.when((F.col(c) >= lo) & (F.col(c) <= hi), F.struct(
                F.lit(b).alias("b"),
                (F.col(c).cast("double") if n <= leaf else F.least(
                    F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("double")).alias("slot"),
                F.col(c).cast("double").alias("v")))
            for b, (c, lo, hi, n) in enumerate(ids)])
        counted = df.select(F.inline(F.filter(cells, lambda x: x.isNotNull()))).groupBy("b", "slot").agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        # At most max(bins, leaf) rows per bracket; the window partition is one bracket.
        upto = Window.partitionBy("b").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = counted.withColumn("c", F.sum("n").over(upto))
        wanted = spark.createDataFrame(
            [(ids.index(bk), key[1], state[key][0] - state[key][3]) for bk, keys in brackets.items() for key in keys],
            "b int, side int, want long")
        hits = ranked.join(F.broadcast(wanted), "b").filter(
            (F.col("want") < F.col("c")) & (F.col("want") >= F.col("c") - F.col("n"))).collect()
        for hit in hits:
            key = (ids[hit["b"]][0], hit["side"])
            rank, before = state[key][0], state[key][3]
            state[key] = [rank, hit["lo"], hit["hi"], before + hit["c"] - hit["n"], hit["n"]]
    for c in columns:
        if (c, 0) in found:
            medians[c] = (found[(c, 0)] + found[(c, 1)]) / 2
    return medians


def rhat_folded(chain: DataFrame, columns: Sequence[str]) -> DataFrame:
    """R-hat of abs(x - median over all chains), next to the plain one; sample variances."""
    columns = [c for c in columns if not c.startswith(NOT_COMPARED)]
    medians = exact_medians(chain, columns)
    stats = []
    for i, c in enumerate(columns):
        folded = F.abs(F.col(c) - F.lit(medians.get(c)).cast("double"))
        stats += [F.avg(c).alias(f"m_{i}"), F.var_samp(c).alias(f"v_{i}"),
                  F.avg(folded).alias(f"fm_{i}"), F.var_samp(folded).alias(f"fv_{i}")]
    sums = chain.groupBy("chain_id").agg(F.count(F.lit(1)).cast("double").alias("n"), *stats)
    rows = F.array(*[
        F.struct(F.lit(c).alias("param"), F.lit(kind).alias("kind"), F.col(f"{a}m_{i}").alias("m"), F.col(f"{a}v_{i}").alias("v"))
        for i, c in enumerate(columns) for kind, a in (("plain", ""), ("folded", "f"))])
    both = _rhat_from_moments(sums.select("chain_id", "n", F.inline(rows)), ["param", "kind"], True)

    def of(kind: str, column: str):
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    median = F.create_map(*[v for c in columns for v in (F.lit(c), F.lit(medians.get(c)).cast("double"))])
    return both.groupBy("param").agg(
        F.max("chains").alias("chains"), of("plain", "rhat").alias("rhat"), of("plain", "ess").alias("ess"),
        of("folded", "rhat").alias("rhat_folded"), of("folded", "ess").alias("ess_folded"),
    ).withColumn("median", F.element_at(median, F.col("param")))


def count_runs(df: DataFrame, label: str, step: str = "step", keys: Sequence[str] = ("chain_id",),
               block: int = 1 << 20) -> DataFrame:
    """Number of runs of equal labels in step order.

    Changes inside a block of steps are counted by a window over the block; the
    borders of neighbouring blocks are compared afterwards, one row per block.
    """
    keyed = df.select(*keys, F.col(step).alias("_s"), F.col(label).alias("_l"),
                      F.floor(F.col(step) / block).alias("_b"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_s")
    marked = keyed.withColumn("_p", F.lag("_l").over(inside))
    blocks = marked.groupBy(*keys, "_b").agg(
        F.sum(F.when(F.col("_p") != F.col("_l"), 1).otherwise(0)).alias("_changes"),
        F.min_by("_l", "_s").alias("_first"), F.max_by("_l", "_s").alias("_end"))
    order = Window.partitionBy(*keys).orderBy("_b")
    border = blocks.withColumn("_before", F.lag("_end").over(order))
    return border.groupBy(*keys).agg(
        (1 + F.sum(F.col("_changes") + F.when(F.col("_before") != F.col("_first"), 1).otherwise(0))).alias("runs"))
