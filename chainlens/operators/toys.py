"""Likelihoods of spectra, and summaries over toys (toy, sample_id, bin, mc, w2)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from chainlens.functions import llh as stats
from chainlens.functions.expr import uniform_bin, z_score
from chainlens.functions.numeric import normal_pvalue
from chainlens.operators.binning import broadcast_if_small
from chainlens.session import stored


def binned_llh(spectra: DataFrame, stat: str = "poisson", data: str = "data", mc: str = "mc",
               w2: str = "w2", name: str = "llh") -> DataFrame:
    """Add -lnL of each bin."""
    return spectra.withColumn(name, stats.bin_llh(stat, F.col(data), F.col(mc), F.col(w2)))


def sample_llh(spectra: DataFrame, stat: str = "poisson", keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    return binned_llh(spectra, stat).groupBy(*keys).agg(F.sum("llh").alias("llh"))


def sample_rates(spectra: DataFrame, stat: str = "poisson") -> DataFrame:
    """Data, prediction and -lnL per sample and in total (null sample)."""
    return binned_llh(spectra, stat).rollup("sample_id").agg(
        F.sum("data").alias("data"), F.sum("mc").alias("mc"), F.sum("llh").alias("llh"))


def every_bin_llh(spectra: DataFrame, data: DataFrame, by: str, stat: str = "poisson", column: str = "data") -> DataFrame:
    """-lnL (by, sample_id, llh) over all bins of ``data``, filled or not.

    A bin that a spectrum lacks holds a prediction of 0, and the low-prediction bound
    applies there. Such terms depend on the data alone: they are summed once per sample
    and corrected by the bins that are there, so no (spectrum x bin) frame is made. A bin
    without data has 0. Spectra that are empty in a sample get their row.
    """
    none = F.lit(0.0)
    zero = data.select("sample_id", "bin", F.col(column).alias("_data"), stats.bin_llh(
        stat, F.col(column), none, none).alias("_zero"))
    base = zero.groupBy("sample_id").agg(F.sum("_zero").alias("_base"))
    observed = F.coalesce("_data", none)
    term = stats.bin_llh(stat, observed, F.col("mc"), F.col("w2")) - F.coalesce("_zero", none)
    there = spectra.select(by, "sample_id", "bin", "mc", "w2").join(
        broadcast_if_small(zero), ["sample_id", "bin"], "left").groupBy(by, "sample_id").agg(F.sum(term).alias("_there"))
    samples = [r[0] for r in base.select("sample_id").collect()]  # one row per sample
    frame = spectra.select(by).distinct().withColumn(
        "sample_id", F.explode(F.lit(samples).cast(f"array<{dict(data.dtypes)['sample_id']}>")))
    return frame.join(F.broadcast(base), "sample_id").join(there, [by, "sample_id"], "left").select(
        by, "sample_id", (F.col("_base") + F.coalesce("_there", none)).alias("llh"))


def llh_scan(spectra: DataFrame, data: DataFrame, stat: str = "poisson", systematics: DataFrame | None = None) -> DataFrame:
    """-2lnL per point and sample, and in total (null sample), over all bins of the data.

    ``systematics`` (point, set, llh) holds the -lnL of systematic sets: they become rows
    with their ``set`` and count in the total.
    """
    rows = every_bin_llh(spectra, data, "point", stat).withColumn("llh", 2 * F.col("llh"))
    if systematics is not None:
        none = F.lit(None)
        sets = systematics.select("point", none.cast(dict(rows.dtypes)["sample_id"]).alias("sample_id"), "set",
                                  (2 * F.col("llh")).alias("llh"))
        rows = rows.select("point", "sample_id", none.cast("string").alias("set"), "llh").union(sets)
    total = rows.groupBy("point").agg(F.sum("llh").alias("llh"))
    return rows.unionByName(total, allowMissingColumns=True)


def llh_map(points: DataFrame, spectra: DataFrame, data: DataFrame, samples: Sequence[int],
            stat: str = "poisson", systematics: dict[str, str] | None = None) -> DataFrame:
    """Wide map: parameters of a point, -2lnL per sample and systematic set, and totals.

    ``systematics`` maps a set name to the column of ``points`` with its -lnL.
    """
    per_sample = llh_scan(spectra, data, stat).groupBy("point").pivot("sample_id", list(samples)).agg(F.first("llh"))
    named = per_sample.select("point", *[
        F.coalesce(F.col(str(s)), F.lit(0.0)).alias(f"sample_{s}_LLH") for s in samples])
    table = points.join(named, "point")
    total = F.lit(0.0)
    for s in samples:
        total = total + F.col(f"sample_{s}_LLH")
    table = table.withColumn("Sample_LLH", total)
    every = F.col("Sample_LLH")
    for name, column in (systematics or {}).items():
        table = table.withColumn(f"{name}_LLH", 2 * F.col(column))
        every = every + F.col(f"{name}_LLH")
    return table.withColumn("Total_LLH", every)


# -- fluctuations -------------------------------------------------------------


def _fluctuate(spectra: DataFrame, mean: str, name: str, seed: int, keys: Sequence[str], draw_one) -> DataFrame:
    """Draw per spectrum: packed to one row of at most its bins, in bin order.

    Each spectrum is seeded by the numbers that name it, so a draw does not
    depend on the partitioning; a batch of spectra is drawn per Arrow batch.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def draw(ids: pd.Series, means: pd.Series) -> pd.Series:
        return pd.Series([
            draw_one(np.random.default_rng([seed, *(int(x) & 0xFFFFFFFFFFFFFFFF for x in k)]), np.maximum(np.asarray(m, float), 0.0)).astype(float)
            for k, m in zip(ids, means)])

    rest = [c for c in spectra.columns if c not in keys and c != "bin"]
    packed = spectra.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", *rest))).alias("_r"))
    drawn = packed.withColumn("_d", draw(F.array(*[F.col(k).cast("long") for k in keys]), F.col(f"_r.{mean}")))
    spread = drawn.select(*keys, F.inline(F.arrays_zip("_r", "_d")))
    return spread.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in spectra.columns], F.col("_d").alias(name))


def poisson_fluctuate(spectra: DataFrame, mean: str = "mc", name: str = "fluctuated", seed: int = 1,
                      keys: Sequence[str] = ("toy", "sample_id")) -> DataFrame:
    """Independent Poisson draw per bin."""
    return _fluctuate(spectra, mean, name, seed, keys, lambda rng, mu: rng.poisson(mu))


def multinomial_fluctuate(spectra: DataFrame, mean: str = "mc", name: str = "fluctuated", seed: int = 1,
                          keys: Sequence[str] = ("toy", "sample_id")) -> DataFrame:
    """Poisson total per spectrum, spread over its bins."""

    def spread(rng: np.random.Generator, mu: np.ndarray) -> np.ndarray:
        n = rng.poisson(mu.sum())
        return rng.multinomial(n, mu / mu.sum()) if n else np.zeros(len(mu))

    return _fluctuate(spectra, mean, name, seed, keys, spread)


# -- summaries over toys ------------------------------------------------------


def with_weights(toys: DataFrame, info: DataFrame | None) -> DataFrame:
    """Attach the weight of each toy; 1 without a record."""
    if info is None:
        return toys.withColumn("weight", F.lit(1.0))
    return toys.join(info.select("toy", "weight"), "toy")


def total_weight(toys: DataFrame, weight: str = "weight") -> float:
    """Sum of the weights of all toys, each counted once."""
    return toys.groupBy("toy").agg(F.first(weight).alias("w")).agg(F.sum("w")).first()[0] or 0.0


def weighted_moments(df: DataFrame, keys: Sequence[str], values: dict[str, str], weight: str = "weight",
                     total: float | None = None) -> DataFrame:
    """Weighted mean and population RMS of columns, summed about each group's plain mean.

    With ``total``, the weight of a group is that, and what its rows lack of it counts as
    rows of value 0.
    """
    base = df.groupBy(*keys).agg(*[F.avg(v).alias(f"_a_{n}") for n, v in values.items()])
    # One row per group, which is a bin of a spectrum; the rows are not shuffled for it.
    joined = df.join(broadcast_if_small(base), list(keys))
    w = F.col(weight)
    sums = [F.sum(w).alias("_w")]
    for n, v in values.items():
        d = F.col(v) - F.col(f"_a_{n}")
        sums += [F.sum(w * d).alias(f"_s_{n}"), F.sum(w * d * d).alias(f"_q_{n}"), F.first(f"_a_{n}").alias(f"_a_{n}")]
    grouped = joined.groupBy(*keys).agg(*sums)
    share = F.lit(1.0) if total is None else F.least(F.lit(1.0), F.try_divide("_w", F.lit(float(total))))
    out = []
    for n in values:
        shift = F.try_divide(f"_s_{n}", "_w")
        mean = F.col(f"_a_{n}") + shift
        spread = F.greatest(F.lit(0.0), F.try_divide(f"_q_{n}", "_w") - shift * shift)
        out += [(share * mean).alias(f"{n}_mean"), F.sqrt(share * (spread + (1 - share) * mean * mean)).alias(f"{n}_rms")]
    return grouped.select(*keys, *out)


def predictive_mean(toys: DataFrame, keys: Sequence[str] = ("sample_id", "bin"), weight: str = "weight",
                    bins: DataFrame | None = None, info: DataFrame | None = None) -> DataFrame:
    """Weighted mean and RMS of content and of squared weights per bin over all toys.

    A toy without events in a bin counts there with 0; with ``info`` (toy and its weight), so does
    one without any event. With ``bins`` (keys), bins that no toy fills are in the result, too.
    """
    every = toys if info is None else info
    out = weighted_moments(toys, keys, {"mc": "mc", "w2": "w2"}, weight, total_weight(every, weight))
    if bins is None:
        return out
    return bins.select(*keys).distinct().join(out, list(keys), "left").fillna(0.0)


def predictive_by_mode(toys: DataFrame, weight: str = "weight") -> DataFrame:
    """The same per mode, for toys filled with the mode as a key."""
    return predictive_mean(toys, ("sample_id", "mode", "bin"), weight)


def apply_beta(predicted: DataFrame, betas: DataFrame, keys: Sequence[str] = ("sample_id", "bin")) -> DataFrame:
    """Prediction times beta with propagated error."""
    table = predicted.join(betas.select(*keys, "beta_mean", "beta_rms"), list(keys))
    error = F.sqrt(F.pow(F.col("beta_mean") * F.col("mc_rms"), 2) + F.pow(F.col("mc_mean") * F.col("beta_rms"), 2))
    return table.withColumn("corrected", F.col("mc_mean") * F.col("beta_mean")).withColumn("corrected_error", error)


def beta_study(toys: DataFrame, data: DataFrame, stat: str = "barlow_beeston",
               keys: Sequence[str] = ("sample_id", "bin")) -> DataFrame:
    """Mean and RMS over toys of the scale parameter of each bin.

    A toy that predicts nothing in a bin has no scale there.
    """
    joined = toys.filter("mc > 0").join(broadcast_if_small(data), list(keys))
    value = stats.beta(F.col("data"), F.col("mc"), F.col("w2"), stat)
    return weighted_moments(joined.withColumn("beta", value), keys, {"beta": "beta"})


def toy_violin(toys: DataFrame, keys: Sequence[str] = ("sample_id",), nbins: int = 400,
               bins: DataFrame | None = None, info: DataFrame | None = None) -> DataFrame:
    """Count of toys per bin and content bin; content runs from 0 to 1.05 x the largest.

    Toys, or those of ``info`` (toy), without events in a bin are in its first content bin. With ``bins`` (keys, bin),
    bins that no toy fills are there, too, if their sample has any events.
    """
    n = (toys if info is None else info).select("toy").distinct().count()
    top = toys.groupBy(*keys).agg((F.max("mc") * 1.05).alias("_top"))
    content = F.least(uniform_bin(F.col("mc"), F.lit(0.0), F.col("_top"), nbins), F.lit(nbins - 1))
    counts = toys.join(F.broadcast(top), list(keys)).groupBy(  # one row per sample
        *keys, "bin", "_top", content.alias("content_bin")).agg(F.count(F.lit(1)).alias("n_toys"))
    places = (toys if bins is None else toys.select(*keys, "bin").union(bins.select(*keys, "bin"))).select(
        *keys, "bin").distinct().join(F.broadcast(top), list(keys))
    seen = counts.groupBy(*keys, "bin", "_top").agg(F.sum("n_toys").alias("_seen"))
    empty = places.join(seen, [*keys, "bin", "_top"], "left").select(
        *keys, "bin", "_top", F.lit(0).alias("content_bin"), (F.lit(n) - F.coalesce("_seen", F.lit(0))).alias("n_toys"))
    every = counts.unionByName(empty).groupBy(*keys, "bin", "_top", "content_bin").agg(
        F.sum("n_toys").alias("n_toys")).filter("n_toys > 0")
    return every.withColumn("content", (F.col("content_bin") + 0.5) * F.col("_top") / nbins).drop("_top")


def violin_summary(violin: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Mean and RMS of the content distribution of each bin, from its bin centres."""
    table = violin.withColumn("weight", F.col("n_toys").cast("double"))
    return weighted_moments(table, [*keys, "bin"], {"content": "content"})


def with_totals(per_toy: DataFrame, values: Sequence[str]) -> DataFrame:
    """Add to each toy the sum over its samples, as a row without sample."""
    none = F.lit(None).cast(dict(per_toy.dtypes)["sample_id"])
    twice = per_toy.select("toy", *values, F.explode(F.array(F.col("sample_id"), none)).alias("sample_id"))
    return twice.groupBy("toy", "sample_id").agg(*[F.sum(v).alias(v) for v in values])


def event_rates(toys: DataFrame, data: DataFrame | None = None, weight: str | None = None,
                info: DataFrame | None = None) -> DataFrame:
    """Rates per toy, then mean, sigma, fractional error and P(rate >= data) over all toys.

    A null sample is the total of all samples. A toy without events in a sample has rate 0
    there, and so has one of ``info`` (toy and its weight) that has no events at all. ``weight``
    names the toys' weight column.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rates = with_totals(toys.groupBy("toy", "sample_id").agg(F.sum("mc").alias("rate")), ["rate"])
    every = (toys if info is None else info).groupBy("toy").agg(F.first(w).alias("weight"))
    rates = rates.join(every, "toy")
    total = every.agg(F.sum("weight")).first()[0] or 0.0
    if data is None:
        rates = rates.withColumn("data_rate", F.lit(None).cast("double"))
    else:
        # Samples + 1 rows.
        observed = data.rollup("sample_id").agg(F.sum("data").alias("data_rate"))
        o = observed.withColumnRenamed("sample_id", "_o")
        rates = rates.join(F.broadcast(o), F.col("sample_id").eqNullSafe(F.col("_o")), "left").drop("_o")
    # Toys that are not there have rate 0: their weight is what is missing of the total.
    grouped = rates.groupBy("sample_id").agg(
        F.sum("weight").alias("_w"), F.sum(F.col("weight") * F.col("rate")).alias("_s"), F.avg("rate").alias("_a"),
        F.first("data_rate").alias("data_rate"),
        F.sum(F.when(F.col("rate") >= F.col("data_rate"), F.col("weight")).otherwise(0.0)).alias("_p"))
    centred = rates.join(F.broadcast(grouped.select(F.col("sample_id").alias("_g"), (F.col("_s") / F.lit(total)).alias("mean"))),  # samples + 1 rows
                         F.col("sample_id").eqNullSafe(F.col("_g")))
    d = F.col("rate") - F.col("mean")
    spread = centred.groupBy("sample_id").agg(F.first("mean").alias("mean"), F.sum(F.col("weight") * d * d).alias("_q")).withColumnRenamed(
        "sample_id", "_g")
    out = grouped.join(F.broadcast(spread), F.col("sample_id").eqNullSafe(F.col("_g")))
    absent = F.greatest(F.lit(0.0), F.lit(total) - F.col("_w"))
    sigma = F.sqrt((F.col("_q") + absent * F.col("mean") * F.col("mean")) / F.lit(total))
    p = (F.col("_p") + F.when(F.col("data_rate") <= 0, absent).otherwise(0.0)) / F.lit(total)
    out = out.select("sample_id", "mean", sigma.alias("sigma"), "data_rate", p.alias("p_value"))
    return out.withColumn("frac_error", F.try_divide(100 * F.col("sigma"), F.col("mean")))


def rate_significance(rates: DataFrame) -> DataFrame:
    """z-score of the data rate and its normal p-value."""
    z = rates.withColumn("z", z_score(F.col("data_rate"), F.col("mean"), F.col("sigma")))
    return z.withColumn("z_pvalue", normal_pvalue("z"))


def rate_correlation(toys: DataFrame, by: str = "sample_id", keys: Sequence[str] = (),
                     value: str = "mc") -> DataFrame:
    """Correlation over toys of the integrals of samples, modes or bins; absent rates are 0.

    Rates of a toy become one short vector; each task sums its vectors to one matrix over
    the labels it meets, so pairs are shuffled per task and not per toy, and no label
    reaches the driver. A matrix has the labels of one group squared.
    """
    keys = list(keys)
    rates = toys.groupBy("toy", *keys, by).agg(F.sum(value).alias("r"))
    n = float(toys.select("toy").distinct().count())
    packed = rates.groupBy("toy", *keys).agg(
        F.collect_list(by).alias("names"), F.collect_list("r").alias("rates"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels: dict[tuple, dict] = {}
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
            for key, part in groups:
                key = tuple(k.item() if hasattr(k, "item") else k for k in key)
                place = labels.setdefault(key, {})
                for names in part["names"]:
                    for name in names:
                        place.setdefault(name, len(place))
                x = np.zeros((len(part), len(place)))
                for r, (names, values) in enumerate(zip(part["names"], part["rates"])):
                    x[r, [place[name] for name in names]] = values
                total = np.zeros((len(place), len(place)))
                if key in sums:
                    total[:len(sums[key]), :len(sums[key])] = sums[key]
                sums[key] = total + x.T @ x
        for key, m in sums.items():
            i, j = np.triu_indices(len(m))
            names = np.array(list(labels[key]), dtype=object)
            low, high = np.minimum(names[i], names[j]), np.maximum(names[i], names[j])
            out = pd.DataFrame({"i": low, "j": high, "s": m[i, j]})
            for name, value in zip(keys, key):
                out[name] = value
            yield out

    types = dict(toys.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"i {types[by]}, j {types[by]}, s double"])
    sums = packed.mapInPandas(partial, schema).groupBy(*keys, "i", "j").agg(F.sum("s").alias("s"))
    # Labels that no task saw together have a sum of 0; the frame is the result's size by definition.
    listed = rates.groupBy(*keys).agg(F.sort_array(F.collect_set(by)).alias("_l")).withColumn("i", F.explode("_l"))
    frame = listed.withColumn("j", F.explode(F.filter("_l", lambda x: x >= F.col("i")))).drop("_l")
    sums = frame.join(sums, [*keys, "i", "j"], "left").fillna(0.0, ["s"])
    means = broadcast_if_small(rates.groupBy(*keys, by).agg((F.sum("r") / n).alias("m")))
    for side in "ij":
        sums = sums.join(means.select(*keys, F.col(by).alias(side), F.col("m").alias(f"_m{side}")), [*keys, side])
    sums = sums.withColumn("s", F.col("s") - n * F.col("_mi") * F.col("_mj"))
    # A window partition is one row or column of a matrix.
    own = F.when(F.col("i") == F.col("j"), F.col("s"))
    scaled = sums.withColumn("_vi", F.max(own).over(Window.partitionBy(*keys, "i"))).withColumn(
        "_vj", F.max(own).over(Window.partitionBy(*keys, "j")))
    return scaled.filter("i < j").select(*keys, "i", "j", F.when(
        (F.col("_vi") > 0) & (F.col("_vj") > 0),
        F.try_divide(F.col("s"), F.sqrt(F.col("_vi") * F.col("_vj")))).alias("corr"))


# -- model checks -------------------------------------------------------------


def deviance(toys: DataFrame, data: DataFrame, stat: str, name: str = "llh", column: str = "data") -> DataFrame:
    """-2lnL per toy and sample of observed counts against the toy, over all bins of the data."""
    return every_bin_llh(toys, data, "toy", stat, column).select("toy", "sample_id", (2 * F.col("llh")).alias(name))


def in_every_bin(data: DataFrame, *predictions: DataFrame) -> DataFrame:
    """The data (sample_id, bin, data) with a row of 0 for bins that only the predictions have.

    So results do not depend on whether zero counts are stored.
    """
    keys = ["sample_id", "bin"]
    seen = reduce(DataFrame.unionByName, [p.select(*keys) for p in predictions]).distinct()
    return data.select(*keys, "data").join(broadcast_if_small(seen), keys, "full").fillna(0.0, ["data"])


def information_criteria(toys: DataFrame, data: DataFrame, predicted: DataFrame, n_params: int,
                         stat: str = "poisson", info: DataFrame | None = None) -> DataFrame:
    """BIC by events and by bins, DIC and WAIC, with effective parameter numbers.

    ``predicted`` (sample_id, bin, mc_mean, w2_mean) gives the point estimate. All bins of
    the data, the toys and the estimate count, with 0 where one of them has none, and all toys of
    ``info`` (toy), those without any event included. Means of likelihoods are taken about
    the largest one of the bin, so they do not underflow.
    """
    none = F.lit(0.0)
    data = stored(in_every_bin(data, toys, predicted), "data")  # a row per bin, read three times
    best = data.join(predicted.select("sample_id", "bin", "mc_mean", "w2_mean"), ["sample_id", "bin"], "left").fillna(
        0.0, ["mc_mean", "w2_mean"]).withColumn("_l", stats.bin_llh(stat, F.col("data"), F.col("mc_mean"), F.col("w2_mean")))
    point = best.agg((2 * F.sum("_l")).alias("d_hat"), F.sum("data").alias("n_data"),
                     F.count(F.lit(1)).alias("n_bins"))
    n_toys = (toys if info is None else info).select("toy").distinct().count()
    keys = ["sample_id", "bin"]
    empty = data.select(*keys, "data", (-stats.bin_llh(stat, F.col("data"), none, none)).alias("ll0"))
    joined = binned_llh(toys.join(broadcast_if_small(empty), keys), stat).withColumn("ll", -F.col("llh"))
    tops = joined.groupBy(*keys).agg(F.max("ll").alias("_max"), F.count(F.lit(1)).alias("_n"))
    tops = empty.join(tops, keys, "left").withColumn("_absent", F.lit(n_toys) - F.coalesce("_n", F.lit(0))).withColumn(
        "_top", F.when(F.col("_absent") > 0, F.greatest("ll0", "_max")).otherwise(F.col("_max"))).drop("data", "_n", "_max")
    sums = joined.drop("ll0").join(broadcast_if_small(tops.select(*keys, "_top")), keys).groupBy(*keys).agg(
        F.sum("ll").alias("_m"), F.sum(F.col("ll") * F.col("ll")).alias("_q"), F.sum(F.exp(F.col("ll") - F.col("_top"))).alias("_e"))
    per_bin = tops.join(sums, keys, "left").fillna(0.0, ["_m", "_q", "_e"])
    n, ll0, absent = F.lit(float(n_toys)), F.col("ll0"), F.col("_absent")
    per_bin = per_bin.select(
        ((F.col("_m") + absent * ll0) / n).alias("m"), ((F.col("_q") + absent * ll0 * ll0) / n).alias("q"),
        (F.col("_top") + F.log((F.col("_e") + F.when(absent > 0, absent * F.exp(ll0 - F.col("_top"))).otherwise(0.0)) / n)).alias("lppd"))
    waic = per_bin.agg(F.sum("lppd").alias("lppd"), F.sum(F.col("q") - F.col("m") * F.col("m")).alias("p_waic"),
                       (-2 * F.sum("m")).alias("d_bar"))
    # Two single rows side by side.
    table = point.unionByName(waic, allowMissingColumns=True).agg(*[
        F.max(c).alias(c) for c in ("d_hat", "n_data", "n_bins", "lppd", "p_waic", "d_bar")])
    p_dic = F.abs(F.col("d_bar") - F.col("d_hat"))
    return table.select(
        "d_hat", "d_bar", (n_params * F.log(F.floor("n_data")) + F.col("d_hat")).alias("bic_events"),
        (n_params * F.log(F.col("n_bins")) + F.col("d_hat")).alias("bic_bins"),
        p_dic.alias("p_dic"), (F.col("d_hat") + 2 * p_dic).alias("dic"), "p_waic",
        (-2 * (F.col("lppd") - F.col("p_waic"))).alias("waic"))


def predictive_pvalue(chi2: DataFrame, info: DataFrame | None = None, nbins: int = 50) -> DataFrame:
    """P(fluctuated >= data), exact and on a 50 x 50 grid, per sample and in total.

    ``chi2`` is (toy, sample_id, data_llh, fluct_llh).  The total of a toy also
    holds its penalty.
    """
    every = with_totals(chi2, ["data_llh", "fluct_llh"])
    if info is not None:
        extra = F.when(F.col("sample_id").isNull(), F.col("penalty")).otherwise(0.0)
        every = every.join(info.select("toy", "penalty"), "toy").select(
            "toy", "sample_id", (F.col("data_llh") + extra).alias("data_llh"), (F.col("fluct_llh") + extra).alias("fluct_llh"))
    every = stored(every, "deviances")  # read twice: for the limits and for the counts
    limits = every.groupBy(F.col("sample_id").alias("_s")).agg(
        F.min(F.least("data_llh", "fluct_llh")).alias("_lo"), F.max(F.greatest("data_llh", "fluct_llh")).alias("_hi"))
    # Samples + 1 rows.
    joined = every.join(F.broadcast(limits), F.col("sample_id").eqNullSafe(F.col("_s")))
    x = uniform_bin(F.col("fluct_llh"), F.col("_lo"), F.col("_hi"), nbins)
    y = uniform_bin(F.col("data_llh"), F.col("_lo"), F.col("_hi"), nbins)
    inside = (x < nbins) & (y < nbins)
    return joined.groupBy("sample_id").agg(
        F.avg(F.when(F.col("fluct_llh") >= F.col("data_llh"), 1.0).otherwise(0.0)).alias("p_exact"),
        F.try_divide(F.sum(F.when(inside & (x >= y), 1.0).otherwise(0.0)), F.sum(F.when(inside, 1.0))).alias("p_binned"),
        F.count(F.lit(1)).alias("n_toys"))


def fluctuated_deviances(toys: DataFrame, data: DataFrame, predicted: DataFrame, stat: str = "poisson",
                         seed: int = 1, standard: bool = True, info: DataFrame | None = None) -> DataFrame:
    """-2lnL per toy and sample of data, a fluctuated toy, and a fluctuated prediction.

    All bins of the data, the toys and the prediction count, with 0 where one of them has none, and
    all toys of ``info`` (toy), those without any event included.
    """
    fluctuate = poisson_fluctuate if standard else multinomial_fluctuate
    data = stored(in_every_bin(data, toys, predicted), "data")
    drawn = fluctuate(every_toy_bin(toys, data, info), "mc", "fluct_draw", seed)
    keys = ["sample_id", "bin"]
    with_pred = drawn.join(broadcast_if_small(predicted.select(*keys, "mc_mean")), keys, "left").fillna(0.0, ["mc_mean"])
    both = fluctuate(with_pred, "mc_mean", "fluct_pred", seed + 1)
    joined = both.join(broadcast_if_small(data), keys)

    def against(column: str):
        return 2 * F.sum(stats.bin_llh(stat, F.col(column), F.col("mc"), F.col("w2")))

    return joined.groupBy("toy", "sample_id").agg(
        against("data").alias("data_llh"), against("fluct_draw").alias("draw_llh"),
        against("fluct_pred").alias("pred_llh"))


def every_toy_bin(toys: DataFrame, bins: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """Toys, or those of ``info``, with a row for every bin (sample_id, bin), 0 where there were no events.

    A row per toy and bin by nature, for draws in every bin; made in parallel from the
    toys' numbers and one list of bins.
    """
    places = bins.select("sample_id", "bin").distinct().agg(F.collect_list(F.struct("sample_id", "bin")).alias("_b"))
    listed = (toys if info is None else info).select("toy").distinct().withColumn("_1", F.lit(1)).join(
        F.broadcast(places.withColumn("_1", F.lit(1))), "_1")  # one row: the bins of a model
    frame = listed.select("toy", F.inline("_b"))
    return frame.join(toys.select("toy", "sample_id", "bin", "mc", "w2"), ["toy", "sample_id", "bin"], "left").fillna(
        0.0, ["mc", "w2"])


def llh_tail_pvalue(values: DataFrame, column: str, reference: float, keys: Sequence[str] = ()) -> DataFrame:
    """Share of values at or above a reference."""
    return values.groupBy(*keys).agg(
        F.avg(F.when(F.col(column) >= F.lit(float(reference)), 1.0).otherwise(0.0)).alias("p_value"))


def hist_tail_pvalue(hist: DataFrame, reference: float, keys: Sequence[str] = ("param",)) -> DataFrame:
    """Share of a histogram in bins whose centre is at or above a reference."""
    centre = (F.col("lo") + F.col("hi")) / 2
    above = F.sum(F.when(centre >= F.lit(float(reference)), F.col("content")).otherwise(0.0))
    return hist.groupBy(*keys).agg(F.try_divide(above, F.sum("content")).alias("p_value"))


def combine_pvalues(pvalues: DataFrame, keys: Sequence[str] = (), column: str = "p_value") -> DataFrame:
    """Fisher's combination; the chi2 tail with 2n degrees of freedom is a finite sum.

    exp(-t/2) * sum_{i<n} (t/2)^i / i!, added up by logarithms: neither factor underflows.
    """
    p = F.greatest(F.col(column), F.lit(1e-5))
    sums = pvalues.groupBy(*keys).agg((-2 * F.sum(F.log(p))).alias("statistic"), F.count(F.lit(1)).alias("n"))
    half = F.col("statistic") / 2
    # The logarithm of a term and of the sum so far; a term is the one before times (t/2)/i.
    larger = lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    tail = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n").cast("int") - 1)),
        F.struct((-half).alias("total"), (-half).alias("term")),
        lambda acc, i: F.struct(larger(acc["total"], acc["term"] + F.log(half / i)).alias("total"),
                                (acc["term"] + F.log(half / i)).alias("term")),
        lambda acc: F.exp(acc["total"]))
    return sums.withColumn("combined", F.when(half == 0, 1.0).when(F.col("n") == 1, F.exp(-half)).otherwise(
        F.least(F.lit(1.0), tail)))


def bonferroni(pvalues: DataFrame, threshold: float = 0.05, keys: Sequence[str] = (), column: str = "p_value") -> DataFrame:
    """Flag p-values that disagree at the threshold divided by the number of tests."""
    # A window partition holds the tests of one family, one per sample.
    tests = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    table = pvalues.withColumn("level", F.lit(float(threshold)) / tests)
    p = F.col(column)
    return table.withColumn("flag", F.when((p < 0.5) & (p < F.col("level")), "low").when(
        (p > 0.5) & (p > 1 - F.col("level")), "high"))


def predictive_llh_table(inputs: dict[str, DataFrame], stat: str = "poisson") -> DataFrame:
    """Data, prediction and -2lnL per sample, one group of columns per input set."""
    parts = [
        binned_llh(df, stat).groupBy("sample_id").agg(
            F.sum("data").alias("data"), F.sum("mc").alias("mc"), (2 * F.sum("llh")).alias("llh")
        ).withColumn("input", F.lit(name)) for name, df in inputs.items()]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.groupBy("sample_id").pivot("input", list(inputs)).agg(
        F.first("data").alias("data"), F.first("mc").alias("mc"), F.first("llh").alias("llh"))
