"""Model comparison from posterior histograms, prior pulls, Jarlskog posterior."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.functions.expr import dunne_kaboth_label, gauss, jeffreys_label, normal, row_keys, uniform
from chainlens.operators.chain import jarlskog
from chainlens.operators.hist import posterior_hist, posterior_hist_2d
from chainlens.operators.intervals import credible_interval

PI = 3.141592653589793


def bayes_factor(hist: DataFrame, cases: DataFrame) -> DataFrame:
    """Larger over smaller posterior integral of two ranges, with labels.

    ``cases``: (param, name1, name2, lo1, hi1, lo2, hi2).  A range takes all
    bins from the one that holds its lower to the one that holds its upper end.
    """
    joined = hist.join(F.broadcast(cases), "param")  # configuration rows

    def integral(lo: str, hi: str):
        return F.sum(F.when((F.col("hi") > F.col(lo)) & (F.col("lo") <= F.col(hi)), F.col("content")).otherwise(0.0))

    sums = joined.groupBy("param", "name1", "name2").agg(
        integral("lo1", "hi1").alias("i1"), integral("lo2", "hi2").alias("i2"))
    first = F.col("i1") >= F.col("i2")
    return sums.withColumn("favoured", F.when(first, F.col("name1")).otherwise(F.col("name2"))).withColumn(
        "bayes_factor", F.try_divide(F.greatest("i1", "i2"), F.least("i1", "i2"))).withColumn(
        "jeffreys", jeffreys_label(F.col("bayes_factor"))).withColumn(
        "dunne_kaboth", dunne_kaboth_label(F.col("bayes_factor")))


def savage_dickey(hist: DataFrame, cases: DataFrame, params: DataFrame) -> DataFrame:
    """Posterior over prior density at a point; null where the prior vanishes.

    ``cases``: (param, point, lo, hi); the bounds hold for flat priors.
    """
    whole = Window.partitionBy("param")
    density = hist.withColumn("posterior", F.try_divide(
        F.try_divide("content", F.sum("content").over(whole)), F.col("hi") - F.col("lo")))
    c = cases.select("param", "point", F.col("lo").alias("case_lo"), F.col("hi").alias("case_hi"))
    model = params.select(F.col("branch").alias("param"), "prior", "error", "flat")
    at = density.join(F.broadcast(c), "param").filter(
        (F.col("lo") <= F.col("point")) & (F.col("point") < F.col("hi"))).join(F.broadcast(model), "param")
    inside = (F.col("point") >= F.col("case_lo")) & (F.col("point") < F.col("case_hi"))
    flat = F.when(inside, F.try_divide(F.lit(1.0), F.col("case_hi") - F.col("case_lo"))).otherwise(0.0)
    normal = gauss(F.col("point"), F.col("prior"), F.col("error"))
    prior = F.when(F.col("flat"), flat).otherwise(normal)
    return at.select("param", "point", "posterior", prior.alias("prior_density")).withColumn(
        "savage_dickey", F.when(F.col("prior_density") > 0, F.try_divide("posterior", "prior_density"))
    ).withColumn("dunne_kaboth", dunne_kaboth_label(F.col("savage_dickey")))


def prior_pull(postfit: DataFrame, params: DataFrame) -> DataFrame:
    """(post - prior) / sigma_prior; the plain difference for a vanishing prior error."""
    model = params.select(F.col("branch").alias("param"), F.col("prior").alias("p"), F.col("error").alias("e"))
    joined = postfit.select("param", "mean", "rms").join(F.broadcast(model), "param")
    scale = F.when(F.col("e") > 1e-5, F.col("e")).otherwise(1.0)
    return joined.select("param", ((F.col("mean") - F.col("p")) / scale).alias("pull"),
                         (F.col("rms") / scale).alias("pull_error"))


def relative_to_prior(params: DataFrame, hide_flat: bool = False) -> DataFrame:
    """Errors relative to the prior, around 1; the plain error where the prior is 0."""
    error = F.when(F.col("prior") == 0, F.col("error")).otherwise(F.try_divide("error", "prior"))
    if hide_flat:
        error = F.when(F.col("flat"), 0.0).otherwise(error)
    return params.select("name", F.lit(1.0).alias("central"), error.alias("error"))


def jarlskog_posterior(chain: DataFrame, columns: dict[str, str], weight: str | None = None, nbins: int = 1000,
                       limit: float = 0.05) -> DataFrame:
    """Histograms of J for both mass orderings and together, for both phase priors.

    ``columns`` names sin2_12, sin2_23, sin2_13, delta and dm2.  The second
    prior is flat in sin(delta), a weight abs(cos(delta)).
    """
    labelled = with_orderings(with_jarlskog(chain, columns, weight), columns)
    return posterior_hist(labelled, ["J"], nbins, {"J": (-limit, limit)}, weight="_jw",
                          keys=("ordering", "phase_prior"))


def jarlskog_posterior_2d(chain: DataFrame, columns: dict[str, str], weight: str | None = None, nbins: int = 500,
                          limit: float = 0.05, theta_range: tuple[float, float] = (0.3, 0.7)) -> DataFrame:
    """J against theta_23 and J against the phase, with the same keys."""
    labelled = with_orderings(with_jarlskog(chain, columns, weight), columns).withColumn(
        "theta23", F.col(columns["sin2_23"])).withColumn("delta", F.col(columns["delta"]))
    ranges = {"J": (-limit, limit), "theta23": theta_range, "delta": (-PI, PI)}
    return posterior_hist_2d(labelled, [("J", "theta23"), ("J", "delta")], nbins, ranges, weight="_jw",
                             keys=("ordering", "phase_prior"))


def jarlskog_outside(chain: DataFrame, columns: dict[str, str], weight: str | None = None, limit: float = 0.05) -> DataFrame:
    """Weights of J below and above the histograms' axis, per ordering and phase prior."""
    labelled = with_orderings(with_jarlskog(chain, columns, weight), columns)
    at = lambda test: F.sum(F.when(test, F.col("_jw")).otherwise(0.0))
    return labelled.groupBy("ordering", "phase_prior").agg(
        at(F.col("J") < -limit).alias("below"), at(F.col("J") >= limit).alias("above"))


def with_jarlskog(chain: DataFrame, columns: dict[str, str], weight: str | None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    value = jarlskog(*[F.col(columns[c]) for c in ("sin2_12", "sin2_23", "sin2_13", "delta")])
    return chain.withColumn("J", value).withColumn("_jw0", w)


def with_orderings(chain: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Each row once for its own ordering and once for both, under both phase priors."""
    ordering = F.when(F.col(columns["dm2"]) > 0, "normal").when(F.col(columns["dm2"]) < 0, "inverted")
    tags = F.array(*[
        F.struct(o.alias("ordering"), F.lit(p).alias("phase_prior"), w.alias("_jw"))
        for o in (F.lit("both"), ordering)
        for p, w in (("flat", F.col("_jw0")),
                     ("flat_sin", F.col("_jw0") * F.abs(F.cos(F.col(columns["delta"])))))])
    return chain.select("*", F.inline(tags)).filter("ordering is not null")


def jarlskog_intervals(hist: DataFrame, levels: Sequence[float] = (0.99, 0.90, 0.68)) -> DataFrame:
    return credible_interval(hist, levels, keys=("ordering", "phase_prior"))


def jarlskog_prior(chain: DataFrame, priors: dict[str, tuple[float, float] | None], seed: int = 1,
                   nbins: int = 1000, limit: float = 0.05) -> DataFrame:
    """Histogram of J for one prior draw per chain entry, for both phase priors.

    ``priors`` gives (mean, sigma) of a Gaussian for sin2_12, sin2_23 and
    sin2_13, or None for a flat one on 0..1; phases are flat.
    """
    row, draws = row_keys(chain), {}
    for i, name in enumerate(("sin2_12", "sin2_23", "sin2_13")):
        given = priors.get(name)
        draws[name] = uniform(seed + i, *row) if given is None else F.lit(given[0]) + normal(seed + i, *row) * given[1]
    phase = uniform(seed + 103, *row) * (2 * PI) - PI
    thrown = chain.select(*[v.alias(k) for k, v in draws.items()], phase.alias("delta"),
                          (uniform(seed + 104, *row) * 2 - 1).alias("sine"))
    size = jarlskog(F.col("sin2_12"), F.col("sin2_23"), F.col("sin2_13"), F.lit(PI / 2))
    both = thrown.select(size.alias("size"), "delta", "sine").select(F.inline(F.array(
        F.struct(F.lit("flat").alias("phase_prior"), (F.col("size") * F.sin("delta")).alias("J")),
        F.struct(F.lit("flat_sin").alias("phase_prior"), (F.col("size") * F.col("sine")).alias("J")))))
    return posterior_hist(both, ["J"], nbins, {"J": (-limit, limit)}, keys=("phase_prior",))
