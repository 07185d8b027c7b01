"""Predictive analysis: toys from a chain, their summaries and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.operators import events as event_ops
from chainlens.operators import predict, splines as spline_ops, toys
from chainlens.session import stored


def toys_from_chain(chain: DataFrame, binned: DataFrame, norms: Sequence[dict], codes: dict[str, str], n: int,
                    params: Sequence[str], weight: str | None = None, seed: int = 1, cut: int | None = None):
    """Spectra for n random chain rows with normalisation parameters; returns (toys, info).

    Events are read once into stored signatures; each toy costs signatures, not events.
    """
    matched = event_ops.match_norms(binned, norms, None, codes)
    summed = stored(predict.signatures(matched), "signatures")
    return predict.produce_toys(chain, summed, n, params, lambda pts: predict.norm_factors(pts, norms),
                                weight=weight, seed=seed, cut=cut)


def toys_from_prior(binned: DataFrame, params: Sequence[dict], cov, norms: Sequence[dict], codes: dict[str, str], n: int,
                    splines: DataFrame | None = None, spline_axes: Sequence[tuple[str, Sequence[float]]] = (), seed: int = 1):
    """Spectra at n draws from the prior; returns (toys, info).

    ``splines`` (built, with ``param`` and the keys of ``match_splines``) respond to the parameter they name.
    Events are read once into stored signatures, whatever the number of toys.
    """
    matched = event_ops.match_norms(binned, norms, None, codes)
    if splines is not None:
        matched = spline_ops.match_splines(matched, splines, spline_axes)
    summed = stored(predict.signatures(matched, spline_ids=None if splines is None else "spline_ids"), "signatures")

    def factors_at(points: DataFrame) -> DataFrame:
        found = predict.norm_factors(points, norms)
        if splines is None:
            return found
        return found.unionByName(predict.spline_factors(spline_ops.evaluate_splines(splines, points)))

    return predict.prior_toys(summed, params, cov, n, factors_at, seed)


def predictive_summary(toy_spectra: DataFrame, info: DataFrame, data: DataFrame, n_params: int,
                       stat: str = "poisson", seed: int = 1) -> dict[str, DataFrame]:
    """All results that follow from stored toys, as lazy tables by name.

    Pass toys read back with ``load_toys`` so that they are not predicted again
    for every table.
    """
    weighted = toys.with_weights(toy_spectra, info)
    predicted = toys.predictive_mean(weighted, info=info)
    chi2 = toys.fluctuated_deviances(toy_spectra, data, predicted, stat, seed, info=info)
    return {
        "violin": toys.toy_violin(toy_spectra, info=info),
        "mean": predicted,
        "rates": toys.rate_significance(toys.event_rates(weighted, data, "weight", info)),
        "rate_correlation": toys.rate_correlation(toy_spectra),
        "beta": toys.beta_study(weighted, data),
        "criteria": toys.information_criteria(toy_spectra, data, predicted, n_params, stat, info),
        "pvalue_draw": toys.predictive_pvalue(
            chi2.select("toy", "sample_id", "data_llh", F.col("draw_llh").alias("fluct_llh")), info),
        "pvalue_prediction": toys.predictive_pvalue(
            chi2.select("toy", "sample_id", "data_llh", F.col("pred_llh").alias("fluct_llh")), info),
    }
