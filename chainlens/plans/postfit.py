"""Post-fit of a chain: one histogram pass, then everything read off it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from chainlens.operators import chain as chain_ops
from chainlens.operators import hist, intervals, moments
from chainlens.session import stored


def credible_intervals(chain: DataFrame, columns: Sequence[str], cut: int | None = None, nbins: int = 70,
                       levels: Sequence[float] = (0.99, 0.90, 0.68), weight: str | None = None) -> DataFrame:
    """Burn-in, histogram, interval."""
    kept = chain_ops.burn_in(chain, cut)
    return intervals.credible_interval(hist.posterior_hist(kept, columns, nbins, weight=weight), levels)


def postfit_table(chain: DataFrame, columns: Sequence[str], params: DataFrame | None = None, cut: int | None = None,
                  nbins: int = 70, weight: str | None = None) -> DataFrame:
    """Prior, arithmetic, Gaussian and highest-density values of each parameter."""
    kept = chain_ops.burn_in(chain, cut)
    histogram = stored(hist.posterior_hist(kept, columns, nbins, weight=weight), "posteriors")
    table = hist.postfit_summary(kept, columns, weight, params)
    return table.join(hist.postfit_gauss(histogram), "param", "left").join(
        intervals.hpd(histogram), "param", "left")


def matrices(chain: DataFrame, columns: Sequence[str], cut: int | None = None, weight: str | None = None,
             fixed: Sequence[str] = ()) -> DataFrame:
    return moments.covariance(chain_ops.burn_in(chain, cut), columns, weight, fixed=fixed)
