"""Diagnostics of chains, as lazy tables by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.operators import convergence as ops
from chainlens.operators.chain import with_entry_index
from chainlens.session import stored


def prepare(chain: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Chain numbered 0..n-1 per chain_id, written once so that each diagnostic rereads it."""
    indexed = with_entry_index(chain.select("chain_id", "step", *columns))
    return stored(indexed.withColumn("step", F.col("entry")).drop("entry"), "chain")


def diagnose(chain: DataFrame, columns: Sequence[str], nlags: int = 25000, batches: int = 20) -> dict[str, DataFrame]:
    """Traces, batches, autocorrelation, spectrum and Geweke scores of each chain."""
    chain = prepare(chain, columns)
    means = ops.batched_means(chain, columns, batches, contiguous=True)
    acf = ops.autocorrelation(chain, columns, nlags)
    spectrum = ops.power_spectrum(chain, columns)
    return {
        "trace": ops.trace(chain, columns),
        "trace_level": ops.trace_level(chain, columns, contiguous=True),
        "batched_means": means,
        "batch_variance": ops.batch_variance_test(means, batches),
        "autocorrelation": acf,
        "average_autocorrelation": ops.average_autocorrelation(acf),
        "effective_sample_size": ops.effective_sample_size(acf, chain),
        "power_spectrum": spectrum,
        "power_spectrum_fit": ops.power_spectrum_fit(spectrum),
        "geweke": ops.geweke(chain, columns),
    }


def between_chains(chain: DataFrame, columns: Sequence[str], folded: bool = False) -> DataFrame:
    """R-hat after burn-in over chains told apart by chain_id."""
    kept = ops.after_burn_in(chain)
    return ops.rhat_folded(kept, columns) if folded else ops.rhat(kept, columns)
