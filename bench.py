"""Time headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores.
Each query is run once to warm up the session's code paths and once timed; a
result is fully computed and dropped (no rows are brought to the driver).
"""

from __future__ import annotations

import json
import os
import time

import chainlens.catalog  # noqa: F401  (registers the queries)
from chainlens.catalog.registry import RAW
from chainlens.session import local_session

HEADLINE = [
    "posterior_hist", "posterior_hist_2d", "credible_interval", "hpd", "postfit_summary",
    "covariance", "covariance_by_blocks", "covariance_stability", "running_covariance",
    "thin_with_gaps", "batched_means", "autocorrelation", "effective_sample_size", "geweke",
    "power_spectrum", "rhat", "rhat_folded", "ks_distance", "bayes_factor", "penalty_term",
    "jarlskog_posterior", "reweight_gaussian", "reweight_graph_2d",
    "fill_spectra", "assign_bin_uniform", "assign_bin_boxes", "match_norms", "rate_table",
    "sample_rates", "predict_spectra", "llh_scan", "llh_map", "sigma_variations", "shift_events",
    "predictive_mean", "toy_violin", "event_rates", "rate_correlation_bins",
    "information_criteria", "predictive_pvalue",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            RAW[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(os.path.normpath(folder)), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
