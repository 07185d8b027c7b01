import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlens.operators import convergence as ops
from chainlens.operators import moments
from chainlens.plans import diagnostics


def acf(x, nlags):
    d = x - x.mean()
    return np.array([(d[:len(d) - k] * d[k:]).sum() for k in range(nlags)]) / (d * d).sum()


@pytest.mark.parametrize("nlags,block", [(20, 500), (200, 1000), (700, 100)])
def test_autocorrelation_over_block_borders(ar1, nlags, block):
    chain, x, y = ar1
    rows = ops.autocorrelation(chain, ["x", "y"], nlags, block=block, width=1).collect()
    for name, values in (("x", x), ("y", y)):
        got = np.array([r["r"] for r in sorted((r for r in rows if r["param"] == name), key=lambda r: r["lag"])])
        assert np.allclose(got, acf(values, nlags), atol=1e-10)
    assert abs(acf(x, 2)[1] - 0.8) < 0.03


def test_effective_size_counts_lag_zero_unless_told(ar1):
    chain, x, _ = ar1
    table = ops.autocorrelation(chain, ["x"], 50)
    r = acf(x, 50)
    assert ops.effective_sample_size(table, chain).first()["ess"] == pytest.approx(len(x) / (1 + 2 * r.sum()))
    assert ops.effective_sample_size(table, chain, 1).first()["ess"] == pytest.approx(len(x) / (1 + 2 * r[1:].sum()))


def test_power_spectrum_is_the_transform(ar1):
    chain, x, y = ar1
    rows = ops.power_spectrum(chain, ["x", "y"], max_coefficients=1000, block=700).collect()
    n = 6000
    want = np.abs(np.fft.fft(x[:n])) ** 2 / n
    got = {r["j"]: r["power"] for r in rows if r["param"] == "x"}
    assert sorted(got) == list(range(-499, 499))
    assert all(got[j] == pytest.approx(want[j % n], rel=1e-6, abs=1e-9) for j in got)


def test_power_spectrum_fit(spark):
    k = np.linspace(-0.9, 0.9, 401)
    k = k[k != 0]
    p = 7.0 * (0.2 / np.abs(k)) ** 1.5 / ((0.2 / np.abs(k)) ** 1.5 + 1)
    df = spark.createDataFrame([(0, "x", i, float(a), float(b)) for i, (a, b) in enumerate(zip(k, p))],
                               "chain_id int, param string, j int, k double, power double")
    row = ops.power_spectrum_fit(df).first()
    assert (row["p0"], row["k_star"], row["alpha"]) == pytest.approx((7.0, 0.2, 1.5), rel=1e-3)


def test_geweke_matches_plain_sums(ar1):
    chain, x, _ = ar1
    got = {r["k"]: r["t_score"] for r in ops.geweke(chain, ["x"]).collect()}
    steps = np.arange(len(x))
    end = len(x) - 1
    up = x[steps > 0.5 * end]
    for k in (1, 2, 7, 29, 50, 99, 100):
        low = x[steps < int(0.01 * k * end)]
        assert got[k] == pytest.approx(abs(low.mean() - up.mean()) / np.sqrt(low.var() + up.var()))


@pytest.mark.parametrize("end", [7, 99, 101, 250, 1234])
def test_geweke_thresholds_on_short_chains(spark, end):
    chain = spark.range(end + 1).select(F.lit(0).alias("chain_id"), F.col("id").alias("step"), (F.col("id") * F.col("id") % 17).cast("double").alias("x"))
    x, steps = np.array([i * i % 17 for i in range(end + 1)], float), np.arange(end + 1)
    up = x[steps > 0.5 * end]
    for r in ops.geweke(chain, ["x"]).collect():
        low = x[steps < int(0.01 * r["k"] * end)]
        spread = low.var() + up.var() if len(low) else 0
        if spread > 1e-12:
            assert r["t_score"] == pytest.approx(abs(low.mean() - up.mean()) / np.sqrt(spread))
        else:
            assert r["t_score"] is None


def test_batches(ar1):
    chain, x, _ = ar1
    nb, length = 20, len(x) // 20 + 1
    want = np.array([x[b * length:(b + 1) * length].sum() / length for b in range(nb)])
    means = ops.batched_means(chain, ["x"], nb, contiguous=True)
    got = [r["mean"] for r in means.orderBy("batch").collect()]
    assert got == pytest.approx(list(want))
    row = ops.batch_variance_test(means, nb).first()
    d = want.mean() - want
    assert row["batch_variance"] == pytest.approx(length / (nb - 1) * (d * d).sum())
    c = np.sqrt((nb * nb - 1) / (nb - 2)) * ((d[:-1] * d[1:]).sum() / (d * d).sum() + (d[0] ** 2 + d[-1] ** 2) / (2 * (d * d).sum()))
    assert row["c_statistic"] == pytest.approx(c)


def test_identical_chains_have_rhat_near_one(spark, ar1):
    chain, x, _ = ar1
    twice = chain.withColumn("chain_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    row = ops.rhat(twice, ["x", "y", "accProb"]).filter("param = 'x'").first()
    n = len(x)
    assert row["between"] == pytest.approx(0, abs=1e-12) and row["rhat"] == pytest.approx(np.sqrt((n - 1) / n))
    moved = twice.withColumn("x", F.col("x") + 10 * F.col("chain_id"))
    assert ops.rhat(moved, ["x"]).first()["not_converged"]
    folded = ops.rhat_folded(twice, ["x"]).first()
    assert folded["median"] == pytest.approx(np.median(x)) and folded["rhat_folded"] < 1.001


@pytest.mark.parametrize("bins,leaf", [(8, 3), (64, 50), (4096, 100000)])
def test_exact_medians(spark, bins, leaf):
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.normal(0, 1, 1000), [1e9, -1e9]])
    b = np.repeat([1.0, 2.0, 2.0], 334)
    c = np.concatenate([np.full(501, -3.0), np.full(501, 4.0)])
    rows = [(float(u), float(v), float(w)) for u, v, w in zip(a, b, c)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(6)
    got = ops.exact_medians(df, ["a", "b", "c"], bins, leaf)
    assert got == pytest.approx({"a": np.median(a), "b": np.median(b), "c": np.median(c)})


def test_runs_over_block_borders(spark):
    labels = np.random.default_rng(2).integers(0, 3, 500)
    df = spark.createDataFrame([(0, i, int(v)) for i, v in enumerate(labels)], "chain_id int, step long, l int").repartition(5)
    want = 1 + int((labels[1:] != labels[:-1]).sum())
    assert ops.count_runs(df, "l", block=7).first()["runs"] == want


def test_covariance_paths_agree(spark, ar1):
    chain, x, y = ar1
    weighted = chain.withColumn("w", F.lit(1.0) + F.col("step") % 5).withColumn("z", F.lit(2.0))
    a = {(r["param_i"], r["param_j"]): r for r in moments.covariance(weighted, ["x", "y", "z"], "w", method="sql").collect()}
    b = {(r["param_i"], r["param_j"]): r for r in moments.covariance(weighted, ["x", "y", "z"], "w", method="blocks").collect()}
    w = 1.0 + np.arange(len(x)) % 5
    want = np.cov(x, y, aweights=w, bias=True)
    for t in (a, b):
        assert t[("x", "y")]["cov"] == pytest.approx(want[0, 1]) and t[("y", "y")]["cov"] == pytest.approx(want[1, 1])
        assert t[("x", "x")]["corr"] == pytest.approx(1) and t[("z", "x")]["corr"] == 0
    fixed = moments.covariance(weighted, ["x", "y"], fixed=["y"]).filter("param_i = 'y' or param_j = 'y'")
    assert fixed.filter("cov <> 0 or corr <> 0").count() == 0


def test_covariance_keeps_digits_far_from_zero(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e8, 1.0, 2000)
    df = spark.createDataFrame([(float(v), float(v * 2)) for v in x], "x double, y double")
    for method in ("sql", "blocks"):
        rows = {(r["param_i"], r["param_j"]): r["cov"] for r in moments.covariance(df, ["x", "y"], method=method).collect()}
        assert rows[("x", "x")] == pytest.approx(x.var(), rel=1e-6)


def test_running_covariance(ar1):
    chain, x, y = ar1
    rows = {r["step"]: r for r in moments.running_covariance(chain, [("x", "y")], block=333).collect()}
    for n in (1, 2, 332, 333, 334, 5000, 6001):
        want = np.cov(x[:n], y[:n])[0, 1] if n > 1 else 0.0
        assert rows[n - 1]["cov"] == pytest.approx(want, abs=1e-12) and rows[n - 1]["mean_i"] == pytest.approx(x[:n].mean())


def test_suboptimality_and_stability(ar1):
    chain, x, y = ar1
    table = {r["interval"]: r["suboptimality"] for r in moments.suboptimality(chain, ["x", "y"], 4, 6000).collect()}
    for k in range(4):
        values = np.linalg.eigvalsh(np.cov(x[1:1500 * (k + 1) + 1], y[1:1500 * (k + 1) + 1], bias=True))
        assert table[k] == pytest.approx(2 * (values ** -2).sum() / (1 / values).sum() ** 2)
    rows = moments.covariance_stability(chain, ["x", "y"], 4, 6000).filter("param_i = 'x' and param_j = 'x'").collect()
    got = {r["interval"]: r["cov_ratio"] for r in rows}
    assert got[2] == pytest.approx(x[3001:].var() / x[1501:].var())


def test_all_diagnostics_run(ar1):
    chain, x, _ = ar1
    tables = diagnostics.diagnose(chain.filter("step % 2 = 0"), ["x", "y"], nlags=120)
    assert all(t.limit(1).count() == 1 for t in tables.values())
    assert diagnostics.between_chains(chain, ["x"]).count() == 1


def test_registered_queries_with_all_lags(spark, tmp_path):
    """Each of the default's 25,000 lags, against sums over a chain that has a few more steps."""
    from chainlens.catalog import QUERIES
    n, lags = 25_400, 25_000
    events = spark.range(n).select(
        F.col("id").alias("event_id"), F.lit(0).cast("long").alias("user_id"), F.lit("a").alias("event_type"),
        (F.lit(50.0) + 40 * F.sin(F.col("id") / 700) + F.col("id") % 13).alias("value"),
        F.concat(F.lit("k"), (F.col("id") * 7919 % 101).cast("string")).alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    rows = events.orderBy("event_id").toPandas()
    x = {"val": rows["value"].to_numpy(), "root": np.sqrt(rows["value"].to_numpy()),
         "k": rows["props"].str[1:].astype(float).to_numpy()}
    want = {p: acf(v, lags) for p, v in x.items()}
    got = QUERIES["autocorrelation_all_lags"](spark, str(tmp_path)).toPandas()
    for p in x:
        r = got[got["param"] == p].sort_values("lag")
        assert r["lag"].tolist() == list(range(lags)) and np.allclose(r["r"], want[p], atol=1e-9)
    for r in QUERIES["effective_sample_size_all_lags"](spark, str(tmp_path)).collect():
        assert r["ess"] == pytest.approx(n / (1 + 2 * want[r["param"]].sum()), rel=1e-6)
    mean = QUERIES["average_autocorrelation_all_lags"](spark, str(tmp_path)).toPandas().sort_values("lag")
    assert np.allclose(mean["mean_r"], np.mean(list(want.values()), axis=0), atol=1e-9) and len(mean) == lags
