"""Rules that hold whatever the data and the layout: empty bins, missing values, hot keys, repeatable draws."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlens.functions.expr import axis_edges
from chainlens.functions.numeric import log_gamma
from chainlens.operators import binning, chain as chain_ops, convergence, events, hist, moments, predict, toys
from chainlens.sources import chains, events as event_files

TOY = "toy long, sample_id int, bin int, mc double, w2 double"


@pytest.fixture(scope="module")
def gappy(spark):
    """Two toys that each leave one bin empty."""
    return spark.createDataFrame([(0, 0, 0, 10.0, 10.0), (1, 0, 1, 4.0, 4.0)], TOY)


def test_means_count_every_toy(gappy):
    rows = {r.bin: (r.mc_mean, r.mc_rms) for r in toys.predictive_mean(gappy.withColumn("weight", F.lit(1.0))).collect()}
    assert rows == {0: (5.0, 5.0), 1: (2.0, 2.0)}


def test_violins_and_rates_count_every_toy(spark, gappy):
    violin = toys.toy_violin(gappy, nbins=10).collect()
    assert {r.bin: sum(x.n_toys for x in violin if x.bin == r.bin) for r in violin} == {0: 2, 1: 2}
    more = gappy.union(spark.createDataFrame([(0, 1, 0, 6.0, 6.0)], TOY))  # toy 1 has nothing in sample 1
    rates = {r.sample_id: (r.mean, r.sigma) for r in toys.event_rates(more).collect()}
    assert rates == {0: (7.0, 3.0), 1: (3.0, 3.0), None: (10.0, 6.0)}
    weighed = toys.event_rates(more.withColumn("w", 1 + 2 * F.col("toy")), weight="w").where("sample_id = 1").first()
    assert (weighed["mean"], weighed["sigma"]) == pytest.approx((1.5, math.sqrt((4.5 ** 2 + 3 * 1.5 ** 2) / 4)))


def test_likelihood_of_bins_without_prediction(spark):
    spectra = spark.createDataFrame([(0, 0, 0, 5.0, 5.0)], "point long, sample_id int, bin int, mc double, w2 double")
    data = spark.createDataFrame([(0, 0, 5.0), (0, 1, 100.0), (1, 0, 3.0)], "sample_id int, bin int, data double")
    low = lambda d: 1e-5 - d + d * math.log(d / 1e-5)
    got = {r.sample_id: r.llh for r in toys.llh_scan(spectra, data).collect()}
    assert got == pytest.approx({0: 2 * low(100), 1: 2 * low(3), None: 2 * (low(100) + low(3))})
    sets = spark.createDataFrame([(0, "flux", 1.5)], "point long, set string, llh double")
    rows = toys.llh_scan(spectra, data, systematics=sets).collect()
    assert {(r.sample_id, r.set): r.llh for r in rows}[(None, "flux")] == 3.0
    assert max(r.llh for r in rows) == pytest.approx(3.0 + got[None])


def test_data_outside_the_prediction_stays(spark):
    mc = spark.createDataFrame([(0, 0, 5.0, 5.0)], "sample_id int, bin int, mc double, w2 double")
    data = spark.createDataFrame([(0, 1, 7.0)], "sample_id int, bin int, data double")
    rows = event_files.load_data_spectrum(mc, data).orderBy("bin").collect()
    assert [(r.bin, r.mc, r.w2, r.data) for r in rows] == [(0, 5.0, 5.0, 0.0), (1, 0.0, 0.0, 7.0)]
    with pytest.raises(ValueError):
        event_files.load_data_spectrum(mc.selectExpr("*", "0.0 lo", "1.0 hi"), data)


def test_waic_does_not_underflow(spark):
    rows = [(t, 0, 0, 2000.0 + 40 * t, 2000.0) for t in range(5)]
    data = spark.createDataFrame([(0, 0, 500.0)], "sample_id int, bin int, data double")
    table = spark.createDataFrame(rows, TOY)
    mean = toys.predictive_mean(table.withColumn("weight", F.lit(1.0)))
    got = toys.information_criteria(table, data, mean, 1).first()
    ll = np.array([-(r[3] - 500 + 500 * math.log(500 / r[3])) for r in rows])
    lppd = ll.max() + math.log(np.exp(ll - ll.max()).mean())
    assert got["waic"] == pytest.approx(-2 * (lppd - ll.var())) and got["d_bar"] == pytest.approx(-2 * ll.mean())


def test_many_ordinary_pvalues_combine_to_one(spark):
    p = spark.range(1000).select(((F.col("id") + 0.5) / 1000).alias("p_value"))
    assert 0.4 < toys.combine_pvalues(p).first()["combined"] < 0.6
    small = spark.createDataFrame([(x,) for x in (0.2, 0.03, 0.7)], "p_value double")
    half = -sum(map(math.log, (0.2, 0.03, 0.7)))
    assert toys.combine_pvalues(small).first()["combined"] == pytest.approx(math.exp(-half) * (1 + half + half ** 2 / 2))


def test_log_gamma():
    x = np.array([1e-9, 0.3, 1.0, 2.0, 7.5, 9.999, 10.0, 123.4, 1e7])
    assert log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-13, abs=1e-14)
    assert log_gamma(np.array([0.0, -1.0])).tolist() == [math.inf, math.inf]


def lists(spark):
    return spark.createDataFrame([(["n1", "n2"],), ([],)], "factors array<string>")


def factor_rows(spark, rows):
    return spark.createDataFrame(rows, "point long, factor string, f double")


def test_weights_stand_at_their_points(spark):
    rows = [(p, f, v) for f, vs in (("n1", (2.0, 3.0, 5.0)), ("n2", (10.0, 20.0, 30.0))) for p, v in enumerate(vs)]
    got = {tuple(r.factors): r.weights for r in predict.list_weights(lists(spark), factor_rows(spark, rows[::-1]), 3).collect()}
    assert got == {("n1", "n2"): [20.0, 60.0, 150.0], (): [1.0, 1.0, 1.0]}
    several = predict.list_weights(lists(spark), factor_rows(spark, rows), 3, chunk=2).collect()
    assert sorted((len(r.factors), *r.points, *r.weights) for r in several) == [
        (0, 0, 1, 1.0, 1.0), (0, 2, 1.0), (2, 0, 1, 20.0, 60.0), (2, 2, 150.0)]


@pytest.mark.parametrize("lost", [("n1", 0), ("n2", 2), ("n2", None)])
def test_an_absent_factor_is_an_error(spark, lost):
    rows = [(p, f, 2.0) for f in ("n1", "n2") for p in range(3) if (f, p) != lost and (f, None) != lost]
    with pytest.raises(Exception, match="factor n[12]"):
        predict.list_weights(lists(spark), factor_rows(spark, rows), 3).collect()


def test_equal_rows_reach_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(binning, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(100_000).select(F.lit(1).alias("key"))
        small = spark.createDataFrame([(1, "a"), (2, "b")], "key int, name string")
        joined = binning.join_hot(big, small, ["key"]).withColumn("part", F.spark_partition_id())
        counts = [r["count"] for r in joined.groupBy("part").count().collect()]
        assert sum(counts) == 100_000 and len(counts) >= 3 and max(counts) < 60_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_broadcasts_are_checked_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(binning, "BROADCAST_BYTES", 100_000)
    narrow = spark.range(2_000)
    wide = narrow.select("id", F.array_repeat(F.lit(0.5), 200).alias("v"))
    hinted = lambda df: binning.broadcast_if_small(df) is not df
    assert hinted(narrow) and not hinted(wide)


def test_unmapped_channels_are_an_error(spark):
    table = spark.createDataFrame([(14, 12), (14, 99)], "init_pdg int, final_pdg int")
    known = spark.createDataFrame([(14, 12, 3)], "init_pdg int, final_pdg int, channel int")
    assert events.map_channels(table.limit(1), known).first()["channel"] == 3
    with pytest.raises(Exception, match="no channel for flavours 14 -> 99"):
        events.map_channels(table, known).collect()


def test_long_axes_hold_their_edges(spark):
    edges = [i / 10 for i in range(258)]
    points = [x for e in edges for x in (e, np.nextafter(e, -1), np.nextafter(e, 99))]
    table = spark.createDataFrame([(float(x),) for x in points], "x double")
    got = table.select("x", binning.axis_bin(F.col("x"), edges).alias("b")).collect()
    for r in got:
        want = int(np.searchsorted(edges, r.x, "right")) - 1
        assert r.b == (want if 0 <= want < 257 else None)


def test_covariance_with_missing_values_and_any_layout(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b)) for a, b in rng.normal(size=(40, 2))]
    rows[7], rows[9] = (None, 1.0), (float("nan"), 2.0)
    clean = np.array([r for i, r in enumerate(rows) if i not in (7, 9)])
    want = np.cov(clean.T, bias=True)
    for parts in (1, 2, 4, 8):
        table = spark.createDataFrame(rows, "a double, b double").repartition(parts)
        for method in ("sql", "blocks"):
            got = {(r.param_i, r.param_j): r.cov for r in moments.covariance(table, ["a", "b"], method=method).collect()}
            assert [got["a", "a"], got["a", "b"], got["b", "b"]] == pytest.approx([want[0, 0], want[0, 1], want[1, 1]])


def test_nan_and_constants_in_histograms_and_medians(spark):
    rows = [(float(i), float("nan") if i == 3 else i / 2, 7.0, float("nan"), i % 2) for i in range(11)]
    table = spark.createDataFrame(rows, "x double, y double, c double, n double, chain_id long")
    contents = {r.param: r.s for r in hist.posterior_hist(table, ["x", "y", "c", "n"], 5).groupBy("param").agg(F.sum("content").alias("s")).collect()}
    assert contents == {"x": 10, "y": 9, "c": 11}
    problems = {r.param: (r.n, r.n_null, r.n_nan) for r in hist.value_problems(table, ["x", "y", "c", "n"]).collect()}
    assert problems == {"x": (11, 0, 0), "y": (11, 0, 1), "c": (11, 0, 0), "n": (11, 0, 11)}
    assert convergence.exact_medians(table, ["x", "y", "c", "n"]) == {"x": 5.0, "y": 2.75, "c": 7.0}
    assert {r.param for r in convergence.rhat_folded(table, ["x", "n"]).collect()} == {"x", "n"}


def test_files_with_the_same_chain_id_stay_apart(spark, tmp_path):
    table = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.7)], "chain_id int, step long, x double")
    for name in ("a", "b"):
        table.write.parquet(f"{tmp_path}/{name}")
    both = chains.read_chain(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert sorted((r.chain_id, r.step) for r in both.collect()) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_draws_do_not_follow_the_layout(spark):
    table = spark.range(1, 2001).select(F.lit(0).alias("chain_id"), F.col("id").alias("step"), (F.col("id") / 7).alias("x"))
    found = []
    for parts in (1, 3):
        t = table.repartition(parts)
        found.append((
            sorted(r.step for r in chain_ops.random_draws(t, 30, 100, 5).collect()),
            sorted((r.step, r.x) for r in chain_ops.smear_chain(t, {"x": 1.0}, seed=2).collect()),
            sorted(map(tuple, hist.prior_violin(t, {"x": (1.0, 2.0)}).collect()))))
    assert found[0] == found[1]


def test_throws_in_blocks(spark):
    params = [{"name": "a", "prior": 1.0, "low": 0.5, "up": None}, {"name": "b", "prior": -2.0, "fixed": True}]
    cov = np.array([[1.0, 0.3], [0.3, 1.0]])
    one = predict.throw_prior(spark, params, cov, 1500, seed=3).orderBy("point").toPandas()
    two = predict.throw_prior(spark, params, cov, 1500, seed=3).repartition(5).orderBy("point").toPandas()
    assert one.equals(two) and list(one["point"]) == list(range(1500))
    assert (one["a"] >= 0.5).all() and (one["b"] == -2.0).all() and (one["n_given_up"] == 0).all()


def test_axis_records():
    assert axis_edges([0, {"linspace": {"nb": 2, "low": 1, "up": 3}}, {"logspace": {"nb": 2, "low": 3, "up": 300}}]) == pytest.approx(
        [0, 1, 2, 3, 30, 300])
    with pytest.raises(ValueError):
        axis_edges([1, 0])
    with pytest.raises(ValueError):
        axis_edges([{"steps": {}}])


def test_starting_points(spark):
    table = spark.createDataFrame([(0, 1, 9.0, 0.1), (0, 3, 8.0, 0.3), (1, 2, 7.0, 0.2)], "chain_id int, step long, LogL double, x double")
    got = {r.chain_id: (r.step, r.LogL, r.x) for r in chains.starting_point(table, ["x"], "a: 1", "a: 1").collect()}
    assert got == {0: (3, 8.0, 0.3), 1: (2, 7.0, 0.2)}
    with pytest.raises(ValueError):
        chains.starting_point(table, ["x"], "a: 1", "a: 2")


def test_stored_tables_can_be_forgotten(spark):
    from pathlib import Path

    from chainlens.session import checkpoint_folder, forget_stored, stored
    table = stored(spark.range(5), "once")
    assert table.count() == 5 and list(Path(checkpoint_folder(spark).removeprefix("file://")).glob("once-*"))
    assert forget_stored(spark) > 0
    assert not list(Path(checkpoint_folder(spark).removeprefix("file://")).glob("once-*"))
