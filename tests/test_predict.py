import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlens.functions import llh
from chainlens.operators import binning, events, predict, splines, toys
from chainlens.plans import predictive
from chainlens.sources import toys as toy_store

LOW = 1e-5


def py_llh(stat, d, m, w2):
    """Plain scalar forms, for comparison."""
    def pois(d, m):
        if d == 0:
            return m
        if m < LOW:
            return LOW - d + d * math.log(d / LOW) if d > LOW else 0.0
        return m - d + d * math.log(d / m)

    if stat == "poisson":
        return pois(d, m)
    if stat == "pearson":
        if d == 0:
            return m / 2
        if m < LOW:
            return (d - LOW) ** 2 / (2 * LOW) if d > LOW else 0.0
        return (d - m) ** 2 / (2 * m)
    if stat in ("dembinski_abdelmotteleb", "icecube") and w2 == 0:
        return pois(d, m)
    if stat == "icecube":
        b = m / w2
        a = m * b + 1
        s = -(a * math.log(b) + math.lgamma(d + a) - math.lgamma(d + 1) - (d + a) * math.log1p(b) - math.lgamma(a))
        return min(s, pois(d, LOW)) if m <= d and d > LOW else (0.0 if m <= d else s)
    n = LOW if m < LOW and d > LOW else m
    if stat == "dembinski_abdelmotteleb":
        k = n * n / w2
        b = (d + k) / (n + k)
        return (n * b - d + d * math.log(d / (n * b)) if d > 0 else n * b) + k * b - k - k * math.log(b)
    f = w2 / n ** 2
    t = n * f - 1
    b = (-t + math.sqrt(t * t + 4 * d * f)) / 2
    return (n * b - d + d * math.log(d / (n * b)) if d > 0 else m * b) + ((b - 1) ** 2 / (2 * f) if f > 0 else 0)


@pytest.mark.parametrize("stat", llh.STATISTICS)
def test_likelihoods(spark, stat):
    cases = [(0.0, 3.0, 1.5), (5.0, 4.2, 2.0), (12.0, 15.5, 30.0), (3.0, 1e-7, 1e-9), (7.0, 7.0, 0.0), (100.0, 80.0, 10.0), (0.0, 0.4, 0.1)] + ([(0.0, 0.0, 0.0), (4.0, 0.0, 0.0)] if stat in ("poisson", "pearson") else [])
    df = spark.createDataFrame(cases, "data double, mc double, w2 double")
    got = [r["llh"] for r in toys.binned_llh(df, stat).collect()]
    assert got == pytest.approx([py_llh(stat, *c) for c in cases], rel=1e-8, abs=1e-10)


def test_exact_data_has_no_poisson_penalty(spark):
    df = spark.createDataFrame([(7.0, 7.0, 1.0)], "data double, mc double, w2 double")
    assert toys.binned_llh(df).first()["llh"] == 0


KNOTS = {1: ([0.0, 1.0, 2.5, 3.0, 5.0], [1.0, 1.4, 0.9, 0.9, 2.0]), 2: ([-1.0, 0.0, 2.0], [0.5, 1.0, 1.2]), 3: ([0.0, 1.0], [1.0, 3.0]),
         4: ([0.0, 1.0, 2.0, 3.0], [1.0, 1.1, 3.0, 3.05])}


def knot_table(spark, flat=True):
    rows = [(i, x, y) for i, (xs, ys) in KNOTS.items() for x, y in zip(xs, ys)]
    rows += [(9, 0.0, 1.0), (9, 1.0, 1.000001)] if flat else []
    return spark.createDataFrame(rows, "spline_id int, x double, y double")


@pytest.mark.parametrize("method", splines.METHODS)
def test_splines_pass_their_knots(spark, method):
    built = splines.build_splines(splines.pack_knots(knot_table(spark)), method).collect()
    assert sorted(r["spline_id"] for r in built) == [1, 2, 3, 4]
    for r in built:
        xs, ys = np.array(r["xs"]), np.array(r["ys"])
        assert list(xs) == KNOTS[r["spline_id"]][0]
        for i in range(len(xs) - 1):
            dx = xs[i + 1] - xs[i]
            end = ys[i] + dx * (r["b"][i] + dx * (r["c"][i] + dx * r["d"][i]))
            assert end == pytest.approx(ys[i + 1])
            if method == "monotonic":
                t = np.linspace(0, dx, 50)
                v = ys[i] + t * (r["b"][i] + t * (r["c"][i] + t * r["d"][i]))
                assert v.min() >= min(ys[i], ys[i + 1]) - 1e-9 and v.max() <= max(ys[i], ys[i + 1]) + 1e-9
        if method in ("cubic", "akima", "kochanek_bartels"):
            for i in range(len(xs) - 2):
                dx = xs[i + 1] - xs[i]
                assert r["b"][i] + dx * (2 * r["c"][i] + 3 * dx * r["d"][i]) == pytest.approx(r["b"][i + 1])
        if method == "cubic" and len(xs) == 4:
            p = np.polyfit(xs, ys, 3)
            assert r["d"] == pytest.approx([p[0]] * 3)


def test_knots_are_capped(spark):
    row = splines.pack_knots(knot_table(spark), low=0.8, high=1.3).filter("spline_id = 1").first()
    assert row["ys"] == [1.0, 1.3, 0.9, 0.9, 1.3]


def test_segments(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0], v) for v in (-1.0, 0.0, 0.5, 1.0, 1.9, 2.0, 7.0)], "xs array<double>, x double")
    assert [r[0] for r in df.select(splines.spline_segment(F.col("xs"), F.col("x"))).collect()] == [0, 0, 0, 1, 1, 1, 1]


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 2), "ABC"[i % 3], "FO"[int(rng.integers(2))], float(rng.uniform(0, 10)), float(rng.uniform(-0.1, 1))) for i in range(2000)]
    return spark.createDataFrame(rows, "event_id long, sample_id int, mode string, channel string, x double, w0 double").repartition(5).cache()


AXES = [{"sample_id": s, "dim": 0, "var": "x", "edges": [0.0, 2.0, 5.0, 10.0]} for s in (0, 1)]
NORMS = [{"idx": 0, "name": "a", "modes": ["A"]}, {"idx": 1, "name": "o", "channels": ["O"], "kin": {"x": [(1, 6)]}}, {"idx": 2, "name": "b", "modes": ["B"]}]
CODES = {"modes": "mode", "channels": "channel"}


@pytest.mark.parametrize("limit,chunk", [(200_000, 64), (0, 2)])
def test_spectra_match_event_by_event_weights(spark, sample, monkeypatch, limit, chunk):
    monkeypatch.setattr(binning, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(6)
    values = rng.uniform(-0.2, 2, (5, 3))
    wide = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], "point long, a double, o double, b double")
    factors = predict.norm_factors(predict.to_points(wide, ["a", "o", "b"]), NORMS)
    binned = events.match_norms(binning.assign_bin_uniform(sample, AXES), NORMS, None, CODES)
    want = {}
    for r in sample.collect():
        for p, (a, o, b) in enumerate(values):
            w = r["w0"] * (a if r["mode"] == "A" else 1) * (o if r["channel"] == "O" and 1 < r["x"] <= 6 else 1) * (b if r["mode"] == "B" else 1)
            if r["w0"] > 0 and w > 0:
                k = (p, r["sample_id"], int(np.searchsorted([2.0, 5.0], r["x"], side="right")))
                m = want.setdefault(k, [0.0, 0.0])
                m[0] += w
                m[1] += w * w
    spectra = predict.predict_spectra(predict.signatures(binned), factors, 5, chunk=chunk)
    got = {(r["point"], r["sample_id"], r["bin"]): (r["mc"], r["w2"]) for r in spectra.collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(tuple(want[k])) for k in want)
    single = predict.reweight_events(predict.factor_ids(binned.filter("w0 > 0")), factors, 5, chunk=chunk)
    again = {(r["point"], r["sample_id"], r["bin"]): r["s"] for r in single.groupBy("point", "sample_id", "bin").agg(F.sum("w").alias("s")).collect()}
    assert all(again[k] == pytest.approx(want[k][0]) for k in want)


def test_weights_of_one_change_nothing(spark, sample):
    wide = spark.createDataFrame([(0, 1.0, 1.0, 1.0)], "point long, a double, o double, b double")
    factors = predict.norm_factors(predict.to_points(wide, ["a", "o", "b"]), NORMS)
    binned = binning.assign_bin_uniform(sample, AXES)
    tagged = events.match_norms(binned, NORMS, None, CODES)
    got = {(r["sample_id"], r["bin"]): r["mc"] for r in predict.predict_spectra(predict.signatures(tagged), factors, 1).collect()}
    want = {(r["sample_id"], r["bin"]): r["mc"] for r in events.fill_spectra(binned).collect()}
    assert got == pytest.approx(want)


PARAMS = [{"name": "a", "prior": 0.0, "low": -0.5, "up": 3.0}, {"name": "b", "prior": 1.0}, {"name": "c", "prior": 5.0, "fixed": True},
          {"name": "d", "prior": 3.0, "circular": (-3.141592653589793, 3.141592653589793)}, {"name": "e", "prior": 2.0, "flip": 0.0, "grp": "osc"}]


def test_prior_throws(spark):
    cov = np.diag([1.0, 4.0, 1.0, 1.0, 0.01])
    cov[0, 1] = cov[1, 0] = 1.2
    table = predict.throw_prior(spark, PARAMS, cov, 3000, seed=3).toPandas().sort_values("point")
    assert table["a"].between(-0.5, 3.0).all() and (table["c"] == 5.0).all() and table["d"].abs().max() <= 3.1415927
    assert table["b"].std() == pytest.approx(2.0, abs=0.15) and abs((table["e"] > 0).mean() - 0.5) < 0.05
    assert np.corrcoef(table["a"], table["b"])[0, 1] > 0.25
    again = predict.throw_prior(spark, PARAMS, cov, 3000, seed=3).repartition(3).toPandas().sort_values("point")
    assert np.array_equal(table.to_numpy(), again.to_numpy())
    only = predict.throw_prior(spark, PARAMS, cov, 50, seed=3, groups=["osc"]).toPandas()
    assert (only["b"] == 1.0).all() and only["e"].nunique() > 10


def test_eigen_basis(spark):
    cov = np.array([[2.0, 0.0, 0.0, 0.0], [0.0, 3.0, 1.0, 0.0], [0.0, 1.0, 3.0, 0.0], [0.0, 0.0, 0.0, 1.0]])
    transfer = predict.pca_basis(cov, 1, 2, 0.0)
    assert transfer.shape == (4, 4) and predict.pca_basis(cov, 1, 2, 0.5).shape == (4, 3)
    bad = cov.copy()
    bad[0, 1] = bad[1, 0] = 0.1
    with pytest.raises(ValueError):
        predict.pca_basis(bad, 1, 2, 0.0)
    df = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 4.0)], "point long, a double, b double, c double, d double")
    there = predict.pca_transform(df, list("abcd"), transfer)
    back = predict.pca_transform(there, list("abcd"), transfer, inverse=True).first()
    assert [back[c] for c in "abcd"] == pytest.approx([1.0, 2.0, 3.0, 4.0])


def test_grids(spark):
    grid = predict.scan_grid(spark, [("a", 3, 0.0, 1.0), ("b", 2, 5.0, 7.0)], ends=True).orderBy("point").collect()
    assert [(r["a"], r["b"]) for r in grid] == [(0, 5), (0.5, 5), (1, 5), (0, 7), (0.5, 7), (1, 7)]
    centres = predict.scan_grid(spark, [("a", 4, 0.0, 1.0)]).orderBy("point").collect()
    assert [r["a"] for r in centres] == pytest.approx([0.125, 0.375, 0.625, 0.875])
    assert predict.scan_range(1.0, 0.5, 0.8, None, 2.0) == (0.8, 2.0)
    with pytest.raises(ValueError):
        predict.sigma_points(spark, [{"name": "a", "prior": 0.0, "error": 1.0}], [-1, 1])


def test_penalties_large_and_small(spark):
    rng = np.random.default_rng(1)
    p = 20
    a = rng.normal(size=(p, p))
    cov = a @ a.T + p * np.eye(p)
    x = rng.normal(size=(30, p))
    names = [f"q{i}" for i in range(p)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    inverse = np.linalg.inv(cov)
    flat = [i == 3 for i in range(p)]
    sets = [{"set": "all", "prefixes": [], "exclude": True}, {"set": "some", "prefixes": ["q1"], "exclude": False}]
    out = predict.penalty_term(df, names, [0.5] * p, cov, sets, flat).toPandas()
    d = x - 0.5
    d[:, 3] = 0
    assert out["penalty_all"].to_numpy() == pytest.approx(0.5 * np.einsum("ri,ij,rj->r", d, inverse, d))
    keep = np.array([n.startswith("q1") for n in names])
    assert out["penalty_some"].to_numpy() == pytest.approx(0.5 * np.einsum("ri,ij,rj->r", d * keep, inverse, d * keep))


def toy_table(spark, n=200):
    rng = np.random.default_rng(12)
    rows = [(t, s, b, float(v), float(v) / 2) for t in range(n) for s in (0, 1) for b, v in enumerate(rng.uniform(5, 40, 4))]
    return spark.createDataFrame(rows, "toy long, sample_id int, bin int, mc double, w2 double").repartition(5)


def test_fluctuations(spark):
    table = toy_table(spark)
    out = toys.poisson_fluctuate(table, seed=7)
    row = out.agg(F.avg(F.col("fluctuated") - F.col("mc")).alias("m"), F.avg(F.pow(F.col("fluctuated") - F.col("mc"), 2) / F.col("mc")).alias("v")).first()
    assert abs(row["m"]) < 0.5 and abs(row["v"] - 1) < 0.15
    key = ["toy", "sample_id", "bin"]
    assert out.exceptAll(toys.poisson_fluctuate(table.repartition(2), seed=7)).count() == 0
    spread = toys.multinomial_fluctuate(table, seed=7)
    assert spread.select(*key).distinct().count() == 1600
    per = spread.groupBy("toy", "sample_id").agg(F.sum("fluctuated").alias("n"), F.sum("mc").alias("m"))
    assert abs(per.agg(F.avg(F.pow(F.col("n") - F.col("m"), 2) / F.col("m"))).first()[0] - 1) < 0.3


def test_correlation_over_toys(spark):
    table = toy_table(spark)
    got = {(r["sample_id"], r["i"], r["j"]): r["corr"] for r in toys.rate_correlation(table, "bin", ("sample_id",)).collect()}
    wide = table.toPandas().pivot(index="toy", columns=["sample_id", "bin"], values="mc")
    assert len(got) == 12
    for (s, i, j), c in got.items():
        assert c == pytest.approx(np.corrcoef(wide[(s, i)], wide[(s, j)])[0, 1])


def test_fisher_tail(spark):
    df = spark.createDataFrame([(0.2,), (0.7,)], "p_value double")
    half = -math.log(0.2) - math.log(0.7)
    assert toys.combine_pvalues(df).first()["combined"] == pytest.approx(math.exp(-half) * (1 + half))


def test_toys_are_stored_and_summarised(spark, sample, tmp_path):
    chain = spark.range(400).select(F.lit(0).alias("chain_id"), F.col("id").alias("step"), *[
        (1 + F.randn(i) * 0.1).alias(n) for i, n in enumerate(("a", "o", "b"))])
    binned = binning.assign_bin_uniform(sample, AXES)
    spectra, info = predictive.toys_from_chain(chain, binned, NORMS, CODES, 40, ["a", "o", "b"])
    toy_store.write_toys(spectra, info, str(tmp_path / "toys"))
    spectra, info = toy_store.load_toys(spark, str(tmp_path / "toys"))
    assert spectra.count() == 40 * 6 and info.count() == 40
    data = binned.groupBy("sample_id", "bin").agg(F.ceil(F.sum("w0")).cast("double").alias("data"))
    tables = predictive.predictive_summary(spectra, info, data, 3)
    rows = {name: t.collect() for name, t in tables.items()}
    assert all(rows.values())
    for name in ("pvalue_draw", "pvalue_prediction"):
        assert all(0 <= r["p_exact"] <= 1 and r["n_toys"] == 40 for r in rows[name])
