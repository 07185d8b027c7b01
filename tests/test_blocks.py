import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlens.operators import binning, convergence, events, hist, predict, product, toys


def signatures(spark, rows):
    return spark.createDataFrame(rows, "sample_id int, bin int, factors array<string>, sw double, sw2 double")


def factors(spark, values):
    rows = [(p, f, float(v)) for f, vs in values.items() for p, v in enumerate(vs)]
    return spark.createDataFrame(rows, "point long, factor string, f double")


@pytest.mark.parametrize("size, chunk", [(2048, 64), (3, 2), (1, 1)])
def test_block_spectra_match_products_by_hand(spark, size, chunk):
    rng = np.random.default_rng(2)
    names = [f"n{i}" for i in range(6)]
    values = {n: rng.uniform(-0.2, 2, 5) for n in names}
    rows = [(int(s), int(b), [names[i] for i in rng.permutation(6)[:rng.integers(0, 4)]], float(rng.uniform(0, 3)), float(rng.uniform(0, 3)))
            for s in range(2) for b in range(4) for _ in range(5)]
    want = {}
    for s, b, on, sw, sw2 in rows:
        for p in range(5):
            w = math.prod(values[n][p] for n in on)
            if w > 0:
                m = want.setdefault((p, s, b), [0.0, 0.0])
                m[0] += sw * w
                m[1] += sw2 * w * w
    packed = predict.pack_factors(factors(spark, values), 5, chunk)
    got = {tuple(r)[:3]: list(r)[3:] for r in product.block_spectra(
        signatures(spark, rows), packed, 5, ["sample_id", "bin"], chunk, size).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_block_spectra_of_odd_tables(spark):
    some = factors(spark, {"n1": [2.0, -1.0]})
    assert predict.predict_spectra(signatures(spark, []), some, 2).collect() == []
    keys = [(None, 3, ["n1"], 1.0, 1.0), (None, 3, [], 1.0, 1.0), (1, None, ["n1"], 2.0, 4.0)]
    got = {tuple(r)[:3]: (r.mc, r.w2) for r in predict.predict_spectra(signatures(spark, keys), some, 2).collect()}
    assert got == {(0, None, 3): (3.0, 5.0), (1, None, 3): (1.0, 1.0), (0, 1, None): (4.0, 16.0)}
    with pytest.raises(Exception, match="factor n2"):
        predict.predict_spectra(signatures(spark, [(0, 0, ["n1", "n2"], 1.0, 1.0)]), some, 2).collect()
    with pytest.raises(Exception, match="factor n1"):
        predict.predict_spectra(signatures(spark, [(0, 0, ["n1"], 1.0, 1.0)]), some.where("point = 0"), 2).collect()


AXES = [{"sample_id": 0, "dim": 0, "var": "x", "edges": [0.0, 1.0, 4.0, 5.0]}, {"sample_id": 0, "dim": 1, "var": "y", "edges": [0.0, 2.0, 3.0]},
        {"sample_id": 1, "dim": 0, "var": "x", "edges": [-1.0, 2.0]}]
CUTS = [{"var": "y", "lo": 0.25, "hi": 2.75}, {"sample_id": 1, "var": "x", "lo": 0.0, "hi": 1.5}]
SHIFTS = {"x": lambda c: c["x"] * c["a"] + c["b"], "y": lambda c: c["y"] + c["x"] / 10}


@pytest.mark.parametrize("cells", [1 << 20, 14])
def test_fused_shifts_match_events_one_by_one(spark, cells):
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 3)), float(rng.uniform(-1, 6)), float(rng.uniform(0, 4)), float(rng.uniform(-0.2, 1))) for _ in range(1500)]
    rows += [(0, None, 1.0, 1.0), (0, float("nan"), 1.0, 1.0), (None, 1.0, 1.0, 1.0), (1, 1.0, 1.0, None), (0, 1.0, 2.0, 1.0), (0, 1.0, 2.0, 1.0)]
    sample = spark.createDataFrame(rows, "sample_id int, x double, y double, w0 double").repartition(3)
    points = spark.createDataFrame([(i, 1.0 + i / 10, i / 3) for i in range(7)], "point long, a double, b double")
    got = {tuple(r)[:3]: (r.mc, r.w2) for r in product.shifted_spectra(sample, SHIFTS, points, AXES, CUTS, cells=cells).collect()}
    one_by_one = predict.shift_events(sample, SHIFTS, points)
    binned = binning.assign_bin_uniform(events.select_events(one_by_one, CUTS), AXES)
    want = {tuple(r)[:3]: (r.mc, r.w2) for r in events.fill_spectra(binned, keys=("point", "sample_id", "bin")).collect()}
    assert set(got) == set(want) and len(want) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert product.shifted_spectra(sample.limit(0), SHIFTS, points, AXES).collect() == []
    assert product.shifted_spectra(sample, SHIFTS, points.limit(0), AXES).collect() == []


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_salts_follow_from_the_rows(spark):
    """A map stage that is repeated with its rows in another order deals them alike."""
    rows = spark.range(30_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("v"))
    dealt = lambda df: binning.dealt(df.withColumn("_heavy", F.col("k") < 2), 8)
    first, again = dealt(rows.repartition(7)), dealt(rows.orderBy(F.rand(3)).coalesce(2))
    assert plain(first.collect()) == plain(again.collect())
    assert first.agg(F.sum("_copies")).first()[0] == 30_000
    assert {r[0] for r in first.where("k = 2").select("_salt").distinct().collect()} == {0}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_keys_join_as_others_do(spark, monkeypatch, how):
    big = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id") % 400).cast("int").alias("k"),
        (F.col("id") % 4).alias("v"))
    small = spark.createDataFrame([(i, f"name {i}") for i in range(300)] + [(1, "again"), (None, "nothing")], "k int, name string")
    want = plain(big.join(small, "k", how).collect())
    monkeypatch.setattr(binning, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(binning, "HEAVY_ROWS", 100)
    monkeypatch.setattr(binning, "SHARE", 64)
    assert plain(binning.join_hot(big, small, ["k"], how).collect()) == want
    monkeypatch.setattr(binning, "HEAVY_BYTES", 20)  # fewer keys may be heavy
    assert plain(binning.join_hot(big, small, ["k"], how).collect()) == want


def test_infinite_values_count_as_missing(spark):
    inf = float("inf")
    df = spark.createDataFrame([(float(i),) for i in range(50)] + [(inf,), (-inf,), (float("nan"),), (None,)], "x double")
    assert hist.column_ranges(df, ["x"]) == {"x": (0.0, 49.0)}
    assert convergence.exact_medians(df, ["x"], bins=8, leaf=5) == {"x": 24.5}
    assert tuple(hist.value_problems(df, ["x"]).first()) == ("x", 54, 1, 3)
    only = df.where(F.abs("x") == inf)
    assert hist.column_ranges(only, ["x"]) == {} and convergence.exact_medians(only, ["x"]) == {}


def test_results_do_not_depend_on_stored_zero_counts(spark):
    rows = [(t, s, b, 5.0 + t + b, 5.0) for t in range(4) for s in range(2) for b in range(3)]
    table = spark.createDataFrame(rows, "toy long, sample_id int, bin int, mc double, w2 double")
    full = spark.createDataFrame([(s, b, 0.0 if b == 1 else 6.0) for s in range(2) for b in range(3)], "sample_id int, bin int, data double")
    mean = toys.predictive_mean(table.withColumn("weight", F.lit(1.0)))
    for made in (lambda d: toys.information_criteria(table, d, mean, 2), lambda d: toys.fluctuated_deviances(table, d, mean)):
        assert plain(made(full).collect()) == plain(made(full.where("data > 0")).collect())


def test_a_toy_without_events_counts(spark):
    rows = [(t, 0, b, 2.0 * t + b, 2.0) for t in range(1, 4) for b in range(2)]
    table = spark.createDataFrame(rows, "toy long, sample_id int, bin int, mc double, w2 double").withColumn("weight", F.lit(1.0))
    info = spark.range(4).select((F.col("id") - F.when(F.col("id") == 0, 1).otherwise(0)).alias("toy"), F.lit(1.0).alias("weight"))
    mean = {r.bin: r.mc_mean for r in toys.predictive_mean(table, info=info).collect()}
    assert mean == pytest.approx({0: 3.0, 1: 3.75})
    rates = {r.sample_id: r["mean"] for r in toys.event_rates(table, info=info).collect()}
    assert rates[0] == pytest.approx(6.75)
    violin = toys.toy_violin(table, info=info)
    assert {r.bin: r.n for r in violin.groupBy("bin").agg(F.sum("n_toys").alias("n")).collect()} == {0: 4, 1: 4}
    data = spark.createDataFrame([(0, 0, 3.0)], "sample_id int, bin int, data double")
    assert toys.fluctuated_deviances(table, data, toys.predictive_mean(table, info=info), info=info).count() == 4


def test_prior_toys_are_the_predictions_at_their_draws(spark):
    rng = np.random.default_rng(5)
    rows = [(int(s), int(b), [f"n{i}" for i in range(3) if rng.random() < .5], float(rng.uniform(1, 3)), 1.0) for s in range(2) for b in range(3) for _ in range(3)]
    summed = signatures(spark, rows).cache()
    norms = [{"idx": i, "name": f"p{i}"} for i in range(3)]
    params = [{"name": "p0", "prior": 1.0}, {"name": "p1", "prior": 1.5, "fixed": True}, {"name": "p2", "prior": 0.8, "low": 0.7, "up": 0.9, "flat": True}]
    cov = np.array([[0.04, 0, 0.01], [0, 0.01, 0], [0.01, 0, 0.04]])
    made, info = predict.prior_toys(summed, params, cov, 50, lambda pts: predict.norm_factors(pts, norms), seed=3)
    record = {r.toy: r for r in info.collect()}
    assert sorted(record) == list(range(50)) and all(r.p1 == 1.5 and 0.7 <= r.p2 <= 0.9 and r.n_given_up == 0 for r in record.values())
    inverse = np.linalg.inv(cov)[:2, :2]  # the flat one is left out
    for r in record.values():
        d = np.array([r.p0 - 1.0, 0.0])
        assert r.penalty == pytest.approx(0.5 * d @ inverse @ d)
    want = {}
    for t, r in record.items():
        for s, b, on, sw, _ in rows:
            w = math.prod(r[f"p{n[1:]}"] for n in on)
            if w > 0:
                want[t, s, b] = want.get((t, s, b), 0.0) + sw * w
    got = {(r.toy, r.sample_id, r.bin): r.mc for r in made.collect()}
    assert got == pytest.approx(want)
    again, _ = predict.prior_toys(summed, params, cov, 50, lambda pts: predict.norm_factors(pts, norms), seed=3)
    assert plain(made.select("toy", "bin").collect()) == plain(again.select("toy", "bin").collect())
