import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlens.operators import chain as ops
from chainlens.plans import postfit
from chainlens.sources import chains, model


def steps(df):
    return sorted(r["step"] for r in df.select("step").collect())


def test_burn_in_default_and_error(ar1):
    chain, x, _ = ar1
    assert steps(ops.burn_in(chain)) == list(range(1201, 6001))
    assert min(steps(ops.burn_in(chain, 100))) == 101
    with pytest.raises(ValueError):
        ops.burn_in(chain, 6001)


def test_entry_index_with_gaps_matches_row_number(spark):
    rows = [(c, s * s + c) for c in range(3) for s in range(200)]
    chain = spark.createDataFrame(rows, "chain_id int, step long").repartition(5)
    got = {(r["chain_id"], r["step"]): r["entry"] for r in ops.with_entry_index(chain, block=1000).collect()}
    assert got == {(c, s * s + c): s for c in range(3) for s in range(200)}
    kept = ops.thin(chain, 7).groupBy("chain_id").count().collect()
    assert all(r["count"] == math.ceil(200 / 7) for r in kept)


def test_random_draws_are_rows_after_burn_in(ar1):
    chain, x, _ = ar1
    draws = ops.random_draws(chain, 500, cut=3000, seed=9).collect()
    assert sorted(r["draw"] for r in draws) == list(range(500))
    assert all(r["step"] > 3000 and r["x"] == x[r["step"]] for r in draws)
    assert len({r["step"] for r in draws}) > 400
    gaps = chain.filter("step % 3 <> 0")
    with pytest.raises(ValueError):
        ops.random_draws(gaps, 5)


def test_gaps_are_noticed(ar1):
    chain, _, _ = ar1
    with pytest.raises(Exception, match="step gaps"):
        ops.thin(chain.filter("step % 3 <> 0"), 2, contiguous=True).collect()


def test_random_draws_cover_all_chains(spark):
    chain = spark.range(600).select((F.col("id") % 3).cast("int").alias("chain_id"), F.floor(F.col("id") / 3).alias("step"))
    draws = ops.random_draws(chain, 900, cut=99, seed=2)
    assert {r["chain_id"] for r in draws.collect()} == {0, 1, 2}
    assert draws.agg(F.min("step")).first()[0] >= 100 and draws.count() == 900


def test_smearing_keeps_old_values(ar1):
    chain, x, _ = ar1
    out = ops.smear_chain(chain, {"x": 0.5}, keep=True, seed=4)
    row = out.select(F.stddev(F.col("x") - F.col("x_unsmeared")).alias("s"), F.avg(F.col("x") - F.col("x_unsmeared")).alias("m")).first()
    assert abs(row["s"] - 0.5) < 0.03 and abs(row["m"]) < 0.03


def test_gaussian_reweighting_to_the_old_prior_changes_nothing(ar1):
    chain, _, _ = ar1
    out = ops.reweight_gaussian(chain, {"y": (3.0, 2.0)}, {"y": (3.0, 2.0)})
    assert out.filter("abs(Weight - 1) > 1e-12").count() == 0


def test_classification():
    kinds = [chains.column_kind(c) for c in ("step", "LogL_sample_0", "LogL_systematic_x", "param_3", "ndd_1", "delta_cp", "a_Prop")]
    assert kinds == ["bookkeeping", "sample_llh", "systematic_llh", "model", "near", "oscillation", "proposal"]


def test_model_round_trip(spark, tmp_path):
    good = model.make_params(spark, [
        {"name": "a", "prior": 1.0, "error": 0.1, "corr": {"b": 0.3}}, {"name": "b", "prior": 2.0, "error": 0.5, "corr": {"a": 0.3}}])
    good.write.json(str(tmp_path / "good"))
    back = model.read_params(spark, str(tmp_path / "good"))
    cov = {(r["param_i"], r["param_j"]): r["cov"] for r in model.prior_covariance(back).collect()}
    assert cov[("a", "b")] == pytest.approx(0.3 * 0.1 * 0.5) and cov[("b", "b")] == pytest.approx(0.25)
    bad = model.make_params(spark, [{"name": "a", "prior": 1.0, "error": 0.1, "corr": {"b": 0.3}}, {"name": "b", "prior": 2.0, "error": 0.5}])
    bad.write.json(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        model.read_params(spark, str(tmp_path / "bad"))


def test_merge_skips_empty_and_refuses_other_config(spark, tmp_path):
    paths = []
    for i, n in enumerate((10, 0, 5)):
        paths.append(str(tmp_path / f"c{i}"))
        spark.range(n).select(F.col("id").alias("step"), F.lit(1.0).alias("x")).write.parquet(paths[-1])
    text = "Sampler: a\nNSteps: {}\nOutputFile: f{}\n"
    same = spark.createDataFrame([(p, text.format(i, i)) for i, p in enumerate(paths)], "path string, config string")
    merged = chains.merge_chains(spark, paths, str(tmp_path / "out"), same)
    assert {r["chain_id"]: r["count"] for r in merged.groupBy("chain_id").count().collect()} == {0: 10, 2: 5}
    other = same.withColumn("config", F.concat("config", F.col("path")))
    with pytest.raises(ValueError):
        chains.merge_chains(spark, paths, str(tmp_path / "out2"), other)
    assert chains.merge_chains(spark, paths, str(tmp_path / "out"), other, force=True).count() == 15
    stored = spark.createDataFrame([("a", "h", 1.0), ("b", "h", 1.1)], "path string, hist string, integral double")
    with pytest.raises(ValueError):
        chains.merge_chains(spark, paths, str(tmp_path / "out3"), same, stored)


def test_postfit_tables_are_written(spark, ar1, tmp_path):
    chain, x, y = ar1
    table = postfit.postfit_table(chain, ["x", "y"], cut=0)
    chains.write_postfit(table, str(tmp_path / "postfit"))
    rows = {r["param"]: r for r in spark.read.parquet(str(tmp_path / "postfit")).collect()}
    assert rows["y"]["mean"] == pytest.approx(y[1:].mean()) and rows["y"]["rms"] == pytest.approx(y[1:].std())
    assert abs(rows["y"]["gauss_mean"] - 3.0) < 0.25 and abs(rows["y"]["gauss_sigma"] - 2.0) < 0.3
    matrix = postfit.matrices(chain, ["x", "y"], cut=0)
    chains.export_correlations(table, matrix, str(tmp_path / "model"), "Gaussian")
    records = {r["param"]: r for r in spark.read.json(str(tmp_path / "model")).collect()}
    assert records["x"]["corr"]["y"] == pytest.approx(np.corrcoef(x[1:], y[1:])[0, 1])
    assert records["y"]["prior"] == pytest.approx(rows["y"]["gauss_mean"])
