"""Random draws, fits and files, as queries whose results SQL can foretell.

A draw is checked by what must hold for it: row counts, bounds, values kept, and moments
that lie within about five standard errors, as true or false.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from chainlens.catalog.chains import MODEL_SQL, POSTFIT, li_hist, li_model
from chainlens.catalog.comparing import BOUNDS
from chainlens.catalog.event_samples import binned_sample, event_sample
from chainlens.catalog.prediction import TOYS, NORMS, toy_data, toy_table
from chainlens.catalog.registry import (EV, LI, LI_SQL, SAMPLE_SQL, add, ev_chain, ev_sql, li_chain, long_sql,
                                        table)
from chainlens.operators import chain as chain_ops
from chainlens.operators import convergence, events, hist, moments, predict, toys
from chainlens.plans import predictive as plans
from chainlens.session import checkpoint_folder
from chainlens.sources import chains, toys as toy_files

EVENTS = f"WITH {ev_sql()}"


def near(found, wanted, error):
    """Within five standard errors."""
    return F.coalesce(F.abs(found - wanted) <= 5 * error, F.lit(False))


@add("random_draws_check", f"{EVENTS} SELECT 2000 AS n, 2000 AS n_draws, TRUE AS is_chain_row, TRUE AS after_cut, TRUE AS evenly, count(*) AS chain_rows FROM ch")
def _(spark, path):
    chain = ev_chain(spark, path)
    cut = chain_ops.last_step(chain) // 5
    draws = chain_ops.random_draws(chain, 2000, cut, seed=3)
    same = draws.join(chain.select("step", *[F.col(c).alias(f"own_{c}") for c in EV]), "step", "left")
    equal = F.lit(True)
    for c in EV:
        equal = equal & F.col(c).eqNullSafe(F.col(f"own_{c}"))
    place = (F.col("step") - cut) / F.lit(float(chain_ops.last_step(chain) - cut))  # evenly over (0, 1]
    size = chain.agg(F.count(F.lit(1)).alias("chain_rows"))
    return same.agg(F.count(F.lit(1)).cast("int").alias("n"), F.countDistinct("draw").cast("int").alias("n_draws"),
                    F.min(equal).alias("is_chain_row"), (F.min("step") > cut).alias("after_cut"),
                    near(F.avg(place), 0.5, (1 / 12 / 2000) ** 0.5).alias("evenly")).join(F.broadcast(size))  # two single rows


@add("smear_chain_check", f"{EVENTS}, l AS (SELECT 'val' AS param, val AS v FROM ch UNION ALL SELECT 'k', k FROM ch) SELECT param, count(*) AS n, sum(v) AS old_sum, TRUE AS mean_fits, TRUE AS width_fits FROM l GROUP BY param", "old_sum")
def _(spark, path):
    out = chain_ops.smear_chain(ev_chain(spark, path), {"val": 2.0, "k": 0.5}, keep=True, seed=5)
    long = out.select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("param"), F.col(f"{p}_unsmeared").alias("old"), ((F.col(p) - F.col(f"{p}_unsmeared")) / e).alias("pull"))
        for p, e in (("val", 2.0), ("k", 0.5))])))
    n = F.count(F.lit(1))
    return long.groupBy("param").agg(n.alias("n"), F.sum("old").alias("old_sum"), near(F.avg("pull"), F.lit(0.0), 1 / F.sqrt(n)).alias("mean_fits"),
                                     near(F.var_pop("pull"), F.lit(1.0), F.sqrt(2 / n)).alias("width_fits"))


@add("throw_prior_check", f"WITH {LI_SQL}, l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS param, avg({c}) AS prior FROM ch" for c in LI)
     + ") SELECT param, prior, 3000 AS n, 3000 AS n_points, TRUE AS in_bounds, TRUE AS none_given_up, TRUE AS mean_fits FROM l", "prior")
def _(spark, path):
    chain = li_chain(spark, path)
    means = moments.column_means(chain, LI)
    cov = np.zeros((4, 4))
    for r in moments.covariance(chain, LI).collect():  # parameters squared
        cov[LI.index(r["param_i"]), LI.index(r["param_j"])] = r["cov"] / 100  # narrow: bounds cut off nothing
    params = [{"name": p, "prior": means[p], "low": lo, "up": hi} for p, (lo, hi) in zip(LI, BOUNDS)]
    thrown = predict.throw_prior(spark, params, cov, 3000, seed=11)
    rows = thrown.select("point", "n_given_up", F.inline(F.array(*[
        F.struct(F.lit(p["name"]).alias("param"), F.lit(p["prior"]).alias("prior"), F.col(p["name"]).alias("x"),
                 F.lit(float(cov[i, i]) ** 0.5).alias("error"), F.lit(p["low"]).cast("double").alias("low"), F.lit(p["up"]).cast("double").alias("up"))
        for i, p in enumerate(params)])))
    inside = (F.col("low").isNull() | (F.col("x") >= F.col("low"))) & (F.col("up").isNull() | (F.col("x") <= F.col("up")))
    return rows.groupBy("param", "prior").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.countDistinct("point").cast("int").alias("n_points"), F.min(inside).alias("in_bounds"),
        (F.max("n_given_up") == 0).alias("none_given_up"), near(F.avg("x"), F.first("prior"), F.first("error") / 3000 ** 0.5).alias("mean_fits"))


@add("throw_prior_given_up", "SELECT count(*) AS suppliers, 50 AS n, TRUE AS at_prior, TRUE AS flagged FROM supplier")
def _(spark, path):
    """Bounds that no draw can meet: every draw is left at the prior and says so."""
    top = table(spark, path, "supplier").agg(F.max("s_acctbal").alias("m"), F.count(F.lit(1)).alias("n")).first()
    params = [{"name": "a", "prior": 0.0, "low": float(top.m) * 1e6, "up": float(top.m) * 1e6 + 1}]
    return predict.throw_prior(spark, params, np.eye(1), 50, max_tries=20).agg(
        F.lit(top.n).alias("suppliers"), F.count(F.lit(1)).cast("int").alias("n"), (F.max(F.abs("a")) == 0).alias("at_prior"),
        (F.min("n_given_up") == 1).alias("flagged"))


@add("fluctuations_check", f"""{TOYS}, k AS (SELECT * FROM (VALUES ('poisson'), ('multinomial')) t(kind))
 SELECT kind, sample_id, count(*) AS n, sum(mc) AS expected, TRUE AS whole, TRUE AS total_fits, TRUE AS width_fits FROM toys, k WHERE mc > 0 GROUP BY ALL""", "expected", digits=8)
def _(spark, path):
    table_ = toy_table(spark, path)
    parts = [f(table_, seed=7).withColumn("kind", F.lit(k)) for k, f in (("poisson", toys.poisson_fluctuate), ("multinomial", toys.multinomial_fluctuate))]
    pull = F.pow(F.col("fluctuated") - F.col("mc"), 2) / F.col("mc")
    n = F.count(F.lit(1))
    return parts[0].unionByName(parts[1]).groupBy("kind", "sample_id").agg(
        n.alias("n"), F.sum("mc").alias("expected"), F.min((F.col("fluctuated") >= 0) & (F.col("fluctuated") == F.floor("fluctuated"))).alias("whole"),
        near(F.sum("fluctuated"), F.sum("mc"), F.sqrt(F.sum("mc"))).alias("total_fits"),
        near(F.avg(pull), F.lit(1.0), F.sqrt((2 + F.avg(1 / F.col("mc"))) / n)).alias("width_fits"))


@add("fluctuated_deviances_check", f"""{TOYS}, d AS (SELECT toy, sample_id, count(*) AS n_bins FROM toys GROUP BY ALL)
 SELECT sample_id, count(*) AS n_toys, TRUE AS not_negative, TRUE AS draw_size_fits FROM d GROUP BY sample_id""")
def _(spark, path):
    table_ = toy_table(spark, path)
    mean = toys.predictive_mean(table_.withColumn("weight", F.lit(1.0)))
    out = toys.fluctuated_deviances(table_, toy_data(spark, path), mean)
    # A Poisson draw deviates by about one unit a bin; ten bins.
    return out.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_toys"), (F.min(F.least("data_llh", "draw_llh", "pred_llh")) >= 0).alias("not_negative"),
                                        F.avg("draw_llh").between(5.0, 20.0).alias("draw_size_fits"))


@add("produce_toys_check", f"WITH {SAMPLE_SQL}, {ev_sql()} SELECT 50 AS n_toys, TRUE AS in_chain, TRUE AS rate_fits, (SELECT sum(w0) FROM es) AS nominal FROM (SELECT 1)", "nominal")
def _(spark, path):
    chain = ev_chain(spark, path).withColumn("norm_a", F.lit(1.0)).withColumn("norm_n", F.lit(1.0)).withColumn("norm_o", F.lit(1.0))
    out, info = plans.toys_from_chain(chain, binned_sample(spark, path), NORMS, {"modes": "mode", "channels": "channel"}, 50, ["norm_a", "norm_n", "norm_o"])
    nominal = event_sample(spark, path).agg(F.sum("w0").alias("nominal"))
    rates = out.groupBy("toy").agg(F.sum("mc").alias("rate"))  # all factors 1: each toy is the nominal prediction
    found = info.join(chain.select(F.col("step").alias("draw")), "draw", "left_semi").agg(F.count(F.lit(1)).alias("found"))
    side = rates.agg(F.count(F.lit(1)).cast("int").alias("n_toys"), F.min("rate").alias("a"), F.max("rate").alias("b"))
    one = side.join(F.broadcast(nominal)).join(F.broadcast(found))  # single rows
    return one.select("n_toys", (F.col("found") == 50).alias("in_chain"), ((F.col("b") - F.col("nominal") < 1e-6 * F.col("nominal")) & (
        F.col("nominal") - F.col("a") < 1e-6 * F.col("nominal"))).alias("rate_fits"), "nominal")


@add("prior_violin_check", f"{EVENTS} SELECT param, count(*)::DOUBLE AS n, TRUE AS mean_fits FROM ch, (VALUES ('root'), ('k')) p(param) GROUP BY param", "n")
def _(spark, path):
    priors = {"root": (8.0, 1.0), "k": (50.0, 5.0)}
    out = hist.prior_violin(ev_chain(spark, path), priors)
    centre = (F.col("lo") + F.col("hi")) / 2
    summed = out.groupBy("param").agg(F.sum("content").alias("n"), (F.sum(centre * F.col("content")) / F.sum("content")).alias("m"), F.first(F.col("hi") - F.col("lo")).alias("w"))
    wanted = F.when(F.col("param") == "root", 8.0).otherwise(50.0)
    error = F.when(F.col("param") == "root", 1.0).otherwise(5.0) / F.sqrt("n")
    return summed.select("param", "n", near(F.col("m"), wanted, error + F.col("w") / 10).alias("mean_fits"))


@add("postfit_gauss_check", f"WITH {LI_SQL} SELECT param, TRUE AS inside FROM (VALUES {', '.join(f'({c!r})' for c in LI)}) p(param)")
def _(spark, path):
    """A fit that converged has its mean inside the histogram and a width below its span."""
    h = li_hist(spark, path)
    span = h.groupBy("param").agg(F.min("lo").alias("a"), F.max("hi").alias("b"))
    fits = hist.postfit_gauss(h).join(span, "param")
    inside = (F.col("gauss_mean") > 2 * F.col("a") - F.col("b")) & (F.col("gauss_mean") < 2 * F.col("b") - F.col("a")) & (F.col("gauss_sigma") > 0)
    return fits.select("param", (~F.col("converged") | inside).alias("inside"))


@add("power_spectrum_fit_check", f"{EVENTS} SELECT param, TRUE AS within_limits, TRUE AS step_follows FROM (VALUES ('val'), ('root'), ('k')) p(param)")
def _(spark, path):
    spectrum = convergence.power_spectrum(ev_chain(spark, path), EV)
    n = spectrum.groupBy("param").agg(F.count(F.lit(1)).alias("n"))
    fits = convergence.power_spectrum_fit(spectrum).join(n, "param")
    limits = F.col("p0").between(0, 100) & F.col("k_star").between(0.001, 1) & F.col("alpha").between(0, 5)
    return fits.select("param", limits.alias("within_limits"), (
        F.abs(F.col("step_size") - F.sqrt(F.col("p0") / (0.5 * F.col("n")))) < 1e-9).alias("step_follows"))


# -- files: written, read back and compared -------------------------------------


def _place(spark) -> str:
    return f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"


@add("toys_on_disk", f"{TOYS} SELECT toy, sample_id, bin, mc, w2 FROM toys WHERE mc > 0", "mc w2")
def _(spark, path):
    place = _place(spark)
    table_ = toy_table(spark, path)
    toy_files.write_toys(table_, table_.select("toy").distinct().withColumn("weight", F.lit(1.0)), place)
    return toy_files.load_toys(spark, place)[0].select("toy", "sample_id", "bin", "mc", "w2")


@add("rate_table_on_disk", f"WITH {SAMPLE_SQL} SELECT mode, channel, sum(w0) AS rate, CAST(grouping_id(mode, channel) AS INTEGER) AS level FROM es GROUP BY CUBE (mode, channel)", "rate")
def _(spark, path):
    place = _place(spark)
    events.write_rate_table(events.rate_table(event_sample(spark, path)), place)
    return spark.read.option("header", True).csv(place).select(
        "mode", "channel", F.col("rate").cast("double").alias("rate"), F.col("level").cast("int").alias("level"))


@add("merged_chains", f"WITH {ev_sql(3)} SELECT chain_id, count(*) AS n, sum(val) AS total FROM ch GROUP BY chain_id", "total")
def _(spark, path):
    place = _place(spark)
    chain = ev_chain(spark, path, 3).drop("event_type")
    for i in range(3):
        chain.filter(F.col("chain_id") == i).write.parquet(f"{place}/in_{i}")
    merged = chains.merge_chains(spark, [f"{place}/in_{i}" for i in range(3)], f"{place}/out")
    return merged.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"), F.sum("val").alias("total"))


@add("postfit_on_disk", f"""WITH {LI_SQL}, {MODEL_SQL}, lng AS ({long_sql(LI, weight='Weight')}), pf AS ({POSTFIT})
 SELECT param, prior, error, mean, rms, FALSE AS is_fixed FROM pf JOIN pm ON param = name""", "prior error mean rms")
def _(spark, path):
    """The post-fit table written and read back."""
    place = _place(spark)
    chains.write_postfit(hist.postfit_summary(li_chain(spark, path), LI, "Weight", li_model(spark)), place)
    return spark.read.parquet(place)


@add("merged_chains_same_id", f"WITH {ev_sql(3)}, b AS (SELECT chain_id, val FROM ch UNION ALL SELECT 3 + chain_id, val FROM ch WHERE chain_id < 2) SELECT CAST(chain_id AS INTEGER) AS chain_id, count(*) AS n, sum(val) AS total FROM b GROUP BY chain_id", "total")
def _(spark, path):
    place = _place(spark)
    chain = ev_chain(spark, path, 3).drop("event_type")
    chain.write.parquet(f"{place}/in_0")
    chain.filter("chain_id < 2").write.parquet(f"{place}/in_1")
    merged = chains.merge_chains(spark, [f"{place}/in_0", f"{place}/in_1"], f"{place}/out")
    return merged.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"), F.sum("val").alias("total"))


@add("same_chain_id_in_two_files", f"WITH {ev_sql()}, b AS (SELECT 0 AS chain_id, val FROM ch UNION ALL SELECT 1, val FROM ch) SELECT CAST(chain_id AS INTEGER) AS chain_id, count(*) AS n, sum(val) AS total FROM b GROUP BY chain_id", "total")
def _(spark, path):
    place = _place(spark)
    ev_chain(spark, path).drop("event_type").write.parquet(place)
    both = chains.read_chain(spark, [place, place])
    return both.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"), F.sum("val").alias("total"))


# -- values that are missing, not numbers, constant or on an edge ---------------

ODD_SQL = f"""WITH {LI_SQL}, od AS (SELECT chain_id, Weight, CASE WHEN qty % 7 = 0 THEN NULL ELSE qty END AS a, CASE WHEN tax = 0.01 THEN 'nan'::DOUBLE ELSE tax END AS b, 3.0::DOUBLE AS c, disc FROM ch)"""


def odd_chain(spark, path):
    """qty with nulls, tax with NaN, a constant, and a complete parameter."""
    chain = li_chain(spark, path)
    return chain.select("chain_id", "Weight", F.when(F.col("qty") % 7 != 0, F.col("qty")).alias("a"),
                        F.when(F.col("tax") == 0.01, F.lit(float("nan"))).otherwise(F.col("tax")).alias("b"), F.lit(3.0).alias("c"), "disc")


@add("value_problems", f"""{ODD_SQL} SELECT 'a' AS param, count(*) AS n, count(*) - count(a) AS n_null, 0 AS n_nan FROM od UNION ALL
 SELECT 'b', count(*), 0, count(*) FILTER (isnan(b)) FROM od UNION ALL SELECT 'c', count(*), 0, 0 FROM od""")
def _(spark, path):
    return hist.value_problems(odd_chain(spark, path), ["a", "b", "c"])


@add("posterior_hist_odd_values", f"""{ODD_SQL}, l AS (SELECT 'a' AS param, a AS v FROM od WHERE a IS NOT NULL UNION ALL SELECT 'b', b FROM od WHERE NOT isnan(b) UNION ALL SELECT 'c', c FROM od),
 r AS (SELECT param, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM l GROUP BY param)
 SELECT l.param, CAST(least(floor(8 * (v - lo) / (hi - lo)), 7) AS INTEGER) AS bin, count(*)::DOUBLE AS content FROM l JOIN r ON l.param = r.param WHERE v < hi GROUP BY ALL""", "content")
def _(spark, path):
    return hist.posterior_hist(odd_chain(spark, path), ["a", "b", "c"], 8).filter("content > 0").select("param", "bin", "content")


INF_SQL = f"""WITH {LI_SQL}, od AS (SELECT CASE WHEN qty % 7 = 0 THEN 'inf'::DOUBLE WHEN qty % 11 = 0 THEN '-inf'::DOUBLE ELSE qty END AS a,
 CASE WHEN tax = 0.01 THEN 'nan'::DOUBLE WHEN disc = 0.02 THEN 'inf'::DOUBLE ELSE price END AS b FROM ch), l AS (
 SELECT 'a' AS param, a AS v FROM od WHERE isfinite(a) UNION ALL SELECT 'b', b FROM od WHERE isfinite(b))"""


def infinite_chain(spark, path):
    """qty with infinite values of both signs, price with infinite ones and NaN."""
    inf = float("inf")
    return li_chain(spark, path).select(
        F.when(F.col("qty") % 7 == 0, inf).when(F.col("qty") % 11 == 0, -inf).otherwise(F.col("qty")).alias("a"),
        F.when(F.col("tax") == 0.01, float("nan")).when(F.col("disc") == 0.02, inf).otherwise(F.col("price")).alias("b"))


@add("posterior_hist_infinite_values", f"""{INF_SQL}, r AS (SELECT param, min(v) AS lo, max(v) AS hi FROM l GROUP BY param)
 SELECT l.param, CAST(least(floor(8 * (v - lo) / (hi - lo)), 7) AS INTEGER) AS bin, count(*)::DOUBLE AS content FROM l JOIN r ON l.param = r.param WHERE v < hi GROUP BY ALL""", "content")
def _(spark, path):
    return hist.posterior_hist(infinite_chain(spark, path), ["a", "b"], 8).filter("content > 0").select("param", "bin", "content")


@add("exact_medians_infinite_values", f"{INF_SQL} SELECT param, median(v) AS median FROM l GROUP BY param", "median")
def _(spark, path):
    found = convergence.exact_medians(infinite_chain(spark, path), ["a", "b"], bins=8, leaf=500)
    return spark.createDataFrame(list(found.items()), "param string, median double")


@add("value_problems_infinite", f"""{INF_SQL} SELECT 'a' AS param, count(*) AS n, 0 AS n_null, count(*) FILTER (NOT isfinite(a)) AS n_nan FROM od
 UNION ALL SELECT 'b', count(*), 0, count(*) FILTER (NOT isfinite(b)) FROM od""")
def _(spark, path):
    return hist.value_problems(infinite_chain(spark, path), ["a", "b"])


def _odd_cov(spark, path, method):
    return moments.covariance(odd_chain(spark, path), ["a", "b", "disc"], "Weight", method=method).select("param_i", "param_j", "cov")


ODD_COV = f"{ODD_SQL}, cm AS (SELECT * FROM od WHERE a IS NOT NULL AND NOT isnan(b)), m AS (SELECT sum(Weight * a) / sum(Weight) AS ma, sum(Weight * b) / sum(Weight) AS mb, sum(Weight * disc) / sum(Weight) AS md FROM cm) " + " UNION ALL ".join(
    f"SELECT '{x}' AS param_i, '{y}' AS param_j, sum(Weight * ({x} - m{x[0]}) * ({y} - m{y[0]})) / sum(Weight) AS cov FROM cm, m"
    for x in ("a", "b", "disc") for y in ("a", "b", "disc"))


@add("covariance_odd_values", ODD_COV, "cov", digits=7)
def _(spark, path):
    return _odd_cov(spark, path, "sql")


@add("covariance_odd_values_by_blocks", ODD_COV, "cov", digits=7)
def _(spark, path):
    return _odd_cov(spark, path, "blocks")


EDGES = [0.1 * i for i in range(601)]


@add("var_hist_long_axis", f"WITH {SAMPLE_SQL}, e AS (SELECT i.range AS bin, 0.1::DOUBLE * i.range AS lo, 0.1::DOUBLE * (i.range + 1) AS hi FROM range(600) i), v AS (SELECT x, count(*) AS n FROM es GROUP BY x)"
     " SELECT CAST(bin AS INTEGER) AS bin, sum(n)::DOUBLE AS content FROM v JOIN e ON x >= lo AND x < hi GROUP BY bin", "content")
def _(spark, path):
    return events.var_hist_1d(event_sample(spark, path), "x", EDGES, weight=None).select("bin", "content")


@add("pca_keep_one", f"""WITH {LI_SQL}, t AS (SELECT 0.5 * atan2(200.0::DOUBLE, 7e8::DOUBLE - 0.001::DOUBLE) AS th)
 SELECT chain_id, sum(qty) AS qty_sum, sum(cos(th) * (cos(th) * price + sin(th) * disc)) AS price_sum, sum(sin(th) * (cos(th) * price + sin(th) * disc)) AS disc_sum FROM ch, t GROUP BY chain_id""",
     "qty_sum price_sum disc_sum", digits=7)
def _(spark, path):
    """The smaller eigenvalue of the block falls below the threshold: its direction is lost on the way back."""
    cov = np.diag([200.0, 7e8, 0.001, 0.0007])
    cov[1, 2] = cov[2, 1] = 100.0
    transfer = predict.pca_basis(cov, 1, 2, 0.5)
    there = predict.pca_transform(li_chain(spark, path), LI, transfer, keep=("chain_id",))
    back = predict.pca_transform(there, LI, transfer, inverse=True, keep=("chain_id",))
    return back.groupBy("chain_id").agg(*[F.sum(c).alias(f"{c}_sum") for c in ("qty", "price", "disc")])
