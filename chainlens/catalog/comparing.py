"""Queries that compare chains, models and priors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chainlens.catalog.chains import (
    HIST, J_SQL, LI_MODEL, MODEL_SQL, OSC, OSC_SQL, POSTFIT, li_hist, li_model, osc_chain,
)
from chainlens.catalog.registry import LI, LI_SQL, add, hist_sql, li_chain, long_sql
from chainlens.operators import compare as ops
from chainlens.operators import hist, intervals, predict

BY_CHAIN = f"WITH {LI_SQL}, {hist_sql(LI, keys='chain_id')}"


def chain_hist(spark, path):
    chain = li_chain(spark, path)
    return hist.posterior_hist(chain, LI, keys=("chain_id",))


@add("compare_chains", f"""{BY_CHAIN} SELECT a.chain_id, a.param, a.bin, a.lo, a.hi, a.content, b.content AS first_content FROM hist a
 JOIN hist b ON b.chain_id = 0 AND a.param = b.param AND a.bin = b.bin WHERE a.chain_id <> 0""", "lo hi content first_content")
def _(spark, path):
    return intervals.compare_chains(chain_hist(spark, path))


@add("ks_distance", f"""{BY_CHAIN}, c AS (SELECT *, sum(content) OVER (PARTITION BY chain_id, param ORDER BY bin) /
 sum(content) OVER (PARTITION BY chain_id, param) AS cdf FROM hist), g AS (SELECT a.chain_id, a.param, a.bin, abs(a.cdf - b.cdf) AS d,
 (a.lo + a.hi) / 2 AS "at" FROM c a JOIN c b ON b.chain_id = 0 AND a.param = b.param AND a.bin = b.bin WHERE a.chain_id <> 0)
 SELECT chain_id, param, d, "at" FROM g QUALIFY row_number() OVER (PARTITION BY chain_id, param ORDER BY d DESC, bin) = 1""", 'd "at"')
def _(spark, path):
    return intervals.ks_distance(chain_hist(spark, path))


PAIR = f"""{BY_CHAIN}, dt AS (SELECT param, bin, content AS d FROM hist WHERE chain_id = 0),
 mc AS (SELECT param, bin, content AS m FROM hist WHERE chain_id = 1)"""


def pair(spark, path):
    both = chain_hist(spark, path)
    return [both.filter(F.col("chain_id") == c).drop("chain_id") for c in (0, 1)]


@add("anderson_darling_curve", f"""{PAIR}, c AS (SELECT dt.param, dt.bin, sum(d) OVER w / sum(d) OVER p AS f_d, sum(m) OVER w / sum(m) OVER p AS f_m,
 sum(d + m) OVER w / sum(d + m) OVER p AS f_j FROM dt JOIN mc ON dt.param = mc.param AND dt.bin = mc.bin
 WINDOW w AS (PARTITION BY dt.param ORDER BY dt.bin), p AS (PARTITION BY dt.param))
 SELECT *, CASE WHEN f_j * (1 - f_j) > 0 THEN abs(f_d - f_m) / sqrt(f_j * (1 - f_j)) ELSE 0.0 END AS ad FROM c""", "f_d f_m f_j ad")
def _(spark, path):
    return intervals.anderson_darling_curve(*pair(spark, path), ["param"])


@add("kl_divergence", f"""{PAIR}, n AS (SELECT param, d / sum(d) OVER (PARTITION BY param) AS p, bin FROM dt),
 q AS (SELECT param, m / sum(m) OVER (PARTITION BY param) AS q, bin FROM mc)
 SELECT n.param, sum(p * ln(p / q)) AS kl FROM n JOIN q ON n.param = q.param AND n.bin = q.bin WHERE p > 0 AND q > 0 GROUP BY n.param""",
     "kl")
def _(spark, path):
    return hist.kl_divergence(*pair(spark, path), ["param"])


@add("hist_ratio", f"""{PAIR} SELECT dt.param, dt.bin, d AS content, m AS below, CASE WHEN m <> 0 THEN d / m END AS ratio
 FROM dt JOIN mc ON dt.param = mc.param AND dt.bin = mc.bin""", "content below ratio")
def _(spark, path):
    a, b = pair(spark, path)
    return hist.ratio(a.drop("lo", "hi"), b, ["param", "bin"])


BAYES = [("qty", "low", "high", 1.0, 20.0, 20.0, 50.0), ("disc", "small", "large", 0.0, 0.01, 0.02, 0.1),
         ("tax", "half", "rest", 0.0, 0.0401, 0.0402, 0.08)]
LABELS = """CASE WHEN b < 0 THEN 'Negative' WHEN b < 5 THEN 'Barely worth mentioning' WHEN b < 10 THEN 'Substantial'
 WHEN b < 15 THEN 'Strong' WHEN b < 20 THEN 'Very strong' WHEN b IS NOT NULL THEN 'Decisive' END"""
SIGMAS = """CASE WHEN {b} < 2.125 THEN '< 1 #sigma' WHEN {b} < 20.74 THEN '> 1 #sigma' WHEN {b} < 369.4 THEN '> 2 #sigma'
 WHEN {b} < 15800 THEN '> 3 #sigma' WHEN {b} < 1745000 THEN '> 4 #sigma' WHEN {b} IS NOT NULL THEN '> 5 #sigma' END"""


@add("bayes_factor", f"""{HIST}, cs AS (SELECT * FROM (VALUES {', '.join(map(str, BAYES))}) t(param, name1, name2, lo1, hi1, lo2, hi2)),
 i AS (SELECT hist.param, name1, name2, sum(CASE WHEN hi > lo1 AND lo <= hi1 THEN content ELSE 0 END) AS i1,
 sum(CASE WHEN hi > lo2 AND lo <= hi2 THEN content ELSE 0 END) AS i2 FROM hist JOIN cs ON hist.param = cs.param GROUP BY ALL),
 f AS (SELECT *, CASE WHEN least(i1, i2) <> 0 THEN greatest(i1, i2) / least(i1, i2) END AS b FROM i)
 SELECT param, name1, name2, i1, i2, CASE WHEN i1 >= i2 THEN name1 ELSE name2 END AS favoured, b AS bayes_factor,
 {LABELS} AS jeffreys, {SIGMAS.format(b='b')} AS dunne_kaboth FROM f""", "i1 i2 bayes_factor")
def _(spark, path):
    cases = spark.createDataFrame(BAYES, "param string, name1 string, name2 string, lo1 double, hi1 double, lo2 double, hi2 double")
    return ops.bayes_factor(li_hist(spark, path), cases)


SAVAGE = [("qty", 24.3, 0.0, 60.0), ("disc", 0.0512, 0.0, 0.2), ("tax", 0.0333, 0.0, 0.2), ("price", 30001.0, 0.0, 200000.0)]


@add("savage_dickey", f"""{HIST}, {MODEL_SQL}, cs AS (SELECT param, CAST(point AS DOUBLE) AS point, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b
 FROM (VALUES {', '.join(map(str, SAVAGE))}) t(param, point, a, b)),
 d AS (SELECT *, content / sum(content) OVER (PARTITION BY param) / (hi - lo) AS posterior FROM hist),
 s AS (SELECT d.param, point, posterior, CASE WHEN flat THEN CASE WHEN point >= a AND point < b THEN 1 / (b - a) ELSE 0 END
 ELSE exp(-0.5 * ((point - prior) / error) * ((point - prior) / error)) / (error * sqrt(2 * pi())) END AS prior_density
 FROM d JOIN cs ON d.param = cs.param JOIN pm ON name = d.param WHERE lo <= point AND point < hi)
 SELECT *, CASE WHEN prior_density > 0 THEN posterior / prior_density END AS savage_dickey,
 {SIGMAS.format(b='(CASE WHEN prior_density > 0 THEN posterior / prior_density END)')} AS dunne_kaboth FROM s""",
     "point posterior prior_density savage_dickey")
def _(spark, path):
    cases = spark.createDataFrame(SAVAGE, "param string, point double, lo double, hi double")
    return ops.savage_dickey(li_hist(spark, path), cases, li_model(spark))


@add("prior_pull", f"""WITH {LI_SQL}, {MODEL_SQL}, lng AS ({long_sql(LI, weight='Weight')}), pf AS ({POSTFIT})
 SELECT param, (mean - prior) / (CASE WHEN error > 1e-5 THEN error ELSE 1 END) AS pull,
 rms / (CASE WHEN error > 1e-5 THEN error ELSE 1 END) AS pull_error FROM pf JOIN pm ON param = name""", "pull pull_error")
def _(spark, path):
    return ops.prior_pull(hist.postfit_summary(li_chain(spark, path), LI, "Weight"), li_model(spark))


@add("relative_to_prior", """SELECT s_name AS name, CAST(1 AS DOUBLE) AS central, CASE WHEN s_nationkey % 5 = 0 THEN 0.0
 ELSE CASE WHEN s_nationkey = 7 THEN s_acctbal ELSE s_acctbal / s_nationkey END END AS error FROM supplier""", "central error")
def _(spark, path):
    from chainlens.catalog.registry import table
    params = table(spark, path, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("error"), (F.col("s_nationkey") % 5 == 0).alias("flat"),
        F.when(F.col("s_nationkey") == 7, 0.0).otherwise(F.col("s_nationkey").cast("double")).alias("prior"))
    return ops.relative_to_prior(params, hide_flat=True)


# -- penalties -----------------------------------------------------------------

ERRORS = 1.0123456789 * np.array([p["error"] for p in LI_MODEL])
CORR = np.eye(4)
CORR[0, 1] = CORR[1, 0] = 0.3
CORR[1, 3] = CORR[3, 1] = -0.2
COV = CORR * np.outer(ERRORS, ERRORS)
INVERSE = np.linalg.inv(COV)
PRIOR = [p["prior"] for p in LI_MODEL]
FLAT = [p.get("flat", False) for p in LI_MODEL]
BOUNDS = [(2.0, 49.0), (1000.0, 90000.0), (None, 0.09), (0.01, None)]
SETS = [{"set": "rates", "prefixes": ["disc", "tax"], "exclude": False},
        {"set": "others", "prefixes": ["disc", "tax"], "exclude": True},
        {"set": "all", "prefixes": [], "exclude": True}]


def quad_sql(use) -> str:
    terms = [f"0.5 * ({LI[i]} - {PRIOR[i]!r}) * ({LI[j]} - {PRIOR[j]!r}) * CAST({float(INVERSE[i][j])!r} AS DOUBLE)"
             for i in range(4) for j in range(4) if use[i] and use[j] and not FLAT[i] and not FLAT[j]]
    return " + ".join(terms) or "0.0"


@add("penalty_term", f"""WITH {LI_SQL}, p AS (SELECT chain_id, qty, price, disc, tax, {quad_sql([0, 0, 1, 1])} AS penalty_rates,
 {quad_sql([1, 1, 0, 0])} AS penalty_others, {quad_sql([1, 1, 1, 1])} AS penalty_all FROM ch) SELECT * FROM p""",
     "qty price disc tax penalty_rates penalty_others penalty_all")
def _(spark, path):
    return predict.penalty_term(li_chain(spark, path).drop("Weight"), LI, PRIOR, COV, SETS, FLAT)


def _outside() -> str:
    tests = []
    for c, (lo, hi) in zip(LI, BOUNDS):
        t = " OR ".join([f"{c} < {lo}"] * (lo is not None) + [f"{c} > {hi}"] * (hi is not None))
        tests.append(f"CASE WHEN {t} THEN 1 ELSE 0 END")
    return " + ".join(tests)


@add("prior_llh", f"""WITH {LI_SQL}, p AS (SELECT chain_id, qty, price, CASE WHEN {_outside()} > 0 THEN ({_outside()}) * CAST(1234567890 AS DOUBLE)
 ELSE {quad_sql([1, 1, 1, 1])} END AS prior_llh FROM ch) SELECT * FROM p""", "qty price prior_llh")
def _(spark, path):
    chain = li_chain(spark, path)
    return predict.prior_llh(chain, LI, PRIOR, COV, BOUNDS, FLAT).select("chain_id", "qty", "price", "prior_llh")


# -- Jarlskog ------------------------------------------------------------------

ORDERINGS = f"""{OSC_SQL}, j0 AS (SELECT *, {J_SQL} AS J FROM ch),
 jo AS (SELECT 'both' AS ordering, * FROM j0 UNION ALL SELECT CASE WHEN dm2 > 0 THEN 'normal' ELSE 'inverted' END, * FROM j0 WHERE dm2 <> 0),
 jw AS (SELECT *, 'flat' AS phase_prior, Weight AS w0 FROM jo UNION ALL SELECT *, 'flat_sin', Weight * abs(cos(delta)) FROM jo)"""
JHIST = "WITH " + ORDERINGS + ", " + hist_sql(
    ["J"], 1000, keys="ordering, phase_prior", source="jw", weight="w0",
    ranges="SELECT 'J' AS param, CAST(-0.05 AS DOUBLE) AS a, CAST(0.05 AS DOUBLE) AS b")


@add("jarlskog_posterior", f"{JHIST} SELECT ordering, phase_prior, param, bin, lo, hi, content FROM hist", "lo hi content")
def _(spark, path):
    return ops.jarlskog_posterior(osc_chain(spark, path), OSC, "Weight")


@add("jarlskog_outside", f"""WITH {ORDERINGS} SELECT ordering, phase_prior, sum(CASE WHEN J < -0.01::DOUBLE THEN w0 ELSE 0.0 END) AS below, sum(CASE WHEN J >= 0.01::DOUBLE THEN w0 ELSE 0.0 END) AS above
 FROM jw GROUP BY ALL""", "below above", digits=7)
def _(spark, path):
    return ops.jarlskog_outside(osc_chain(spark, path), OSC, "Weight", 0.01)


@add("jarlskog_intervals", f"""{JHIST}, kept AS (SELECT * FROM (SELECT *, coalesce(sum(content) OVER (PARTITION BY ordering, phase_prior
 ORDER BY content DESC, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(content) OVER (PARTITION BY ordering, phase_prior) AS total
 FROM hist WHERE content > 0), (VALUES (0.99), (0.90), (0.68)) t(level) WHERE before / total < level)
 SELECT ordering, phase_prior, CAST(level AS DOUBLE) AS level, min(lo) AS lo, max(hi) AS hi, count(*) AS n_bins, sum(content) AS content
 FROM kept GROUP BY ALL""", "level lo hi content")
def _(spark, path):
    return ops.jarlskog_intervals(ops.jarlskog_posterior(osc_chain(spark, path), OSC, "Weight"))


PI_SQL = "CAST(3.141592653589793 AS DOUBLE)"


@add("jarlskog_posterior_2d", f"""WITH {ORDERINGS}, b AS (SELECT ordering, phase_prior, w0, CAST(least(floor(500 * (J - CAST(-0.05 AS DOUBLE)) / (CAST(0.05 AS DOUBLE) - CAST(-0.05 AS DOUBLE))), 499) AS INTEGER) AS bin_x,
 CASE WHEN s23 >= 0.3 AND s23 < 0.7 THEN CAST(least(floor(500 * (s23 - CAST(0.3 AS DOUBLE)) / (CAST(0.7 AS DOUBLE) - CAST(0.3 AS DOUBLE))), 499) AS INTEGER) END AS b23,
 CASE WHEN delta >= -{PI_SQL} AND delta < {PI_SQL} THEN CAST(least(floor(500 * (delta - (-{PI_SQL})) / ({PI_SQL} - (-{PI_SQL}))), 499) AS INTEGER) END AS bd
 FROM jw WHERE J >= -0.05 AND J < 0.05), u AS (SELECT ordering, phase_prior, 'J' AS param_x, 'theta23' AS param_y, bin_x, b23 AS bin_y, sum(w0) AS content
 FROM b WHERE b23 IS NOT NULL GROUP BY ALL UNION ALL SELECT ordering, phase_prior, 'J', 'delta', bin_x, bd, sum(w0) FROM b WHERE bd IS NOT NULL GROUP BY ALL)
 SELECT * FROM u""", "content")
def _(spark, path):
    return ops.jarlskog_posterior_2d(osc_chain(spark, path), OSC, "Weight")


@add("jarlskog_prior")
def _(spark, path):
    return ops.jarlskog_prior(osc_chain(spark, path), {"sin2_13": (0.022, 0.0007), "sin2_12": (0.307, 0.013), "sin2_23": None})
