"""Queries of the convergence diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlens.catalog.registry import EV, add, ev_chain, ev_sql, long_sql
from chainlens.operators import convergence as ops

EV1 = ev_sql()
LNG = f"WITH {EV1}, lng AS ({long_sql(EV, 'chain_id, step')})"


@add("trace", f"{LNG} SELECT chain_id, step, param, value FROM lng", "value")
def _(spark, path):
    return ops.trace(ev_chain(spark, path), EV)


@add("trace_level", f"{LNG} SELECT chain_id, param, avg(value) AS level FROM lng WHERE step >= (SELECT count(*) // 2 FROM ch) GROUP BY ALL",
     "level")
def _(spark, path):
    return ops.trace_level(ev_chain(spark, path), EV, contiguous=True)


NB = 20
BATCHES = f"""{LNG}, n AS (SELECT count(*) // {NB} + 1 AS length FROM ch), bt AS (SELECT chain_id, param, step // length AS batch,
 length, sum(value) / max(length) AS mean FROM lng, n GROUP BY chain_id, param, step // length, length)"""


@add("batched_means", f"{BATCHES} SELECT chain_id, param, batch, length, mean FROM bt", "mean")
def _(spark, path):
    return ops.batched_means(ev_chain(spark, path), EV, NB, contiguous=True)


@add("batched_means_with_gaps", f"""WITH {ev_sql(4)}, lng AS ({long_sql(EV, 'chain_id, step')}), e AS (SELECT *, row_number() OVER (
 PARTITION BY chain_id, param ORDER BY step) - 1 AS entry, count(*) OVER (PARTITION BY chain_id, param) // {NB} + 1 AS length FROM lng)
 SELECT chain_id, param, entry // length AS batch, length, sum(value) / count(*) AS mean FROM e GROUP BY chain_id, param, entry // length, length""", "mean")
def _(spark, path):
    return ops.batched_means(ev_chain(spark, path, 4), EV, NB, exact_last=True)


def _batch_test(integer: bool) -> str:
    factor = f"floor(max(length) / {NB - 1})" if integer else f"max(length) / {NB - 1}.0"
    root = f"sqrt(floor({NB * NB - 1} / {NB - 2}))" if integer else f"sqrt({NB * NB - 1} / {NB - 2}.0)"
    return f"""{BATCHES}, d AS (SELECT *, sum(mean) OVER (PARTITION BY param) / {NB} - mean AS dev FROM bt),
 x AS (SELECT *, lead(dev) OVER (PARTITION BY param ORDER BY batch) AS nxt FROM d)
 SELECT chain_id, param, {factor} * sum(dev * dev) AS batch_variance, {root} * (sum(dev * nxt) / sum(dev * dev)
 + sum(CASE WHEN batch IN (0, {NB - 1}) THEN dev * dev END) / (2 * sum(dev * dev))) AS c_statistic FROM x GROUP BY chain_id, param, length"""


@add("batch_variance_test", _batch_test(False), "batch_variance c_statistic")
def _(spark, path):
    return ops.batch_variance_test(ops.batched_means(ev_chain(spark, path), EV, NB, contiguous=True), NB)


@add("batch_variance_test_integer", _batch_test(True), "batch_variance c_statistic")
def _(spark, path):
    return ops.batch_variance_test(ops.batched_means(ev_chain(spark, path), EV, NB, contiguous=True), NB, True)


LAGS = 1000
ACF = f"""WITH {EV1}, c AS (SELECT step, {', '.join(f'{p} - avg({p}) OVER () AS {p}' for p in EV)} FROM ch),
 s AS (SELECT CAST(l.range AS INTEGER) AS lag, {', '.join(f'sum(a.{p} * b.{p}) AS {p}' for p in EV)}
 FROM c a, range({LAGS}) l, c b WHERE b.step = a.step + l.range GROUP BY 1),
 acf AS ({' UNION ALL '.join(f"SELECT 0 AS chain_id, '{p}' AS param, lag, {p} / (SELECT {p} FROM s WHERE lag = 0) AS r FROM s" for p in EV)})"""


def _acf(spark, path):
    return ops.autocorrelation(ev_chain(spark, path), EV, LAGS, block=4096)


@add("autocorrelation", f"{ACF} SELECT * FROM acf", "r", digits=7)
def _(spark, path):
    return _acf(spark, path)


@add("effective_sample_size", f"""{ACF}, d AS (SELECT chain_id, param, 1 + 2 * sum(r) AS den FROM acf GROUP BY ALL)
 SELECT chain_id, param, (SELECT count(*) FROM ch) / den AS ess, 100 / den AS efficiency,
 CAST(CASE WHEN abs(1 / den) <= 1 AND abs(1 / den) > 0.02 THEN 0 WHEN abs(1 / den) <= 0.02 AND abs(1 / den) > 0.005 THEN 1
 WHEN abs(1 / den) <= 0.005 AND abs(1 / den) > 0.001 THEN 2 WHEN abs(1 / den) <= 0.001 AND abs(1 / den) > 0.0001 THEN 3
 WHEN abs(1 / den) <= 0.0001 AND abs(1 / den) > 0 THEN 4 END AS INTEGER) AS ess_class FROM d""", "ess efficiency", digits=7)
def _(spark, path):
    return ops.effective_sample_size(_acf(spark, path), ev_chain(spark, path))


@add("average_autocorrelation", f"""{ACF}, ok AS (SELECT param FROM acf GROUP BY param HAVING
 count(CASE WHEN lag >= 1 AND abs(r - 1) > 0.001 THEN 1 END) > 100 AND max(r) > 0)
 SELECT chain_id, lag, avg(r) AS mean_r, min(r) AS min_r, max(r) AS max_r, count(*) AS n_params
 FROM acf WHERE param IN (SELECT param FROM ok) GROUP BY ALL""", "mean_r min_r max_r", digits=7)
def _(spark, path):
    return ops.average_autocorrelation(_acf(spark, path))


# All lags of the operator's default; the SQL above has LAGS of them. A test holds these against sums over a small chain.
def _acf_all(spark, path):
    return ops.autocorrelation(ev_chain(spark, path), EV)


@add("autocorrelation_all_lags")
def _(spark, path):
    return _acf_all(spark, path)


@add("effective_sample_size_all_lags")
def _(spark, path):
    return ops.effective_sample_size(_acf_all(spark, path), ev_chain(spark, path))


@add("average_autocorrelation_all_lags")
def _(spark, path):
    return ops.average_autocorrelation(_acf_all(spark, path))


def _geweke(param: str) -> str:
    return f"""SELECT 0 AS chain_id, '{param}' AS param, CAST(t.k AS INTEGER) AS k, abs(avg(ch.{param}) - max(u.m)) / sqrt(var_pop(ch.{param}) + max(u.v)) AS t_score
 FROM thr t JOIN ch ON ch.step < t.thr, (SELECT avg({param}) AS m, var_pop({param}) AS v FROM ch WHERE step > 0.5 * (SELECT max(step) FROM ch)) u GROUP BY t.k"""


@add("geweke", f"""WITH {EV1}, thr AS (SELECT range AS k, CAST(floor(CAST(0.01 AS DOUBLE) * range * (SELECT max(step) FROM ch)) AS BIGINT) AS thr FROM range(1, 101)),
 g AS ({' UNION ALL '.join(_geweke(p) for p in EV)}) SELECT * FROM g""", "t_score", digits=8)
def _(spark, path):
    return ops.geweke(ev_chain(spark, path), EV)


@add("power_spectrum", f"""WITH {EV1}, z AS (SELECT count(*) - count(*) % 2 AS n, least(10000, count(*)) // 2 AS half FROM ch),
 t AS (SELECT j.range AS j, n, cos(2 * pi() * ((j.range * step) % n) / n) AS c, sin(2 * pi() * ((j.range * step) % n) / n) AS s, val, root, k
   FROM ch, z, range(5000) j WHERE step < n AND j.range < half),
 f AS (SELECT j, {', '.join(f'sum({p} * c) AS {p}_re, sum({p} * s) AS {p}_im' for p in EV)} FROM t GROUP BY 1),
 p AS ({' UNION ALL '.join(f"SELECT '{p}' AS param, j, ({p}_re * {p}_re + {p}_im * {p}_im) / n AS power FROM f, z" for p in EV)}),
 both_sides AS (SELECT param, j, power FROM p WHERE j < (SELECT half FROM z) - 1 OR j = 0 UNION ALL SELECT param, -j, power FROM p WHERE j > 0)
 SELECT 0 AS chain_id, param, CAST(j AS INTEGER) AS j, 2 * pi() * j / (SELECT n FROM z) AS k, power FROM both_sides""", "k power", digits=7)
def _(spark, path):
    return ops.power_spectrum(ev_chain(spark, path), EV, block=4096)


@add("power_spectrum_fit")
def _(spark, path):
    return ops.power_spectrum_fit(ops.power_spectrum(ev_chain(spark, path), EV))


EV4 = f"""WITH {ev_sql(4)}, cut AS (SELECT chain_id, floor(count(*) / 5) AS cut FROM ch GROUP BY 1),
 kept AS (SELECT ch.* FROM ch JOIN cut ON ch.chain_id = cut.chain_id AND step >= cut), lng AS ({long_sql(EV, 'chain_id, step', 'kept')})"""
RHAT = """co AS (SELECT param, chain_id, count(*) AS n, avg({x}) AS m, {var}({x}) AS v FROM {src} GROUP BY ALL),
 ov AS (SELECT param, {centre} AS mu, sum(n) AS total, count(*) AS chains FROM co GROUP BY param),
 q AS (SELECT co.param, total, chains, total // chains AS nn, avg(v) AS within, sum(n * (m - mu) * (m - mu)) / max(chains - 1) AS between
 FROM co JOIN ov ON co.param = ov.param GROUP BY co.param, total, chains),
 rh AS (SELECT *, (nn - 1) * within / nn + between / nn AS pooled FROM q)"""


@add("rhat", f"""{EV4}, {RHAT.format(x='value', var='var_pop', src='lng', centre='sum(n * m) / sum(n)')}
 SELECT param, chains, CAST(total AS BIGINT) AS total, within, between, sqrt(pooled / within) AS rhat, total * pooled / between AS ess,
 sqrt(pooled / within) > 1.1 AS not_converged FROM rh""", "within between rhat ess", digits=8)
def _(spark, path):
    return ops.rhat(ops.after_burn_in(ev_chain(spark, path, 4)), EV)


def _folded() -> str:
    plain = RHAT.format(x="value", var="var_samp", src="lng", centre="avg(m)")
    folded = RHAT.format(x="value", var="var_samp", src="fld", centre="avg(m)")
    for name in ("co", "ov", "rh"):
        folded = folded.replace(f"{name} AS", f"{name}2 AS").replace(f"FROM {name} ", f"FROM {name}2 ").replace(
            f"JOIN {name} ", f"JOIN {name}2 ").replace(f"{name}.", f"{name}2.")
    folded = folded.replace("q AS (", "q2 AS (").replace("FROM q)", "FROM q2)")
    return f"""{EV4}, md AS (SELECT param, median(value) AS median FROM lng GROUP BY param), {plain},
 fld AS (SELECT lng.param, chain_id, abs(value - median) AS value FROM lng JOIN md ON lng.param = md.param), {folded}
 SELECT rh.param, rh.chains, sqrt(rh.pooled / rh.within) AS rhat, rh.total * rh.pooled / rh.between AS ess,
 sqrt(rh2.pooled / rh2.within) AS rhat_folded, rh2.total * rh2.pooled / rh2.between AS ess_folded, median
 FROM rh JOIN rh2 ON rh.param = rh2.param JOIN md ON md.param = rh.param"""


@add("rhat_folded", _folded(), "rhat ess rhat_folded ess_folded median", digits=8)
def _(spark, path):
    return ops.rhat_folded(ops.after_burn_in(ev_chain(spark, path, 4)), EV)


@add("exact_medians", f"""WITH {EV1}, lng AS ({long_sql(EV)}) SELECT param, median(value) AS median FROM lng GROUP BY param""", "median")
def _(spark, path):
    found = ops.exact_medians(ev_chain(spark, path), EV, bins=64, leaf=50)
    return spark.createDataFrame(list(found.items()), "param string, median double")


@add("count_runs", f"""WITH {ev_sql(4)} SELECT chain_id, CAST(sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) AS BIGINT) AS runs
 FROM (SELECT chain_id, event_type, lag(event_type) OVER (PARTITION BY chain_id ORDER BY step) AS p FROM ch) GROUP BY 1""")
def _(spark, path):
    return ops.count_runs(ev_chain(spark, path, 4), "event_type", block=1000)
