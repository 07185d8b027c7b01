"""Queries on chains: reading, cuts, histograms, intervals, moments."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlens.catalog.registry import (
    EV, LI, LI_SQL, add, ev_chain, ev_sql, hist_sql, li_chain, long_sql, table,
)
from chainlens.operators import chain as ops
from chainlens.operators import hist, intervals, moments
from chainlens.sources import chains, model

EV1 = ev_sql()


# -- reading -------------------------------------------------------------------


@add("read_chain", "SELECT CAST(0 AS INTEGER) AS chain_id, count(*) AS entries, min(event_id) AS first_step,"
     " max(event_id) AS last_step FROM events")
def _(spark, path):
    chain = chains.read_chain(spark, [f"{path}/events.parquet"]).withColumnRenamed("event_id", "step")
    return chains.chain_summary(chain)


@add("chain_columns", """SELECT CAST(column_index AS INTEGER) AS idx, column_name AS "column",
 CASE WHEN column_name IN ('chain_id','step','accProb','stepTime','LogL','Weight') THEN 'bookkeeping' ELSE 'other' END AS kind
 FROM (SELECT row_number() OVER () - 1 AS column_index, column_name FROM (DESCRIBE lineitem))""")
def _(spark, path):
    return chains.classify_columns(spark, table(spark, path, "lineitem").columns)


@add("union_chains", """SELECT chain_id, count(*) AS n, sum(l_quantity) AS total FROM (
 SELECT 0 AS chain_id, l_quantity FROM lineitem UNION ALL SELECT 1 AS chain_id, l_quantity FROM lineitem) GROUP BY 1""", "total")
def _(spark, path):
    both = chains.read_chain(spark, [f"{path}/lineitem.parquet"] * 2)
    return both.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))


@add("check_same_columns", """SELECT CAST(chain AS INTEGER) AS chain, missing FROM (
 SELECT 1 AS chain, column_name AS missing FROM (DESCRIBE lineitem) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE orders))
 UNION ALL SELECT 0, column_name FROM (DESCRIBE orders) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE lineitem)))""")
def _(spark, path):
    return chains.check_same_columns(spark, [table(spark, path, "lineitem"), table(spark, path, "orders")])


@add("merge_check_configs", r"""SELECT source, count(DISTINCT digest) AS n_configs, count(*) AS n_files,
 count(DISTINCT digest) = 1 AS mergeable FROM (SELECT source, md5(array_to_string(list_filter(string_split(text, chr(10)),
 lambda x: NOT contains(x, 'OutputFile:') AND NOT contains(x, 'NSteps:')), chr(10))) AS digest FROM documents) GROUP BY source""")
def _(spark, path):
    docs = table(spark, path, "documents").select("source", F.col("text").alias("config"))
    return chains.config_groups(docs, ["source"])


@add("merge_check_integrals", """SELECT hist, min(integral) AS low, max(integral) AS high, count(*) AS n_files,
 max(integral) - min(integral) > 1e-6 AS conflict FROM (SELECT l_suppkey AS path, l_returnflag AS hist,
 sum(l_quantity) AS integral FROM lineitem GROUP BY 1, 2) GROUP BY 1""", "low high")
def _(spark, path):
    stored = table(spark, path, "lineitem").groupBy(
        F.col("l_suppkey").alias("path"), F.col("l_returnflag").alias("hist")).agg(F.sum("l_quantity").alias("integral"))
    return chains.integral_conflicts(stored)


def supplier_params(spark, path):
    return table(spark, path, "supplier").select(
        F.col("s_suppkey").cast("int").alias("idx"), F.col("s_name").alias("name"), F.col("s_name").alias("branch"),
        F.lit(1.0).alias("prior"), F.col("s_acctbal").alias("error"), F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("up"), (F.col("s_nationkey") % 5 == 0).alias("flat"),
        F.lit(False).alias("fixed"), F.concat(F.lit("g"), F.col("s_nationkey") % 3).alias("grp"),
        F.lit(1.0).alias("step_scale"), F.array(F.concat(F.lit("Nation"), F.col("s_nationkey") % 4, F.lit("*"))).alias("samples"),
        F.create_map(F.lit("Supplier#000000000"), F.lit(0.5)).alias("corr"))


@add("model_problems", """SELECT s_name AS name, CAST(NULL AS VARCHAR) AS other, 'error not positive' AS problem FROM supplier
 WHERE NOT s_acctbal > 0 UNION ALL SELECT s_name, 'Supplier#000000000', 'correlation not symmetric' FROM supplier
 WHERE s_name <> 'Supplier#000000000'""")
def _(spark, path):
    return model.model_problems(supplier_params(spark, path))


def fitted_params(spark, path):
    """Model whose priors, errors and correlations are those of the sample itself."""
    chain = li_chain(spark, path)
    matrix = moments.covariance(chain, LI)
    summary = hist.postfit_summary(chain, LI)
    return chains.correlation_model(summary, matrix).withColumnRenamed("param", "name")


def corr_sql(names=LI):
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS param_i, '{b}' AS param_j, covar_pop({a} - m.{a}_m, {b} - m.{b}_m) AS cov,"
        f" {'1.0' if a == b else f'corr({a}, {b})'} AS corr FROM ch, m" for a in names for b in names)
    means = ", ".join(f"avg({a}) AS {a}_m" for a in names)
    return f"m AS (SELECT {means} FROM ch), mat AS ({pairs})"


@add("prior_covariance", f"WITH {LI_SQL}, {corr_sql()} SELECT param_i, param_j, cov FROM mat", "cov")
def _(spark, path):
    return model.prior_covariance(fitted_params(spark, path)).select("param_i", "param_j", "cov")


@add("correlation_model", f"""WITH {LI_SQL}, {corr_sql()}, pf AS (SELECT param, avg(value) AS prior, stddev_pop(value) AS error
 FROM ({long_sql(LI)}) GROUP BY param) SELECT pf.param, prior, error, param_j AS partner, corr FROM pf
 JOIN mat ON pf.param = param_i AND param_i <> param_j""", "prior error corr")
def _(spark, path):
    records = fitted_params(spark, path).withColumnRenamed("name", "param")
    return records.select("param", "prior", "error", F.explode("corr").alias("partner", "corr"))


# -- cuts ----------------------------------------------------------------------


@add("burn_in", f"""WITH {EV1} SELECT step, val, root, k FROM ch WHERE step > (SELECT max(step) // 5 FROM ch)""", "val root k")
def _(spark, path):
    return ops.burn_in(ev_chain(spark, path)).select("step", *EV)


@add("posterior_cut", f"WITH {EV1} SELECT step, val, k FROM ch WHERE k > 50 AND val < 100", "val k")
def _(spark, path):
    return ops.posterior_cut(ev_chain(spark, path), "k > 50 and val < 100").select("step", "val", "k")


@add("exclude", """SELECT s_name AS name, 'g' || (s_nationkey % 3) AS grp FROM supplier
 WHERE NOT starts_with(s_name, 'Supplier#00000001') AND s_nationkey % 3 <> 1""")
def _(spark, path):
    return ops.exclude(supplier_params(spark, path), names=["Supplier#00000001"], groups=["g1"]).select("name", "grp")


@add("thin", f"WITH {EV1} SELECT step, val FROM ch WHERE step % 7 = 0", "val")
def _(spark, path):
    return ops.thin(ev_chain(spark, path), 7, contiguous=True).select("step", "val")


@add("thin_with_gaps", f"""WITH {ev_sql(4)} SELECT chain_id, step, val FROM (SELECT *, row_number() OVER (
 PARTITION BY chain_id ORDER BY step) - 1 AS entry FROM ch) WHERE entry % 5 = 0""", "val")
def _(spark, path):
    return ops.thin(ev_chain(spark, path, 4), 5).select("chain_id", "step", "val")


@add("max_entries", f"""WITH {ev_sql(4)} SELECT chain_id, step, val FROM (SELECT *, row_number() OVER (
 PARTITION BY chain_id ORDER BY step) AS entry FROM ch) WHERE entry <= 500""", "val")
def _(spark, path):
    return ops.max_entries(ev_chain(spark, path, 4), 500).select("chain_id", "step", "val")


@add("random_draws")
def _(spark, path):
    return ops.random_draws(ev_chain(spark, path), 200, seed=3).select("draw", "chain_id", "step", *EV)


@add("select_by_tags", """SELECT p_partkey, 'any' AS how FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') OR p_type IN ('Brand#1', 'Brand#2')
 UNION ALL SELECT p_partkey, 'all' FROM part WHERE p_brand = 'Brand#3' AND p_type = 'ECONOMY'
 UNION ALL SELECT p_partkey, 'exact' FROM part WHERE p_brand = 'Brand#4' AND p_type = 'PROMO'""")
def _(spark, path):
    parts = table(spark, path, "part").select("p_partkey", F.array("p_brand", "p_type").alias("tags"))
    found = [ops.select_by_tags(parts, tags, how).select("p_partkey", F.lit(how).alias("how"))
             for how, tags in (("any", ["Brand#1", "Brand#2"]), ("all", ["Brand#3", "ECONOMY"]),
                               ("exact", ["Brand#4", "PROMO"]))]
    return found[0].unionByName(found[1]).unionByName(found[2])


OSC = {"sin2_12": "s12", "sin2_23": "s23", "sin2_13": "s13", "delta": "delta", "dm2": "dm2"}


def osc_chain(spark, path):
    """Mixing parameters in their physical ranges, made from lineitem columns."""
    return table(spark, path, "lineitem").select(
        (F.lit(0.2) + F.col("l_quantity") / 200.0).alias("s12"), (F.lit(0.3) + F.col("l_discount") * 4.0).alias("s23"),
        (F.lit(0.01) + F.col("l_tax") / 4.0).alias("s13"), (F.col("l_extendedprice") / 20000.0 - 2.5).alias("delta"),
        F.when(F.col("l_returnflag") == "A", -0.0025).otherwise(0.0025).alias("dm2"),
        (F.lit(1.0) + F.col("l_linenumber") / 10.0).alias("Weight"))


OSC_SQL = """ch AS (SELECT CAST(0.2 AS DOUBLE) + l_quantity / CAST(200 AS DOUBLE) AS s12, CAST(0.3 AS DOUBLE) + l_discount * CAST(4 AS DOUBLE) AS s23,
 CAST(0.01 AS DOUBLE) + l_tax / CAST(4 AS DOUBLE) AS s13, l_extendedprice / CAST(20000 AS DOUBLE) - CAST(2.5 AS DOUBLE) AS delta,
 CAST(CASE WHEN l_returnflag = 'A' THEN -0.0025 ELSE 0.0025 END AS DOUBLE) AS dm2,
 CAST(1.0 + l_linenumber / 10.0 AS DOUBLE) AS Weight FROM lineitem)"""
J_SQL = "sqrt(s13) * (1 - s13) * sqrt(s12) * sqrt(1 - s12) * sqrt(s23) * sqrt(1 - s23) * sin(delta)"


@add("add_jarlskog", f"WITH {OSC_SQL} SELECT s12, s23, s13, delta, {J_SQL} AS J FROM ch", "s12 s23 s13 delta J")
def _(spark, path):
    return ops.add_jarlskog(osc_chain(spark, path), "s12", "s23", "s13", "delta").select("s12", "s23", "s13", "delta", "J")


@add("smear_chain")
def _(spark, path):
    return ops.smear_chain(ev_chain(spark, path), {"val": 2.0, "k": 0.5}, keep=True, seed=5).select(
        "step", "val", "k", "val_unsmeared", "k_unsmeared")


@add("reweight_gaussian", f"""WITH {LI_SQL} SELECT chain_id, sum(W) AS total, sum(W * price) AS weighted FROM (SELECT *,
 exp(-0.5 * ((qty - 20.0) / 10.0) * ((qty - 20.0) / 10.0)) / exp(-0.5 * ((qty - 25.0) / 14.0) * ((qty - 25.0) / 14.0))
 * exp(-0.5 * ((disc - 0.04) / 0.02) * ((disc - 0.04) / 0.02)) AS W FROM ch) GROUP BY chain_id""", "total weighted")
def _(spark, path):
    out = ops.reweight_gaussian(li_chain(spark, path), {"qty": (20.0, 10.0), "disc": (0.04, 0.02)},
                                {"qty": (25.0, 14.0), "disc": None})
    return out.groupBy("chain_id").agg(F.sum("Weight").alias("total"), F.sum(F.col("Weight") * F.col("price")).alias("weighted"))


LI_MODEL = [
    {"name": "qty", "prior": 25.0, "error": 10.0, "grp": "flow", "low": 0.0, "up": 60.0},
    {"name": "price", "prior": 40000.0, "error": 20000.0, "grp": "flow", "low": 0.0, "up": 200000.0},
    {"name": "disc", "prior": 0.05, "error": 0.02, "grp": "rate", "flat": True, "low": 0.0, "up": 0.2},
    {"name": "tax", "prior": 0.04, "error": 0.03, "grp": "rate", "low": 0.0, "up": 0.2},
]
MODEL_SQL = "pm AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{p['name']}', CAST({p['prior']} AS DOUBLE), CAST({p['error']} AS DOUBLE), '{p['grp']}', {str(p.get('flat', False)).upper()})"
    for i, p in enumerate(LI_MODEL)) + ") t(idx, name, prior, error, grp, flat))"


def li_model(spark):
    return model.make_params(spark, LI_MODEL)


@add("attach_params", f"""WITH {LI_SQL}, {MODEL_SQL}, lng AS ({long_sql(LI)}) SELECT param, prior, error, flat, grp, count(*) AS n,
 sum((value - prior) / error) AS pull_sum FROM lng JOIN pm ON param = name GROUP BY ALL""", "prior error pull_sum")
def _(spark, path):
    long = li_chain(spark, path).select(*[F.col(c) for c in LI]).unpivot([], LI, "param", "value")
    return ops.attach_params(long, li_model(spark)).groupBy("param", "prior", "error", "flat", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("value") - F.col("prior")) / F.col("error")).alias("pull_sum"))


GRAPH = [(0.0, 9.0), (10.0, 2.0), (25.0, 0.0), (40.0, 3.0), (50.0, 12.0)]


def graph_sql(x: str) -> str:
    parts = " ".join(
        f"WHEN {x} < {b[0]} THEN exp(-0.5 * ({a[1]} + CAST({(b[1] - a[1]) / (b[0] - a[0])!r} AS DOUBLE) * ({x} - {a[0]})))"
        for a, b in zip(GRAPH, GRAPH[1:]))
    return f"CASE WHEN {x} <= {GRAPH[0][0]} OR {x} >= {GRAPH[-1][0]} THEN 0.0 {parts} END"


@add("reweight_graph_1d", f"""WITH {LI_SQL} SELECT qty, chain_id, sum({graph_sql('qty')}) AS total, count(*) AS n
 FROM ch GROUP BY 1, 2""", "qty total")
def _(spark, path):
    out = ops.reweight_graph_1d(li_chain(spark, path).select("qty", "chain_id"), "qty", GRAPH)
    return out.groupBy("qty", "chain_id").agg(F.sum("Weight").alias("total"), F.count(F.lit(1)).alias("n"))


XS, YS = [0.0, 0.02, 0.05, 0.09], [0.001, 0.0024, 0.0026, 0.004]
NORMAL = {"xs": XS, "ys": YS, "chi2": [[4.0, 3.0, 2.0, 5.0], [2.0, 1.0, 0.5, 3.0], [1.0, 0.2, 0.1, 2.0], [6.0, 5.0, 4.0, 7.0]]}
INVERTED = {"xs": XS, "ys": YS, "chi2": [[5.0, 4.0, 3.0, 6.0], [3.0, 2.0, 1.5, 4.0], [2.0, 1.2, 1.1, 3.0], [7.0, 6.0, 5.0, 8.0]]}


def _grid_rows() -> str:
    rows = []
    for name, g in (("n", NORMAL), ("i", INVERTED)):
        for i in range(3):
            for j in range(3):
                c = g["chi2"]
                rows.append(f"('{name}', {XS[i]!r}, {XS[i + 1]!r}, {YS[j]!r}, {YS[j + 1]!r}, {c[i][j]}, {c[i + 1][j]}, {c[i][j + 1]}, {c[i + 1][j + 1]})")
    return ", ".join(rows)


@add("reweight_graph_2d", f"""WITH pt AS (SELECT l_discount AS x, (CASE WHEN l_returnflag = 'A' THEN -1 ELSE 1 END) * (CAST(0.002 AS DOUBLE) + l_tax / CAST(50 AS DOUBLE)) AS dm2
 FROM lineitem), cells AS (SELECT * FROM (VALUES {_grid_rows()}) t(o, x0, x1, y0, y1, c00, c10, c01, c11)),
 wt AS (SELECT dm2, x, coalesce((SELECT exp(-0.5 * ((c00 * (1 - (x - x0) / (x1 - x0)) + c10 * ((x - x0) / (x1 - x0))) * (1 - (abs(dm2) - y0) / (y1 - y0))
  + (c01 * (1 - (x - x0) / (x1 - x0)) + c11 * ((x - x0) / (x1 - x0))) * ((abs(dm2) - y0) / (y1 - y0)))) FROM cells
  WHERE o = CASE WHEN dm2 > 0 THEN 'n' ELSE 'i' END AND x >= x0 AND x < x1 AND abs(dm2) >= y0 AND abs(dm2) < y1 AND x > 0.0), 0.0) AS w
  FROM (SELECT DISTINCT x, dm2 FROM pt))
 SELECT x, dm2, w AS "Weight", count(*) AS n FROM pt JOIN wt USING (x, dm2) GROUP BY ALL""", "x dm2 Weight")
def _(spark, path):
    pts = table(spark, path, "lineitem").select(
        F.col("l_discount").alias("x"),
        (F.when(F.col("l_returnflag") == "A", -1).otherwise(1) * (F.lit(0.002) + F.col("l_tax") / 50.0)).alias("dm2"))
    return ops.reweight_graph_2d(pts, "x", "dm2", NORMAL, INVERTED).groupBy("x", "dm2", "Weight").agg(F.count(F.lit(1)).alias("n"))


# Graphs of scattered points: one per nation, chi2 from its keys; the second is the first upside down.
SCATTERED = """pts AS (SELECT n_nationkey AS i, ((n_nationkey * 37 + 11) % 101) / CAST(1000 AS DOUBLE) AS px, CAST(0.001 AS DOUBLE) + ((n_nationkey * 53 + 5) % 97) / CAST(40000 AS DOUBLE) AS py,
   CAST(n_regionkey + n_nationkey % 7 AS DOUBLE) / 3 AS z FROM nation),
 u AS (SELECT i, px, py, z, (px - min(px) OVER ()) / (max(px) OVER () - min(px) OVER ()) AS sx, (py - min(py) OVER ()) / (max(py) OVER () - min(py) OVER ()) AS sy FROM pts),
 t AS (SELECT a.i AS a, b.i AS b, c.i AS c, sign((b.sx - a.sx) * (c.sy - a.sy) - (b.sy - a.sy) * (c.sx - a.sx)) AS o FROM u a JOIN u b ON a.i < b.i JOIN u c ON b.i < c.i),
 d AS (SELECT * FROM t WHERE o <> 0 AND NOT EXISTS (SELECT 1 FROM u p, u a, u b, u c WHERE a.i = t.a AND b.i = t.b AND c.i = t.c AND p.i NOT IN (t.a, t.b, t.c) AND
   t.o * (((a.sx - p.sx) * (a.sx - p.sx) + (a.sy - p.sy) * (a.sy - p.sy)) * ((b.sx - p.sx) * (c.sy - p.sy) - (b.sy - p.sy) * (c.sx - p.sx))
        - ((b.sx - p.sx) * (b.sx - p.sx) + (b.sy - p.sy) * (b.sy - p.sy)) * ((a.sx - p.sx) * (c.sy - p.sy) - (a.sy - p.sy) * (c.sx - p.sx))
        + ((c.sx - p.sx) * (c.sx - p.sx) + (c.sy - p.sy) * (c.sy - p.sy)) * ((a.sx - p.sx) * (b.sy - p.sy) - (a.sy - p.sy) * (b.sx - p.sx))) > 1e-12)),
 q AS (SELECT DISTINCT x, dm2 FROM pt),
 w AS (SELECT q.x, q.dm2, (b.py - c.py) * (a.px - c.px) + (c.px - b.px) * (a.py - c.py) AS det, (b.py - c.py) * (q.x - c.px) + (c.px - b.px) * (abs(q.dm2) - c.py) AS l1,
   (c.py - a.py) * (q.x - c.px) + (a.px - c.px) * (abs(q.dm2) - c.py) AS l2, a.z AS za, b.z AS zb, c.z AS zc
   FROM q, d JOIN u a ON a.i = d.a JOIN u b ON b.i = d.b JOIN u c ON c.i = d.c),
 chi AS (SELECT x, dm2, avg((l1 * za + l2 * zb + (det - l1 - l2) * zc) / det) AS c FROM w WHERE l1 / det >= -1e-12 AND l2 / det >= -1e-12 AND (l1 + l2) / det <= 1 + 1e-12 GROUP BY ALL),
 r AS (SELECT min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM pts)"""


@add("reweight_scattered_2d", f"""WITH pt AS (SELECT l_discount + l_quantity / CAST(2000 AS DOUBLE) AS x, (CASE WHEN l_returnflag = 'A' THEN -1 ELSE 1 END) * (CAST(0.0012 AS DOUBLE) + l_tax / CAST(40 AS DOUBLE)) AS dm2
 FROM lineitem), {SCATTERED}
 SELECT pt.x, pt.dm2, CASE WHEN pt.x > x0 AND pt.x < x1 AND abs(pt.dm2) > y0 AND abs(pt.dm2) < y1 THEN exp(-0.5 * coalesce(c, 0) * CASE WHEN pt.dm2 > 0 THEN 1 ELSE 2 END) ELSE 0 END AS "Weight",
 count(*) AS n FROM pt CROSS JOIN r LEFT JOIN chi ON chi.x = pt.x AND chi.dm2 = pt.dm2 GROUP BY ALL""", "x dm2 Weight", digits=7)
def _(spark, path):
    key = F.col("n_nationkey")
    graph = [tuple(r) for r in table(spark, path, "nation").select(
        ((key * 37 + 11) % 101) / 1000.0, F.lit(0.001) + ((key * 53 + 5) % 97) / 40000.0, (F.col("n_regionkey") + key % 7) / 3.0).collect()]  # one point per nation
    pts = table(spark, path, "lineitem").select(
        (F.col("l_discount") + F.col("l_quantity") / 2000.0).alias("x"),
        (F.when(F.col("l_returnflag") == "A", -1).otherwise(1) * (F.lit(0.0012) + F.col("l_tax") / 40.0)).alias("dm2"))
    out = ops.reweight_scattered_2d(pts, "x", "dm2", graph, [(x, y, 2 * z) for x, y, z in graph])
    return out.groupBy("x", "dm2", "Weight").agg(F.count(F.lit(1)).alias("n"))


# -- histograms ----------------------------------------------------------------

HIST = f"WITH {LI_SQL}, {hist_sql(LI, weight='Weight')}"


def li_hist(spark, path, **kw):
    return hist.posterior_hist(li_chain(spark, path), LI, weight="Weight", **kw)


@add("posterior_hist", f"{HIST} SELECT param, bin, lo, hi, content FROM hist", "lo hi content")
def _(spark, path):
    return li_hist(spark, path)


EDGES = {"qty": [0.0, 5.0, 7.5, 20.0, 45.0, 51.0], "disc": [0.0, 0.025, 0.055, 0.095]}


def edges_sql() -> str:
    rows = ", ".join(f"('{c}', {b}, {e[b]!r}, {e[b + 1]!r})" for c, e in EDGES.items() for b in range(len(e) - 1))
    return f"ax AS (SELECT param, bin, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM (VALUES {rows}) t(param, bin, lo, hi))"


@add("posterior_hist_custom_edges", f"""WITH {LI_SQL}, {edges_sql()}, lng AS ({long_sql(['qty', 'disc'], 'chain_id', weight='Weight')})
 SELECT k.chain_id, ax.param, ax.bin, ax.lo, ax.hi, coalesce(sum(w), 0.0) AS content
 FROM ax CROSS JOIN (SELECT DISTINCT chain_id FROM ch) k LEFT JOIN lng ON lng.param = ax.param AND lng.chain_id = k.chain_id
 AND value >= ax.lo AND value < ax.hi GROUP BY ALL""", "lo hi content")
def _(spark, path):
    return hist.posterior_hist(li_chain(spark, path), ["qty", "disc"], edges=EDGES, weight="Weight", keys=("chain_id",))


PAIRS = [(a, b) for i, a in enumerate(LI) for b in LI[i + 1:]]


def bin_sql(c: str) -> str:
    return f"CAST(least(floor(70 * ({c} - {c}_a) / ({c}_b - {c}_a)), 69) AS INTEGER)"


HIST2D = f"WITH {LI_SQL}, r AS (SELECT " + ", ".join(f"min({c}) AS {c}_a, max({c}) AS {c}_b" for c in LI) + " FROM ch), h2 AS (" + " UNION ALL ".join(
    f"SELECT '{x}' AS param_x, '{y}' AS param_y, {bin_sql(x)} AS bin_x, {bin_sql(y)} AS bin_y, sum(Weight) AS content FROM ch, r"
    f" WHERE {x} < {x}_b AND {y} < {y}_b GROUP BY ALL" for x, y in PAIRS) + ")"


def li_hist_2d(spark, path):
    return hist.posterior_hist_2d(li_chain(spark, path), PAIRS, weight="Weight")


@add("posterior_hist_2d", f"{HIST2D} SELECT * FROM h2", "content")
def _(spark, path):
    return li_hist_2d(spark, path)


POSTFIT = """SELECT param, sum(w * value) / sum(w) AS mean,
 sqrt(sum(w * (value - c) * (value - c)) / sum(w) - (sum(w * (value - c)) / sum(w)) * (sum(w * (value - c)) / sum(w))) AS rms
 FROM (SELECT *, avg(value) OVER (PARTITION BY param) AS c FROM lng) GROUP BY param"""


@add("postfit_summary", f"""WITH {LI_SQL}, {MODEL_SQL}, lng AS ({long_sql(LI, weight='Weight')}), pf AS ({POSTFIT})
 SELECT param, prior, error, mean, rms, FALSE AS is_fixed FROM pf JOIN pm ON param = name""", "prior error mean rms")
def _(spark, path):
    return hist.postfit_summary(li_chain(spark, path), LI, "Weight", li_model(spark))


@add("postfit_gauss")
def _(spark, path):
    return hist.postfit_gauss(hist.posterior_hist(ev_chain(spark, path), EV))


BUCKETS = """bk AS (SELECT *, CAST(least(floor((step - 1) / CAST((SELECT max(step) // 5 FROM ch) AS DOUBLE)), 5) AS INTEGER)
 AS bucket FROM ch)"""


@add("parameter_evolution", f"""WITH {EV1}, {BUCKETS}, {hist_sql(EV, keys='bucket', source='bk')},
 cum AS (SELECT param, bucket, bin, lo, hi, sum(content) OVER (PARTITION BY param, bin ORDER BY bucket DESC) AS content FROM hist)
 SELECT bucket - 1 AS "interval", param, bin, lo, hi, content, content / sum(content) OVER (PARTITION BY param, bucket) AS density
 FROM cum WHERE bucket >= 1""", "lo hi content density")
def _(spark, path):
    chain = ev_chain(spark, path)
    return hist.parameter_evolution(chain, EV, 5, ops.last_step(chain))


VIOLIN_BINS = "((SELECT CAST(floor((max(value) - min(value)) * 25) AS INTEGER) FROM lng))"
VIOLIN_AXIS = "SELECT * FROM (SELECT min(value) AS a, max(value) AS b FROM lng), (SELECT DISTINCT param FROM lng)"


@add("violin", f"WITH {EV1}, {hist_sql(EV, VIOLIN_BINS, ranges=VIOLIN_AXIS)} SELECT param, bin, lo, hi, content FROM hist",
     "lo hi content")
def _(spark, path):
    return hist.violin(ev_chain(spark, path), EV)


@add("prior_violin")
def _(spark, path):
    return hist.prior_violin(ev_chain(spark, path), {"val": (50.0, 20.0), "root": (8.0, 3.0), "k": (50.0, 25.0)})


@add("mode_bin", f"""{HIST} SELECT param, bin, lo, hi, content FROM (SELECT *, row_number() OVER (PARTITION BY param
 ORDER BY content DESC, bin) AS r FROM hist) WHERE r = 1""", "lo hi content")
def _(spark, path):
    return hist.mode_bin(li_hist(spark, path))


@add("best_fit_2d", f"""{HIST2D} SELECT param_x, param_y, bin_x, bin_y, content FROM (SELECT *, row_number() OVER (
 PARTITION BY param_x, param_y ORDER BY content DESC, bin_x, bin_y) AS r FROM h2) WHERE r = 1""", "content")
def _(spark, path):
    return hist.best_fit_2d(li_hist_2d(spark, path))


@add("normalise", f"""{HIST} SELECT param, bin, content / sum(content) OVER (PARTITION BY param) AS density FROM hist""", "density")
def _(spark, path):
    return hist.normalise(li_hist(spark, path)).select("param", "bin", "density")


@add("scale_by_width", f"{HIST} SELECT param, bin, content / ((hi - lo) * 2.0) AS density FROM hist", "density")
def _(spark, path):
    return hist.scale_by_width(li_hist(spark, path), 2.0).select("param", "bin", "density")


@add("integrals", f"{HIST} SELECT param, sum(content) AS integral, sum(content * (hi - lo)) AS width_integral, sum(content) AS integral_with_overflow FROM hist GROUP BY param",
     "integral width_integral integral_with_overflow")
def _(spark, path):
    return hist.integrals(li_hist(spark, path))


@add("hist_iqr", f"""{HIST}, c AS (SELECT *, sum(content) OVER (PARTITION BY param ORDER BY bin) / sum(content) OVER (PARTITION BY param) AS cdf,
 content / sum(content) OVER (PARTITION BY param) AS p FROM hist), q AS (SELECT param, t.level, lo + (hi - lo) * (t.level - (cdf - p)) / p AS x,
 row_number() OVER (PARTITION BY param, t.level ORDER BY bin) AS r FROM c, (VALUES (0.25), (0.5), (0.75)) t(level) WHERE cdf >= t.level AND p > 0)
 SELECT param, max(CASE WHEN level = 0.25 THEN x END) AS q1, max(CASE WHEN level = 0.5 THEN x END) AS median,
 max(CASE WHEN level = 0.75 THEN x END) AS q3, max(CASE WHEN level = 0.75 THEN x END) - max(CASE WHEN level = 0.25 THEN x END) AS iqr
 FROM q WHERE r = 1 GROUP BY param""", "q1 median q3 iqr")
def _(spark, path):
    return hist.hist_iqr(li_hist(spark, path))


@add("hist_min_in_range", f"""{HIST} SELECT param, coalesce(min(CASE WHEN lo > 10 AND hi < 40 THEN content END), 1234567890.0) AS minimum
 FROM hist GROUP BY param""", "minimum")
def _(spark, path):
    return hist.hist_min_in_range(li_hist(spark, path), 10, 40)


# -- intervals -----------------------------------------------------------------

KEPT = """kept AS (SELECT * FROM (SELECT *, coalesce(sum(content) OVER (PARTITION BY param ORDER BY content DESC, bin
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(content) OVER (PARTITION BY param) AS total
 FROM hist WHERE content > 0), (VALUES (0.99), (0.90), (0.68)) t(level) WHERE before / total < level)"""


@add("credible_interval", f"""{HIST}, {KEPT} SELECT param, CAST(level AS DOUBLE) AS level, min(lo) AS lo, max(hi) AS hi,
 count(*) AS n_bins, sum(content) AS content FROM kept GROUP BY ALL""", "level lo hi content")
def _(spark, path):
    return intervals.credible_interval(li_hist(spark, path))


@add("credible_bins_in_sigmas", f"""{HIST}, {KEPT.replace("(0.99), (0.90), (0.68)", "(0.997300203937), (0.954499736104), (0.682689492137)")}
 SELECT param, CAST(level AS DOUBLE) AS level, bin, content FROM kept""", "level content")
def _(spark, path):
    return intervals.credible_bins(li_hist(spark, path), [3, 2, 1], in_sigmas=True).select("param", "level", "bin", "content")


@add("credible_region", f"""{HIST2D} SELECT param_x, param_y, CAST(level AS DOUBLE) AS level, min(content) AS height, count(*) AS n_cells
 FROM (SELECT *, coalesce(sum(content) OVER (PARTITION BY param_x, param_y ORDER BY content DESC, bin_x, bin_y
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(content) OVER (PARTITION BY param_x, param_y) AS total FROM h2),
 (VALUES (0.99), (0.90), (0.68)) t(level) WHERE before / total < level GROUP BY ALL""", "level height")
def _(spark, path):
    return intervals.credible_region(li_hist_2d(spark, path))


PEAK = """pk AS (SELECT param, bin AS p, content AS pc, (lo + hi) / 2 AS centre, lo AS plo FROM (SELECT *, row_number() OVER (
 PARTITION BY param ORDER BY content DESC, bin) AS r FROM hist) WHERE r = 1),
 h AS (SELECT hist.*, p, pc, centre, plo, abs(bin - p) AS d, max(bin) OVER (PARTITION BY hist.param) AS last,
 sum(content) OVER (PARTITION BY hist.param) AS total FROM hist JOIN pk ON hist.param = pk.param),
 dist AS (SELECT param, d, p, last, total, sum(CASE WHEN bin < p THEN content ELSE 0 END) AS low, sum(CASE WHEN bin > p THEN content ELSE 0 END) AS high,
 sum(content) AS both_sides FROM h GROUP BY ALL),
 stop AS (SELECT * FROM (SELECT *, sum(both_sides) OVER (PARTITION BY param ORDER BY d) AS s FROM dist)
 WHERE s / total >= 0.6827 QUALIFY row_number() OVER (PARTITION BY param ORDER BY d) = 1),
 two AS (SELECT param, CASE WHEN low > high THEN greatest(p - d, 0) ELSE least(p + d, last) END AS b, low > high AS low_side FROM stop)"""


@add("hpd", f"""{HIST}, {PEAK}, up AS (SELECT *, CASE WHEN bin = p THEN pc / 2 WHEN bin > p THEN content ELSE 0 END AS u,
 CASE WHEN bin = p THEN pc / 2 WHEN bin < p THEN content ELSE 0 END AS dn FROM h),
 walk AS (SELECT *, sum(u) OVER (PARTITION BY param ORDER BY bin) / sum(u) OVER (PARTITION BY param) AS fu,
 sum(dn) OVER (PARTITION BY param ORDER BY bin DESC) / sum(dn) OVER (PARTITION BY param) AS fd FROM up),
 ends AS (SELECT param, coalesce(min(CASE WHEN bin >= p AND fu >= 0.6827 THEN bin END), max(last)) AS ub,
 coalesce(max(CASE WHEN bin <= p AND fd >= 0.6827 THEN bin END), 0) AS db FROM walk GROUP BY param)
 SELECT h.param, max(centre) AS peak, max(CASE WHEN h.bin = two.b THEN CASE WHEN low_side THEN abs(h.lo - centre) ELSE abs(h.hi - centre) END END) AS hpd_error,
 max(CASE WHEN h.bin = ub THEN abs(h.hi - centre) END) AS error_up, max(CASE WHEN h.bin = db THEN abs((h.lo + h.hi) / 2 - plo) END) AS error_down
 FROM h JOIN two ON h.param = two.param JOIN ends ON h.param = ends.param GROUP BY h.param""", "peak hpd_error error_up error_down")
def _(spark, path):
    return intervals.hpd(li_hist(spark, path))


@add("mode_error", f"""{HIST}, {PEAK} SELECT h.param, max(centre) AS mode, max(CASE WHEN h.bin = two.b THEN abs((h.lo + h.hi) / 2 - centre) END) AS mode_error
 FROM h JOIN two ON h.param = two.param GROUP BY h.param""", "mode mode_error")
def _(spark, path):
    return intervals.mode_error(li_hist(spark, path))


# -- moments -------------------------------------------------------------------


def weighted_cov_sql(names=LI, source="ch", keys: str = "", weight: str = "Weight") -> str:
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    means = ", ".join(f"avg({a}) AS {a}_m" for a in names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = ", ".join([f"sum({weight}) AS sw"] + [f"sum({weight} * ({a} - {a}_m)) AS s{i}" for i, a in enumerate(names)]
                     + [f"sum({weight} * ({names[i]} - {names[i]}_m) * ({names[j]} - {names[j]}_m)) AS q{i}_{j}" for i, j in pairs])
    parts = " UNION ALL ".join(
        f"SELECT {k}'{a}' AS param_i, '{b}' AS param_j, q{min(i, j)}_{max(i, j)} / sw - s{i} / sw * (s{j} / sw) AS cov FROM sums"
        for i, a in enumerate(names) for j, b in enumerate(names))
    join = "".join(f" AND c.{x.strip()} = v.{x.strip()}" for x in keys.split(",") if x.strip())
    ck = "".join(f"c.{x.strip()}, " for x in keys.split(",") if x.strip())
    return f"""m AS (SELECT {means} FROM ch), sums AS MATERIALIZED (SELECT {k}{sums} FROM {source}, m {group}), c AS ({parts}), v AS (SELECT * FROM c WHERE param_i = param_j),
 mat AS (SELECT {ck}c.param_i, c.param_j, c.cov, c.cov / sqrt(v.cov * v2.cov) AS corr FROM c
 JOIN v ON v.param_i = c.param_i{join} JOIN v v2 ON v2.param_i = c.param_j{join.replace('v.', 'v2.')})"""


MAT = f"WITH {LI_SQL}, {weighted_cov_sql()}"


@add("covariance", f"{MAT} SELECT * FROM mat", "cov corr")
def _(spark, path):
    return moments.covariance(li_chain(spark, path), LI, "Weight")


@add("covariance_by_blocks", f"WITH {LI_SQL}, {weighted_cov_sql(keys='chain_id')} SELECT * FROM mat", "cov corr")
def _(spark, path):
    return moments.covariance(li_chain(spark, path), LI, "Weight", keys=("chain_id",), method="blocks")


IVL = "iv AS (SELECT *, least(floor((step - 1) / CAST((SELECT max(step) // 5 FROM ch) AS DOUBLE)), 4) AS b FROM ch WHERE step > 0)"


SUBOPT = f"""WITH {EV1}, {IVL}, m AS (SELECT avg(val) AS mv, avg(root) AS mr, avg(k) AS mk FROM ch),
 c AS (SELECT i.range AS "interval", var_pop(val - mv) AS a, covar_pop(val - mv, root - mr) AS b, covar_pop(val - mv, k - mk) AS c,
 var_pop(root - mr) AS d, covar_pop(root - mr, k - mk) AS e, var_pop(k - mk) AS f FROM iv, m, range(5) i WHERE iv.b <= i.range GROUP BY 1),
 g AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM c),
 h AS (SELECT *, (d * f - e * e) / det AS p, (c * e - b * f) / det AS q, (b * e - c * d) / det AS r, (a * f - c * c) / det AS s, (b * c - a * e) / det AS t,
 (a * d - b * b) / det AS u FROM g)
 SELECT CAST("interval" AS INTEGER) AS "interval", 3 * (p * p + s * s + u * u + 2 * (q * q + r * r + t * t)) / ((p + s + u) * (p + s + u)) AS suboptimality FROM h"""


@add("suboptimality", SUBOPT, "suboptimality", digits=7)
def _(spark, path):
    chain = ev_chain(spark, path)
    return moments.suboptimality(chain, EV, 5, ops.last_step(chain))


def _stability_sql() -> str:
    m = ", ".join(f"avg({a}) AS {a}_m" for a in EV)
    parts = " UNION ALL ".join(
        f"SELECT i.range AS \"interval\", '{a}' AS param_i, '{b}' AS param_j, covar_pop({a} - {a}_m, {b} - {b}_m) AS cov,"
        f" {'1.0' if a == b else f'corr({a} - {a}_m, {b} - {b}_m)'} AS corr FROM iv, m, range(5) i WHERE b >= i.range GROUP BY i.range"
        for a in EV for b in EV)
    ratio = lambda c: (
        f"CASE WHEN NOT (abs({c}) < 1e-5 AND abs(lag({c}) OVER w) < 1e-5) AND lag({c}) OVER w <> 0 THEN {c} / lag({c}) OVER w END AS {c}_ratio")
    return f"""WITH {EV1}, {IVL}, m AS (SELECT {m} FROM ch), c AS ({parts}), r AS (SELECT *, {ratio('cov')}, {ratio('corr')} FROM c
 WINDOW w AS (PARTITION BY param_i, param_j ORDER BY "interval")) SELECT CAST("interval" AS INTEGER) AS "interval", param_i, param_j, cov, corr, cov_ratio, corr_ratio
 FROM r WHERE "interval" >= 1"""


@add("covariance_stability", _stability_sql(), "cov corr cov_ratio corr_ratio", digits=7)
def _(spark, path):
    chain = ev_chain(spark, path)
    return moments.covariance_stability(chain, EV, 5, ops.last_step(chain))


# Roots, whose means have no short decimals: these would be rounded up or down by chance.
RUNNING = [("root", "rk"), ("root", "root"), ("fourth", "root"), ("fourth", "fourth"), ("fourth", "rk"), ("rk", "rk")]


@add("running_covariance", f"WITH {ev_sql(4)}, th AS (SELECT *, sqrt(root) AS fourth, sqrt(k) AS rk FROM ch) " + " UNION ALL ".join(
    f"SELECT chain_id, step, '{a}' AS param_i, '{b}' AS param_j, avg({a}) OVER w AS mean_i, coalesce(covar_samp({a}, {b}) OVER w, 0.0) AS cov"
    " FROM th WINDOW w AS (PARTITION BY chain_id ORDER BY step)" for a, b in RUNNING), "mean_i cov", digits=8)
def _(spark, path):
    chain = ev_chain(spark, path, 4).withColumns({"fourth": F.sqrt("root"), "rk": F.sqrt("k")})
    return moments.running_covariance(chain, RUNNING, block=1000)


@add("strong_correlations", f"""{MAT} SELECT param_i, param_j, corr, CAST(CASE WHEN abs(corr) < 0.25 THEN 0 WHEN abs(corr) < 0.5 THEN 1
 WHEN abs(corr) < 1.0001 THEN 2 END AS INTEGER) AS band, abs(corr) > 0.5 AS is_strong FROM mat WHERE param_i <> param_j""", "corr")
def _(spark, path):
    return moments.strong_correlations(moments.covariance(li_chain(spark, path), LI, "Weight"), 0.5)


@add("group_correlations", f"""{MAT}, {MODEL_SQL}, bl AS (SELECT name, grp, CASE WHEN grp = 'flow' THEN 0 ELSE 1 END AS block FROM pm)
 SELECT a.block AS block_i, a.grp AS grp_i, b.block AS block_j, b.grp AS grp_j, count(*) AS n, avg(corr) AS mean_corr,
 max(CASE WHEN param_i <> param_j THEN abs(corr) END) AS max_abs_corr FROM mat JOIN bl a ON param_i = a.name JOIN bl b ON param_j = b.name GROUP BY ALL""",
     "mean_corr max_abs_corr")
def _(spark, path):
    return moments.group_correlations(moments.covariance(li_chain(spark, path), LI, "Weight"), li_model(spark))


def _names(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


@add("sub_matrix", f"{MAT} SELECT param_i, param_j, cov FROM mat WHERE param_i IN ('qty', 'tax') AND param_j IN ('qty', 'tax')", "cov")
def _(spark, path):
    matrix = moments.covariance(li_chain(spark, path), LI, "Weight")
    return moments.sub_matrix(matrix, _names(spark, ["qty", "tax", "absent"])).select("param_i", "param_j", "cov")


# Names of a correlation matrix over the days of orders that its table lacks: days without an order of high price.
@add("sub_matrix_missing", """SELECT DISTINCT 'day_' || l_linenumber || l_returnflag AS name FROM lineitem
 EXCEPT SELECT 'day_' || l_linenumber || l_returnflag FROM lineitem WHERE l_quantity > 48 AND l_linestatus = 'F'""")
def _(spark, path):
    named = table(spark, path, "lineitem").withColumn("name", F.concat(F.lit("day_"), F.col("l_linenumber").cast("string"), "l_returnflag"))
    kept = named.filter("l_quantity > 48 and l_linestatus = 'F'").select("name").distinct()
    matrix = kept.select(F.col("name").alias("param_i"), F.col("name").alias("param_j"), F.lit(1.0).alias("cov"))
    return moments.missing_names(matrix, named.select("name").distinct())


@add("matrix_compare", f"""WITH {LI_SQL}, {weighted_cov_sql()}, mat2 AS (SELECT * FROM ({corr_sql().split('mat AS (')[1][:-1]}))
 SELECT mat.param_i, mat.param_j, mat.cov, mat.corr, mat2.cov AS cov_2, mat2.corr AS corr_2, mat2.corr - mat.corr AS corr_diff
 FROM mat JOIN mat2 ON mat.param_i = mat2.param_i AND mat.param_j = mat2.param_j""", "cov corr cov_2 corr_2 corr_diff")
def _(spark, path):
    chain = li_chain(spark, path)
    return moments.matrix_compare(moments.covariance(chain, LI, "Weight"), moments.covariance(chain, LI))
