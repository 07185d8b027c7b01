"""Queries at parameter points and over toys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chainlens.catalog.chains import li_hist, HIST, supplier_params
from chainlens.catalog.comparing import BOUNDS, COV, FLAT, PRIOR
from chainlens.catalog.event_samples import (
    ES, HALVES, SPECTRA, binned_sample, data_spectrum, halves, model_bins, sources, spectra,
)
from chainlens.catalog.registry import (
    AXES, EV, LI, LI_SQL, SAMPLE_SQL, X_BIN_SQL, add, ev_chain, ev_sql, event_sample, li_chain, table, toy_sql,
)
from chainlens.functions.numeric import normal_pvalue
from chainlens.operators import binning, chain as chain_ops, events, hist, moments, predict, product, splines, toys
from chainlens.plans import predictive as plans
from chainlens.session import stored

LOW = "CAST(1e-5 AS DOUBLE)"


def poisson_sql(d="data", m="mc") -> str:
    return (f"CASE WHEN {d} = 0 THEN {m} WHEN {m} < {LOW} AND {d} > {LOW} THEN {LOW} - {d} + {d} * ln({d} / {LOW})"
            f" WHEN {m} < {LOW} AND {d} >= {m} THEN 0 ELSE {m} - {d} + {d} * ln({d} / {m}) END")


# -- likelihoods ---------------------------------------------------------------

STAT_SQL = {
    "poisson": poisson_sql(),
    "pearson": "CASE WHEN data = 0 THEN mc / 2 ELSE (data - mc) * (data - mc) / (2 * mc) END",
    "barlow_beeston": "mc * b - data + data * ln(data / (mc * b)) + (b - 1) * (b - 1) / (2 * f)",
    "dembinski_abdelmotteleb": "mc * g - data + data * ln(data / (mc * g)) + k * g - k + k * ln(1 / g)",
    "icecube": "-(a * ln(c) + lgamma(data + a) - lgamma(data + 1) - (data + a) * ln(1 + c) - lgamma(a))",
}
STAT_CTE = """st AS (SELECT *, mc * mc / w2 AS k, w2 / (mc * mc) AS f, mc / w2 AS c, mc * mc / w2 + 1 AS a, (data + mc * mc / w2) / (mc + mc * mc / w2) AS g,
 (sqrt((mc * (w2 / (mc * mc)) - 1) * (mc * (w2 / (mc * mc)) - 1) + 4 * data * (w2 / (mc * mc))) - (mc * (w2 / (mc * mc)) - 1)) / 2 AS b FROM sp)"""


def register_llh(stat: str) -> None:
    @add(f"binned_llh_{stat}", f"""{SPECTRA}, {STAT_CTE} SELECT sample_id, bin, CASE WHEN mc = 0 AND data = 0 THEN 0.0 ELSE {STAT_SQL[stat]} END AS llh FROM st""", "llh",
         digits=6 if stat == "icecube" else 7)
    def _(spark, path):
        table_ = sources.load_data_spectrum(spectra(spark, path), data_spectrum(spark, path))
        return toys.binned_llh(table_, stat).select("sample_id", "bin", "llh")


for _stat in STAT_SQL:
    register_llh(_stat)


@add("sample_llh", f"{SPECTRA} SELECT sample_id, sum({poisson_sql()}) AS llh FROM sp GROUP BY 1", "llh", digits=7)
def _(spark, path):
    return toys.sample_llh(sources.load_data_spectrum(spectra(spark, path), data_spectrum(spark, path)))


# -- splines -------------------------------------------------------------------

KNOTS = [-1.0, 0.0, 1.0, 2.0]
KNOT_ROWS = ", ".join(f"(CAST({x} AS DOUBLE))" for x in KNOTS)
SPLINE_SQL = f"""{SAMPLE_SQL}, kn AS (SELECT sample_id, channel, mode, CASE WHEN x >= 0.5 AND x < 20.5 THEN 0 WHEN x >= 20.5 AND x < 50.5 THEN 1 END AS b1,
 sample_id * 1000 + (ascii(mode) - 65) * 20 + CASE WHEN channel = 'F' THEN 0 ELSE 10 END + CASE WHEN x < 20.5 THEN 0 ELSE 1 END AS spline_id,
 avg(tax) AS t, avg(w0) - 0.9 AS u FROM es WHERE x >= 0.5 AND x < 50.5 GROUP BY ALL),
 kt AS (SELECT kn.*, kx AS x, least(greatest(1 + kx * t * 8 - kx * kx * u * 2, 0.6), 1.6) AS y FROM kn, (VALUES {KNOT_ROWS}) k(kx))"""


def knots(spark, path, binned=None):
    """Responses per (sample, channel, mode, coarse bin), with slopes taken from the events."""
    x = F.col("x")
    first = x < 20.5
    keyed = (binned or event_sample(spark, path)).filter((x >= 0.5) & (x < 50.5)).withColumn("b1", F.when(first, 0).otherwise(1))
    number = (F.col("sample_id") * 1000 + (F.ascii("mode") - 65) * 20 + F.when(F.col("channel") == "F", 0).otherwise(10) + F.col("b1"))
    keys = ["sample_id", "channel", "mode", "b1"]
    stats = keyed.groupBy(*keys, number.alias("spline_id")).agg(F.avg("tax").alias("t"), (F.avg("w0") - 0.9).alias("u"))
    return stats.withColumn("x", F.explode(F.lit(KNOTS))).withColumn(
        "y", F.lit(1.0) + F.col("x") * F.col("t") * 8.0 - F.col("x") * F.col("x") * F.col("u") * 2.0)


KEYS = ("spline_id", "sample_id", "channel", "mode", "b1")


def built(spark, path, method="linear", binned=None):
    packed = splines.pack_knots(knots(spark, path, binned), KEYS, 0.6, 1.6)
    return stored(splines.build_splines(packed, method, KEYS).withColumn("param", F.lit("shape")), "splines")


@add("build_splines_linear", f"""WITH {SPLINE_SQL} SELECT CAST(spline_id AS INTEGER) AS spline_id, x AS knot, y, (ny - y) / (nx - x) AS slope FROM (
 SELECT *, lead(x) OVER (PARTITION BY spline_id ORDER BY x) AS nx, lead(y) OVER (PARTITION BY spline_id ORDER BY x) AS ny FROM kt) WHERE nx IS NOT NULL""",
     "knot y slope", digits=8)
def _(spark, path):
    rows = F.arrays_zip(F.slice("xs", 1, F.size("b")).alias("knot"), F.slice("ys", 1, F.size("b")).alias("y"), F.col("b").alias("slope"))
    return built(spark, path).select("spline_id", F.inline(rows)).toDF("spline_id", "knot", "y", "slope")


# Four knots at unit distance: y0..y3 with secants s0..s2.
FOUR = f"""{SPLINE_SQL}, y AS (SELECT spline_id, max(CASE WHEN x = -1 THEN y END) AS y0, max(CASE WHEN x = 0 THEN y END) AS y1,
 max(CASE WHEN x = 1 THEN y END) AS y2, max(CASE WHEN x = 2 THEN y END) AS y3 FROM kt GROUP BY 1),
 s AS (SELECT *, y1 - y0 AS s0, y2 - y1 AS s1, y3 - y2 AS s2 FROM y)"""


def hermite_sql(slopes: str) -> str:
    """Coefficients per segment from slopes m0..m3 at the knots."""
    rows = " UNION ALL ".join(
        f"SELECT spline_id, {i} AS segment, m{i} AS b, 3 * s{i} - 2 * m{i} - m{i + 1} AS c, m{i} + m{i + 1} - 2 * s{i} AS d FROM m" for i in range(3))
    tidy = ", ".join(f"CASE WHEN abs({v}) < 1e-11 THEN 0.0 ELSE {v} END AS {v}" for v in "bcd")
    return f"WITH {FOUR}, m AS (SELECT *, {slopes} FROM s), r AS ({rows}) SELECT CAST(spline_id AS INTEGER) AS spline_id, CAST(segment AS INTEGER) AS segment, {tidy} FROM r"


def akima_sql(i: int) -> str:
    m = ["(2 * (2 * s0 - s1) - s0)", "(2 * s0 - s1)", "s0", "s1", "s2", "(2 * s2 - s1)", "(2 * (2 * s2 - s1) - s2)"]
    after, before = f"abs({m[i + 3]} - {m[i + 2]})", f"abs({m[i + 1]} - {m[i]})"
    return (f"CASE WHEN {after} + {before} = 0 THEN {m[i + 2]} ELSE ({after} * {m[i + 1]} + {before} * {m[i + 2]}) / ({after} + {before}) END AS m{i}")


SPLINE_ORACLE = {
    "kochanek_bartels": hermite_sql("s0 AS m0, (s0 + s1) / 2 AS m1, (s1 + s2) / 2 AS m2, s2 AS m3"),
    "akima": hermite_sql(", ".join(akima_sql(i) for i in range(4))),
    # Without a knot in the middle two conditions the spline is one cubic through four points.
    "cubic": f"""WITH {FOUR}, p AS (SELECT *, (s2 - 2 * s1 + s0) / 6 AS e, (s1 - s0) / 2 AS f FROM s),
 q AS (SELECT *, i.range AS segment, i.range AS t FROM p, range(3) i)
 SELECT CAST(spline_id AS INTEGER) AS spline_id, CAST(segment AS INTEGER) AS segment, s0 + f * (2 * t - 1) + e * (3 * t * t - 6 * t + 2) AS b,
 CASE WHEN abs(f + e * (3 * t - 3)) < 1e-11 THEN 0.0 ELSE f + e * (3 * t - 3) END AS c, CASE WHEN abs(e) < 1e-11 THEN 0.0 ELSE e END AS d FROM q""",
    "monotonic": None,
}


def shrink_sql(i: int) -> str:
    """Scale the slopes of segment i into the circle of radius 3."""
    a, b = f"m{i}", f"m{i + 1}"
    k = (f"(CASE WHEN s{i} = 0 THEN 0 WHEN {a} * {a} + {b} * {b} > 9 * s{i} * s{i} THEN 3 * abs(s{i}) / sqrt({a} * {a} + {b} * {b}) ELSE 1 END)")
    return f"SELECT * REPLACE ({a} * {k} AS {a}, {b} * {k} AS {b}) FROM z{i}"


SPLINE_ORACLE["monotonic"] = hermite_sql("0 AS m0").replace(
    "m AS (SELECT *, 0 AS m0 FROM s)",
    """z0 AS (SELECT *, s0 AS m0, CASE WHEN (s0 >= 0) = (s1 >= 0) THEN (s0 + s1) / 2 ELSE 0 END AS m1,
 CASE WHEN (s1 >= 0) = (s2 >= 0) THEN (s1 + s2) / 2 ELSE 0 END AS m2, s2 AS m3 FROM s), """
    + f"z1 AS ({shrink_sql(0)}), z2 AS ({shrink_sql(1)}), m AS ({shrink_sql(2)})")


def register_splines(method: str) -> None:
    @add(f"build_splines_{method}", SPLINE_ORACLE[method], "b c d", digits=6)
    def _(spark, path):
        rows = built(spark, path, method).select("spline_id", F.posexplode(F.arrays_zip("b", "c", "d")).alias("segment", "_r"))
        return rows.select("spline_id", "segment", *[
            F.when(F.abs(F.col(f"_r.{v}")) < 1e-11, 0.0).otherwise(F.col(f"_r.{v}")).alias(v) for v in "bcd"])


for _method in SPLINE_ORACLE:
    register_splines(_method)

POINTS = [  # norm_a, norm_n, norm_o, shape
    (1.0, 1.0, 1.0, 0.0), (1.1, 0.9, 1.05, -0.5), (0.8, 1.2, 0.95, 0.7), (1.3, 1.0, 0.7, 1.5), (0.95, 0.6, 1.4, 2.5)]
PARAMS = ["norm_a", "norm_n", "norm_o", "shape"]
POINT_SQL = "pt AS (SELECT CAST(point AS BIGINT) AS point, na::DOUBLE AS na, nn::DOUBLE AS nn, no::DOUBLE AS no, sh::DOUBLE AS sh FROM (VALUES " + ", ".join(
    f"({i}, {', '.join(map(repr, p))})" for i, p in enumerate(POINTS)) + ") t(point, na, nn, no, sh))"
NORMS = [{"idx": 0, "name": "norm_a", "modes": ["A"]}, {"idx": 1, "name": "norm_n", "modes": ["N"], "kin": {"x": [(10, 40)]}},
         {"idx": 2, "name": "norm_o", "channels": ["O"]}]


def wide_points(spark):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(POINTS)], "point long, " + ", ".join(f"{p} double" for p in PARAMS))


def points(spark):
    return predict.to_points(wide_points(spark), PARAMS)


VALUE_SQL = """seg AS (SELECT point, spline_id, max(CASE WHEN x <= sh THEN x END) AS kx FROM kt, pt GROUP BY ALL),
 sv AS (SELECT seg.point, seg.spline_id, CASE WHEN kx IS NULL THEN 0 WHEN kx >= 2 THEN 2 ELSE CAST(kx + 1 AS INTEGER) END AS segment FROM seg),
 ev AS (SELECT sv.point, sv.spline_id, segment, greatest(a.y + (sh - a.x) * ((b.y - a.y) / (b.x - a.x)), 0) AS weight FROM sv JOIN pt ON pt.point = sv.point
 JOIN kt a ON a.spline_id = sv.spline_id AND a.x = segment - 1 JOIN kt b ON b.spline_id = sv.spline_id AND b.x = segment)"""


@add("evaluate_splines", f"""WITH {SPLINE_SQL}, {POINT_SQL}, {VALUE_SQL} SELECT point, CAST(spline_id AS INTEGER) AS spline_id, 'shape' AS param,
 CAST(segment AS INTEGER) AS segment, weight FROM ev""", "weight", digits=8)
def _(spark, path):
    return splines.evaluate_splines(built(spark, path), points(spark))


SPLINE_AXES = [("x", [0.5, 20.5, 50.5])]


def labelled(spark, path, responses=None, binned=None):
    """Binned events with their norms and splines."""
    matched = events.match_norms(binned or binned_sample(spark, path), NORMS, None, {"modes": "mode", "channels": "channel"})
    table_ = (responses or built(spark, path)).select(*KEYS)
    return splines.match_splines(matched, table_, SPLINE_AXES)


EV_ID = """sid AS (SELECT *, CASE WHEN x < 50.5 THEN sample_id * 1000 + (ascii(mode) - 65) * 20 + CASE WHEN channel = 'F' THEN 0 ELSE 10 END
 + CASE WHEN x < 20.5 THEN 0 ELSE 1 END END AS spline_id FROM es)"""


@add("match_splines", f"""WITH {SPLINE_SQL}, {EV_ID} SELECT coalesce(CAST(spline_id AS VARCHAR), '') AS ids, count(*) AS n, sum(w0) AS rate FROM sid GROUP BY 1""", "rate")
def _(spark, path):
    return labelled(spark, path).groupBy(F.concat_ws(",", F.col("spline_ids").cast("array<string>")).alias("ids")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("w0").alias("rate"))


def factors(spark, responses):
    values = points(spark)
    return predict.norm_factors(values, NORMS).unionByName(
        predict.spline_factors(splines.evaluate_splines(responses, values)))


WEIGHTED = f"""{SPLINE_SQL}, {POINT_SQL}, {VALUE_SQL}, {EV_ID}, wt AS (SELECT pt.point, sid.sample_id, sid.mode, {X_BIN_SQL} AS bin,
 w0 * CASE WHEN mode = 'A' THEN na ELSE 1 END * CASE WHEN mode = 'N' AND x > 10 AND x <= 40 THEN nn ELSE 1 END * CASE WHEN channel = 'O' THEN no ELSE 1 END
 * coalesce(ev.weight, 1) AS w FROM sid CROSS JOIN pt LEFT JOIN ev ON ev.point = pt.point AND ev.spline_id = sid.spline_id),
 pr AS (SELECT point, sample_id, bin, sum(w) AS mc, sum(w * w) AS w2 FROM wt WHERE w > 0 GROUP BY ALL),
 dat AS (SELECT sample_id, {X_BIN_SQL} AS bin, count(*)::DOUBLE AS data FROM es GROUP BY ALL)"""


def predicted(spark, path, binned=None):
    """Spectra at the points; the events are joined and binned once for knots, signatures and data."""
    binned = binned or stored(binned_sample(spark, path), "events")
    responses = built(spark, path, binned=binned)
    summed = stored(predict.signatures(labelled(spark, path, responses, binned), spline_ids="spline_ids"), "signatures")
    return predict.predict_spectra(summed, factors(spark, responses), len(POINTS))


@add("predict_spectra", f"WITH {WEIGHTED} SELECT * FROM pr", "mc w2", digits=8)
def _(spark, path):
    return predicted(spark, path)


def line_responses(spark, path):
    """Straight lines through 1 with the slopes of the knots."""
    first = knots(spark, path).filter("x = 0")
    return first.select("spline_id", F.lit("shape").alias("param"), (F.col("t") * 8.0).alias("a"), F.lit(1.0).alias("b"))


LINE_WEIGHTED = WEIGHTED.replace(VALUE_SQL, "ev AS (SELECT pt.point, spline_id, greatest(t * 8 * sh + 1, 0) AS weight FROM kn, pt)")


@add("predict_spectra_linear", f"WITH {LINE_WEIGHTED} SELECT * FROM pr", "mc w2", digits=8)
def _(spark, path):
    responses, values = built(spark, path), points(spark)
    summed = stored(predict.signatures(labelled(spark, path, responses), spline_ids="spline_ids"), "signatures")
    lines = predict.spline_factors(splines.evaluate_lines(line_responses(spark, path), values))
    return predict.predict_spectra(summed, predict.norm_factors(values, NORMS).unionByName(lines), len(POINTS))


# Probability by (point, channel, energy bin, zenith bin); events with x >= 40 are outside the table and left out.
OSC_SQL = f"""{SAMPLE_SQL}, {POINT_SQL}, o AS (SELECT *, CASE WHEN channel = 'F' THEN 0 ELSE 1 END AS c, CASE WHEN x < 20.5 THEN 0 WHEN x < 40 THEN 1 END AS e,
 CASE WHEN tax < 0.035 THEN 0 ELSE 1 END AS z FROM es),
 wt AS (SELECT point, sample_id, {X_BIN_SQL} AS bin, w0 * CASE WHEN mode = 'A' THEN na ELSE 1 END * CASE WHEN mode = 'N' AND x > 10 AND x <= 40 THEN nn ELSE 1 END
 * CASE WHEN channel = 'O' THEN no ELSE 1 END * (0.3::DOUBLE + ((point * 7 + c * 5 + e * 3 + z) % 10) / 20.0::DOUBLE) AS w FROM o, pt WHERE e IS NOT NULL)"""


@add("predict_spectra_osc", f"WITH {OSC_SQL} SELECT point, sample_id, bin, sum(w) AS mc, sum(w * w) AS w2 FROM wt WHERE w > 0 GROUP BY ALL", "mc w2", digits=11)
def _(spark, path):
    matched = events.match_norms(binned_sample(spark, path), NORMS, None, {"modes": "mode", "channels": "channel"})
    placed = matched.withColumn("channel", F.when(F.col("channel") == "F", 0).otherwise(1)).withColumn(
        "e_bin", binning.axis_bin(F.col("x"), [0.5, 20.5, 40.0])).withColumn("z_bin", binning.axis_bin(F.col("tax"), [0.0, 0.035, 1.0]))
    n = F.col("id")
    table_ = spark.range(len(POINTS) * 8).select(
        F.floor(n / 8).alias("point"), (F.floor(n / 4) % 2).alias("channel"), (F.floor(n / 2) % 2).alias("e_bin"), (n % 2).alias("z_bin"))
    prob = F.lit(0.3) + ((F.col("point") * 7 + F.col("channel") * 5 + F.col("e_bin") * 3 + F.col("z_bin")) % 10) / 20.0
    parts = predict.norm_factors(points(spark), NORMS).unionByName(predict.osc_factors(table_.withColumn("prob", prob)))
    summed = stored(predict.signatures(placed, osc=True), "signatures")
    return predict.predict_spectra(summed, parts, len(POINTS))


@add("reweight_events", f"""WITH {ev_sql()}, pt AS (SELECT point::BIGINT AS point, a::DOUBLE AS a, b::DOUBLE AS b FROM (VALUES (0, 1.0, 1.0), (1, 1.2, 0.8), (2, 0.5, 1.5)) t(point, a, b)),
 w AS (SELECT point, step AS event_id, Weight * CASE WHEN event_type IN ('click', 'view') THEN a ELSE 1 END * CASE WHEN k > 20 AND k <= 60 THEN b ELSE 1 END AS w FROM ch, pt)
 SELECT point, event_id, w FROM w WHERE w > 0""", "w")
def _(spark, path):
    values = predict.to_points(spark.createDataFrame([(0, 1.0, 1.0), (1, 1.2, 0.8), (2, 0.5, 1.5)], "point long, a double, b double"), ["a", "b"])
    norms = [{"idx": 0, "name": "a", "modes": ["click", "view"]}, {"idx": 1, "name": "b", "kin": {"k": [(20, 60)]}}]
    sample = ev_chain(spark, path).withColumnsRenamed({"step": "event_id", "event_type": "mode"})
    tagged = predict.factor_ids(events.match_norms(sample, norms, None, {"modes": "mode"}))
    return predict.reweight_events(tagged, predict.norm_factors(values, norms), 3, weight="Weight", keep=()).select("point", "event_id", "w")


# Draws that are as narrow as the last digits: every toy is the prediction at the second point.
@add("prior_toys_narrow", f"WITH {WEIGHTED} SELECT CAST(t.range AS BIGINT) AS toy, sample_id, bin, mc, w2 FROM pr, range(8) t WHERE point = 1", "mc w2", digits=6)
def _(spark, path):
    binned = stored(binned_sample(spark, path), "events")
    params = [{"name": p, "prior": x} for p, x in zip(PARAMS, POINTS[1])]
    out, _ = plans.toys_from_prior(binned, params, np.diag([1e-18] * 4), NORMS, {"modes": "mode", "channels": "channel"}, 8,
                                   built(spark, path, binned=binned), SPLINE_AXES)
    return out


# Independent norms: the mean total over toys is the nominal one, up to a few of its errors.
@add("prior_toys_check", f"WITH {SAMPLE_SQL} SELECT 300 AS n_toys, sum(w0) AS nominal, TRUE AS mean_fits, TRUE AS spread_fits, TRUE AS fixed_stays FROM es", "nominal")
def _(spark, path):
    params = [{"name": "norm_a", "prior": 1.0}, {"name": "norm_n", "prior": 1.0}, {"name": "norm_o", "prior": 1.0, "fixed": True}]
    out, info = plans.toys_from_prior(binned_sample(spark, path), params, np.diag([0.01, 0.04, 0.01]), NORMS, {"modes": "mode", "channels": "channel"}, 300)
    sample = event_sample(spark, path)
    x = F.col("x")
    parts = sample.agg(F.sum("w0").alias("nominal"), F.sum(F.when(F.col("mode") == "A", F.col("w0"))).alias("a"),
                       F.sum(F.when((F.col("mode") == "N") & (x > 10) & (x <= 40), F.col("w0"))).alias("b"))
    sigma = F.sqrt(0.01 * F.col("a") * F.col("a") + 0.04 * F.col("b") * F.col("b"))
    rates = out.groupBy("toy").agg(F.sum("mc").alias("rate")).agg(F.avg("rate").alias("m"), F.stddev("rate").alias("s"), F.count(F.lit(1)).cast("int").alias("n_toys"))
    stays = info.agg(F.min(F.col("norm_o") == 1.0).alias("fixed_stays"))
    # Single rows side by side.
    return rates.crossJoin(parts).crossJoin(stays).select(
        "n_toys", "nominal", (F.abs(F.col("m") - F.col("nominal")) < 5 * sigma / 300 ** 0.5).alias("mean_fits"),
        (F.abs(F.col("s") / sigma - 1) < 0.25).alias("spread_fits"), "fixed_stays")


@add("shift_events", f"""{ES}, sh AS (SELECT point::BIGINT AS point, scale::DOUBLE AS scale, moved::DOUBLE AS moved FROM (VALUES (0, 1.0, 0.0), (1, 1.03, 0.4), (2, 0.96, -0.7)) t(point, scale, moved)),
 m AS (SELECT point, sample_id, x * scale + moved AS x, w0 FROM es, sh) SELECT point, sample_id, {X_BIN_SQL} AS bin, sum(w0) AS mc, sum(w0 * w0) AS w2
 FROM m WHERE x >= 0.5 AND x < 50.5 GROUP BY ALL""", "mc w2")
def _(spark, path):
    moves = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.03, 0.4), (2, 0.96, -0.7)], "point long, scale double, moved double")
    shifted = predict.shift_events(event_sample(spark, path), {"x": lambda c: c["x"] * c["scale"] + c["moved"]}, moves)
    return events.fill_spectra(binning.assign_bin_uniform(shifted, AXES), keys=("point", "sample_id", "bin"))


def moved_points(spark, path):
    """A point for each nation: a scale and an offset."""
    key = F.col("n_nationkey")
    return table(spark, path, "nation").select(key.cast("long").alias("point"), (0.9 + key / 100.0).alias("scale"), ((key % 7) / 5.0 - 0.6).alias("moved"))


MOVED_SQL = f"""{ES}, sh AS (SELECT CAST(n_nationkey AS BIGINT) AS point, CAST(0.9 AS DOUBLE) + n_nationkey / CAST(100 AS DOUBLE) AS scale,
 (n_nationkey % 7) / CAST(5 AS DOUBLE) - CAST(0.6 AS DOUBLE) AS moved FROM nation)"""


@add("shifted_spectra", f"""{MOVED_SQL}, m AS (SELECT point, sample_id, x * scale + moved AS x, w0 FROM es, sh) SELECT point, sample_id, {X_BIN_SQL} AS bin, sum(w0) AS mc, sum(w0 * w0) AS w2
 FROM m WHERE x >= 0.5 AND x < 50.5 AND w0 > 0 AND (sample_id <> 1 OR (x >= 5.5 AND x < 40.5)) GROUP BY ALL""", "mc w2")
def _(spark, path):
    return product.shifted_spectra(event_sample(spark, path), {"x": lambda c: c["x"] * c["scale"] + c["moved"]}, moved_points(spark, path),
                                   AXES, [{"sample_id": 1, "var": "x", "lo": 5.5, "hi": 40.5}])


@add("shifted_spectra_2d", f"""{MOVED_SQL}, m AS (SELECT point, sample_id, x * scale + moved AS x, y * (2 - scale) AS y, w0 FROM es, sh)
 SELECT point, sample_id, CAST(CASE WHEN x < 10.5 THEN 0 WHEN x < 30.5 THEN 1 ELSE 2 END + 3 * CASE WHEN y < 20000 THEN 0 ELSE 1 END AS INTEGER) AS bin, sum(w0) AS mc, sum(w0 * w0) AS w2
 FROM m WHERE x >= 0.5 AND x < 50.5 AND y >= 1000 AND y < 90000 AND w0 > 0 GROUP BY ALL""", "mc w2")
def _(spark, path):
    axes = [{"sample_id": s, "dim": d, "var": v, "edges": e} for s in range(3)
            for d, (v, e) in enumerate((("x", [0.5, 10.5, 30.5, 50.5]), ("y", [1000.0, 20000.0, 90000.0])))]
    shifts = {"x": lambda c: c["x"] * c["scale"] + c["moved"], "y": lambda c: c["y"] * (2 - c["scale"])}
    return product.shifted_spectra(event_sample(spark, path), shifts, moved_points(spark, path), axes, cells=60)


@add("llh_scan", f"""WITH {WEIGHTED} SELECT point, pr.sample_id, 2 * sum({poisson_sql()}) AS llh FROM pr JOIN dat ON pr.sample_id = dat.sample_id AND pr.bin = dat.bin
 GROUP BY point, ROLLUP (pr.sample_id)""", "llh", digits=7)
def _(spark, path):
    binned = stored(binned_sample(spark, path), "events")
    return toys.llh_scan(predicted(spark, path, binned), data_spectrum(spark, path, binned))


@add("llh_scan_empty_bins", f"""{HALVES}, pt AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 1.25::DOUBLE), (2, 0.5::DOUBLE)) t(point, f)),
 s AS (SELECT CAST(point AS BIGINT) AS point, sample_id, mc * f AS mc, data FROM hv, pt)
 SELECT point, sample_id, 2 * sum({poisson_sql()}) AS llh FROM s GROUP BY point, ROLLUP (sample_id)""", "llh", digits=7)
def _(spark, path):
    mc, counted = halves(spark, path)
    scales = F.array(*[F.struct(F.lit(i).cast("long").alias("point"), F.lit(f).alias("f")) for i, f in enumerate((1.0, 1.25, 0.5))])
    scaled = mc.select("*", F.inline(scales)).select(
        "point", "sample_id", "bin", (F.col("mc") * F.col("f")).alias("mc"), (F.col("w2") * F.col("f") * F.col("f")).alias("w2"))
    data = model_bins(spark).join(counted, ["sample_id", "bin"], "left").fillna(0.0)
    return toys.llh_scan(scaled, data)


SHAPE_PRIOR = "0.5 * (shape / CAST(1.0 AS DOUBLE)) * (shape / CAST(1.0 AS DOUBLE))"


@add("llh_map", f"""WITH {WEIGHTED}, l AS (SELECT point, pr.sample_id AS s, 2 * sum({poisson_sql()}) AS llh FROM pr JOIN dat ON pr.sample_id = dat.sample_id AND pr.bin = dat.bin GROUP BY ALL),
 p AS (SELECT point, sum(CASE WHEN s = 0 THEN llh END) AS a, sum(CASE WHEN s = 1 THEN llh END) AS b, sum(CASE WHEN s = 2 THEN llh END) AS c FROM l GROUP BY point)
 SELECT point, na AS norm_a, nn AS norm_n, no AS norm_o, sh AS shape, a AS "sample_0_LLH", b AS "sample_1_LLH", c AS "sample_2_LLH", a + b + c AS "Sample_LLH",
 2 * 0.5 * sh * sh AS "shape_LLH", a + b + c + 2 * 0.5 * sh * sh AS "Total_LLH" FROM p JOIN pt USING (point)""",
     'norm_a norm_n norm_o shape "sample_0_LLH" "sample_1_LLH" "sample_2_LLH" "Sample_LLH" "shape_LLH" "Total_LLH"', digits=7)
def _(spark, path):
    binned = stored(binned_sample(spark, path), "events")
    at = predict.prior_llh(wide_points(spark), ["shape"], [0.0], np.eye(1), name="shape_prior")
    return toys.llh_map(at, predicted(spark, path, binned), data_spectrum(spark, path, binned), [0, 1, 2],
                        systematics={"shape": "shape_prior"}).drop("shape_prior")


def grid_ranges(spark, path):
    """Scan ranges of one sigma about the mean of the chain."""
    rows = hist.postfit_summary(li_chain(spark, path), LI).collect()  # one row per parameter
    return {r["param"]: (r["mean"], r["rms"]) for r in rows}


@add("scan_grid_1d", f"""WITH {LI_SQL}, s AS (SELECT 'qty' AS scanned, 0 AS start, avg(qty) - stddev_pop(qty) AS lo, avg(qty) + stddev_pop(qty) AS hi, avg(qty) AS mq, avg(tax) AS mt FROM ch
 UNION ALL SELECT 'tax', 10, greatest(avg(tax) - stddev_pop(tax), 0.02), avg(tax) + stddev_pop(tax), avg(qty), avg(tax) FROM ch),
 g AS (SELECT start + i.range AS point, scanned, lo + (i.range + 0.5) * ((hi - lo) / 10) AS x, mq, mt FROM s, range(10) i)
 SELECT CAST(point AS BIGINT) AS point, scanned, x, 'qty' AS param, CASE WHEN scanned = 'qty' THEN x ELSE mq END AS value FROM g
 UNION ALL SELECT CAST(point AS BIGINT), scanned, x, 'tax', CASE WHEN scanned = 'tax' THEN x ELSE mt END FROM g""", "x value")
def _(spark, path):
    found = grid_ranges(spark, path)
    ranges = []
    for p, low in (("qty", None), ("tax", 0.02)):
        ranges.append((p, 10, *predict.scan_range(*found[p], low, None)))
    return predict.scan_grid_1d(spark, ranges, {p: found[p][0] for p in ("qty", "tax")})


@add("scan_grid_2d", f"""WITH {LI_SQL}, s AS (SELECT avg(qty) - stddev_pop(qty) AS a, 2 * stddev_pop(qty) / 4 AS da, avg(tax) - stddev_pop(tax) AS b, 2 * stddev_pop(tax) / 3 AS db,
 avg(disc) - stddev_pop(disc) AS c, 2 * stddev_pop(disc) / 2 AS dc, avg(qty) AS mq, avg(tax) AS mt, avg(disc) AS md FROM ch),
 ax AS (SELECT 'qty' AS p, 0 AS ord, i.range AS i, 4 AS n, a + (i.range + 0.5) * da AS v FROM s, range(4) i UNION ALL SELECT 'tax', 1, i.range, 3, b + (i.range + 0.5) * db FROM s, range(3) i
 UNION ALL SELECT 'disc', 2, i.range, 2, c + (i.range + 0.5) * dc FROM s, range(2) i),
 g AS (SELECT CASE WHEN f.ord = 0 AND t.ord = 1 THEN 0 WHEN f.ord = 0 THEN 12 ELSE 20 END + f.i + t.i * f.n AS point, f.p AS param_x, t.p AS param_y, f.v AS x, t.v AS y FROM ax f JOIN ax t ON f.ord < t.ord),
 l AS (SELECT g.*, k.p AS param, CASE WHEN k.p = param_x THEN x WHEN k.p = param_y THEN y WHEN k.p = 'qty' THEN mq WHEN k.p = 'tax' THEN mt ELSE md END AS value
 FROM g, s, (VALUES ('qty'), ('tax'), ('disc')) k(p)) SELECT CAST(point AS BIGINT) AS point, param_x, param_y, x, y, param, value FROM l""", "x y value")
def _(spark, path):
    found = grid_ranges(spark, path)
    ranges = [(p, n, *predict.scan_range(*found[p], None, None)) for p, n in (("qty", 4), ("tax", 3), ("disc", 2))]
    return predict.scan_grid_2d(spark, ranges, {p: found[p][0] for p in ("qty", "tax", "disc")})


@add("scan_grid_lattice", f"""WITH {LI_SQL}, s AS (SELECT avg(qty) - stddev_pop(qty) AS a, 2 * stddev_pop(qty) AS da, avg(tax) - stddev_pop(tax) AS b, 2 * stddev_pop(tax) AS db,
 avg(disc) - stddev_pop(disc) AS c, 2 * stddev_pop(disc) AS dc FROM ch)
 SELECT i.range + 5 * j.range + 20 * k.range AS point, a + da * i.range / 4 AS qty, b + db * j.range / 3 AS tax, c + dc * k.range / 2 AS disc
 FROM s, range(5) i, range(4) j, range(3) k""", "qty tax disc")
def _(spark, path):
    found = grid_ranges(spark, path)
    axes = [(p, n, *predict.scan_range(*found[p], None, None)) for p, n in (("qty", 5), ("tax", 4), ("disc", 3))]
    return predict.scan_grid(spark, axes, ends=True)


SIGMA_PARAMS = [{"name": "norm_a", "prior": 1.0, "error": 0.1, "low": 0.8, "up": 1.25}, {"name": "norm_n", "prior": 1.0, "error": 0.2, "low": 0.0, "up": 2.0},
                {"name": "norm_o", "prior": 1.0, "error": 0.05, "low": 0.0, "up": 2.0}]


def sigma_spectra(spark, path):
    matched = events.match_norms(binned_sample(spark, path), NORMS, None, {"modes": "mode", "channels": "channel"})
    keys = ("sample_id", "mode", "bin")
    summed = stored(predict.signatures(matched, keys), "signatures")
    return predict.sigma_variations(summed, SIGMA_PARAMS, lambda values: predict.norm_factors(values, NORMS), keys=keys)


SIGMA_SQL = f"""{SAMPLE_SQL}, sg AS (SELECT * FROM (VALUES (-3.0), (-1.0), (0.0), (1.0), (3.0)) t(sigma)),
 vr AS (SELECT 'norm_a' AS scanned, sigma, greatest(least(1 + sigma * 0.1::DOUBLE, 1.25), 0.8) AS va, 1.0::DOUBLE AS vn, 1.0::DOUBLE AS vo FROM sg UNION ALL
 SELECT 'norm_n', sigma, 1.0, greatest(least(1 + sigma * 0.2::DOUBLE, 2.0), 0.0), 1.0 FROM sg UNION ALL
 SELECT 'norm_o', sigma, 1.0, 1.0, greatest(least(1 + sigma * 0.05::DOUBLE, 2.0), 0.0) FROM sg),
 sw AS (SELECT scanned, sigma::DOUBLE AS sigma, sample_id, mode, {X_BIN_SQL} AS bin, w0 * CASE WHEN mode = 'A' THEN va ELSE 1 END
 * CASE WHEN mode = 'N' AND x > 10 AND x <= 40 THEN vn ELSE 1 END * CASE WHEN channel = 'O' THEN vo ELSE 1 END AS w FROM es, vr),
 sp AS (SELECT scanned, sigma, sample_id, mode, bin, sum(w) AS mc, sum(w * w) AS w2 FROM sw WHERE w > 0 GROUP BY ALL)"""


SCAN_PARAMS = [("norm_a", 6, 0.8, 1.2), ("norm_n", 6, 0.7, 1.3), ("norm_o", 6, 0.9, 1.1)]
SCAN_SQL = f"""{SAMPLE_SQL}, ax AS (SELECT p AS scanned, start + i.range AS point, lo + (i.range + 0.5) * ((hi - lo) / 6) AS x FROM (VALUES ('norm_a', 0, 0.8::DOUBLE, 1.2::DOUBLE),
 ('norm_n', 6, 0.7::DOUBLE, 1.3::DOUBLE), ('norm_o', 12, 0.9::DOUBLE, 1.1::DOUBLE)) t(p, start, lo, hi), range(6) i),
 sw AS (SELECT point, scanned, ax.x AS x, sample_id, CAST(floor((es.x - 0.5) / 5) AS INTEGER) AS bin, w0 * CASE WHEN scanned = 'norm_a' AND mode = 'A' THEN ax.x
 WHEN scanned = 'norm_n' AND mode = 'N' AND es.x > 10 AND es.x <= 40 THEN ax.x WHEN scanned = 'norm_o' AND channel = 'O' THEN ax.x ELSE 1 END AS w FROM es, ax),
 sp AS (SELECT point, scanned, x, sample_id, bin, sum(w) AS mc FROM sw GROUP BY ALL), dat AS (SELECT sample_id, {X_BIN_SQL} AS bin, count(*)::DOUBLE AS data FROM es GROUP BY ALL)"""


@add("llh_scan_1d", f"""WITH {SCAN_SQL} SELECT CAST(point AS BIGINT) AS point, scanned, x, sp.sample_id, 2 * sum({poisson_sql()}) AS llh FROM sp JOIN dat ON sp.sample_id = dat.sample_id AND sp.bin = dat.bin
 GROUP BY point, scanned, x, ROLLUP (sp.sample_id)""", "x llh", digits=7)
def _(spark, path):
    grid = predict.scan_grid_1d(spark, SCAN_PARAMS, {p[0]: 1.0 for p in SCAN_PARAMS})
    matched = events.match_norms(binned_sample(spark, path), NORMS, None, {"modes": "mode", "channels": "channel"})
    summed = stored(predict.signatures(matched), "signatures")
    out = predict.predict_spectra(summed, predict.norm_factors(grid.select("point", "param", "value"), NORMS), 18)
    label = grid.select("point", "scanned", "x").distinct()
    return toys.llh_scan(out, data_spectrum(spark, path)).join(F.broadcast(label), "point")  # one row per point


@add("sigma_variations", f"WITH {SIGMA_SQL} SELECT scanned, sigma, sample_id, mode, bin, mc, w2 FROM sp", "sigma mc w2", digits=11)
def _(spark, path):
    return sigma_spectra(spark, path)


@add("sigma_var_ratio", f"""WITH {SIGMA_SQL} SELECT a.scanned, a.sigma, a.sample_id, a.mode, a.bin, a.mc / b.mc AS ratio FROM sp a JOIN sp b
 ON b.sigma = 0 AND a.scanned = b.scanned AND a.sample_id = b.sample_id AND a.mode = b.mode AND a.bin = b.bin WHERE a.sigma <> 0""", "sigma ratio", digits=8)
def _(spark, path):
    keys = ("scanned", "sample_id", "mode", "bin")
    return predict.sigma_var_ratio(sigma_spectra(spark, path), keys).select(*keys, "sigma", "ratio")


@add("sigma_var_rates", f"WITH {SIGMA_SQL} SELECT scanned, sigma, sample_id, sum(mc) AS rate FROM sp GROUP BY ALL", "sigma rate", digits=8)
def _(spark, path):
    return predict.sigma_var_rates(sigma_spectra(spark, path))


def llhmap_table(spark, path):
    return table(spark, path, "lineitem").select("l_discount", "l_tax", "l_quantity", F.col("l_extendedprice").alias("Total_LLH"))


@add("profile_llh_1d", """SELECT 'l_discount' AS param, l_discount AS value, least(min(l_extendedprice), 1234567890) AS llh FROM lineitem GROUP BY ALL UNION ALL
 SELECT 'l_tax', l_tax, least(min(l_extendedprice), 1234567890) FROM lineitem GROUP BY ALL""", "value llh")
def _(spark, path):
    return predict.profile_llh_1d(llhmap_table(spark, path), ["l_discount", "l_tax"])


@add("profile_llh_2d", " UNION ALL ".join(
    f"SELECT '{a}' AS param_x, '{b}' AS param_y, {a} AS x, {b} AS y, least(min(l_extendedprice), 1234567890) AS llh FROM lineitem GROUP BY ALL"
    for a, b in (("l_discount", "l_tax"), ("l_discount", "l_quantity"), ("l_tax", "l_quantity"))), "x y llh")
def _(spark, path):
    return predict.profile_llh_2d(llhmap_table(spark, path), ["l_discount", "l_tax", "l_quantity"])


@add("step_scale_from_scan", """WITH s AS (SELECT l_returnflag AS param, l_quantity AS x, min(l_extendedprice) / 1000000 AS llh FROM lineitem GROUP BY ALL),
 e AS (SELECT param, greatest(arg_min(llh, x), arg_max(llh, x)) AS end_llh FROM s GROUP BY param)
 SELECT param, end_llh, CASE WHEN end_llh >= 0.001 THEN 1 / sqrt(end_llh) * 2.38 / sqrt(3) END AS step_scale FROM e""", "end_llh step_scale")
def _(spark, path):
    scan = table(spark, path, "lineitem").groupBy(F.col("l_returnflag").alias("param"), F.col("l_quantity").alias("x")).agg(
        (F.min("l_extendedprice") / 1000000).alias("llh"))
    return predict.step_scale_from_scan(scan, 3)


@add("throw_prior")
def _(spark, path):
    chain = li_chain(spark, path)
    means = moments.column_means(chain, LI)
    entries = moments.covariance(chain, LI).collect()  # parameters squared
    cov = np.zeros((4, 4))
    for r in entries:
        cov[LI.index(r["param_i"]), LI.index(r["param_j"])] = r["cov"]
    params = [{"name": p, "prior": means[p], "low": lo, "up": hi} for p, (lo, hi) in zip(LI, BOUNDS)]
    return predict.throw_prior(spark, params, cov, 500, seed=11)


@add("apply_tune", """SELECT s_name AS name, CASE WHEN s_acctbal > 0 THEN s_acctbal / 100 ELSE 1 END AS prior FROM supplier""", "prior")
def _(spark, path):
    params = supplier_params(spark, path)
    base = table(spark, path, "supplier")
    tunes = base.filter("s_acctbal > 0").select(
        F.explode(F.array(F.lit("low"), F.lit("high"))).alias("tune"), F.col("s_name").alias("param"), F.col("s_acctbal").alias("value"))
    tunes = tunes.withColumn("value", F.when(F.col("tune") == "low", F.col("value") / 100).otherwise(F.col("value") * 100))
    return predict.apply_tune(params, tunes, "low").select("name", "prior")


@add("pca_transform", f"""WITH {LI_SQL} SELECT chain_id, sum(price) AS price_sum, sum(disc) AS disc_sum, count(*) AS n FROM ch GROUP BY 1""", "price_sum disc_sum")
def _(spark, path):
    cov = np.diag([200.0, 7e8, 0.001, 0.0007])
    cov[1, 2] = cov[2, 1] = 100.0
    transfer = predict.pca_basis(cov, 1, 2, 0.0)
    sample = li_chain(spark, path)
    there = predict.pca_transform(sample, LI, transfer, keep=("chain_id",))
    back = predict.pca_transform(there, LI, transfer, inverse=True, keep=("chain_id",))
    return back.groupBy("chain_id").agg(F.sum("price").alias("price_sum"), F.sum("disc").alias("disc_sum"), F.count(F.lit(1)).alias("n"))


@add("produce_toys")
def _(spark, path):
    toys_, _info = plans.toys_from_chain(
        ev_chain(spark, path).withColumn("norm_a", F.col("k") / 100 + 0.5).withColumn("norm_n", F.col("root") / 10).withColumn("norm_o", F.lit(1.0)),
        binned_sample(spark, path), NORMS, {"modes": "mode", "channels": "channel"}, 50, ["norm_a", "norm_n", "norm_o"])
    return toys_


# -- toys ----------------------------------------------------------------------

TOYS = f"WITH {toy_sql()}"


def toy_table(spark, path, extra=()):
    return stored(events.fill_spectra(binned_sample(spark, path), keys=("toy", "sample_id", *extra, "bin")), "toys")


def toy_data(spark, path):
    binned = binned_sample(spark, path)
    n = binned.select("toy").distinct().count()
    counted = binned.groupBy("sample_id", "bin").agg(F.ceil(F.count(F.lit(1)) / n).cast("double").alias("data"))
    return model_bins(spark).join(counted, ["sample_id", "bin"], "left").fillna(0.0)


TW = TOYS + ", tw AS (SELECT *, 1 + toy % 3 AS weight FROM toys)"


def weighted_toys(spark, path, extra=()):
    return toy_table(spark, path, extra).withColumn("weight", 1.0 + F.col("toy") % 3)


def moments_sql(keys: str, values: str, source: str = "tw") -> str:
    parts = ", ".join(
        f"sum(weight * {v}) / sum(weight) AS {n}_mean, sqrt(greatest(0, sum(weight * ({v} - c_{n}) * ({v} - c_{n})) / sum(weight) - power(sum(weight * ({v} - c_{n})) / sum(weight), 2))) AS {n}_rms"
        for n, v in (x.split("=") for x in values.split()))
    centre = ", ".join(f"avg({v}) OVER (PARTITION BY {keys}) AS c_{n}" for n, v in (x.split("=") for x in values.split()))
    return f"SELECT {keys}, {parts} FROM (SELECT *, {centre} FROM {source}) GROUP BY {keys}"


@add("predictive_mean", f"{TW} {moments_sql('sample_id, bin', 'mc=mc w2=w2')}", "mc_mean mc_rms w2_mean w2_rms", digits=8)
def _(spark, path):
    return toys.predictive_mean(weighted_toys(spark, path), bins=model_bins(spark))


@add("predictive_by_mode", f"WITH {toy_sql(', mode')}, tw AS (SELECT *, 1 + toy % 3 AS weight FROM toys) {moments_sql('sample_id, mode, bin', 'mc=mc w2=w2')}",
     "mc_mean mc_rms w2_mean w2_rms", digits=8)
def _(spark, path):
    return toys.predictive_by_mode(weighted_toys(spark, path, ("mode",)))


BETA = f"{TW}, bt AS (SELECT tw.*, (sqrt(power(mc * (w2 / (mc * mc)) - 1, 2) + 4 * data * (w2 / (mc * mc))) - (mc * (w2 / (mc * mc)) - 1)) / 2 AS beta FROM tw JOIN dat ON tw.sample_id = dat.sample_id AND tw.bin = dat.bin WHERE mc > 0)"


@add("beta_study", f"{BETA} {moments_sql('sample_id, bin', 'beta=beta', 'bt')}", "beta_mean beta_rms", digits=8)
def _(spark, path):
    return toys.beta_study(weighted_toys(spark, path), toy_data(spark, path))


@add("apply_beta", f"""{BETA}, b AS ({moments_sql('sample_id, bin', 'beta=beta', 'bt')}), m AS ({moments_sql('sample_id, bin', 'mc=mc')}) SELECT sample_id, bin, mc_mean * beta_mean AS corrected,
 sqrt(power(beta_mean * mc_rms, 2) + power(mc_mean * beta_rms, 2)) AS corrected_error FROM b JOIN m USING (sample_id, bin)""", "corrected corrected_error", digits=8)
def _(spark, path):
    table_ = weighted_toys(spark, path)
    out = toys.apply_beta(toys.predictive_mean(table_), toys.beta_study(table_, toy_data(spark, path)))
    return out.select("sample_id", "bin", "corrected", "corrected_error")


VIOLIN = f"""{TOYS}, mx AS (SELECT sample_id, max(mc) * 1.05 AS top FROM toys GROUP BY 1), v AS (SELECT toys.sample_id, bin,
 CAST(least(floor(400 * (mc - 0.0) / (top - 0.0)), 399) AS INTEGER) AS content_bin, count(*) AS n_toys,
 (CAST(least(floor(400 * (mc - 0.0) / (top - 0.0)), 399) AS INTEGER) + 0.5) * top / 400 AS content FROM toys JOIN mx ON toys.sample_id = mx.sample_id GROUP BY ALL)"""


@add("toy_violin", f"{VIOLIN} SELECT * FROM v", "content", digits=12)
def _(spark, path):
    return toys.toy_violin(toy_table(spark, path), bins=model_bins(spark))


@add("violin_summary", f"{VIOLIN}, w AS (SELECT *, n_toys AS weight FROM v) {moments_sql('sample_id, bin', 'content=content', 'w')}", "content_mean content_rms", digits=7)
def _(spark, path):
    return toys.violin_summary(toys.toy_violin(toy_table(spark, path), bins=model_bins(spark)))


RATES = f"""{TOYS}, r AS (SELECT toy, sample_id, sum(mc) AS rate FROM toys GROUP BY ALL), a AS (SELECT * FROM r UNION ALL SELECT toy, NULL, sum(rate) FROM r GROUP BY toy),
 o AS (SELECT sample_id, sum(data) AS data_rate FROM dat GROUP BY ROLLUP (sample_id)), er AS (SELECT a.sample_id, avg(rate) AS mean, stddev_pop(rate) AS sigma,
 max(data_rate) AS data_rate, avg(CASE WHEN rate >= data_rate THEN 1.0 ELSE 0.0 END) AS p_value, 100 * stddev_pop(rate) / avg(rate) AS frac_error
 FROM a JOIN o ON a.sample_id IS NOT DISTINCT FROM o.sample_id GROUP BY a.sample_id)"""


@add("event_rates", f"{RATES} SELECT * FROM er", "mean sigma data_rate p_value frac_error", digits=8)
def _(spark, path):
    return toys.event_rates(toy_table(spark, path), toy_data(spark, path))


# The normal distribution as a series: 1/2 + density(z) * sum of z^(2n+1) / (2n+1)!!
@add("rate_significance", f"""{RATES}, z AS (SELECT *, (data_rate - mean) / sigma AS z FROM er), t AS (SELECT z.sample_id, sum(exp((2 * n.range + 1) * ln(abs(z))
 - ((n.range + 1) * ln(2.0) + lgamma(n.range + 1.5) - 0.5 * ln(pi())))) AS series FROM z, range(150) n GROUP BY z.sample_id)
 SELECT z.*, 0.5 + sign(z) * series * exp(-0.5 * z * z) / sqrt(2 * pi()) AS z_pvalue FROM z JOIN t ON z.sample_id IS NOT DISTINCT FROM t.sample_id""",
     "mean sigma data_rate p_value frac_error z z_pvalue", digits=7)
def _(spark, path):
    return toys.rate_significance(toys.event_rates(toy_table(spark, path), toy_data(spark, path)))


def corr_over_toys(by: str, keys: str = "", extra: str = "") -> str:
    k = f"{keys}, " if keys else ""
    on = f" AND a.{keys} = b.{keys}" if keys else ""
    return f"""WITH {toy_sql(extra)}, r AS (SELECT toy, {k}{by}, sum(mc) AS r FROM toys GROUP BY ALL), c AS (SELECT *, r - avg(r) OVER (PARTITION BY {k}{by}) AS d FROM r)
 SELECT {'a.' + keys + ', ' if keys else ''}a.{by} AS i, b.{by} AS j, corr(a.d, b.d) AS corr FROM c a JOIN c b ON a.toy = b.toy{on} AND a.{by} < b.{by} GROUP BY ALL"""


@add("rate_correlation_samples", corr_over_toys("sample_id"), "corr", digits=7)
def _(spark, path):
    return toys.rate_correlation(toy_table(spark, path), "sample_id")


@add("rate_correlation_modes", corr_over_toys("mode", "sample_id", ", mode"), "corr", digits=7)
def _(spark, path):
    return toys.rate_correlation(toy_table(spark, path, ("mode",)), "mode", ("sample_id",))


@add("rate_correlation_bins", corr_over_toys("bin", "sample_id"), "corr", digits=7)
def _(spark, path):
    return toys.rate_correlation(toy_table(spark, path), "bin", ("sample_id",))


@add("information_criteria", f"""{TW}, pm AS ({moments_sql('sample_id, bin', 'mc=mc w2=w2')}), b AS (SELECT 2 * sum({poisson_sql('data', 'mc_mean')}) AS d_hat, sum(data) AS n_data, count(*) AS n_bins
 FROM dat JOIN pm ON dat.sample_id = pm.sample_id AND dat.bin = pm.bin), l AS (SELECT toys.sample_id, toys.bin, -({poisson_sql()}) AS ll FROM toys JOIN dat ON toys.sample_id = dat.sample_id AND toys.bin = dat.bin),
 q AS (SELECT avg(ll) AS m, avg(ll * ll) AS q, ln(avg(exp(ll))) AS lppd FROM l GROUP BY sample_id, bin), w AS (SELECT sum(lppd) AS lppd, sum(q - m * m) AS p_waic, -2 * sum(m) AS d_bar FROM q)
 SELECT d_hat, d_bar, 4 * ln(floor(n_data)) + d_hat AS bic_events, 4 * ln(n_bins) + d_hat AS bic_bins, abs(d_bar - d_hat) AS p_dic, d_hat + 2 * abs(d_bar - d_hat) AS dic, p_waic,
 -2 * (lppd - p_waic) AS waic FROM b, w""", "d_hat d_bar bic_events bic_bins p_dic dic p_waic waic", digits=7)
def _(spark, path):
    table_ = toy_table(spark, path)
    mean = toys.predictive_mean(table_.withColumn("weight", 1.0 + F.col("toy") % 3))
    return toys.information_criteria(table_, toy_data(spark, path), mean, 4)


# Data that keep no zero counts, and a toy (-1) without events; events from x = 30.5 on are in no data.
SPARSE = f"""{TOYS.replace("hits AS (SELECT sample_id", "hits0 AS (SELECT sample_id", 1).replace("dat AS (SELECT s.range", "hits AS (SELECT * FROM hits0 WHERE bin < 6), dat AS (SELECT s.range", 1).replace("every_toy AS (SELECT DISTINCT toy FROM es)", "every_toy AS (SELECT DISTINCT toy FROM es UNION SELECT -1)", 1)},
 tw AS (SELECT *, CAST(1.0 AS DOUBLE) AS weight FROM toys)"""


def sparse(spark, path):
    """(toys, every toy, data): the data without rows for empty bins, and a toy without events."""
    table_ = toy_table(spark, path)
    every = table_.select("toy").distinct().union(spark.range(1).select((F.col("id") - 1).alias("toy"))).withColumn("weight", F.lit(1.0))
    binned = binned_sample(spark, path)
    n = every.count()
    counted = binned.where("bin < 6").groupBy("sample_id", "bin").agg(F.ceil(F.count(F.lit(1)) / n).cast("double").alias("data"))
    return table_.withColumn("weight", F.lit(1.0)), every, counted


@add("predictive_mean_empty_toy", f"{SPARSE} {moments_sql('sample_id, bin', 'mc=mc w2=w2')}", "mc_mean mc_rms w2_mean w2_rms", digits=8)
def _(spark, path):
    table_, every, _ = sparse(spark, path)
    return toys.predictive_mean(table_, info=every)


@add("information_criteria_sparse_data", f"""{SPARSE}, pm AS ({moments_sql('sample_id, bin', 'mc=mc w2=w2')}), b AS (SELECT 2 * sum({poisson_sql('data', 'mc_mean')}) AS d_hat, sum(data) AS n_data, count(*) AS n_bins
 FROM dat JOIN pm USING (sample_id, bin)), l AS (SELECT toys.sample_id, toys.bin, -({poisson_sql()}) AS ll FROM toys JOIN dat ON toys.sample_id = dat.sample_id AND toys.bin = dat.bin),
 t AS (SELECT *, max(ll) OVER (PARTITION BY sample_id, bin) AS top FROM l),
 q AS (SELECT avg(ll) AS m, avg(ll * ll) AS q, max(top) + ln(avg(exp(ll - top))) AS lppd FROM t GROUP BY sample_id, bin), w AS (SELECT sum(lppd) AS lppd, sum(q - m * m) AS p_waic, -2 * sum(m) AS d_bar FROM q)
 SELECT d_hat, d_bar, 4 * ln(n_bins) + d_hat AS bic_bins, p_waic, -2 * (lppd - p_waic) AS waic FROM b, w""", "d_hat d_bar bic_bins p_waic waic", digits=7)
def _(spark, path):
    table_, every, data = sparse(spark, path)
    out = toys.information_criteria(table_, data, toys.predictive_mean(table_, info=every), 4, info=every)
    return out.select("d_hat", "d_bar", "bic_bins", "p_waic", "waic")


@add("fluctuated_deviances_sparse_data", f"{SPARSE} SELECT toy, toys.sample_id, 2 * sum({poisson_sql()}) AS data_llh FROM toys JOIN dat USING (sample_id, bin) GROUP BY toy, toys.sample_id", "data_llh", digits=7)
def _(spark, path):
    table_, every, data = sparse(spark, path)
    out = toys.fluctuated_deviances(table_.drop("weight"), data, toys.predictive_mean(table_, info=every), info=every)
    return out.select("toy", "sample_id", "data_llh")


# WAIC on whole data counts: likelihoods of thousands per bin, which no exponential holds.
BIG = f"""{TOYS}, big AS (SELECT dat.sample_id, dat.bin, coalesce(n, 0)::DOUBLE AS data FROM dat LEFT JOIN hits USING (sample_id, bin)),
 l AS (SELECT toys.sample_id, toys.bin, -({poisson_sql()}) AS ll FROM toys JOIN big ON toys.sample_id = big.sample_id AND toys.bin = big.bin),
 t AS (SELECT *, max(ll) OVER (PARTITION BY sample_id, bin) AS top FROM l),
 q AS (SELECT avg(ll) AS m, avg(ll * ll) AS q, max(top) + ln(avg(exp(ll - top))) AS lppd FROM t GROUP BY sample_id, bin)"""


@add("waic_whole_counts", f"{BIG} SELECT sum(q - m * m) AS p_waic, -2 * (sum(lppd) - sum(q - m * m)) AS waic FROM q", "p_waic waic", digits=7)
def _(spark, path):
    table_ = toy_table(spark, path)
    mean = toys.predictive_mean(table_.withColumn("weight", F.lit(1.0)))
    return toys.information_criteria(table_, data_spectrum(spark, path), mean, 4).select("p_waic", "waic")


CHI2 = f"""{TOYS}, c AS (SELECT toy, toys.sample_id, 2 * sum({poisson_sql()}) AS data_llh, 2 * sum({poisson_sql('ceil(w2)')}) AS fluct_llh FROM toys
 JOIN dat ON toys.sample_id = dat.sample_id AND toys.bin = dat.bin GROUP BY ALL), info AS (SELECT DISTINCT toy, toy / 10.0 AS penalty FROM toys),
 e AS (SELECT * FROM c UNION ALL SELECT c.toy, NULL, sum(data_llh) + max(penalty), sum(fluct_llh) + max(penalty) FROM c JOIN info ON c.toy = info.toy GROUP BY c.toy)"""


def chi2(spark, path):
    """Deviance of data and of a second, fixed variation of each toy."""
    table_ = toy_table(spark, path)
    a = toys.deviance(table_, toy_data(spark, path), "poisson", "data_llh")
    varied = table_.withColumn("varied", F.ceil("w2").cast("double"))
    b = toys.binned_llh(varied, "poisson", data="varied").groupBy("toy", "sample_id").agg((2 * F.sum("llh")).alias("fluct_llh"))
    return a.join(b, ["toy", "sample_id"])


@add("predictive_pvalue", f"""{CHI2}, m AS (SELECT *, min(least(data_llh, fluct_llh)) OVER (PARTITION BY sample_id) AS lo, max(greatest(data_llh, fluct_llh)) OVER (PARTITION BY sample_id) AS hi FROM e),
 g AS (SELECT *, CASE WHEN fluct_llh < hi THEN least(floor(50 * (fluct_llh - lo) / (hi - lo)), 49) END AS gx, CASE WHEN data_llh < hi THEN least(floor(50 * (data_llh - lo) / (hi - lo)), 49) END AS gy FROM m)
 SELECT sample_id, avg(CASE WHEN fluct_llh >= data_llh THEN 1.0 ELSE 0.0 END) AS p_exact, sum(CASE WHEN gx >= gy THEN 1.0 ELSE 0.0 END) / count(gx + gy) AS p_binned, count(*) AS n_toys
 FROM g GROUP BY sample_id""", "p_exact p_binned")
def _(spark, path):
    table_ = chi2(spark, path)
    info = table_.select("toy").distinct().withColumn("penalty", F.col("toy") / 10.0)
    return toys.predictive_pvalue(table_, info)


@add("fluctuated_deviances")
def _(spark, path):
    table_ = toy_table(spark, path)
    return toys.fluctuated_deviances(table_, toy_data(spark, path), toys.predictive_mean(table_.withColumn("weight", F.lit(1.0))))


@add("poisson_fluctuate")
def _(spark, path):
    return toys.poisson_fluctuate(toy_table(spark, path))


@add("multinomial_fluctuate")
def _(spark, path):
    return toys.multinomial_fluctuate(toy_table(spark, path))


@add("llh_tail_pvalue", f"{CHI2} SELECT sample_id, avg(CASE WHEN data_llh >= 12.345 THEN 1.0 ELSE 0.0 END) AS p_value FROM c GROUP BY 1", "p_value")
def _(spark, path):
    return toys.llh_tail_pvalue(chi2(spark, path), "data_llh", 12.345, ("sample_id",))


@add("hist_tail_pvalue", f"{HIST} SELECT param, sum(CASE WHEN (lo + hi) / 2 >= 20.05 THEN content ELSE 0 END) / sum(content) AS p_value FROM hist GROUP BY 1", "p_value")
def _(spark, path):
    return toys.hist_tail_pvalue(li_hist(spark, path), 20.05)


PVALUES = """pv AS (SELECT l_returnflag AS grp, l_linenumber AS test, avg(l_discount) * 12 - 0.3 + l_linenumber / 20.0 AS p_value FROM lineitem GROUP BY l_returnflag, l_linenumber)"""


def pvalues(spark, path):
    return table(spark, path, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("test")).agg(
        F.avg("l_discount").alias("_a")).select("grp", "test", (F.col("_a") * 12 - 0.3 + F.col("test") / 20.0).alias("p_value"))


@add("combine_pvalues", f"""WITH {PVALUES}, s AS (SELECT grp, -2 * sum(ln(greatest(p_value, 1e-5))) AS statistic, count(*) AS n FROM pv GROUP BY grp)
 SELECT grp, statistic, n, sum(exp(-statistic / 2) * power(statistic / 2, i.range) / factorial(CAST(i.range AS INTEGER))) AS combined FROM s, range(7) i
 WHERE i.range < n GROUP BY grp, statistic, n""", "statistic combined", digits=8)
def _(spark, path):
    return toys.combine_pvalues(pvalues(spark, path), ("grp",))


# More than a thousand ordinary p-values a group at any scale of the tables; their combination is an ordinary one.
@add("combine_many_pvalues", """WITH pv AS (SELECT l_linenumber % 3 AS grp, ((l_orderkey * 13 + l_partkey * 7 + l_suppkey) % 1009 + 0.5) / 1009.0::DOUBLE AS p_value FROM lineitem),
 s AS (SELECT grp, -2 * sum(ln(greatest(p_value, 1e-5))) AS statistic, count(*) AS n FROM pv GROUP BY grp)
 SELECT grp, statistic, n, TRUE AS ordinary FROM s""", "statistic", digits=8)
def _(spark, path):
    place = (F.col("l_orderkey") * 13 + F.col("l_partkey") * 7 + F.col("l_suppkey")) % 1009
    out = toys.combine_pvalues(table(spark, path, "lineitem").select(
        (F.col("l_linenumber") % 3).alias("grp"), ((place + 0.5) / 1009.0).alias("p_value")), ("grp",))
    # By the cube-root approximation of the chi2 distribution: the tail must be its normal tail.
    m = 2.0 * F.col("n")
    z = (F.pow(F.col("statistic") / m, 1 / 3) - 1 + 2 / (9 * m)) / F.sqrt(2 / (9 * m))
    return out.withColumn("_t", normal_pvalue(-z)).select(
        "grp", "statistic", "n", (F.abs(F.col("combined") - F.col("_t")) < 1e-3).alias("ordinary"))


@add("bonferroni", f"""WITH {PVALUES} SELECT grp, test, p_value, 0.2 / count(*) OVER (PARTITION BY grp) AS level, CASE WHEN p_value < 0.5 AND p_value < 0.2 / count(*) OVER (PARTITION BY grp) THEN 'low'
 WHEN p_value > 0.5 AND p_value > 1 - 0.2 / count(*) OVER (PARTITION BY grp) THEN 'high' END AS flag FROM pv""", "p_value level")
def _(spark, path):
    return toys.bonferroni(pvalues(spark, path), 0.2, ("grp",))


@add("predictive_llh_table", f"""{SPECTRA}, a AS (SELECT sample_id, sum(data) AS d, sum(mc) AS m, 2 * sum({poisson_sql()}) AS l FROM sp GROUP BY 1),
 b AS (SELECT sample_id, sum(data) AS d, sum(w2) AS m, 2 * sum({poisson_sql('data', 'w2')}) AS l FROM sp GROUP BY 1)
 SELECT a.sample_id, a.d AS nominal_data, a.m AS nominal_mc, a.l AS nominal_llh, b.d AS varied_data, b.m AS varied_mc, b.l AS varied_llh FROM a JOIN b ON a.sample_id = b.sample_id""",
     "nominal_data nominal_mc nominal_llh varied_data varied_mc varied_llh", digits=7)
def _(spark, path):
    table_ = sources.load_data_spectrum(spectra(spark, path), data_spectrum(spark, path))
    return toys.predictive_llh_table({"nominal": table_, "varied": table_.withColumn("mc", F.col("w2"))})
