"""Queries on weighted events: selection, labels, binning, spectra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chainlens.catalog.chains import supplier_params
from chainlens.catalog.registry import (
    AXES, SAMPLE_SQL, X_BIN_SQL, X_EDGES, add, ev_chain, ev_sql, event_sample, table,
)
from chainlens.operators import binning, events as ops, hist, toys
from chainlens.sources import events as sources

ES = f"WITH {SAMPLE_SQL}"


@add("read_events", """SELECT CAST(channel AS INTEGER) AS channel, CAST(init_pdg AS INTEGER) AS init_pdg, CAST(final_pdg AS INTEGER) AS final_pdg,
 count(*) AS n, sum(l_quantity) AS total FROM lineitem, (VALUES (0, 14, 14), (1, 14, 12)) t(channel, init_pdg, final_pdg) GROUP BY ALL""", "total")
def _(spark, path):
    f = f"{path}/lineitem.parquet"
    return sources.read_events(spark, [(f, 14, 14), (f, 14, 12)]).groupBy("channel", "init_pdg", "final_pdg").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))


@add("select_events", f"""{ES} SELECT sample_id, count(*) AS n, sum(w0) AS rate FROM es WHERE x >= 5 AND x < 40
 AND (sample_id <> 1 OR (y >= 20000 AND y < 60000)) GROUP BY 1""", "rate")
def _(spark, path):
    kept = ops.select_events(event_sample(spark, path), [
        {"var": "x", "lo": 5, "hi": 40}, {"var": "y", "lo": 20000, "hi": 60000, "sample_id": 1}])
    return kept.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("w0").alias("rate"))


def sub_events(spark, path):
    return table(spark, path, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("e"),
        F.reverse(F.col("embedding")).cast("array<double>").alias("r"))


@add("select_subevents", """SELECT vec_id, label, e, r FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS e, unnest(list_reverse(embedding))::DOUBLE AS r
 FROM embeddings) WHERE e >= -0.1 AND e < 0.2 AND r >= 0 AND r < 0.3""", "e r")
def _(spark, path):
    return ops.select_subevents(sub_events(spark, path), ["e", "r"], [("e", -0.1, 0.2), ("r", 0.0, 0.3)])


@add("var_hist_subevents", """SELECT label, CAST(floor((e + 0.5) / 0.125) AS INTEGER) AS bin, count(*)::DOUBLE AS content FROM (
 SELECT label, unnest(embedding)::DOUBLE AS e FROM embeddings) WHERE e >= -0.25 AND e < 0.5 GROUP BY ALL""", "content")
def _(spark, path):
    spread = ops.select_subevents(sub_events(spark, path).drop("r"), ["e"], [("e", -0.25, 0.5)])
    edges = [-0.5 + 0.125 * i for i in range(9)]
    return ops.var_hist_1d(spread, "e", edges, weight=None, keys=("label",)).select("label", "bin", "content")


@add("select_mode_channel", f"{ES} SELECT sample_id, count(*) AS n FROM es WHERE mode = 'A' AND channel = 'F' AND x >= 3 AND x < 30 GROUP BY 1")
def _(spark, path):
    kept = ops.select_events(event_sample(spark, path), [{"var": "x", "lo": 3, "hi": 30}])
    return ops.select_mode_channel(kept, "A", "F").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


def leptons(spark, path):
    return ev_chain(spark, path).select(
        F.col("step").alias("event_id"), (F.lit(0.1) + F.col("val") / 400.0).alias("p"), (F.col("k") / 100.0).alias("c"),
        (F.lit(0.5) + F.col("root") / 10.0).alias("e"))


LEP = f"""WITH {ev_sql()}, lp AS (SELECT step AS event_id, CAST(0.1 AS DOUBLE) + val / CAST(400 AS DOUBLE) AS p, k / CAST(100 AS DOUBLE) AS c,
 CAST(0.5 AS DOUBLE) + root / CAST(10 AS DOUBLE) AS e FROM ch)"""
M = "CAST(0.10565837 AS DOUBLE)"


@add("derive_kinematics", f"""{LEP}, m AS (SELECT *, CAST(0.93956536 AS DOUBLE) - CAST(0.027 AS DOUBLE) AS mn, CAST(0.93827203 AS DOUBLE) AS mp, sqrt(p * p + {M} * {M}) AS el FROM lp)
 SELECT event_id, (2 * mn * el - {M} * {M} + mp * mp - mn * mn) / (2 * (mn - el + p * c)) AS e_qe FROM m""", "e_qe", digits=8)
def _(spark, path):
    return ops.derive_kinematics(leptons(spark, path), "p", "c", 27.0).select("event_id", "e_qe")


@add("q2_shift", f"""{LEP}, m AS (SELECT *, CAST(0.3 AS DOUBLE) AS q2, p * CAST(1.02 AS DOUBLE) AS pn FROM lp), n AS (SELECT *, (2 * e * sqrt(p * p + {M} * {M}) - {M} * {M} - q2) / (2 * e * p) AS ct FROM m)
 SELECT event_id, 2 * e * (sqrt(pn * pn + {M} * {M}) - pn * ct) - {M} * {M} - q2 AS shift FROM n""", "shift", digits=8)
def _(spark, path):
    shift = ops.q2_shift(F.col("p"), F.col("p") * 1.02, F.col("e"), F.lit(0.3))
    return leptons(spark, path).select("event_id", shift.alias("shift"))


MODES = [(1, 0, "CCQE", "ccqe", False), (2, 1, "RES", "res", False), (3, 1, "RES", "res", False),
         (4, 2, "NCOTHER", "nc", True), (4, 3, "DIS", "dis", False)]
MODE_SQL = "md AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, '{c}')" for a, b, c, _, _ in MODES) + ") t(code, mode, name))"


def modes(spark):
    return spark.createDataFrame(MODES, "generator_code int, mode int, name string, spline_suffix string, is_nc boolean")


@add("map_modes", f"""WITH {MODE_SQL} SELECT md.mode AS mode, coalesce(name, 'UNKNOWN_BAD') AS mode_name, count(*) AS n, sum(l_quantity) AS total
 FROM lineitem LEFT JOIN md ON l_linenumber = code AND NOT (code = 4 AND mode = 3) GROUP BY ALL""", "total")
def _(spark, path):
    known = modes(spark).filter("not (generator_code = 4 and mode = 3)")
    events = table(spark, path, "lineitem").select(F.col("l_linenumber").alias("generator_code"), "l_quantity")
    return ops.map_modes(events, known).groupBy("mode", "mode_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))


@add("duplicate_codes", """SELECT l_linenumber AS generator_code, count(DISTINCT l_returnflag) AS n_modes FROM lineitem GROUP BY 1
 HAVING count(DISTINCT l_returnflag) > 1""")
def _(spark, path):
    return ops.duplicate_codes(table(spark, path, "lineitem").select(
        F.col("l_linenumber").alias("generator_code"), F.col("l_returnflag").alias("mode")))


CHANNELS = [("A", "F", 0), ("A", "O", 1), ("R", "F", 2), ("N", "O", 3), ("R", "O", 4), ("N", "F", 5)]


def flavours(spark, path):
    return table(spark, path, "lineitem").select(
        F.col("l_returnflag").alias("init_pdg"), F.col("l_linestatus").alias("final_pdg"), "l_quantity")


@add("map_channels", f"""SELECT t.channel AS channel, count(*) AS n, sum(l_quantity) AS total FROM lineitem JOIN (VALUES {', '.join(map(str, CHANNELS))}) t(a, b, channel)
 ON l_returnflag = a AND l_linestatus = b GROUP BY 1""", "total")
def _(spark, path):
    channels = spark.createDataFrame(CHANNELS, "init_pdg string, final_pdg string, channel int")
    return ops.map_channels(flavours(spark, path), channels).groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))


@add("unmapped_channels", f"""SELECT l_returnflag AS init_pdg, l_linestatus AS final_pdg, count(*) AS n_events FROM lineitem
 WHERE (l_returnflag, l_linestatus) NOT IN (SELECT (a, b) FROM (VALUES {', '.join(map(str, CHANNELS[:3]))}) t(a, b, c)) GROUP BY ALL""")
def _(spark, path):
    channels = spark.createDataFrame(CHANNELS[:3], "init_pdg string, final_pdg string, channel int")
    return ops.unmapped_channels(flavours(spark, path), channels)


NORM_RECORDS = [
    {"idx": 0, "name": "n_a", "modes": ["A"], "targets": [1, 2, 3]},
    {"idx": 1, "name": "n_nr", "modes": ["N", "R"], "kin": {"x": [(5, 20), (30, 45)], "y": [(10000, 70000)]}},
    {"idx": 2, "name": "n_flav", "pdgs": [1, 2], "preosc_pdgs": [1]},
    {"idx": 3, "name": "n_all"},
]


@add("match_norms", """WITH e AS (SELECT l_returnflag AS mode, l_linenumber AS target, l_linenumber % 3 AS pdg, l_linenumber % 2 AS pdg0, l_quantity AS x,
 l_extendedprice AS y, l_tax = 0 AS is_nc FROM lineitem), t AS (SELECT CASE WHEN is_nc AND pdg <> pdg0 THEN '' ELSE concat_ws(',',
 CASE WHEN mode = 'A' AND target IN (1, 2, 3) THEN '0' END,
 CASE WHEN mode IN ('N', 'R') AND ((x > 5 AND x <= 20) OR (x > 30 AND x <= 45)) AND y > 10000 AND y <= 70000 THEN '1' END,
 CASE WHEN pdg IN (1, 2) AND pdg0 = 1 THEN '2' END, '3') END AS ids FROM e) SELECT ids, count(*) AS n FROM t GROUP BY 1""")
def _(spark, path):
    events = table(spark, path, "lineitem").select(
        F.col("l_returnflag").alias("mode"), F.col("l_linenumber").alias("target"), (F.col("l_linenumber") % 3).alias("pdg"),
        (F.col("l_linenumber") % 2).alias("pdg_unosc"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"),
        (F.col("l_tax") == 0).alias("is_nc"))
    matched = ops.match_norms(events, NORM_RECORDS)
    return matched.groupBy(F.array_join("norm_ids", ",").alias("ids")).agg(F.count(F.lit(1)).alias("n"))


@add("params_for_sample", """SELECT s_name AS name, t.name AS sample FROM supplier, (VALUES ('NATION1_FHC', 1), ('nation2', 2), ('xNation3', 9)) t(name, n)
 WHERE s_nationkey % 4 = n""")
def _(spark, path):
    return ops.params_for_sample(supplier_params(spark, path), ["NATION1_FHC", "nation2", "xNation3"]).select("name", "sample")


# -- binning -------------------------------------------------------------------

AXES_2D = [{"sample_id": s, "dim": d, "var": v, "edges": e} for s in range(3)
           for d, v, e in ((0, "x", [1.0, 5.0, 15.0, 30.0 + s, 50.0]), (1, "y", [1000.0, 20000.0, 50000.0 - 1000 * s, 90000.0]))]


@add("assign_bin_uniform", f"""{ES}, b AS (SELECT *, CASE WHEN x >= 1 AND x < 5 THEN 0 WHEN x >= 5 AND x < 15 THEN 1 WHEN x >= 15 AND x < 30 + sample_id THEN 2
 WHEN x >= 30 + sample_id AND x < 50 THEN 3 END AS bx, CASE WHEN y >= 1000 AND y < 20000 THEN 0 WHEN y >= 20000 AND y < 50000 - 1000 * sample_id THEN 1
 WHEN y >= 50000 - 1000 * sample_id AND y < 90000 THEN 2 END AS yb FROM es)
 SELECT sample_id, bx + 4 * yb AS bin, bx + 4 * yb + 12 * sample_id AS global_bin, count(*) AS n, sum(w0) AS rate FROM b
 WHERE bx IS NOT NULL AND yb IS NOT NULL GROUP BY ALL""", "rate")
def _(spark, path):
    binned = binning.assign_bin_uniform(event_sample(spark, path), AXES_2D)
    return binned.groupBy("sample_id", "bin", "global_bin").agg(F.count(F.lit(1)).alias("n"), F.sum("w0").alias("rate"))


def box_list():
    rows = []
    for s in range(3):
        rows += [(s, 0, [0.5, 0.0], [10.0, 50000.0]), (s, 1, [8.0 if s == 2 else 10.0, 0.0], [30.0, 50000.0]),
                 (s, 2, [30.0, 0.0], [50.5, 30000.0]), (s, 3, [0.5, 50000.0], [30.0, 110000.0])]
        if s < 2:
            rows.append((s, 4, [30.0, 30000.0], [50.5, 110000.0]))
    return rows


BOX_SQL = "bx AS (SELECT s, b, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM (VALUES " + ", ".join(
    f"({s}, {b}, {lo[0]}, {lo[1]}, {hi[0]}, {hi[1]})" for s, b, lo, hi in box_list()) + ") t(s, b, x0, y0, x1, y1))"
IN_BOX = "x > x0 AND x <= x1 AND y > y0 AND y <= y1"


def boxes(spark):
    return spark.createDataFrame(box_list(), "sample_id int, bin int, lo array<double>, hi array<double>")


@add("assign_bin_boxes", f"""{ES}, {BOX_SQL}, k AS (SELECT sample_id, x, y, w0, (SELECT min(b) FROM bx WHERE s = sample_id AND {IN_BOX}) AS bin FROM es)
 SELECT sample_id, bin, count(*) AS n, sum(w0) AS rate FROM k WHERE bin IS NOT NULL GROUP BY ALL""", "rate")
def _(spark, path):
    binned = binning.assign_bin_boxes(event_sample(spark, path), boxes(spark), ["x", "y"])
    return binned.groupBy("sample_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("w0").alias("rate"))


def data_boxes(spark, path):
    """One box per (sample, mode, channel): a sigma to both sides of the mean of its events."""
    def end(sign):
        return F.array(*[F.avg(v) + sign * F.stddev_pop(v) for v in ("x", "y")])

    number = F.row_number().over(Window.partitionBy("sample_id").orderBy("mode", "channel")) - 1
    return event_sample(spark, path).groupBy("sample_id", "mode", "channel").agg(
        end(-1).alias("lo"), end(1).alias("hi")).withColumn("bin", number.cast("int"))


DATA_BOXES = """bx AS (SELECT sample_id AS s, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY mode, channel) - 1 AS INTEGER) AS b, x0, y0, x1, y1 FROM (
 SELECT sample_id, mode, channel, avg(x) - stddev_pop(x) AS x0, avg(y) - stddev_pop(y) AS y0, avg(x) + stddev_pop(x) AS x1, avg(y) + stddev_pop(y) AS y1
 FROM es GROUP BY ALL))"""


@add("overlapping_bins", f"""{ES}, {DATA_BOXES} SELECT i.s AS sample_id, i.b AS bin_i, j.b AS bin_j FROM bx i JOIN bx j ON i.s = j.s AND i.b < j.b
 AND i.x0 < j.x1 AND j.x0 < i.x1 AND i.y0 < j.y1 AND j.y0 < i.y1""")
def _(spark, path):
    return binning.overlapping_bins(data_boxes(spark, path), 2)


@add("gap_points", f"""{ES}, {DATA_BOXES}, ex AS (SELECT s, min(x0) AS xa, max(x1) AS xb, min(y0) AS ya, max(y1) AS yb FROM bx GROUP BY s),
 pt AS (SELECT s AS sample_id, 0.5 * ((xa + i.range * ((xb - xa) / 100)) + (xa + (i.range + 1) * ((xb - xa) / 100))) AS x,
 0.5 * ((ya + j.range * ((yb - ya) / 100)) + (ya + (j.range + 1) * ((yb - ya) / 100))) AS y FROM ex, range(100) i, range(100) j)
 SELECT sample_id, x AS x0, y AS x1 FROM pt WHERE NOT EXISTS (SELECT 1 FROM bx WHERE s = sample_id AND {IN_BOX})""", "x0 x1", digits=8)
def _(spark, path):
    return binning.gap_points(data_boxes(spark, path), 2)


@add("osc_weight_lookup", f"""WITH {ev_sql(2)}, pr AS (SELECT p.range AS point, c.range AS channel, e.range AS e_bin, z.range AS z_bin,
 ((p.range * 7 + c.range * 5 + e.range * 3 + z.range) % 10) / 10.0 AS prob FROM range(3) p, range(2) c, range(4) e, range(2) z),
 b AS (SELECT chain_id, CASE WHEN val < 10 THEN 0 WHEN val < 50 THEN 1 WHEN val < 100 THEN 2 ELSE 3 END AS eb, CASE WHEN k < 30 THEN 0 ELSE 1 END AS zb
 FROM ch WHERE val >= 0 AND val < 400 AND k >= 0 AND k < 90)
 SELECT CAST(point AS BIGINT) AS point, chain_id AS channel, count(*) AS n, sum(prob) AS total FROM b JOIN pr ON eb = e_bin AND zb = z_bin AND chain_id = channel GROUP BY ALL""", "total")
def _(spark, path):
    n = F.col("id")
    probabilities = spark.range(3 * 2 * 4 * 2).select(
        F.floor(n / 16).alias("point"), (F.floor(n / 8) % 2).cast("int").alias("channel"),
        (F.floor(n / 2) % 4).cast("int").alias("e_bin"), (n % 2).cast("int").alias("z_bin"))
    probabilities = probabilities.withColumn(
        "prob", ((F.col("point") * 7 + F.col("channel") * 5 + F.col("e_bin") * 3 + F.col("z_bin")) % 10) / 10.0)
    events = ev_chain(spark, path, 2).withColumnRenamed("chain_id", "channel")
    out = ops.osc_weight_lookup(events, probabilities, [0.0, 10.0, 50.0, 100.0, 400.0], [0.0, 30.0, 90.0], "val", "k")
    return out.groupBy("point", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("prob").alias("total"))


# -- spectra -------------------------------------------------------------------

SPECTRA = f"""{ES}, hits AS (SELECT sample_id, {X_BIN_SQL} AS bin, sum(w0) AS mc, sum(w0 * w0) AS w2, count(*)::DOUBLE AS data FROM es GROUP BY ALL),
 sp AS (SELECT CAST(s.range AS INTEGER) AS sample_id, CAST(b.range AS INTEGER) AS bin, coalesce(mc, 0.0) AS mc, coalesce(w2, 0.0) AS w2, coalesce(data, 0.0) AS data
   FROM range(3) s, range(10) b LEFT JOIN hits ON hits.sample_id = s.range AND hits.bin = b.range)"""


def binned_sample(spark, path):
    return binning.assign_bin_uniform(event_sample(spark, path), AXES)


def model_bins(spark):
    return binning.every_bin(spark, AXES)


def spectra(spark, path):
    return ops.fill_spectra(binned_sample(spark, path), bins=model_bins(spark))


def data_spectrum(spark, path, binned=None):
    counted = (binned or binned_sample(spark, path)).groupBy("sample_id", "bin").agg(F.count(F.lit(1)).cast("double").alias("data"))
    return model_bins(spark).join(counted, ["sample_id", "bin"], "left").fillna(0.0)


@add("fill_spectra", f"{SPECTRA} SELECT sample_id, bin, mc, w2 FROM sp", "mc w2")
def _(spark, path):
    return spectra(spark, path)


@add("load_data_spectrum", f"{SPECTRA} SELECT sample_id, bin, mc, w2, data FROM sp", "mc w2 data")
def _(spark, path):
    return sources.load_data_spectrum(spectra(spark, path), data_spectrum(spark, path))


# Prediction of events with x >= 13 only: the data's first bins have no prediction, and its bins 8 and 9 no data.
HALVES = f"""{ES}, m AS (SELECT sample_id, {X_BIN_SQL} AS bin, sum(w0) AS mc, sum(w0 * w0) AS w2 FROM es WHERE x >= 13 GROUP BY ALL),
 d AS (SELECT sample_id, {X_BIN_SQL} AS bin, count(*)::DOUBLE AS data FROM es WHERE x < 40.5 GROUP BY ALL),
 hv AS (SELECT coalesce(m.sample_id, d.sample_id) AS sample_id, coalesce(m.bin, d.bin) AS bin, coalesce(mc, 0.0) AS mc, coalesce(w2, 0.0) AS w2, coalesce(data, 0.0) AS data
   FROM m FULL JOIN d ON m.sample_id = d.sample_id AND m.bin = d.bin)"""


def halves(spark, path):
    binned = binned_sample(spark, path)
    counted = binned.filter("x < 40.5").groupBy("sample_id", "bin").agg(F.count(F.lit(1)).cast("double").alias("data"))
    return ops.fill_spectra(binned.filter("x >= 13")), counted


@add("load_data_spectrum_data_only", f"{HALVES} SELECT sample_id, bin, mc, w2, data FROM hv", "mc w2 data")
def _(spark, path):
    return sources.load_data_spectrum(*halves(spark, path))


@add("spectrum_mismatch", f"""{ES}, a AS (SELECT sample_id, {X_BIN_SQL} AS bin, min(y) AS lo, max(y) AS hi FROM es GROUP BY ALL),
 b AS (SELECT sample_id, {X_BIN_SQL} AS bin, min(y) AS lo, max(y) AS hi FROM es WHERE x > 3 GROUP BY ALL)
 SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, coalesce(a.bin, b.bin) AS bin, a.lo AS data_lo, a.hi AS data_hi, b.lo AS mc_lo, b.hi AS mc_hi
 FROM a FULL JOIN b ON a.sample_id = b.sample_id AND a.bin = b.bin
 WHERE NOT coalesce(greatest(abs(a.lo - b.lo), abs(a.hi - b.hi)) <= 1e-6 AND a.lo IS NOT NULL AND b.lo IS NOT NULL, FALSE)""", "data_lo data_hi mc_lo mc_hi")
def _(spark, path):
    binned = binned_sample(spark, path)
    extent = [F.min("y").alias("lo"), F.max("y").alias("hi")]
    return sources.spectrum_mismatch(binned.groupBy("sample_id", "bin").agg(*extent),
                                     binned.filter("x > 3").groupBy("sample_id", "bin").agg(*extent))


@add("var_hist_1d", f"""{ES} SELECT sample_id, CAST(floor(y / 10000) AS INTEGER) AS bin, sum(w0) AS content, sum(w0 * w0) AS err2,
 floor(y / 10000) * 10000 AS lo, floor(y / 10000) * 10000 + 10000 AS hi FROM es WHERE y < 110000 AND x >= 5 AND x < 45 GROUP BY ALL""", "content err2 lo hi")
def _(spark, path):
    return ops.var_hist_1d(event_sample(spark, path), "y", [10000.0 * i for i in range(12)],
                           [{"var": "x", "lo": 5, "hi": 45}], keys=("sample_id",))


@add("var_hist_1d_unweighted", f"""{ES} SELECT CAST(floor(y / 10000) AS INTEGER) AS bin, count(*)::DOUBLE AS content, count(*)::DOUBLE AS err2,
 floor(y / 10000) * 10000 AS lo, floor(y / 10000) * 10000 + 10000 AS hi FROM es WHERE y < 110000 GROUP BY ALL""", "content err2 lo hi")
def _(spark, path):
    return ops.var_hist_1d(event_sample(spark, path), "y", [10000.0 * i for i in range(12)], weight=None)


@add("var_hist_2d", f"""{ES} SELECT {X_BIN_SQL} AS bin_x, CAST(floor(y / 10000) AS INTEGER) AS bin_y, sum(w0) AS content, sum(w0 * w0) AS err2
 FROM es WHERE y < 110000 GROUP BY ALL""", "content err2")
def _(spark, path):
    return ops.var_hist_2d(event_sample(spark, path), "x", "y", X_EDGES, [10000.0 * i for i in range(12)])


@add("hists_by_mode", f"""{ES}, h AS (SELECT mode, {X_BIN_SQL} AS bin, sum(w0) AS content, sum(w0 * w0) AS err2 FROM es GROUP BY ALL)
 SELECT mode, bin, content, err2, 0.5 + 5 * bin AS lo, 5.5 + 5 * bin AS hi, sum(content) OVER (PARTITION BY mode) AS integral FROM h""",
     "content err2 lo hi integral")
def _(spark, path):
    return ops.hists_by(event_sample(spark, path), "mode", "x", X_EDGES)


@add("rate_table", f"{ES} SELECT mode, channel, sum(w0) AS rate, CAST(grouping_id(mode, channel) AS BIGINT) AS level FROM es GROUP BY CUBE (mode, channel)", "rate")
def _(spark, path):
    return ops.rate_table(event_sample(spark, path))


@add("sample_rates", f"""{SPECTRA} SELECT sample_id, sum(data) AS data, sum(mc) AS mc, sum(CASE WHEN data = 0 THEN mc ELSE mc - data + data * ln(data / mc) END) AS llh
 FROM sp GROUP BY ROLLUP (sample_id)""", "data mc llh", digits=7)
def _(spark, path):
    return toys.sample_rates(sources.load_data_spectrum(spectra(spark, path), data_spectrum(spark, path)))


PROJECTION = [0.5, 5.0, 20.0, 40.0, 60.0]


@add("project_bins", f"""{ES}, {BOX_SQL}, k AS (SELECT sample_id, w0, (SELECT min(b) FROM bx WHERE s = sample_id AND {IN_BOX}) AS b FROM es),
 c AS (SELECT sample_id, b, sum(w0) AS content, sqrt(sum(w0 * w0)) AS err FROM k WHERE b IS NOT NULL GROUP BY ALL),
 o AS (SELECT c.sample_id, e.bin, content, err, (least(x1, b1) - greatest(x0, a1)) / (x1 - x0) AS f FROM c JOIN bx ON s = sample_id AND bx.b = c.b,
 (VALUES {', '.join(f'({i}, {PROJECTION[i]}::DOUBLE, {PROJECTION[i + 1]}::DOUBLE)' for i in range(4))}) e(bin, a1, b1))
 SELECT sample_id, bin, sum(f * content) AS content, sqrt(sum(f * err * f * err)) AS err FROM o WHERE f > 0 GROUP BY ALL""", "content err")
def _(spark, path):
    binned = binning.assign_bin_boxes(event_sample(spark, path), boxes(spark), ["x", "y"])
    filled = ops.fill_spectra(binned).select("sample_id", "bin", F.col("mc").alias("content"), F.sqrt("w2").alias("err"))
    return hist.project_bins(boxes(spark).join(filled, ["sample_id", "bin"]), 0, PROJECTION)
