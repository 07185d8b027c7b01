"""Queries on boxes, projections, variations by channel, axis records and starting points."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlens.catalog.event_samples import AXES_2D, BOX_SQL, IN_BOX, binned_sample, boxes
from chainlens.catalog.prediction import NORMS, SIGMA_PARAMS, SIGMA_SQL
from chainlens.catalog.registry import EV, SAMPLE_SQL, add, ev_chain, ev_sql, event_sample
from chainlens.functions.expr import axis_edges
from chainlens.operators import binning, events, hist, predict, toys
from chainlens.session import stored
from chainlens.sources import chains

# Box contents, and what lies outside of all boxes as a row without edges.
BOXES = f"""WITH {SAMPLE_SQL}, {BOX_SQL}, k AS (SELECT sample_id, w0, (SELECT min(b) FROM bx WHERE s = sample_id AND {IN_BOX}) AS b FROM es),
 c AS (SELECT sample_id, b, sum(w0) AS content, sqrt(sum(w0 * w0)) AS err FROM k GROUP BY ALL),
 h AS (SELECT c.sample_id, c.b AS bin, content, err, (x1 - x0) * (y1 - y0) AS area FROM c LEFT JOIN bx ON s = c.sample_id AND bx.b = c.b)"""


def box_hist(spark, path):
    binned = binning.assign_bin_boxes(event_sample(spark, path), boxes(spark), ["x", "y"])
    filled = events.fill_spectra(binned).select("sample_id", "bin", F.col("mc").alias("content"), F.sqrt("w2").alias("err"))
    return boxes(spark).join(filled, ["sample_id", "bin"])


@add("normalise_boxes", f"{BOXES} SELECT sample_id, bin, content / sum(content) OVER (PARTITION BY sample_id) AS share, content / area / sum(content * area) OVER (PARTITION BY sample_id) AS density,"
     " content / area AS scaled FROM h WHERE bin IS NOT NULL", "share density scaled")
def _(spark, path):
    h = box_hist(spark, path)
    share = hist.normalise(h, ("sample_id",)).withColumnRenamed("density", "share")
    scaled = hist.scale_by_width(share).withColumnRenamed("density", "scaled")
    return hist.normalise(scaled, ("sample_id",), by_measure=True).select("sample_id", "bin", "share", "density", "scaled")


@add("integrals_boxes", f"{BOXES} SELECT sample_id, sum(content) FILTER (bin IS NOT NULL) AS integral, sum(content * area) AS width_integral, sum(content) AS integral_with_overflow FROM h GROUP BY 1",
     "integral width_integral integral_with_overflow", digits=12)
def _(spark, path):
    h = box_hist(spark, path).select("sample_id", "bin", "lo", "hi", "content")
    everything = event_sample(spark, path).groupBy("sample_id").agg(F.sum("w0").alias("all"))
    outside = h.groupBy("sample_id").agg(F.sum("content").alias("inside")).join(everything, "sample_id").select(
        "sample_id", F.lit(None).cast("int").alias("bin"), F.lit(None).cast("array<double>").alias("lo"), F.lit(None).cast("array<double>").alias("hi"),
        (F.col("all") - F.col("inside")).alias("content"))
    return hist.integrals(h.unionByName(outside), ("sample_id",))


@add("ratio_with_error", f"{BOXES}, n AS (SELECT sample_id, b AS bin, count(*)::DOUBLE AS below FROM k GROUP BY ALL) SELECT h.sample_id, h.bin, content / below AS ratio, err / below AS ratio_err"
     " FROM h JOIN n ON h.sample_id = n.sample_id AND h.bin = n.bin", "ratio ratio_err")
def _(spark, path):
    binned = binning.assign_bin_boxes(event_sample(spark, path), boxes(spark), ["x", "y"])
    below = binned.groupBy("sample_id", "bin").agg(F.count(F.lit(1)).cast("double").alias("content"))
    return hist.ratio(box_hist(spark, path), below, ["sample_id", "bin"]).select("sample_id", "bin", "ratio", "ratio_err")


# Toys in two dimensions, projected on each.
PLANE = f"""WITH {SAMPLE_SQL}, p AS (SELECT toy, sample_id, w0, CASE WHEN x >= 1 AND x < 5 THEN 0 WHEN x >= 5 AND x < 15 THEN 1 WHEN x >= 15 AND x < 30 + sample_id THEN 2
 WHEN x >= 30 + sample_id AND x < 50 THEN 3 END AS bx, CASE WHEN y >= 1000 AND y < 20000 THEN 0 WHEN y >= 20000 AND y < 50000 - 1000 * sample_id THEN 1
 WHEN y >= 50000 - 1000 * sample_id AND y < 90000 THEN 2 END AS yb FROM es), q AS (SELECT * FROM p WHERE bx IS NOT NULL AND yb IS NOT NULL),
 seen AS (SELECT toy, sample_id, 0 AS dim, bx AS bin, sum(w0) AS mc, sum(w0 * w0) AS w2 FROM q GROUP BY ALL UNION ALL SELECT toy, sample_id, 1, yb, sum(w0), sum(w0 * w0) FROM q GROUP BY ALL),
 toys AS (SELECT * FROM (SELECT DISTINCT toy FROM q) t, (SELECT DISTINCT sample_id, dim, bin FROM seen) c),
 pr AS (SELECT toy, sample_id, dim, bin, coalesce(mc, 0.0) AS mc, coalesce(w2, 0.0) AS w2 FROM toys LEFT JOIN seen USING (toy, sample_id, dim, bin))"""


def plane_toys(spark, path):
    return stored(events.fill_spectra(binning.assign_bin_uniform(event_sample(spark, path), AXES_2D), keys=("toy", "sample_id", "bin")), "toys")


@add("toy_projections", f"{PLANE} SELECT toy, sample_id, dim, bin, mc, w2 FROM pr WHERE mc > 0", "mc w2")
def _(spark, path):
    return hist.project_axes(plane_toys(spark, path), AXES_2D, ("toy", "sample_id"))


@add("toy_projection_means", f"{PLANE} SELECT sample_id, dim, bin, avg(mc) AS mc_mean, stddev_pop(mc) AS mc_rms FROM pr GROUP BY ALL", "mc_mean mc_rms", digits=8)
def _(spark, path):
    projected = hist.project_axes(plane_toys(spark, path), AXES_2D, ("toy", "sample_id"))
    return toys.predictive_mean(projected.withColumn("weight", F.lit(1.0)), ("sample_id", "dim", "bin")).select(
        "sample_id", "dim", "bin", "mc_mean", "mc_rms")


@add("toy_projection_violin", f"""{PLANE}, mx AS (SELECT sample_id, dim, max(mc) * 1.05 AS top FROM pr GROUP BY ALL)
 SELECT sample_id, dim, bin, CAST(least(floor(40 * (mc - 0.0) / (top - 0.0)), 39) AS INTEGER) AS content_bin, count(*) AS n_toys FROM pr JOIN mx USING (sample_id, dim) GROUP BY ALL""")
def _(spark, path):
    projected = hist.project_axes(plane_toys(spark, path), AXES_2D, ("toy", "sample_id"))
    return toys.toy_violin(projected, ("sample_id", "dim"), 40).select("sample_id", "dim", "bin", "content_bin", "n_toys")


@add("sigma_variations_by_channel", f"WITH {SIGMA_SQL.split('sp AS (')[0].replace('sample_id, mode,', 'sample_id, channel,')}"
     " sp AS (SELECT scanned, sigma, sample_id, channel, bin, sum(w) AS mc, sum(w * w) AS w2 FROM sw WHERE w > 0 GROUP BY ALL) SELECT * FROM sp", "sigma mc w2", digits=12)
def _(spark, path):
    matched = events.match_norms(binned_sample(spark, path), NORMS, None, {"modes": "mode", "channels": "channel"})
    keys = ("sample_id", "channel", "bin")
    summed = stored(predict.signatures(matched, keys), "signatures")
    return predict.sigma_variations(summed, SIGMA_PARAMS, lambda values: predict.norm_factors(values, NORMS), keys=keys)


@add("sigma_variation_projections", f"""WITH {SIGMA_SQL.split('sw AS (')[0]} pl AS (SELECT es.*, CASE WHEN x >= 1 AND x < 5 THEN 0 WHEN x >= 5 AND x < 15 THEN 1 WHEN x >= 15 AND x < 30 + sample_id THEN 2
 WHEN x >= 30 + sample_id AND x < 50 THEN 3 END AS bx, CASE WHEN y >= 1000 AND y < 20000 THEN 0 WHEN y >= 20000 AND y < 50000 - 1000 * sample_id THEN 1
 WHEN y >= 50000 - 1000 * sample_id AND y < 90000 THEN 2 END AS yb FROM es),
 sw AS (SELECT scanned, sigma::DOUBLE AS sigma, sample_id, bx, yb, w0 * CASE WHEN mode = 'A' THEN va ELSE 1 END * CASE WHEN mode = 'N' AND x > 10 AND x <= 40 THEN vn ELSE 1 END
 * CASE WHEN channel = 'O' THEN vo ELSE 1 END AS w FROM pl, vr WHERE bx IS NOT NULL AND yb IS NOT NULL)
 SELECT scanned, sigma, sample_id, 0 AS dim, bx AS bin, sum(w) AS mc FROM sw WHERE w > 0 GROUP BY ALL UNION ALL SELECT scanned, sigma, sample_id, 1, yb, sum(w) FROM sw WHERE w > 0 GROUP BY ALL""", "sigma mc", digits=11)
def _(spark, path):
    binned = binning.assign_bin_uniform(event_sample(spark, path), AXES_2D)
    matched = events.match_norms(binned, NORMS, None, {"modes": "mode", "channels": "channel"})
    summed = stored(predict.signatures(matched), "signatures")
    varied = predict.sigma_variations(summed, SIGMA_PARAMS, lambda values: predict.norm_factors(values, NORMS))
    return hist.project_axes(varied, AXES_2D, ("scanned", "sigma", "sample_id"), ("mc",))


AXIS = axis_edges([0.0, {"linspace": {"nb": 4, "low": 1.0, "up": 9.0}}, {"logspace": {"nb": 2, "low": 10.0, "up": 40.0}}, 60.0])


@add("axis_from_records", f"""WITH {SAMPLE_SQL}, e AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 3), (2, 3, 5), (3, 5, 7), (4, 7, 9), (5, 9, 10), (6, 10, 20), (7, 20, 40), (8, 40, 60)) t(bin, lo, hi))
 SELECT bin, count(*)::DOUBLE AS content FROM es JOIN e ON x >= lo AND x < hi GROUP BY bin""", "content")
def _(spark, path):
    return events.var_hist_1d(event_sample(spark, path), "x", AXIS, weight=None).select("bin", "content")


@add("starting_point", f"WITH {ev_sql(4)} SELECT chain_id, step, val, root, k FROM (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY step DESC) AS r FROM ch) WHERE r = 1", "val root k")
def _(spark, path):
    return chains.starting_point(ev_chain(spark, path, 4), EV)
