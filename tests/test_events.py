import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlens.operators import binning, events as ops
from chainlens.sources import events as sources


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 2), float(a), float(b), float(w)) for i, (a, b, w) in enumerate(
        zip(rng.integers(0, 21, 3000) / 2, rng.integers(0, 21, 3000) / 2, rng.uniform(0.1, 1, 3000)))]
    return spark.createDataFrame(rows, "event_id long, sample_id int, x double, y double, w0 double").repartition(6).cache()


BOXES = [(0, 0, [0.0, 0.0], [4.0, 10.0]), (0, 1, [4.0, 0.0], [10.0, 3.5]), (0, 2, [4.0, 3.5], [7.0, 10.0]),
         (1, 0, [0.0, 0.0], [5.0, 5.0]), (1, 1, [3.0, 3.0], [10.0, 10.0])]


def boxes(spark):
    return spark.createDataFrame(BOXES, "sample_id int, bin int, lo array<double>, hi array<double>")


@pytest.mark.parametrize("limit", [0, 200_000])
def test_boxes_match_a_scan_of_all_boxes(spark, sample, monkeypatch, limit):
    monkeypatch.setattr(binning, "BROADCAST_BYTES", limit)
    got = {r["event_id"]: r["bin"] for r in binning.assign_bin_boxes(sample, boxes(spark), ["x", "y"], grid=5, keep_outside=True).collect()}
    assert len(got) == 3000
    for r in sample.collect():
        inside = [b for s, b, lo, hi in BOXES if s == r["sample_id"] and lo[0] < r["x"] <= hi[0] and lo[1] < r["y"] <= hi[1]]
        assert got[r["event_id"]] == (min(inside) if inside else None)


def test_overlaps_and_gaps(spark):
    rows = binning.overlapping_bins(boxes(spark), 2).collect()
    assert [(r["sample_id"], r["bin_i"], r["bin_j"]) for r in rows] == [(1, 0, 1)]
    gaps = binning.gap_points(boxes(spark), 2, points=20).collect()
    assert {r["sample_id"] for r in gaps} == {0, 1}
    assert all(r["x0"] > 7 and r["x1"] > 3.5 for r in gaps if r["sample_id"] == 0)


def test_a_bad_binning_is_refused(spark):
    with pytest.raises(ValueError, match="overlap"):
        binning.check_bins(boxes(spark), 2, 20)
    with pytest.raises(ValueError, match="covers"):
        binning.check_bins(boxes(spark).filter("sample_id = 0"), 2, 20)
    good = spark.createDataFrame([(0, 0, [0.0], [1.0]), (0, 1, [1.0], [5.0])], "sample_id int, bin int, lo array<double>, hi array<double>")
    binning.check_bins(good, 1)


def test_edges_are_half_open_on_opposite_sides(spark, sample):
    axes = [{"sample_id": s, "dim": 0, "var": "x", "edges": [0.0, 5.0, 10.0]} for s in (0, 1)]
    low = binning.assign_bin_uniform(sample, axes)
    assert low.filter("x = 5 and bin <> 1").count() == 0 and low.filter("x = 10").count() == 0
    assert low.filter("sample_id = 1").agg(F.min("global_bin")).first()[0] == 2
    box = spark.createDataFrame([(s, b, [lo], [hi]) for s in (0, 1) for b, lo, hi in ((0, 0.0, 5.0), (1, 5.0, 10.0))],
                                "sample_id int, bin int, lo array<double>, hi array<double>")
    high = binning.assign_bin_boxes(sample, box, ["x"])
    assert high.filter("x = 5 and bin <> 0").count() == 0 and high.filter("x = 0").count() == 0


def test_hot_key_lookup_is_whole_on_both_ways(spark, monkeypatch):
    big = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted(map(tuple, big.join(small, "k", "left").select("id", "k", "v").collect()), key=str)
    for limit in (0, 1000):
        monkeypatch.setattr(binning, "BROADCAST_BYTES", limit)
        got = sorted(map(tuple, binning.join_hot(big, small, ["k"], "left").select("id", "k", "v").collect()), key=str)
        assert got == want


def test_subevents_of_unequal_length_are_refused(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], [1.0])], "id int, a array<double>, b array<double>")
    with pytest.raises(Exception, match="differ in length"):
        ops.select_subevents(df, ["a", "b"], [("a", 0, 9)]).collect()


def test_totals_of_the_cube_agree(spark, sample):
    tagged = sample.withColumn("mode", (F.col("event_id") % 3).cast("string")).withColumn("channel", (F.col("event_id") % 5).cast("string"))
    rows = ops.rate_table(tagged).collect()
    total = sum(r["rate"] for r in rows if r["level"] == 0)
    assert [r["rate"] for r in rows if r["level"] == 3][0] == pytest.approx(total)
    assert sum(r["rate"] for r in rows if r["level"] == 1) == pytest.approx(total)


def test_rate_table_is_written(spark, sample, tmp_path):
    table = ops.rate_table(sample.withColumn("mode", F.col("sample_id")).withColumn("channel", F.lit(0)))
    ops.write_rate_table(table, str(tmp_path / "rates"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rates")).count() == table.count()


def test_channels_are_unique(spark, sample):
    with pytest.raises(ValueError):
        sources.tag_channels([(sample, 14, 14), (sample, 14, 14)])


def test_data_on_other_bins_is_refused(spark):
    mc = spark.createDataFrame([(0, 0, 0.0, 1.0, 5.0)], "sample_id int, bin int, lo double, hi double, mc double")
    data = spark.createDataFrame([(0, 0, 0.0, 1.5, 4.0)], "sample_id int, bin int, lo double, hi double, data double")
    with pytest.raises(ValueError):
        sources.load_data_spectrum(mc, data)
    assert sources.load_data_spectrum(mc, data.withColumn("hi", F.lit(1.0))).first()["data"] == 4.0


def test_quasi_elastic_shift_vanishes_without_momentum_change(spark):
    df = spark.createDataFrame([(0.7, 1.2, 0.3)], "p double, e double, q2 double")
    assert abs(df.select(ops.q2_shift(F.col("p"), F.col("p"), F.col("e"), F.col("q2"))).first()[0]) < 1e-12


def test_wildcards(spark):
    df = spark.createDataFrame([("SK_FHC*", "sk_fhc_1re"), ("ND.280", "nd.280"), ("ND.280", "ndx280"), ("*", "any"), ("a+b", "A+B")], "p string, s string")
    got = [r[0] for r in df.select(ops.name_matches(F.col("p"), F.col("s"))).collect()]
    assert got == [True, True, False, True, True]
