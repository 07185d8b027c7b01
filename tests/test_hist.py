import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlens.functions.expr import edge_bin, uniform_bin
from chainlens.operators import hist, intervals


def as_hist(spark, contents, lo=0.0, width=1.0, param="p"):
    rows = [(param, i, lo + i * width, lo + (i + 1) * width, float(c)) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "param string, bin int, lo double, hi double, content double")


def test_bin_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-0.1, 0.0, 0.5, 0.999, 1.0, 2.0)], "x double")
    got = [r[0] for r in df.select(uniform_bin(F.col("x"), 0.0, 1.0, 2)).collect()]
    assert got == [-1, 0, 1, 1, 2, 2]
    got = [r[0] for r in df.select(edge_bin(F.col("x"), [0.0, 0.5, 1.0])).collect()]
    assert got == [None, 0, 1, 1, None, None]


def test_contents_add_up_and_the_maximum_overflows(ar1):
    chain, x, y = ar1
    table = hist.posterior_hist(chain, ["x", "y"])
    sums = {r["param"]: r["s"] for r in table.groupBy("param").agg(F.sum("content").alias("s")).collect()}
    assert sums == {"x": len(x) - 1, "y": len(y) - 1}
    assert table.groupBy("param").count().filter("count <> 70").count() == 0
    want = np.histogram(y, bins=np.linspace(y.min(), y.max(), 71))[0]
    got = [r["content"] for r in table.filter("param = 'y'").orderBy("bin").collect()]
    want[-1] -= 1
    assert np.abs(np.array(got) - want).sum() <= 2  # values on an edge may differ by rounding


def test_gaps_are_filled_for_each_key(spark):
    df = spark.createDataFrame([(0, 0.5), (0, 9.5), (1, 4.5)], "k int, x double")
    table = hist.posterior_hist(df, ["x"], 10, {"x": (0.0, 10.0)}, keys=("k",))
    rows = {(r["k"], r["bin"]): r["content"] for r in table.collect()}
    assert len(rows) == 20 and sum(rows.values()) == 3 and rows[(1, 4)] == 1 and rows[(1, 9)] == 0


def brute_hpd(c, coverage=0.6827):
    """Walk over the bins one by one."""
    c = np.asarray(c, float)
    n, peak = len(c), int(np.argmax(c))
    centre = lambda b: b + 0.5
    up, s = peak, c[peak] / 2
    while s / (c[peak + 1:].sum() + c[peak] / 2) < coverage and up < n - 1:
        up += 1
        s += c[up]
    down, s = peak, c[peak] / 2
    while s / (c[:peak].sum() + c[peak] / 2) < coverage and down > 0:
        down -= 1
        s += c[down]
    low = high = peak
    s, lc, hc = c[peak], 0.0, 0.0
    while s / c.sum() < coverage:
        lc = hc = 0.0
        if low > 0:
            low -= 1
            lc = c[low]
        if high < n - 1:
            high += 1
            hc = c[high]
        if (s + lc + hc) / c.sum() > coverage:
            break
        s += lc + hc
    two = abs(low - centre(peak)) if lc > hc else abs(high + 1 - centre(peak))
    mode = abs(centre(low) - centre(peak)) if lc > hc else abs(centre(high) - centre(peak))
    return centre(peak), two, abs(up + 1 - centre(peak)), abs(centre(down) - peak), mode


CASES = [
    [0, 1, 4, 9, 4, 1, 0], [9, 5, 3, 1, 1, 0, 0], [0, 0, 1, 2, 3, 4, 10], [5, 5, 5, 5, 5], [0, 7, 0, 0, 7, 0], [1, 0, 0, 100, 0, 0, 1],
    [3, 8, 2, 2, 2, 2, 2, 2, 2, 7], [0, 0, 12, 0, 0],
] + [list(np.random.default_rng(s).integers(0, 20, 25)) for s in range(8)]


def test_hpd_and_mode_error_match_a_walk(spark):
    table = None
    for i, c in enumerate(CASES):
        h = as_hist(spark, c, param=f"p{i}")
        table = h if table is None else table.unionByName(h)
    table = table.cache()
    got = {r["param"]: r for r in intervals.hpd(table).collect()}
    modes = {r["param"]: r for r in intervals.mode_error(table).collect()}
    for i, c in enumerate(CASES):
        peak, two, up, down, mode = brute_hpd(c)
        r = got[f"p{i}"]
        assert (r["peak"], r["hpd_error"], r["error_up"], r["error_down"]) == pytest.approx((peak, two, up, down)), c
        assert modes[f"p{i}"]["mode_error"] == pytest.approx(mode), c


def test_credible_bins_match_a_greedy_loop(spark):
    for seed in range(5):
        c = np.random.default_rng(seed).integers(0, 30, 20).astype(float)
        levels = [0.99, 0.9, 0.68]
        rows = intervals.credible_bins(as_hist(spark, c), levels).collect()
        previous = None
        for level in levels:
            left, s, want = c.copy(), 0.0, set()
            while s / c.sum() < level:
                b = int(np.argmax(left))
                s += left[b]
                left[b] = -1
                want.add(b)
            got = {r["bin"] for r in rows if r["level"] == level}
            assert got == want
            assert previous is None or got <= previous
            previous = got


def test_levels_are_checked(spark):
    with pytest.raises(ValueError):
        intervals.coverages([0.68, 0.9])
    with pytest.raises(ValueError):
        intervals.coverages([1.2])
    assert intervals.coverages([3, 2, 1], True)[2] == 0.682689492137


def test_iqr_of_an_even_histogram(spark):
    row = hist.hist_iqr(as_hist(spark, [10] * 8)).first()
    assert (row["q1"], row["median"], row["q3"]) == pytest.approx((2.0, 4.0, 6.0))


def test_identical_histograms_have_no_distance(spark):
    h = as_hist(spark, [1, 5, 3])
    assert hist.kl_divergence(h, h, ["param"]).first()["kl"] == pytest.approx(0)
    both = h.withColumn("chain_id", F.explode(F.array(F.lit(0), F.lit(1))))
    assert intervals.ks_distance(both).first()["d"] == 0


def test_gaussian_fit_finds_the_shape(spark):
    x = np.arange(70) + 0.5
    row = hist.postfit_gauss(as_hist(spark, 500 * np.exp(-0.5 * ((x - 31.0) / 6.0) ** 2))).first()
    assert row["gauss_mean"] == pytest.approx(31.0, abs=0.01) and row["gauss_sigma"] == pytest.approx(6.0, abs=0.01)


def test_violins(ar1):
    chain, x, y = ar1
    table = hist.violin(chain, ["x", "y"])
    n = int((max(x.max(), y.max()) - min(x.min(), y.min())) * 25)
    assert table.agg(F.max("bin")).first()[0] == n - 1
    prior = hist.prior_violin(chain, {"x": (0.0, 1.0), "y": (3.0, 2.0)}, seed=3)
    mean = prior.filter("param = 'y'").agg(F.sum(F.col("content") * (F.col("lo") + F.col("hi")) / 2) / F.sum("content")).first()[0]
    assert mean == pytest.approx(3.0, abs=0.15)


def test_projection_shares_content(spark):
    boxes = spark.createDataFrame([(0, 0, [0.0, 0.0], [2.0, 1.0], 10.0, 3.0), (0, 1, [2.0, 0.0], [3.0, 1.0], 6.0, 2.0)],
                                  "sample_id int, bin int, lo array<double>, hi array<double>, content double, err double")
    rows = {r["bin"]: r for r in hist.project_bins(boxes, 0, [0.0, 1.5, 2.5, 3.0]).collect()}
    assert [rows[b]["content"] for b in range(3)] == pytest.approx([7.5, 5.5, 3.0])
    assert rows[1]["err"] == pytest.approx(np.hypot(0.25 * 3, 0.5 * 2))
