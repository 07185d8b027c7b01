"""Predictions at parameter points: grids, throws, weights, spectra, scans.

``points`` is a long table (point, param, value) with point = 0..n-1.  Events
are first summed per signature (bin and list of factors that apply), so the
work per point grows with the number of signatures and not of events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlens.functions.expr import OUT_OF_BOUNDS_LLH
from chainlens.operators.binning import broadcast_if_small, join_hot
from chainlens.operators.chain import random_draws
from chainlens.operators.product import block_spectra
from chainlens.session import stored

POINT_CHUNK = 64


# -- parameter points ---------------------------------------------------------


def scan_range(prior: float, error: float, low: float | None, up: float | None, n_sigma: float = 1.0,
               given: tuple[float, float] | None = None) -> tuple[float, float]:
    """Range of a scan, clipped to the bounds of the parameter."""
    lo, hi = given or (prior - n_sigma * error, prior + n_sigma * error)
    return (lo if low is None else max(lo, low)), (hi if up is None else min(hi, up))


def scan_grid(spark: SparkSession, axes: Sequence[tuple[str, int, float, float]], ends: bool = False) -> DataFrame:
    """Wide grid (point, <param>...) over (name, n, lo, hi) axes, first parameter fastest.

    A point's values follow from its number, so the grid is computed in
    parallel and never held on the driver.
    """
    size = int(np.prod([a[1] for a in axes]))
    grid, stride = spark.range(size).withColumnRenamed("id", "point"), 1
    for name, n, lo, hi in axes:
        index = F.floor(F.col("point") / F.lit(stride)) % n
        value = (F.lit(float(lo)) + F.lit(float(hi - lo)) * index / F.lit(max(n - 1, 1)) if ends
                 else F.lit(float(lo)) + (index + 0.5) * F.lit((hi - lo) / n))
        grid = grid.withColumn(name, value)
        stride *= n
    return grid


def scan_grid_1d(spark: SparkSession, ranges: Sequence[tuple[str, int, float, float]],
                 nominal: dict[str, float]) -> DataFrame:
    """Long points: each parameter scanned alone over bin centres, others at nominal.

    Adds ``scanned``, the name of the moving parameter, and ``x``, its value.
    """
    starts = [int(x) for x in np.cumsum([0] + [r[1] for r in ranges])]
    place = F.col("point")
    name, x = F.lit(None).cast("string"), F.lit(None).cast("double")
    for (p, n, lo, hi), start in zip(ranges, starts):
        here = (place >= start) & (place < start + n)
        name = F.when(here, p).otherwise(name)
        x = F.when(here, F.lit(float(lo)) + (place - start + 0.5) * F.lit((hi - lo) / n)).otherwise(x)
    moved = spark.range(starts[-1]).select(F.col("id").alias("point")).select("point", name.alias("scanned"), x.alias("x"))
    values = F.array(*[F.struct(F.lit(p).alias("param"), F.lit(float(v)).alias("nominal")) for p, v in nominal.items()])
    return moved.select("point", "scanned", "x", F.inline(values)).select(
        "point", "scanned", "x", "param",
        F.when(F.col("param") == F.col("scanned"), F.col("x")).otherwise(F.col("nominal")).alias("value"))


def scan_grid_2d(spark: SparkSession, ranges: Sequence[tuple[str, int, float, float]],
                 nominal: dict[str, float]) -> DataFrame:
    """Long points: each pair of parameters over a grid of bin centres, others at nominal.

    Each unordered pair is scanned once.  Adds ``param_x``, ``param_y`` and
    their values ``x`` and ``y``.
    """
    pairs, start = [], 0
    for i, a in enumerate(ranges):
        for b in ranges[i + 1:]:
            pairs.append((a, b, start))
            start += a[1] * b[1]
    place = F.col("point")
    columns = {"param_x": F.lit(None).cast("string"), "param_y": F.lit(None).cast("string"),
               "x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")}
    for (p, n, lo, hi), (q, m, low, high), first in pairs:
        here = (place >= first) & (place < first + n * m)
        i, j = (place - first) % n, F.floor((place - first) / n)
        for c, v in {"param_x": F.lit(p), "param_y": F.lit(q), "x": F.lit(float(lo)) + (i + 0.5) * F.lit((hi - lo) / n),
                     "y": F.lit(float(low)) + (j + 0.5) * F.lit((high - low) / m)}.items():
            columns[c] = F.when(here, v).otherwise(columns[c])
    rows = spark.range(start).select(F.col("id").alias("point")).select("point", *[v.alias(c) for c, v in columns.items()])
    values = F.array(*[F.struct(F.lit(p).alias("param"), F.lit(float(v)).alias("nominal")) for p, v in nominal.items()])
    return rows.select("point", "param_x", "param_y", "x", "y", F.inline(values)).select(
        "point", "param_x", "param_y", "x", "y", "param",
        F.when(F.col("param") == F.col("param_x"), F.col("x")).when(
            F.col("param") == F.col("param_y"), F.col("y")).otherwise(F.col("nominal")).alias("value"))


def to_points(wide: DataFrame, columns: Sequence[str], point: str = "point") -> DataFrame:
    return wide.select(F.col(point).alias("point"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["point"], list(columns), "param", "value")


def sigma_points(spark: SparkSession, params: Sequence[dict], sigmas: Sequence[float] = (-3, -1, 0, 1, 3)) -> DataFrame:
    """Points that move one parameter by a number of sigma, clipped to its bounds."""
    if 0 not in [float(s) for s in sigmas]:
        raise ValueError("sigma 0 must be among the variations")
    records, nominal = [], {p["name"]: float(p["prior"]) for p in params}
    for k, p in enumerate(params):
        for j, s in enumerate(sigmas):
            x = p["prior"] + s * p["error"]
            x = min(x, p["up"]) if p.get("up") is not None else x
            x = max(x, p["low"]) if p.get("low") is not None else x
            records.append((k * len(sigmas) + j, p["name"], float(s), float(x)))
    # Parameters x sigmas rows of configuration.
    moved = spark.createDataFrame(records, "point long, scanned string, sigma double, x double")
    values = F.array(*[F.struct(F.lit(n).alias("param"), F.lit(v).alias("nominal")) for n, v in nominal.items()])
    return moved.select("point", "scanned", "sigma", "x", F.inline(values)).select(
        "point", "scanned", "sigma", "param",
        F.when(F.col("param") == F.col("scanned"), F.col("x")).otherwise(F.col("nominal")).alias("value"))


def throw_prior(spark: SparkSession, params: Sequence[dict], cov: np.ndarray, n: int, seed: int = 1,
                groups: Sequence[str] = (), names: Sequence[str] = (), max_tries: int = 10000) -> DataFrame:
    """n correlated Gaussian draws (point, <param>..., n_given_up) about the priors.

    Draws come in blocks of 1024 with a seeded generator each, so results do not depend
    on the partitioning. An out-of-bounds parameter is drawn again, all rows of a block
    at once; after ``max_tries`` it is left at its prior and counted in ``n_given_up``.
    Circular parameters wrap into (low, up); flagged ones flip about a point half of the
    time. Fixed parameters, and those outside the chosen groups or names, stay.
    """
    block = 1024
    prior = np.array([p["prior"] for p in params], float)
    lower = np.array([-np.inf if p.get("low") is None else p["low"] for p in params], float)
    upper = np.array([np.inf if p.get("up") is None else p["up"] for p in params], float)
    stays = np.array([
        bool(p.get("fixed")) or (bool(groups) and p.get("grp") not in groups)
        or (bool(names) and p["name"] not in names) for p in params])
    factor = np.linalg.cholesky(np.asarray(cov, float))
    circular = [(i, *p["circular"]) for i, p in enumerate(params) if p.get("circular") and not stays[i]]
    flips = [(i, p["flip"]) for i, p in enumerate(params) if p.get("flip") is not None and not stays[i]]
    columns = [p["name"] for p in params]

    def drawn(number: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([seed, number])
        z = rng.standard_normal((block, len(prior)))
        value = prior + z @ factor.T
        given_up = np.zeros(block, int)
        for i in np.flatnonzero(~stays):
            rows = np.flatnonzero((value[:, i] > upper[i]) | (value[:, i] < lower[i]))
            for _ in range(max_tries):
                if not len(rows):
                    break
                z[rows, i] = rng.standard_normal(len(rows))
                value[rows, i] = prior[i] + z[rows] @ factor[i]
                rows = rows[(value[rows, i] > upper[i]) | (value[rows, i] < lower[i])]
            value[rows, i] = prior[i]
            given_up[rows] += 1
        for i, lo, hi in circular:
            out = (value[:, i] > hi) | (value[:, i] < lo)
            value[out, i] = lo + (value[out, i] - lo) % (hi - lo)
        for i, centre in flips:
            turned = rng.random(block) < 0.5
            value[turned, i] = 2 * centre - value[turned, i]
        return np.where(stays, prior, value), given_up

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number in pdf["id"]:
                values, given_up = drawn(int(number))
                rows = min(block, n - int(number) * block)
                yield pd.DataFrame({"point": int(number) * block + np.arange(rows), **dict(zip(columns, values[:rows].T)),
                                    "n_given_up": given_up[:rows]})

    schema = ", ".join(["point long"] + [f"`{c}` double" for c in columns] + ["n_given_up long"])
    return spark.range(-(-n // block)).mapInPandas(draw, schema)


def apply_tune(params: DataFrame, tunes: DataFrame, name: str) -> DataFrame:
    """Replace parameter values by a named set (tune, param, value)."""
    sizes = tunes.groupBy("tune").agg(F.count(F.lit(1)).alias("n"))
    if sizes.select("n").distinct().count() > 1:
        raise ValueError("tunes differ in length")
    chosen = tunes.filter(F.col("tune") == name).select(F.col("param").alias("name"), F.col("value").alias("_tuned"))
    return params.join(chosen, "name", "left").withColumn(
        "prior", F.coalesce("_tuned", "prior")).drop("_tuned")


def pca_basis(cov: np.ndarray, first: int, last: int, threshold: float) -> np.ndarray:
    """Transfer matrix (parameters x kept) with an eigen block from first to last.

    Eigenvalues are kept in falling order while their share of the sum is at
    least the threshold.
    """
    cov = np.asarray(cov, float)
    n = len(cov)
    inside = np.zeros(n, bool)
    inside[first:last + 1] = True
    if np.abs(cov[np.ix_(inside, ~inside)]).max(initial=0.0) > 1e-6:
        raise ValueError("the decomposed block is correlated with other parameters")
    values, vectors = np.linalg.eigh(cov[np.ix_(inside, inside)])
    order = np.argsort(values)[::-1]
    share = values[order] / values.sum()
    small = np.flatnonzero(share < threshold)
    kept = int(small[0]) if len(small) else len(values)
    block = vectors[:, order][:, :kept]
    transfer = np.zeros((n, first + kept + n - 1 - last))
    transfer[:first, :first] = np.eye(first)
    transfer[first:last + 1, first:first + kept] = block
    transfer[last + 1:, first + kept:] = np.eye(n - 1 - last)
    return transfer


def pca_transform(points: DataFrame, columns: Sequence[str], transfer: np.ndarray, inverse: bool = False,
                  keep: Sequence[str] = ("point",)) -> DataFrame:
    """Move wide points to the eigen basis (pca_0...), or back to the parameters.

    One matrix product per Arrow batch; the matrix is parameters squared.
    """
    k = transfer.shape[1]
    source = [f"pca_{i}" for i in range(k)] if inverse else list(columns)
    target = list(columns) if inverse else [f"pca_{i}" for i in range(k)]
    matrix = transfer.T if inverse else transfer

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[source].to_numpy(dtype=float) @ matrix
            yield pd.concat([pdf[list(keep)].reset_index(drop=True), pd.DataFrame(out, columns=target)], axis=1)

    types = dict(points.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in keep] + [f"`{c}` double" for c in target])
    return points.select(*keep, *source).mapInPandas(move, schema)


# -- weights ------------------------------------------------------------------


def norm_factors(points: DataFrame, norms: Sequence[dict]) -> DataFrame:
    """Factor ``n<idx>`` of each normalisation parameter at each point."""
    names = F.create_map(*[v for n in norms for v in (F.lit(n["name"]), F.lit(f"n{int(n['idx'])}"))])
    return points.filter(F.col("param").isin([n["name"] for n in norms])).select(
        "point", F.element_at(names, F.col("param")).alias("factor"), F.col("value").alias("f"))


def spline_factors(evaluated: DataFrame) -> DataFrame:
    """Factor ``s<spline_id>`` from evaluated splines."""
    return evaluated.select(
        "point", F.concat(F.lit("s"), F.col("spline_id").cast("string")).alias("factor"), F.col("weight").alias("f"))


def osc_factors(probabilities: DataFrame) -> DataFrame:
    """Factor ``o<channel>_<energy bin>_<zenith bin>`` from a probability table."""
    return probabilities.select("point", osc_key().alias("factor"), F.col("prob").alias("f"))


def osc_key() -> Column:
    return F.concat(F.lit("o"), F.concat_ws("_", *[F.col(c).cast("string") for c in ("channel", "e_bin", "z_bin")]))


def factor_ids(table: DataFrame, norm_ids: str | None = "norm_ids", spline_ids: str | None = None,
               osc: bool = False) -> DataFrame:
    """Add ``factors``, the sorted list of all factors that apply to an event or signature."""
    parts = []
    if norm_ids:
        parts.append(F.transform(norm_ids, lambda i: F.concat(F.lit("n"), i.cast("string"))))
    if spline_ids:
        parts.append(F.transform(spline_ids, lambda i: F.concat(F.lit("s"), i.cast("string"))))
    if osc:
        parts.append(F.array(osc_key()))
    return table.withColumn("factors", F.sort_array(F.concat(*parts)))


def signatures(events: DataFrame, keys: Sequence[str] = ("sample_id", "bin"), weight: str = "w0",
               norm_ids: str | None = "norm_ids", spline_ids: str | None = None, osc: bool = False) -> DataFrame:
    """Sum of weights and squared weights per bin and list of factors.

    The one pass over the events; partial sums are made before the shuffle, and
    factor names are built for the sums and not for each event. With ``osc``, events
    outside the probability table are left out, as ``osc_weight_lookup`` does.
    """
    labels = [c for c in (norm_ids, spline_ids) if c] + (["channel", "e_bin", "z_bin"] if osc else [])
    by = list(dict.fromkeys([*keys, *labels]))
    w = F.col(weight)
    inside = F.col("e_bin").isNotNull() & F.col("z_bin").isNotNull() if osc else F.lit(True)
    summed = events.filter((w > 0) & inside).groupBy(*by).agg(F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"))
    return factor_ids(summed, norm_ids, spline_ids, osc).select(*keys, "factors", "sw", "sw2")


def pack_factors(factors: DataFrame, n_points: int, chunk: int = POINT_CHUNK) -> DataFrame:
    """One row per (factor, chunk of points) with the values in point order.

    A factor that lacks a point of a chunk, or has one twice, is an error.
    """
    packed = factors.filter(F.col("point") < n_points).withColumn("chunk", F.floor(F.col("point") / chunk)).groupBy(
        "factor", "chunk").agg(F.sort_array(F.collect_list(F.struct("point", "f"))).alias("_v"))
    first = F.col("chunk") * chunk
    wanted = F.sequence(first, F.least(first + chunk, F.lit(n_points).cast("long")) - 1)
    checked = F.when(F.col("_v.point") == wanted, F.col("_v.f")).otherwise(F.raise_error(
        F.concat(F.lit("factor "), F.col("factor"), F.lit(" does not have one value per point"))).cast("array<double>"))
    return packed.select("factor", "chunk", checked.alias("values"))


def list_weights(lists: DataFrame, factors: DataFrame, n_points: int, chunk: int = POINT_CHUNK) -> DataFrame:
    """(factors, points, weights): product of the factors of each distinct list, by chunk of points.

    Values are placed by point; a factor of a list without values, or without some point,
    is an error. An empty list weighs 1 at every point.
    """
    last = (n_points - 1) // chunk
    # Written once: it is measured and joined.
    packed = stored(pack_factors(factors.select("point", "factor", "f"), n_points, chunk), "factors")
    every_chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))
    spread = lists.filter(F.size("factors") > 0).select("factors", F.explode("factors").alias("factor")).select(
        "factors", "factor", every_chunk.alias("chunk"))
    found = join_hot(spread, packed, ["factor", "chunk"], "left")
    values = F.when(F.col("values").isNull(), F.raise_error(F.concat(
        F.lit("no values for factor "), F.col("factor"))).cast("array<double>")).otherwise(F.col("values"))
    # A group holds the factors of one list, a handful of short arrays.
    product = F.aggregate(
        F.slice("_lists", 2, F.size("_lists")), F.element_at("_lists", 1),
        lambda total, values: F.zip_with(total, values, lambda a, b: a * b))
    weighed = found.groupBy("factors", "chunk").agg(F.collect_list(values).alias("_lists")).select(
        "factors", "chunk", product.alias("weights"))
    first = F.col("chunk") * chunk
    points = F.sequence(first, F.least(first + chunk, F.lit(n_points).cast("long")) - 1)
    free = lists.filter(F.size("factors") == 0).select("factors", every_chunk.alias("chunk")).select(
        "factors", "chunk", F.transform(points, lambda _: F.lit(1.0)).alias("weights"))
    return weighed.unionByName(free).select("factors", points.alias("points"), "weights")


def _at_points(joined: DataFrame, kept: Sequence[str]) -> DataFrame:
    pairs = F.arrays_zip(F.col("points").alias("point"), F.col("weights").alias("weight"))
    return joined.select(*kept, F.inline(pairs)).toDF(*kept, "point", "weight")


def predict_spectra(summed: DataFrame, factors: DataFrame, n_points: int,
                    keys: Sequence[str] = ("sample_id", "bin"), chunk: int = POINT_CHUNK) -> DataFrame:
    """Spectra (point, keys, mc, w2) of all points from signatures and factors.

    Signatures meet the factors in blocks, as a sparse times a dense matrix
    (``product.block_spectra``). Pass them stored, so that the events are read once and
    blocks do not change when a task is repeated.
    """
    return block_spectra(summed, pack_factors(factors.select("point", "factor", "f"), n_points, chunk), n_points, keys, chunk)


def reweight_events(events: DataFrame, factors: DataFrame, n_points: int, key: str = "event_id",
                    weight: str = "w0", keep: Sequence[str] = ("sample_id", "bin"),
                    chunk: int = POINT_CHUNK) -> DataFrame:
    """Weight of every event at every point (point, key, keep, w); w <= 0 is dropped.

    For analyses that need events one by one; spectra come cheaper from
    ``predict_spectra``.
    """
    rows = events.select(key, *keep, F.col(weight).alias("_w0"), "factors")
    weights = list_weights(rows.select("factors").distinct(), factors, n_points, chunk)
    out = _at_points(join_hot(rows, stored(weights, "weights"), ["factors"]), [key, *keep, "_w0"])
    return out.select("point", key, *keep, (F.col("_w0") * F.col("weight")).alias("w")).filter("w > 0")


def shift_events(events: DataFrame, shifts: dict[str, Callable[[dict[str, Column]], Column]],
                 points: DataFrame) -> DataFrame:
    """Events at every point with kinematic values moved by functional parameters.

    One row per event and point by definition; spectra at points whose factors do not move
    events come cheaper from ``predict_spectra``.

    ``points`` is wide (point, <param>...) with point = 0..n-1.  ``shifts`` maps
    a variable to a function of the columns, nominal kinematics and parameters
    of the point alike; every function sees nominal values.
    """
    n = points.count()
    spread = events.withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    joined = spread.join(broadcast_if_small(points), "point")
    columns = {c: F.col(c) for c in joined.columns}
    moved = {v: f(columns) for v, f in shifts.items()}
    return joined.select("point", *[moved.get(c, F.col(c)).alias(c) for c in events.columns])


# -- scans --------------------------------------------------------------------


def prior_terms(columns: Sequence[str], prior: Sequence[float], inverse: np.ndarray,
                flat: Sequence[bool] | None = None, use: Sequence[bool] | None = None) -> Column:
    """Half the quadratic form of (x - prior), a matrix product per Arrow batch.

    Flat or unused parameters are left out; a row that lacks a value has none.
    """
    p = len(columns)
    kept = [i for i in range(p) if not (flat and flat[i]) and (use is None or use[i])]
    if not kept:
        return F.lit(0.0)
    centre = np.array([prior[i] for i in kept], float)
    matrix = np.asarray(inverse, float)[np.ix_(kept, kept)]

    @F.pandas_udf("double")
    def quadratic(*x: pd.Series) -> pd.Series:
        d = np.column_stack([c.to_numpy(dtype=float) for c in x]) - centre
        return pd.Series(((0.5 * d @ matrix) * d).sum(1))

    return quadratic(*[F.col(columns[i]).cast("double") for i in kept])


def penalty_term(chain: DataFrame, columns: Sequence[str], prior: Sequence[float], cov: np.ndarray,
                 sets: Sequence[dict], flat: Sequence[bool] | None = None) -> DataFrame:
    """Penalty of each named set per step; the columns go to Python once for all sets.

    A set record has ``set``, ``prefixes`` and ``exclude``: with exclude the
    set holds the parameters that match no prefix. A row has a null for sets of which it lacks a value.
    """
    inverse = np.linalg.inv(np.asarray(cov, float))
    kept = {}
    for record in sets:
        hit = [c.startswith(tuple(record["prefixes"])) for c in columns]
        use = [not h for h in hit] if record.get("exclude") else hit
        kept[f"penalty_{record['set']}"] = [i for i in range(len(columns)) if use[i] and not (flat and flat[i])]
    wanted = sorted({i for on in kept.values() for i in on})
    filled = {name: on for name, on in kept.items() if on}
    added = {name: F.lit(0.0) for name in kept if name not in filled}
    if not filled:
        return chain.withColumns(added)
    centre = np.array([prior[i] for i in wanted], float)
    parts = {name: [wanted.index(i) for i in on] for name, on in filled.items()}

    @F.pandas_udf(", ".join(f"`{name}` double" for name in filled))
    def quadratic(*x: pd.Series) -> pd.DataFrame:
        d = np.column_stack([c.to_numpy(dtype=float) for c in x]) - centre
        out = {}
        for name, at in parts.items():
            own = d[:, at]
            out[name] = ((0.5 * own @ inverse[np.ix_(filled[name], filled[name])]) * own).sum(1)
        return pd.DataFrame(out)

    found = chain.withColumn("_penalties", quadratic(*[F.col(columns[i]).cast("double") for i in wanted]))
    return found.withColumns({name: F.col("_penalties")[name] for name in filled} | added).drop("_penalties").select(
        *chain.columns, *kept)


def prior_llh(chain: DataFrame, columns: Sequence[str], prior: Sequence[float], cov: np.ndarray,
              bounds: Sequence[tuple[float | None, float | None]] = (), flat: Sequence[bool] | None = None,
              name: str = "prior_llh") -> DataFrame:
    """-lnL of the prior; the number of out-of-bounds parameters times a constant if any."""
    outside = F.lit(0)
    for c, (lo, hi) in zip(columns, bounds):
        test = F.lit(False)
        if lo is not None:
            test = test | (F.col(c) < float(lo))
        if hi is not None:
            test = test | (F.col(c) > float(hi))
        outside = outside + F.when(test, 1).otherwise(0)
    inside = prior_terms(columns, prior, np.linalg.inv(np.asarray(cov, float)), flat)
    return chain.withColumn(name, F.when(outside > 0, outside * F.lit(OUT_OF_BOUNDS_LLH)).otherwise(inside))


def profile_llh_1d(llhmap: DataFrame, params: Sequence[str], llh: str = "Total_LLH") -> DataFrame:
    """Smallest total LLH per grid value of each parameter, capped."""
    long = llhmap.select(llh, *[F.col(p).cast("double").alias(p) for p in params]).unpivot(
        [llh], list(params), "param", "value")
    return long.groupBy("param", "value").agg(F.least(F.min(llh), F.lit(OUT_OF_BOUNDS_LLH)).alias("llh"))


def profile_llh_2d(llhmap: DataFrame, params: Sequence[str], llh: str = "Total_LLH") -> DataFrame:
    """Same per pair of grid values; each unordered pair of parameters once."""
    pairs = F.array(*[
        F.struct(F.lit(a).alias("param_x"), F.lit(b).alias("param_y"),
                 F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for i, a in enumerate(params) for b in params[i + 1:]])
    return llhmap.select(llh, F.inline(pairs)).groupBy("param_x", "param_y", "x", "y").agg(
        F.least(F.min(llh), F.lit(OUT_OF_BOUNDS_LLH)).alias("llh"))


def step_scale_from_scan(scan: DataFrame, n_params: int) -> DataFrame:
    """2.38 / sqrt(LLH * n) from the larger end of each scan; null without sensitivity."""
    ends = scan.groupBy("param").agg(
        F.greatest(F.min_by("llh", "x"), F.max_by("llh", "x")).alias("end_llh"))
    # Scale of a random walk in n dimensions, lowest LLH used.
    scale = F.try_divide(F.lit(2.38 / n_params**0.5), F.sqrt("end_llh"))
    return ends.withColumn("step_scale", F.when(F.col("end_llh") >= 0.001, scale))


def sigma_variations(summed: DataFrame, params: Sequence[dict], factors_at: Callable[[DataFrame], DataFrame],
                     sigmas: Sequence[float] = (-3, -1, 0, 1, 3),
                     keys: Sequence[str] = ("sample_id", "bin")) -> DataFrame:
    """Spectra (scanned, sigma, keys, mc, w2) with one parameter moved at a time.

    Signatures keyed by mode or channel as well give spectra by mode or channel.
    """
    moved = sigma_points(summed.sparkSession, params, sigmas)
    spectra = predict_spectra(summed, factors_at(moved.select("point", "param", "value")), len(params) * len(sigmas), keys)
    # Parameters x sigmas rows.
    return spectra.join(F.broadcast(moved.select("point", "scanned", "sigma").distinct()), "point").drop("point")


def sigma_var_ratio(spectra: DataFrame, keys: Sequence[str] = ("scanned", "sample_id", "bin")) -> DataFrame:
    """Spectra of each variation over the nominal one (sigma 0) of the same parameter."""
    # A window partition holds the variations of one bin.
    nominal = F.max(F.when(F.col("sigma") == 0, F.col("mc"))).over(Window.partitionBy(*keys))
    return spectra.withColumn("nominal", nominal).filter("sigma <> 0").withColumn(
        "ratio", F.try_divide("mc", "nominal"))


def sigma_var_rates(spectra: DataFrame, keys: Sequence[str] = ("scanned", "sigma", "sample_id")) -> DataFrame:
    return spectra.groupBy(*keys).agg(F.sum("mc").alias("rate"))


def produce_toys(chain: DataFrame, summed: DataFrame, n: int, params: Sequence[str],
                 factors_at: Callable[[DataFrame], DataFrame], penalty: Callable[[DataFrame], DataFrame] | None = None,
                 weight: str | None = None, seed: int = 1, cut: int | None = None):
    """Toy spectra and their record for n random chain rows.

    ``factors_at`` turns long points into factors.  Returns (toys, info).
    """
    draws = random_draws(chain, n, cut, seed)
    draws = penalty(draws) if penalty else draws.withColumn("penalty", F.lit(0.0))
    info = draws.select(
        F.col("draw").alias("toy"), "penalty",
        (F.col(weight) if weight else F.lit(1.0)).alias("weight"), F.col("step").alias("draw"), *params)
    points = to_points(info.withColumnRenamed("toy", "point"), params)
    toys = predict_spectra(summed, factors_at(points), n).withColumnRenamed("point", "toy")
    return toys, info


def prior_toys(summed: DataFrame, params: Sequence[dict], cov: np.ndarray, n: int,
               factors_at: Callable[[DataFrame], DataFrame], seed: int = 1, groups: Sequence[str] = (),
               names: Sequence[str] = (), max_tries: int = 10000) -> tuple[DataFrame, DataFrame]:
    """(toys, info): toy spectra at n correlated draws from the prior, and the record of each toy.

    Parameters outside ``groups`` or ``names``, and fixed ones, stay at their prior (``throw_prior``).
    ``info`` has (toy, penalty, weight, <param>..., n_given_up); the penalty is half the quadratic form of the
    draw, flat parameters left out. A toy whose spectrum is empty is in ``info`` alone, so pass
    that to summaries over toys. The draws are written once: they are read for the factors and
    for the record.
    """
    columns = [p["name"] for p in params]
    drawn = throw_prior(summed.sparkSession, params, cov, n, seed, groups, names, max_tries)
    draws = stored(drawn, "draws")
    spectra = predict_spectra(summed, factors_at(to_points(draws, columns)), n).withColumnRenamed("point", "toy")
    penalty = prior_terms(columns, [p["prior"] for p in params], np.linalg.inv(np.asarray(cov, float)),
                          [bool(p.get("flat")) for p in params])
    info = draws.withColumn("penalty", penalty).select(
        F.col("point").alias("toy"), "penalty", F.lit(1.0).alias("weight"), *columns, "n_given_up")
    return spectra, info
