"""Selecting, labelling and histogramming events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlens.functions.expr import weight_column
from chainlens.operators.binning import axis_bin, join_hot


def _all(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def select_events(events: DataFrame, cuts: Sequence[dict]) -> DataFrame:
    """Keep events inside every range cut lo <= x < hi.

    A cut record with ``sample_id`` holds for that sample only.  Cuts are plain
    predicates, so they reach the Parquet scan.
    """
    tests = []
    for cut in cuts:
        x = F.col(cut["var"])
        inside = (x >= float(cut["lo"])) & (x < float(cut["hi"]))
        if cut.get("sample_id") is not None:
            inside = inside | (F.col("sample_id") != cut["sample_id"])
        tests.append(inside)
    return events.filter(_all(tests))


def select_subevents(events: DataFrame, arrays: Sequence[str], cuts: Sequence[tuple[str, float, float]]) -> DataFrame:
    """One row per sub-event that passes lo <= x < hi on the named arrays.

    Arrays of one event must have equal length.
    """
    first = F.size(F.col(arrays[0]))
    same = _all([F.size(F.col(a)) == first for a in arrays[1:]])
    checked = F.when(same, F.arrays_zip(*[F.col(a) for a in arrays])).otherwise(
        F.raise_error(F.lit("sub-event arrays differ in length")))
    rest = [c for c in events.columns if c not in arrays]
    spread = events.select(*rest, F.inline(checked))
    return spread.filter(_all([(F.col(v) >= float(lo)) & (F.col(v) < float(hi)) for v, lo, hi in cuts]))


def select_mode_channel(events: DataFrame, mode=None, channel=None) -> DataFrame:
    """Temporary cut on mode and/or channel."""
    kept = events if mode is None else events.filter(F.col("mode") == F.lit(mode))
    return kept if channel is None else kept.filter(F.col("channel") == F.lit(channel))


# Muon, neutron and proton mass in GeV.
MUON, NEUTRON, PROTON = 0.10565837, 0.93956536, 0.93827203


def quasi_elastic_energy(p_lep: Column, cos_theta: Column, binding: float = 0.0, neutrino: bool = True) -> Column:
    """Neutrino energy from lepton momentum and angle; binding energy in MeV."""
    hit, left = (NEUTRON, PROTON) if neutrino else (PROTON, NEUTRON)
    hit = hit - binding / 1000.0
    energy = F.sqrt(p_lep * p_lep + MUON * MUON)
    top = 2 * hit * energy + (left * left - hit * hit - MUON * MUON)
    return F.try_divide(top, 2 * (hit - energy + p_lep * cos_theta))


def q2_shift(p_lep: Column, p_new: Column, e_true: Column, q2: Column) -> Column:
    """Change of Q2 when the lepton momentum moves at fixed angle."""
    m2 = MUON * MUON
    before, after = F.sqrt(p_lep * p_lep + m2), F.sqrt(p_new * p_new + m2)
    cos_theta = F.try_divide(2 * e_true * before - m2 - q2, 2 * e_true * p_lep)
    return 2 * e_true * (after - p_new * cos_theta) - m2 - q2


def derive_kinematics(events: DataFrame, p_lep: str, cos_theta: str, binding: float = 0.0,
                      neutrino: bool = True, name: str = "e_qe") -> DataFrame:
    return events.withColumn(name, quasi_elastic_energy(F.col(p_lep), F.col(cos_theta), binding, neutrino))


def duplicate_codes(modes: DataFrame) -> DataFrame:
    """Generator codes that belong to more than one mode."""
    return modes.groupBy("generator_code").agg(F.countDistinct("mode").alias("n_modes")).filter("n_modes > 1")


def map_modes(events: DataFrame, modes: DataFrame, key: str = "generator_code") -> DataFrame:
    """Analysis mode of each generator code; unknown codes become UNKNOWN_BAD."""
    table = modes.select(F.col("generator_code").alias(key), "mode", F.col("name").alias("mode_name"))
    return join_hot(events, table, [key], "left").withColumn(
        "mode_name", F.coalesce("mode_name", F.lit("UNKNOWN_BAD")))


def map_channels(events: DataFrame, channels: DataFrame, keys: Sequence[str] = ("init_pdg", "final_pdg")) -> DataFrame:
    """Oscillation channel of each event by its flavours before and after.

    An event that no channel describes is an error when the result is computed;
    ``unmapped_channels`` lists such flavours beforehand.
    """
    found = join_hot(events, channels.select(*keys, "channel"), keys, "left")
    missing = F.raise_error(F.concat(F.lit("no channel for flavours "), F.concat_ws(" -> ", *[
        F.col(k).cast("string") for k in keys])))
    return found.withColumn("channel", F.when(F.col("channel").isNull(), missing.cast(
        dict(channels.dtypes)["channel"])).otherwise(F.col("channel")))


def unmapped_channels(events: DataFrame, channels: DataFrame, keys: Sequence[str] = ("init_pdg", "final_pdg")) -> DataFrame:
    """Flavour pairs of events that no channel describes, with their counts."""
    seen = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"))
    return seen.join(channels, list(keys), "left_anti")


def match_norms(events: DataFrame, norms: Sequence[dict], nc_column: str | None = "is_nc",
                codes: dict[str, str] | None = None, name: str = "norm_ids") -> DataFrame:
    """Add the list of normalisation parameters that apply to each event.

    Records hold ``idx``, optional code lists (an empty list matches all) and
    ``kin``: per variable a list of bounds, lo < x <= hi, any of which may
    hold.  Conditions become one expression per parameter; there is no join.
    Oscillated neutral-current events match nothing.
    """
    codes = codes or {"targets": "target", "pdgs": "pdg", "preosc_pdgs": "pdg_unosc", "modes": "mode"}

    def applies(norm: dict) -> Column:
        tests = [F.col(column).isin(list(norm[key])) for key, column in codes.items() if norm.get(key)]
        for var, bounds in (norm.get("kin") or {}).items():
            any_of = [(F.col(var) > float(lo)) & (F.col(var) <= float(hi)) for lo, hi in bounds]
            tests.append(reduce(lambda a, b: a | b, any_of))
        return _all(tests)

    ids = F.array_compact(F.array(*[F.when(applies(n), F.lit(int(n["idx"]))) for n in norms]))
    if nc_column is not None:
        skip = F.col(nc_column) & (F.col("pdg") != F.col("pdg_unosc"))
        ids = F.when(skip, F.array().cast("array<int>")).otherwise(ids)
    return events.withColumn(name, ids)


def name_matches(pattern: Column, name: Column) -> Column:
    """Case-insensitive whole-name match where * stands for any text."""
    escaped = F.regexp_replace(F.lower(pattern), r"([.^$+?()\[\]{}|\\])", r"\\$1")
    return F.rlike(F.lower(name), F.concat(F.lit("^"), F.regexp_replace(escaped, r"\*", ".*"), F.lit("$")))


def params_for_sample(params: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Parameters that apply to each named sample; no sample list means all."""
    spread = params.withColumn("sample", F.explode(F.array(*[F.lit(s) for s in samples])))
    hit = F.exists("samples", lambda p: name_matches(p, F.col("sample")))
    return spread.filter((F.size("samples") <= 0) | F.col("samples").isNull() | hit)


def osc_weight_lookup(events: DataFrame, probabilities: DataFrame, e_edges: Sequence[float],
                      z_edges: Sequence[float], energy: str = "e_true", cosine: str = "cosz") -> DataFrame:
    """Probability of each event from a table by (point, channel, energy bin, zenith bin).

    The table is packed to one row per cell first, so the event side is
    shuffled at most once and points are spread after the join.
    """
    cells = probabilities.groupBy("channel", "e_bin", "z_bin").agg(
        F.collect_list(F.struct("point", "prob")).alias("_p"))
    binned = events.withColumn("e_bin", axis_bin(F.col(energy), e_edges)).withColumn(
        "z_bin", axis_bin(F.col(cosine), z_edges))
    keys = ["channel", "e_bin", "z_bin"]
    joined = join_hot(binned, cells, keys)
    return joined.select(*[c for c in joined.columns if c != "_p"], F.inline("_p"))


# -- aggregation --------------------------------------------------------------


def fill_spectra(events: DataFrame, weight: str = "w0", keys: Sequence[str] = ("sample_id", "bin"),
                 bins: DataFrame | None = None) -> DataFrame:
    """Sum of weights and of squared weights per bin; events with weight <= 0 are left out.

    With ``bins`` (keys), every bin has a row, 0 where no event fell. Spectra of many toys
    or points are better kept without empty rows: their summaries count these as 0.
    """
    w = F.col(weight)
    filled = events.filter(w > 0).groupBy(*keys).agg(F.sum(w).alias("mc"), F.sum(w * w).alias("w2"))
    if bins is None:
        return filled
    return bins.select(*keys).distinct().join(filled, list(keys), "left").fillna(0.0, ["mc", "w2"])


def rate_table(events: DataFrame, weight: str = "w0", mode: str = "mode", channel: str = "channel") -> DataFrame:
    """Weights by mode and channel with all totals; a total has null keys and a level."""
    return events.cube(mode, channel).agg(
        F.sum(weight).alias("rate"), F.grouping_id().alias("level"))


def write_rate_table(table: DataFrame, out: str, mode: str = "errorifexists") -> None:
    table.write.mode(mode).option("header", True).csv(out)


def _weighted(events: DataFrame, weight: str | None) -> DataFrame:
    w = weight_column(weight)
    return events.withColumn("_w", w) if weight is None else events.withColumn("_w", F.greatest(w, F.lit(0.0)))


def var_hist_1d(events: DataFrame, var: str, edges: Sequence[float], cuts: Sequence[dict] = (),
                weight: str | None = "w0", keys: Sequence[str] = ()) -> DataFrame:
    """Histogram of any event variable on its own axis; weight None counts events."""
    edges = [float(e) for e in edges]
    binned = _weighted(select_events(events, cuts), weight).withColumn("bin", axis_bin(F.col(var), edges))
    return binned.filter("bin is not null").groupBy(*keys, "bin").agg(
        F.sum("_w").alias("content"), F.sum(F.col("_w") * F.col("_w")).alias("err2"),
    ).withColumn("lo", F.element_at(F.lit(edges), F.col("bin") + 1)).withColumn(
        "hi", F.element_at(F.lit(edges), F.col("bin") + 2))


def var_hist_2d(events: DataFrame, x: str, y: str, x_edges: Sequence[float], y_edges: Sequence[float],
                cuts: Sequence[dict] = (), weight: str | None = "w0", keys: Sequence[str] = ()) -> DataFrame:
    binned = _weighted(select_events(events, cuts), weight).withColumn(
        "bin_x", axis_bin(F.col(x), x_edges)).withColumn("bin_y", axis_bin(F.col(y), y_edges))
    return binned.filter("bin_x is not null and bin_y is not null").groupBy(*keys, "bin_x", "bin_y").agg(
        F.sum("_w").alias("content"), F.sum(F.col("_w") * F.col("_w")).alias("err2"))


def hists_by(events: DataFrame, key: str, var: str, edges: Sequence[float], cuts: Sequence[dict] = (),
             weight: str | None = "w0") -> DataFrame:
    """Histogram per mode or channel, each bin next to the integral of its histogram."""
    hist = var_hist_1d(events, var, edges, cuts, weight, keys=(key,))
    # A window partition holds the bins of one histogram.
    return hist.withColumn("integral", F.sum("content").over(Window.partitionBy(key)))
