"""Reusable Column expressions: binning, labels, safe arithmetic."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lowest MC content a likelihood uses, likelihood of a point
# outside its bounds, and the coverage of 1..6 Gaussian sigma.
LOW_MC_BOUND = 1e-5
OUT_OF_BOUNDS_LLH = 1234567890.0
SIGMA_COVERAGE = {
    1: 0.682689492137,
    2: 0.954499736104,
    3: 0.997300203937,
    4: 0.999936657516,
    5: 0.999999426697,
    6: 0.999999998027,
}


def linspace(lo: float, hi: float, n: int) -> list[float]:
    """n + 1 equally spaced edges."""
    width = (hi - lo) / n
    return [lo + i * width for i in range(n)] + [hi]


def logspace(lo: float, hi: float, n: int) -> list[float]:
    """n + 1 edges equally spaced in the logarithm."""
    return [lo] + [lo * (hi / lo) ** (i / n) for i in range(1, n)] + [hi]


def axis_edges(records: Sequence[float | dict]) -> list[float]:
    """Edges of an axis given by numbers and by records of ranges, in order.

    A range is ``{"linspace": {"nb": n, "low": a, "up": b}}`` or the same with
    ``logspace``; where it begins at the edge before it, that edge is not repeated.
    """
    edges: list[float] = []
    for record in records:
        if isinstance(record, dict):
            (kind, given), = record.items()
            if kind not in ("linspace", "logspace"):
                raise ValueError(f"a range is linspace or logspace, not {kind}")
            new = (linspace if kind == "linspace" else logspace)(float(given["low"]), float(given["up"]), int(given["nb"]))
        else:
            new = [float(record)]
        edges += new[1:] if edges and new[0] == edges[-1] else new
    if any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError("edges do not rise")
    return edges


def uniform_bin(x: Column, lo, hi, nbins: int) -> Column:
    """Bin number in 0..nbins-1; -1 is underflow, nbins is overflow (x >= hi)."""
    lo, hi = F.lit(lo), F.lit(hi)
    inside = F.least(
        F.floor(F.try_divide(nbins * (x - lo), hi - lo)).cast("int"), F.lit(nbins - 1)
    )
    return (
        F.when(x < lo, F.lit(-1))
        .when(x >= hi, F.lit(nbins))
        .when(x.isNotNull(), inside)
    )


def inner_bin(x: Column, lo: float, hi: float, nbins: int) -> Column:
    """Bin number of lo <= x < hi, null outside; lo < hi are numbers."""
    place = F.floor(nbins * (x - F.lit(lo)) / F.lit(hi - lo)).cast("int")
    return F.when((x >= lo) & (x < hi), F.least(place, F.lit(nbins - 1)))


def is_equal_width(edges: Sequence[float]) -> bool:
    width = (edges[-1] - edges[0]) / (len(edges) - 1)
    return all(
        abs(edges[i] - (edges[0] + i * width)) <= 1e-12 * max(1.0, abs(edges[i]))
        for i in range(len(edges))
    )


def edge_bin(x: Column, edges: Sequence[float]) -> Column:
    """Bin i with edges[i] <= x < edges[i+1]; null outside.

    Written as a balanced CASE tree, so the search costs log2(bins)
    comparisons and stays in generated code.
    """
    edges = [float(e) for e in edges]

    def search(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last + 1) // 2
        return F.when(x < edges[middle], search(first, middle - 1)).otherwise(
            search(middle, last)
        )

    return F.when((x >= edges[0]) & (x < edges[-1]), search(0, len(edges) - 2))




def product(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a * b, columns) if columns else F.lit(1.0)


def finite_or(value: Column, default) -> Column:
    """The value, or the default when it is null, NaN or infinite."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(value)


def gauss(x: Column, mean, sigma) -> Column:
    """Normal density."""
    z = (x - F.lit(mean)) / F.lit(sigma)
    return F.exp(-0.5 * z * z) / (F.lit(sigma) * F.sqrt(F.lit(2.0) * F.pi()))


def weight_column(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def starts_with_any(column: Column, prefixes: Sequence[str]) -> Column:
    tests = [column.startswith(p) for p in prefixes]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)



# -- labels -----------------------------------------------------------------

# Upper limits of the two evidence scales and their labels.
JEFFREYS = [
    (0.0, "Negative"),
    (5.0, "Barely worth mentioning"),
    (10.0, "Substantial"),
    (15.0, "Strong"),
    (20.0, "Very strong"),
]
JEFFREYS_TOP = "Decisive"
DUNNE_KABOTH = [
    (2.125, "< 1 #sigma"),
    (20.74, "> 1 #sigma"),
    (369.4, "> 2 #sigma"),
    (15800.0, "> 3 #sigma"),
    (1745000.0, "> 4 #sigma"),
]
DUNNE_KABOTH_TOP = "> 5 #sigma"


def scale_label(value: Column, limits, top: str) -> Column:
    """First label whose limit is above the value."""
    label = F.lit(top)
    for limit, name in reversed(limits):
        label = F.when(value < limit, name).otherwise(label)
    return F.when(value.isNotNull(), label)


def jeffreys_label(value: Column) -> Column:
    return scale_label(value, JEFFREYS, JEFFREYS_TOP)


def dunne_kaboth_label(value: Column) -> Column:
    return scale_label(value, DUNNE_KABOTH, DUNNE_KABOTH_TOP)


def z_score(value: Column, mean: Column, sigma: Column) -> Column:
    return F.try_divide(value - mean, sigma)


def uniform(seed: int, *keys: str | Column) -> Column:
    """Uniform number in (0, 1) that depends on the seed and the row's keys alone, not on the partitioning."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, *keys: str | Column) -> Column:
    """Standard normal number of the row's keys, from two uniform ones."""
    radius = F.sqrt(-2 * F.log(uniform(2 * seed, *keys)))
    return radius * F.cos(2 * F.pi() * uniform(2 * seed + 1, *keys))


def row_keys(chain: DataFrame) -> list[str]:
    """What tells the entries of a chain apart: chain and step, or all columns where there is no step.

    Without a step, entries that are alike share their draws.
    """
    return ["chain_id", "step"] if {"chain_id", "step"} <= set(chain.columns) else chain.columns


def number(column: str) -> Column:
    """The column as a double, with NaN and infinite values as null."""
    x = F.col(column).cast("double")
    return F.when(F.abs(x) < float("inf"), x)  # NaN is above infinity
