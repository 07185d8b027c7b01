"""Per-bin -lnL of data against a weighted prediction, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chainlens.functions.expr import LOW_MC_BOUND
from chainlens.functions.numeric import lgamma

STATISTICS = ("poisson", "barlow_beeston", "icecube", "pearson", "dembinski_abdelmotteleb")


def poisson(data: Column, mc) -> Column:
    """mc - data + data ln(data / mc), with the prediction bounded from below."""
    mc = mc if isinstance(mc, Column) else F.lit(float(mc))
    low = LOW_MC_BOUND
    plain = mc - data + data * F.log(F.try_divide(data, mc))
    return (
        F.when(data == 0, mc)
        .when((mc < low) & (data > low), low - data + data * F.log(data / low))
        .when((mc < low) & (data >= mc), 0.0)
        .otherwise(plain)
    )


def bounded_mc(data: Column, mc: Column) -> Column:
    return F.when((mc < LOW_MC_BOUND) & (data > LOW_MC_BOUND), LOW_MC_BOUND).otherwise(mc)


def no_information(data: Column, mc: Column) -> Column:
    """Both prediction and data are below the bound, and data is not below the prediction."""
    return (mc < LOW_MC_BOUND) & (data <= LOW_MC_BOUND) & (data >= mc)


def quadratic_beta(data: Column, mc: Column, w2: Column) -> Column:
    """Positive root of b^2 + (mc f - 1) b - data f = 0 with f = w2 / mc^2."""
    f = F.try_divide(w2, mc * mc)
    b = mc * f - 1
    return (F.sqrt(b * b + 4 * data * f) - b) / 2


def beta(data: Column, mc: Column, w2: Column, stat: str = "barlow_beeston") -> Column:
    """Scale between true and generated prediction."""
    if stat == "dembinski_abdelmotteleb":
        k = F.try_divide(mc * mc, w2)
        return F.try_divide(data + k, mc + k)
    return quadratic_beta(data, mc, w2)


def barlow_beeston(data: Column, mc: Column, w2: Column) -> Column:
    m = bounded_mc(data, mc)
    f = F.try_divide(w2, m * m)
    b = quadratic_beta(data, m, w2)
    stat = F.when(data > 0, m * b - data + data * F.log(F.try_divide(data, m * b))).otherwise(mc * b)
    penalty = F.when(f > 0, F.try_divide((b - 1) * (b - 1), 2 * f)).otherwise(0.0)
    return F.when(no_information(data, mc), 0.0).otherwise(stat + penalty)


def dembinski_abdelmotteleb(data: Column, mc: Column, w2: Column) -> Column:
    m = bounded_mc(data, mc)
    k = F.try_divide(m * m, w2)
    b = F.try_divide(data + k, m + k)
    scaled = m * b
    penalty = k * b - k - k * F.log(b)
    stat = F.when(data > 0, scaled - data + data * F.log(F.try_divide(data, scaled))).otherwise(scaled)
    return (
        F.when(w2 == 0, poisson(data, mc))
        .when(no_information(data, mc), 0.0)
        .otherwise(stat + penalty)
    )


def icecube(data: Column, mc: Column, w2: Column) -> Column:
    safe = F.when(w2 == 0, F.lit(1.0)).otherwise(w2)
    b = mc / safe
    a = mc * b + 1
    stat = -(a * F.log(b) + lgamma(data + a) - lgamma(data + 1.0)
             - (data + a) * F.log1p(b) - lgamma(a))
    bound = poisson(data, LOW_MC_BOUND)
    return (
        F.when(w2 == 0, poisson(data, mc))
        .when((mc <= data) & (data <= LOW_MC_BOUND), 0.0)
        .when((mc <= 0) & (data > LOW_MC_BOUND), bound)  # the statistic is infinite there
        .when((mc <= data) & (stat > bound), bound)
        .otherwise(stat)
    )


def pearson(data: Column, mc: Column, w2: Column | None = None) -> Column:
    low = LOW_MC_BOUND
    return (
        F.when(data == 0, mc / 2)
        .when((mc < low) & (data > low), (data - low) * (data - low) / (2 * low))
        .when((mc < low) & (data >= mc), 0.0)
        .otherwise(F.try_divide((data - mc) * (data - mc), 2 * mc))
    )


def bin_llh(stat: str, data: Column, mc: Column, w2: Column) -> Column:
    if stat == "poisson":
        return poisson(data, mc)
    table = {"barlow_beeston": barlow_beeston, "icecube": icecube, "pearson": pearson,
             "dembinski_abdelmotteleb": dembinski_abdelmotteleb}
    return table[stat](data, mc, w2)
