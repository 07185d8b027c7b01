"""Second moments of a chain: covariance by Gram sums, and what follows from them.

All-pairs sums are never p * p SQL aggregates for large p: each task reduces its
rows to one Gram matrix, and only matrix entries are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.functions.expr import number, weight_column

# Up to this many parameters the pair sums are plain SQL aggregates; both ways give the same sums.
SQL_PAIRS_LIMIT = 16


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(c)).alias(str(i)) for i, c in enumerate(columns)]).first()
    return {c: row[str(i)] if row[str(i)] is not None else 0.0 for i, c in enumerate(columns)}


def _gram_sql(df: DataFrame, columns, keys) -> DataFrame:
    p = len(columns)
    sums = [F.sum("_w").alias("sw")]
    sums += [F.sum(F.col("_w") * F.col(f"x{i}")).alias(f"s{i}") for i in range(p)]
    sums += [F.sum(F.col("_w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}")
             for i in range(p) for j in range(i, p)]
    pairs = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}").alias("si"),
                 F.col(f"s{j}").alias("sj"), F.col(f"q{i}_{j}").alias("sij"))
        for i in range(p) for j in range(i, p)
    ])
    return df.groupBy(*keys).agg(*sums).select(*keys, "sw", F.inline(pairs))


def _gram_blocks(df: DataFrame, columns, keys) -> DataFrame:
    p = len(columns)
    upper = np.triu_indices(p)
    names = [f"x{i}" for i in range(p)]

    def partial(batches):
        sums = {}
        for pdf in batches:
            groups = [((), pdf)] if not keys else pdf.groupby(list(keys), sort=False)
            for key, part in groups:
                x = np.column_stack([part["_w"].to_numpy() ** 0, part[names].to_numpy()])
                gram = (x * part["_w"].to_numpy()[:, None]).T @ x
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums[key] + gram if key in sums else gram
        for key, g in sums.items():
            out = pd.DataFrame({
                "i": upper[0], "j": upper[1], "sw": g[0, 0], "si": g[0, 1:][upper[0]],
                "sj": g[0, 1:][upper[1]], "sij": g[1:, 1:][upper],
            })
            for name, value in zip(keys, key):
                out[name] = value
            yield out

    types = dict(df.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [
        "i int, j int, sw double, si double, sj double, sij double"])
    parts = df.mapInPandas(partial, schema)
    return parts.groupBy(*keys, "i", "j").agg(*[F.sum(c).alias(c) for c in ("sw", "si", "sj", "sij")])


def gram(chain: DataFrame, columns: Sequence[str], weight: str | None = None,
         keys: Sequence[str] = (), method: str = "auto",
         shift: dict[str, float] | None = None) -> DataFrame:
    """Weighted sums (keys, i <= j, sw, si, sj, sij) of the shifted columns.

    Rows count that are complete: a row with null or NaN in its weight or in any of the
    columns is left out of all sums, whatever the method.
    """
    w = weight_column(weight).cast("double")
    complete = w.isNotNull() & (F.abs(w) < float("inf"))
    for c in columns:
        complete = complete & number(c).isNotNull()
    chain = chain.filter(complete)
    shift = shift or column_means(chain, columns)
    shifted = chain.select(*keys, w.alias("_w"), *[
        (F.col(c).cast("double") - F.lit(float(shift[c]))).alias(f"x{i}") for i, c in enumerate(columns)])
    if method == "auto":
        method = "sql" if len(columns) <= SQL_PAIRS_LIMIT else "blocks"
    return (_gram_sql if method == "sql" else _gram_blocks)(shifted, columns, list(keys))


def _cov():
    return F.try_divide("sij", "sw") - F.try_divide("si", "sw") * F.try_divide("sj", "sw")


def matrix_from_gram(sums: DataFrame, columns: Sequence[str], keys: Sequence[str] = (),
                     fixed: Sequence[str] = ()) -> DataFrame:
    """Full symmetric table (keys, param_i, param_j, cov, corr) from upper Gram sums."""
    names = F.array(*[F.lit(c) for c in columns])
    is_fixed = F.array(*[F.lit(c in set(fixed)) for c in columns])
    at = lambda values, index: F.element_at(values, F.col(index) + 1)
    upper = sums.select(
        *keys, "i", "j",
        F.when(at(is_fixed, "i") | at(is_fixed, "j"), F.lit(0.0)).otherwise(_cov()).alias("cov"))
    # Variances stand on the diagonal; a window partition is one row or column of a matrix.
    own = F.when(F.col("i") == F.col("j"), F.col("cov"))
    with_corr = upper.withColumn("vi", F.max(own).over(Window.partitionBy(*keys, "i"))).withColumn(
        "vj", F.max(own).over(Window.partitionBy(*keys, "j"))).withColumn(
        "corr", F.when((F.col("vi") > 0) & (F.col("vj") > 0),
                       F.try_divide(F.col("cov"), F.sqrt(F.col("vi") * F.col("vj")))).otherwise(F.lit(0.0)))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return with_corr.select(*keys, "cov", "corr", F.explode(both).alias("_p")).select(
        *keys, F.element_at(names, F.col("_p.i") + 1).alias("param_i"),
        F.element_at(names, F.col("_p.j") + 1).alias("param_j"), "cov", "corr")


def covariance(chain: DataFrame, columns: Sequence[str], weight: str | None = None,
               keys: Sequence[str] = (), fixed: Sequence[str] = (), method: str = "auto") -> DataFrame:
    """Weighted population covariance and correlation of all pairs; fixed parameters give 0."""
    return matrix_from_gram(gram(chain, columns, weight, keys, method), columns, keys, fixed)


def _interval(n: int, end: int):
    """Interval k holds k * size < step <= (k + 1) * size; later steps go to the last one."""
    size = max(end // n, 1)
    return F.least(F.floor((F.col("step") - 1) / F.lit(size)), F.lit(n - 1)).cast("int"), size


def prefix_gram(chain: DataFrame, columns: Sequence[str], n: int, end: int,
                weight: str | None = None, suffix: bool = False, method: str = "auto") -> DataFrame:
    """Gram sums of growing prefixes (or shrinking suffixes) of the steps.

    One scan sums per interval; the window runs over n rows per pair.
    """
    interval, _ = _interval(n, end)
    sums = gram(chain.withColumn("interval", interval), columns, weight, ["interval"], method)
    order = F.desc("interval") if suffix else F.asc("interval")
    upto = Window.partitionBy("i", "j").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.select("interval", "i", "j", *[F.sum(c).over(upto).alias(c) for c in ("sw", "si", "sj", "sij")])


def suboptimality(chain: DataFrame, columns: Sequence[str], n: int, end: int,
                  weight: str | None = None) -> DataFrame:
    """p * sum(1/l^2) / sum(1/l)^2 over covariance eigenvalues, per growing prefix."""
    p = len(columns)
    matrices = prefix_gram(chain.filter("step > 0"), columns, n, end, weight).select(
        "interval", "i", "j", _cov().alias("cov"))

    def eigen(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((p, p))
        m[pdf["i"], pdf["j"]] = pdf["cov"]
        m[pdf["j"], pdf["i"]] = pdf["cov"]
        values = np.linalg.eigvalsh(m)
        inverse = 1.0 / values if (values > 0).all() else np.full(p, np.nan)
        value = p * (inverse**2).sum() / inverse.sum() ** 2
        return pd.DataFrame({"interval": [pdf["interval"].iloc[0]], "suboptimality": [value]})

    # One group is one p x p matrix.
    return matrices.groupBy("interval").applyInPandas(eigen, "interval int, suboptimality double")


def covariance_stability(chain: DataFrame, columns: Sequence[str], n: int, end: int,
                         weight: str | None = None) -> DataFrame:
    """Ratio of the matrices for burn-in k*size and (k-1)*size; null where both are tiny."""
    sums = prefix_gram(chain.filter("step > 0"), columns, n, end, weight, suffix=True)
    table = matrix_from_gram(sums, columns, ["interval"])
    ordered = Window.partitionBy("param_i", "param_j").orderBy("interval")

    def change(c: str):
        now, before = F.col(c), F.lag(c).over(ordered)
        tiny = (F.abs(now) < 1e-5) & (F.abs(before) < 1e-5)
        return F.when(~tiny, F.try_divide(now, before))

    return table.select("interval", "param_i", "param_j", "cov", "corr",
                        change("cov").alias("cov_ratio"), change("corr").alias("corr_ratio")
                        ).filter("interval >= 1")


def running_covariance(chain: DataFrame, pairs: Sequence[tuple[str, str]], block: int = 1 << 16) -> DataFrame:
    """Mean and sample covariance of the chain after every step, for the given pairs.

    Blocks of steps are summed first and their offsets cumulated (one row per
    block); inside a block, which holds at most ``block`` rows per chain, a
    window adds the rows one by one.
    """
    names = sorted({c for pair in pairs for c in pair})
    shift = column_means(chain, names)
    x = {c: F.col(f"x{i}") for i, c in enumerate(names)}
    base = chain.select("chain_id", "step", F.floor(F.col("step") / block).alias("_b"), *[
        (F.col(c).cast("double") - F.lit(float(shift[c]))).alias(f"x{i}") for i, c in enumerate(names)])
    terms = {"n": F.lit(1.0), **{f"s{i}": x[c] for i, c in enumerate(names)},
             **{f"q{k}": x[a] * x[b] for k, (a, b) in enumerate(pairs)}}
    blocks = base.groupBy("chain_id", "_b").agg(*[F.sum(t).alias(f"o_{k}") for k, t in terms.items()])
    earlier = Window.partitionBy("chain_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("chain_id", "_b", *[
        F.coalesce(F.sum(f"o_{k}").over(earlier), F.lit(0.0)).alias(f"o_{k}") for k in terms])
    within = Window.partitionBy("chain_id", "_b").orderBy("step").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    sums = base.select("chain_id", "_b", "step", *[F.sum(t).over(within).alias(k) for k, t in terms.items()])
    full = sums.join(offsets, ["chain_id", "_b"]).select(
        "chain_id", "step", *[(F.col(k) + F.col(f"o_{k}")).alias(k) for k in terms])
    index = {c: i for i, c in enumerate(names)}
    rows = F.array(*[
        F.struct(
            F.lit(a).alias("param_i"), F.lit(b).alias("param_j"),
            (F.lit(float(shift[a])) + F.col(f"s{index[a]}") / F.col("n")).alias("mean_i"),
            F.when(F.col("n") > 1,
                   (F.col(f"q{k}") - F.col(f"s{index[a]}") * F.col(f"s{index[b]}") / F.col("n"))
                   / F.greatest(F.col("n") - 1, F.lit(1.0))).otherwise(F.lit(0.0)).alias("cov"))
        for k, (a, b) in enumerate(pairs)
    ])
    return full.select("chain_id", "step", F.inline(rows))


def strong_correlations(matrix: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Partners of each parameter with their band, and whether they pass the threshold."""
    size = F.abs(F.col("corr"))
    return matrix.filter("param_i <> param_j").select(
        "param_i", "param_j", "corr",
        # Limits of the correlation bands.
        F.when(size < 0.25, 0).when(size < 0.5, 1).when(size < 1.0001, 2).alias("band"),
        (size > threshold).alias("is_strong"),
    ).orderBy(F.desc(size), "param_i", "param_j")


def group_correlations(matrix: DataFrame, params: DataFrame) -> DataFrame:
    """Correlations summed up by blocks of consecutive parameters of one group."""
    # The model table has one row per parameter.
    order = Window.orderBy("idx")
    blocks = params.select("idx", "branch", F.coalesce("grp", F.lit("Other")).alias("grp")).withColumn(
        "_new", F.when(F.lag("grp").over(order) == F.col("grp"), 0).otherwise(1)
    ).withColumn("block", (F.sum("_new").over(order) - 1).cast("int"))
    side = lambda s: blocks.select(
        F.col("branch").alias(f"param_{s}"), F.col("block").alias(f"block_{s}"), F.col("grp").alias(f"grp_{s}"))
    return (
        matrix.join(F.broadcast(side("i")), "param_i").join(F.broadcast(side("j")), "param_j")
        .groupBy("block_i", "grp_i", "block_j", "grp_j")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("corr").alias("mean_corr"),
             F.max(F.when(F.col("param_i") != F.col("param_j"), F.abs("corr"))).alias("max_abs_corr"))
    )


def sub_matrix(matrix: DataFrame, names: DataFrame) -> DataFrame:
    """Rows and columns of the named parameters; ``names`` has one column ``name``."""
    return matrix.join(names, F.col("param_i") == F.col("name"), "left_semi").join(
        names, F.col("param_j") == F.col("name"), "left_semi")


def missing_names(matrix: DataFrame, names: DataFrame) -> DataFrame:
    return names.join(matrix, F.col("name") == F.col("param_i"), "left_anti")


def matrix_compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two matrices side by side on their common entries."""
    other = second.select("param_i", "param_j", F.col("cov").alias("cov_2"), F.col("corr").alias("corr_2"))
    return first.join(other, ["param_i", "param_j"]).withColumn("corr_diff", F.col("corr_2") - F.col("corr"))
