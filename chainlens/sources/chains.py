"""Chain files: reading, classifying, merging; result tables of a posterior fit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a chain that are not model parameters.
BOOKKEEPING = ("chain_id", "step", "accProb", "stepTime", "LogL", "Weight")
COMPONENT_PREFIXES = ("LogL_sample_", "LogL_systematic_")
# Branch prefixes of the parameter types, and oscillation names.
TYPE_PREFIXES = {"ndd_": "near", "skd_joint_": "far", "param_": "model"}
OSCILLATION_PREFIXES = ("sin2th_", "delm2_", "delta_", "baseline", "density")
# Configuration lines that may differ between mergeable chains.
FREE_CONFIG_LINES = ("OutputFile:", "NSteps:")


def column_kind(name: str) -> str:
    if name in BOOKKEEPING:
        return "bookkeeping"
    if name.startswith("LogL_sample_"):
        return "sample_llh"
    if name.startswith("LogL_systematic_"):
        return "systematic_llh"
    if name.endswith("_Prop"):
        return "proposal"
    for prefix, kind in TYPE_PREFIXES.items():
        if name.startswith(prefix):
            return kind
    if name.startswith(OSCILLATION_PREFIXES):
        return "oscillation"
    return "other"


def classify_columns(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Schema of a chain as a table (column, kind); bounded by the column count."""
    return spark.createDataFrame(
        [(i, n, column_kind(n)) for i, n in enumerate(names)],
        "idx int, column string, kind string",
    )


def parameter_columns(chain: DataFrame, params: DataFrame | None = None,
                      exclude_types: Sequence[str] = (),
                      exclude_names: Sequence[str] = ()) -> list[str]:
    """Parameter columns, by the model table if given, else by name rules."""
    if params is not None:
        known = {r.branch for r in params.select("branch").collect()}
        names = [c for c in chain.columns if c in known]
    else:
        skip = {"bookkeeping", "sample_llh", "systematic_llh", "proposal"}
        names = [c for c in chain.columns if column_kind(c) not in skip]
    prefixes = tuple(exclude_types) + tuple(exclude_names)
    return [c for c in names if not (prefixes and c.startswith(prefixes))]


def read_chain(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Read one or more chain files; each path is a chain unless it names its own.

    If two files name the same ``chain_id``, they are different chains all the same: all
    chains are then numbered anew, by file and old number.
    """
    return union_chains(_told_apart(spark, [paths] if isinstance(paths, str) else list(paths)))


def _told_apart(spark: SparkSession, paths: Sequence[str]) -> list[DataFrame]:
    """The files' chains, numbered anew if two files name the same one; null is a number like any other."""
    parts = []
    for i, path in enumerate(paths):
        part = spark.read.parquet(path)
        if "chain_id" not in part.columns:
            part = part.withColumn("chain_id", F.lit(i))
        parts.append(part)
    if len(parts) == 1:
        return parts
    named = [sorted((r[0] for r in part.select("chain_id").distinct().collect()), key=lambda c: (c is not None, c))
             for part in parts]  # one row per chain
    if len({c for ids in named for c in ids}) < sum(map(len, named)):
        first = 0
        for i, (part, ids) in enumerate(zip(parts, named)):
            place = F.lit(None).cast("int")
            if ids:
                known = [c for c in ids if c is not None]
                place = F.when(F.col("chain_id").isNull(), first).otherwise(
                    F.array_position(F.lit(known or [0]), F.col("chain_id")).cast("int") - 1 + first + len(ids) - len(known))
            parts[i], first = part.withColumn("chain_id", place.cast("int")), first + len(ids)
    return parts


def chain_summary(chain: DataFrame) -> DataFrame:
    """Per chain number of entries and step range: map-side aggregate, one row each."""
    return chain.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.min("step").alias("first_step"),
        F.max("step").alias("last_step"),
    )


def check_same_columns(spark: SparkSession, chains: Sequence[DataFrame]) -> DataFrame:
    """Columns that are missing from a chain another chain has."""
    every = sorted({c for chain in chains for c in chain.columns})
    rows = [
        (i, c) for i, chain in enumerate(chains) for c in every if c not in chain.columns
    ]
    return spark.createDataFrame(rows, "chain int, missing string")


def union_chains(chains: Sequence[DataFrame]) -> DataFrame:
    """Concatenate chains with the same columns, keeping duplicates."""
    first = set(chains[0].columns)
    for other in chains[1:]:
        if set(other.columns) != first:
            raise ValueError(f"chains differ in columns: {sorted(first ^ set(other.columns))}")
    return reduce(DataFrame.unionByName, chains)


def normalised_config(config: Column) -> Column:
    """Configuration text without the lines that may differ."""
    def stays(line: Column) -> Column:
        return ~reduce(lambda a, b: a | b, [line.contains(free) for free in FREE_CONFIG_LINES])

    return F.array_join(F.filter(F.split(config, "\n"), stays), "\n")


def config_groups(configs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Distinct configurations by digest; more than one in a group blocks a merge."""
    digest = configs.select(
        *group, F.md5(normalised_config(F.col("config"))).alias("digest")
    )
    return (
        digest.groupBy(*group, "digest")
        .agg(F.count(F.lit(1)).alias("n_files"))
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("n_configs"), F.sum("n_files").alias("n_files"))
        .withColumn("mergeable", F.col("n_configs") == 1)
    )


def integral_conflicts(integrals: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Stored histograms (path, hist, integral) whose integrals disagree."""
    return (
        integrals.groupBy("hist")
        .agg(F.min("integral").alias("low"), F.max("integral").alias("high"),
             F.count(F.lit(1)).alias("n_files"))
        .withColumn("conflict", F.col("high") - F.col("low") > tolerance)
    )


def merge_chains(spark: SparkSession, paths: Sequence[str], out: str,
                 configs: DataFrame | None = None, integrals: DataFrame | None = None,
                 force: bool = False) -> DataFrame:
    """Concatenate chain files after comparing their configuration.

    ``configs`` is (path, config); ``integrals`` is (path, hist, integral).
    Files that name the same ``chain_id`` stay different chains, as in ``read_chain``.
    Empty files add no rows.  ``force`` merges in spite of a difference and
    overwrites the output.
    """
    if not force:
        if configs is not None and config_groups(configs).filter("not mergeable").count():
            raise ValueError("configurations of the chains differ")
        if integrals is not None and integral_conflicts(integrals).filter("conflict").count():
            raise ValueError("stored histogram integrals of the chains differ")
    merged = union_chains(_told_apart(spark, paths))
    merged.write.mode("overwrite" if force else "errorifexists").parquet(out)
    return spark.read.parquet(out)


def starting_point(chain: DataFrame, params: Sequence[str], config: str | None = None, current: str | None = None) -> DataFrame:
    """(chain_id, step, LogL, params) of the last entry of each chain, to go on from.

    With both configuration texts, they must agree but for the lines that may differ.
    """
    if config is not None and current is not None:
        texts = chain.sparkSession.createDataFrame([(config, current)], "a string, b string")
        if not texts.select(normalised_config(F.col("a")) == normalised_config(F.col("b"))).first()[0]:
            raise ValueError("the configuration of the chain and the current one are different")
    kept = ["step", *[c for c in ("LogL",) if c in chain.columns], *params]
    return chain.groupBy("chain_id").agg(F.max_by(F.struct(*kept), "step").alias("_l")).select("chain_id", "_l.*")


def write_postfit(postfit: DataFrame, out: str, mode: str = "errorifexists") -> None:
    """Save the table of prior, mean, Gaussian and highest-density values."""
    postfit.write.mode(mode).parquet(out)


def correlation_model(postfit: DataFrame, matrix: DataFrame, method: str = "Arithmetic") -> DataFrame:
    """Post-fit values by method and the correlations of each parameter, as model records.

    Groups are bounded by the number of parameters.
    """
    # Method names and the columns they take.
    columns = {"Arithmetic": ("mean", "rms"), "Gaussian": ("gauss_mean", "gauss_sigma"),
               "HPD": ("peak", "hpd_error")}
    mean, error = columns[method]
    partners = matrix.filter("param_i <> param_j").groupBy(F.col("param_i").alias("param")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("param_j").alias("name"), "corr"))).alias("list")
    )
    return postfit.select("param", F.col(mean).alias("prior"), F.col(error).alias("error")).join(
        partners, "param", "left"
    ).select("param", "prior", "error", F.map_from_entries("list").alias("corr"))


def export_correlations(postfit: DataFrame, matrix: DataFrame, out: str,
                        method: str = "Arithmetic", mode: str = "errorifexists") -> None:
    correlation_model(postfit, matrix, method).write.mode(mode).json(out)
