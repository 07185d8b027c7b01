"""Parameter model: one record per parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMS_SCHEMA = (
    "idx int, name string, branch string, prior double, error double, low double, "
    "up double, flat boolean, fixed boolean, grp string, step_scale double, "
    "samples array<string>, corr map<string,double>"
)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Read JSON records and refuse an inconsistent model."""
    params = spark.read.schema(PARAMS_SCHEMA).json(path)
    problems = model_problems(params).limit(5).collect()
    if problems:
        raise ValueError(f"bad parameter model: {[tuple(p) for p in problems]}")
    return params


def make_params(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Model table from records; fields left out get neutral values."""
    names = [field.split()[0] for field in PARAMS_SCHEMA.split(", ")]
    neutral = {"flat": False, "fixed": False, "step_scale": 1.0, "samples": [], "corr": {}}
    rows = []
    for i, record in enumerate(records):
        full = {"idx": i, "branch": record["name"], **neutral, **record}
        rows.append(tuple(full.get(n) for n in names))
    return spark.createDataFrame(rows, PARAMS_SCHEMA)


def correlation_entries(params: DataFrame) -> DataFrame:
    return params.select(F.col("name").alias("a"), F.explode("corr").alias("b", "corr"))


def model_problems(params: DataFrame) -> DataFrame:
    """Non-positive errors; correlations not given both ways or that disagree."""
    bad_error = params.filter(~(F.col("error") > 0)).select(
        "name", F.lit(None).cast("string").alias("other"), F.lit("error not positive").alias("problem")
    )
    pairs = correlation_entries(params)
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("corr").alias("back"))
    one_way = pairs.join(back, ["a", "b"], "left").filter(
        F.col("back").isNull() | (F.col("back") != F.col("corr"))
    ).select(F.col("a").alias("name"), F.col("b").alias("other"),
             F.lit("correlation not symmetric").alias("problem"))
    return bad_error.unionByName(one_way)


def prior_covariance(params: DataFrame) -> DataFrame:
    """Prior matrix: error squared on the diagonal, corr * error * error off it."""
    errors = params.select("name", "error")
    diagonal = errors.select(F.col("name").alias("param_i"), F.col("name").alias("param_j"),
                             (F.col("error") * F.col("error")).alias("cov"))
    other = (
        correlation_entries(params)
        .join(errors.select(F.col("name").alias("a"), F.col("error").alias("ea")), "a")
        .join(errors.select(F.col("name").alias("b"), F.col("error").alias("eb")), "b")
        .select(F.col("a").alias("param_i"), F.col("b").alias("param_j"),
                (F.col("corr") * F.col("ea") * F.col("eb")).alias("cov"))
    )
    return diagonal.unionByName(other)
