"""Toy spectra and their per-toy record, partitioned by sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_toys(toys: DataFrame, info: DataFrame, out: str, mode: str = "errorifexists") -> None:
    toys.write.mode(mode).partitionBy("sample_id").parquet(f"{out}/spectra")
    info.write.mode(mode).parquet(f"{out}/info")


def load_toys(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/spectra"), spark.read.parquet(f"{path}/info")
