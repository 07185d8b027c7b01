"""Corpus preparation in stages: quality, near duplicates, benchmark leaks, personal data, mixing.

Each stage works on the rows its predecessor kept and is written as Parquet before the
next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainlens.llm import circulant, crf, mixing, quality, spaced
from chainlens.session import stored


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance-weighted sample takes."""
    return quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return circulant.deduplicated(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return spaced.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), tolerant_from=spaced.LEAST_TOKENS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced in their texts."""
    return crf.redact(docs, crf.fitted(crf.observations(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: document copies by shard."""
    return mixing.mix(docs)


STAGES = [
    ("quality", select_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

# Fitted models, hashes of whole sets and random draws are not SQL; the tests hold the
# stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
