"""Event files per oscillation channel, observed spectra."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tag_channels(parts: Sequence[tuple[DataFrame, int, int]]) -> DataFrame:
    """Union of event tables, each tagged with its flavours before and after."""
    seen = [(a, b) for _, a, b in parts]
    if len(set(seen)) != len(seen):
        raise ValueError("an oscillation channel is given twice")
    tagged = [
        df.withColumn("init_pdg", F.lit(a)).withColumn("final_pdg", F.lit(b)).withColumn("channel", F.lit(i))
        for i, (df, a, b) in enumerate(parts)
    ]
    return reduce(DataFrame.unionByName, tagged)


def read_events(spark: SparkSession, channel_files: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Read one Parquet path per channel."""
    return tag_channels([(spark.read.parquet(path), a, b) for path, a, b in channel_files])


def spectrum_mismatch(data: DataFrame, mc: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Bins only one side has, or whose edges differ by more than the tolerance."""
    a = data.select("sample_id", "bin", F.col("lo").alias("data_lo"), F.col("hi").alias("data_hi"))
    b = mc.select("sample_id", "bin", F.col("lo").alias("mc_lo"), F.col("hi").alias("mc_hi"))
    gap = F.greatest(F.abs(F.col("data_lo") - F.col("mc_lo")), F.abs(F.col("data_hi") - F.col("mc_hi")))
    return a.join(b, ["sample_id", "bin"], "full_outer").filter(gap.isNull() | (gap > tolerance))


def load_data_spectrum(mc: DataFrame, data: DataFrame, check: bool = True) -> DataFrame:
    """Observed counts beside the prediction, for every bin that either side has; 0 where one has none.

    Edges ``lo``, ``hi`` are compared if both sides have them; if only one has, that is an
    error as well unless ``check`` is off.
    """
    edges = [{"lo", "hi"} <= set(df.columns) for df in (mc, data)]
    if check and any(edges):
        if not all(edges):
            raise ValueError("only one of data and prediction has bin edges")
        # A bin that only one side has is empty on the other, not binned differently.
        if spectrum_mismatch(data, mc).filter("data_lo is not null and mc_lo is not null").limit(1).count():
            raise ValueError("data and prediction are binned differently")
    counts = data.select("sample_id", "bin", "data", *[F.col(c).alias(f"_{c}") for c in ("lo", "hi") if all(edges)])
    filled = [c for c in ("data", "mc", "w2") if c == "data" or c in mc.columns]
    out = mc.join(counts, ["sample_id", "bin"], "full_outer").fillna(0.0, filled)
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in ("lo", "hi")}).drop("_lo", "_hi") if all(edges) else out
