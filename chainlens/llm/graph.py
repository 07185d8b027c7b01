"""Connected components of an edge table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every end of ``edges`` (a, b); root is the smallest id of the component.

    Rounds of large and small stars: each node hands its larger, then its smaller
    neighbours to its smallest one, until the edges form stars. Groups are reduced
    by ``min`` before they are shuffled; each round is written to the shared folder.
    Null ends and loops count for nothing; the result is empty for no edges.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                 "edges")
    seen = None
    while True:
        # Large star: larger neighbours go to the smallest neighbour.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = now.join(least, now["v"] == least["k"]).select("u", F.col("m").alias("v")).where("u <> v")
        # Small star: smaller neighbours and the node go to the smallest one.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = stored(small.where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
