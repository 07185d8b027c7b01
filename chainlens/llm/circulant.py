"""Near-duplicate documents by circulant MinHash.

Two permutations of the 64-bit numbers generate the whole signature: the first
scatters the shingles, the second is shifted circularly by one place for each
coordinate. Bands of coordinates give candidates; full sets confirm the links.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.llm import near
from chainlens.llm.words import mixed
from chainlens.session import stored

BANDS, ROWS = 24, 6


def signer(bands: int = BANDS, rows: int = ROWS, seed: int = 20):
    """Band keys of shingle sets: coordinate k is min over v of pi(sigma(v) - k)."""

    def sign(sets: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, sets[:-1])])
        sigma = mixed(np.concatenate(sets), seed)
        out = np.zeros((bands, len(sets)), np.uint64)
        for k in range(bands * rows):
            pi = mixed(sigma - np.uint64(k), seed * 0x51ED2701)
            band = k // rows
            out[band] = mixed(out[band] + np.minimum.reduceat(pi, starts), band + 1)
        return np.ascontiguousarray(out.T)

    return sign


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of documents (doc_id, text).

    Documents are linked when 100 * intersection >= percent * union of their shingle
    sets; with 24 bands of 6 rows, a pair at 85 % is missed about once in 80,000 times,
    and hardly ever above. ``component_id`` is the smallest doc_id reachable by links and ``kept``
    holds for that document. Null or wordless texts are linked with nothing. A row
    without doc_id is linked with nothing, has a null component and is kept. Rows
    that repeat a doc_id each get the result of their own text. Other columns are
    not looked at. An empty table gives an empty result.
    """
    items = docs.select(F.col("doc_id").alias("id"), "text")
    signed = stored(near.signatures(items, signer(bands, rows), width), "signatures")
    linked = near.linked_keys(signed, items, percent, width)
    ids = signed.where("key is not null").groupBy("key").agg(F.min("id").alias("lowest"))
    roots = linked.join(ids, "key")
    least = roots.groupBy("root").agg(F.min("lowest").alias("low"))
    by_key = ids.join(linked.join(least, "root"), "key", "left").select(
        "key", F.coalesce("low", "lowest").alias("component_id"))
    rows_ = signed.select(F.col("id").alias("doc_id"), "n_shingles", "key").join(by_key, "key", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return rows_.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents that :func:`near_duplicates` keeps, with all their columns.

    Rows that share a doc_id stay if one of them is kept, equal ones (id and text) once.
    """
    found = stored(near_duplicates(docs, **options), "kept")
    ids = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("kept")
    once = ids.where("n = 1").select(F.col("doc_id").alias("_id"))
    out = docs.join(once, docs["doc_id"].eqNullSafe(once["_id"]), "left_semi")
    again = ids.where("n > 1").select(F.col("doc_id").alias("_id"))
    if again.isEmpty():
        return out
    return out.union(docs.join(again, docs["doc_id"].eqNullSafe(again["_id"]), "left_semi").dropDuplicates(
        ["doc_id", "text"]))
