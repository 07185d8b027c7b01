"""Repeated passages by MinHash banding of paragraphs.

Paragraphs are the lines of a text. Bands are tuned for recall, colliding paragraphs are
joined, exact Jaccard similarity of their shingle sets confirms the links, and of each
component the first paragraph stays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.llm import near
from chainlens.llm.mixing import word_count
from chainlens.llm.words import mixed
from chainlens.session import stored

LEAST_WORDS, HASHES, RECALL = 50, 128, 0.9999


def tuned(percent: int, hashes: int = HASHES, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): most rows a band at which a pair of this similarity collides as often as ``recall``."""
    s = percent / 100
    fit = [r for r in range(1, hashes + 1) if 1 - (1 - s ** r) ** (hashes // r) >= recall]
    rows = max(fit, default=1)
    return hashes // rows, rows


def signer(bands: int, rows: int, seed: int = 9):
    """Band keys of shingle sets under independent permutations."""
    draws = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64), seed).reshape(2, -1)

    def sign(sets: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, sets[:-1])])
        values = np.concatenate(sets)
        out = np.zeros((bands, len(sets)), np.uint64)
        for k in range(bands * rows):
            permuted = mixed((values ^ draws[0, k]) * (draws[1, k] | np.uint64(1)))
            band = k // rows
            out[band] = mixed(out[band] + np.minimum.reduceat(permuted, starts), band + 1)
        return np.ascontiguousarray(out.T)

    return sign


def paragraphs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, text) of the lines with ``least_words`` words or more; id is (doc_id, line)."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return rows.where(word_count(F.col("text")) >= least_words).select(F.struct("doc_id", "line").alias("id"), "text")


def repeated_paragraphs(docs: DataFrame, percent: int = 80, width: int = 5, least_words: int = LEAST_WORDS,
                        hashes: int = HASHES, recall: float = RECALL) -> DataFrame:
    """(doc_id, line, n_shingles, first_doc_id, first_line, n_paragraphs, removed) of repeated paragraphs.

    Paragraphs of ``least_words`` words or more are linked at a Jaccard similarity of
    ``percent`` of their shingle sets. Every member of a component of two or more is
    returned with the component's first paragraph (smallest doc_id, null first, then
    line); all but that are ``removed``. A text repeated under one doc_id counts as
    repeated. Null, empty and shorter texts have no paragraphs. Other columns are not
    looked at; an empty table gives an empty result.
    """
    items = paragraphs(docs, least_words)
    signed = stored(near.signatures(items, signer(*tuned(percent, hashes, recall)), width), "signatures")
    linked = near.linked_keys(signed, items, percent, width)
    by_key = signed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    by_key = by_key.join(linked, "key", "left").withColumn("root", F.coalesce("root", "key"))
    groups = by_key.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1")
    groups = by_key.select("key", "root").join(groups, "root").select("key", "first", "n")
    return signed.select("id", "n_shingles", "key").join(groups, "key").select(
        "id.doc_id", "id.line", "n_shingles", F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.line").alias("first_line"), F.col("n").alias("n_paragraphs"),
        (F.col("id") != F.col("first")).alias("removed"))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents without their removed paragraphs; other columns stay as they are."""
    gone = repeated_paragraphs(docs, **options).where("removed").groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_set("line").alias("_gone"))
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("doc")).join(
        gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(
        F.coalesce("_gone", F.array().cast("array<int>")), i))
    text = F.when(F.col("text").isNotNull(), F.array_join(left, "\n")).alias("text")
    return rows.select(*[text if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
