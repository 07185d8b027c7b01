"""Quality selection by importance resampling.

Texts are bags of hashed word unigrams and bigrams. Two generative models, bucket
frequencies of the target texts and of all raw texts, give each document the log of
its importance weight; Gumbel noise is added and the k largest sums are the sample
without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chainlens.llm.batches import bounded
from chainlens.llm.words import mixed, raw_text, slices, word_hashes
from chainlens.session import stored

BUCKETS, FOLDS, SEED = 10_000, 4, 11
SMALL_ROWS = 250_000  # counted ids that are broadcast, 6 MB for 77,722 as measured


def _grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and the row of each."""
    words, rows = word_hashes(data, offsets, symbols=True)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    pairs = mixed(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:], 5)
    inside = row[:-1] == row[1:]
    grams = np.concatenate([words, pairs[inside]]) % np.uint64(buckets)
    return grams.astype(np.int64), np.concatenate([row, row[:-1][inside]])


def fold_counts(docs: DataFrame, folds: int, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target_0, ...) counts over all documents (text, fold); each task sums its own first.

    ``fold`` is null for documents outside the target.
    """
    names = [f"target_{i}" for i in range(folds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros((folds, buckets), np.int64)
        for batch in batches:
            data, offsets = raw_text(batch.column("text"))
            fold = batch.column("fold").fill_null(-1).to_numpy(zero_copy_only=False)
            for a, b in slices(offsets):
                grams, row = _grams(data, offsets[a:b + 1], buckets)
                raw += np.bincount(grams, minlength=buckets)
                own = fold[a:b][row]
                for i in range(folds):
                    target[i] += np.bincount(grams[own == i], minlength=buckets)
        used = np.flatnonzero(raw)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (used, raw[used], *target[:, used])], ["bucket", "raw", *names])

    kinds = ", ".join(f"{c} long" for c in ("bucket", "raw", *names))
    sums = bounded(docs.select("text", F.col("fold").cast("int").alias("fold"))).mapInArrow(run, kinds)
    return sums.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", *names)])


def gram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target) counts over all documents (text, is_target)."""
    return fold_counts(docs.select("text", F.when(F.col("is_target"), 0).alias("fold")), 1, buckets).withColumnRenamed(
        "target_0", "target")


def _log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    target, raw = target + 1.0, raw + 1.0
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    target, raw = target + 1.0, raw + 1.0
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(p_target / p_raw) of each bucket with one added to each count; ``buckets`` numbers on the driver."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return _log_ratio(target, raw)


def fold_log_ratios(raw_counts: DataFrame, counts: DataFrame, folds: int, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratios by target model and bucket: row ``i`` is fitted without fold ``i``, the last one on all folds.

    Raw counts are those of ``raw_counts``, the folds' those of ``counts``.
    """
    raw, target = np.zeros(buckets), np.zeros((folds, buckets))
    for r in raw_counts.select("bucket", "raw").collect():
        raw[r.bucket] = r.raw
    for r in counts.collect():
        target[:, r.bucket] = [r[f"target_{i}"] for i in range(folds)]
    every = target.sum(axis=0)
    return np.stack([*(_log_ratio(every - own, raw) for own in target), _log_ratio(every, raw)])


def log_weights(docs: DataFrame, ratios: np.ndarray, model: str | None = None) -> DataFrame:
    """The documents with ``log_weight``, the summed log ratios of their n-grams; 0 without words.

    ``model`` names the column that says which row of ``ratios`` a document takes.
    """
    names = [c for c in docs.columns if c != "log_weight"]
    docs = docs.select(*names)
    models = np.atleast_2d(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_text(batch.column("text"))
            which = (batch.column(model).to_numpy(zero_copy_only=False) if model
                     else np.zeros(batch.num_rows, np.int64))
            out = np.zeros(batch.num_rows)
            for a, b in slices(offsets):
                grams, row = _grams(data, offsets[a:b + 1], models.shape[1])
                out[a:b] = np.bincount(row, models[which[a:b][row], grams], minlength=b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*names, "log_weight"])

    return bounded(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField("log_weight", DoubleType())]))


def gumbel(seed: int, *columns: str) -> Column:
    """Standard Gumbel noise, a function of the row, so that a lost task repeats its draws."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(scores: DataFrame, column: str, k: int, digits: int = 4096) -> float:
    """The k-th largest value (the least for a larger k), exactly: ranges that hold it are counted ever finer.

    Each round counts the rows of ``digits`` equal ranges; the driver sees these counts only.
    """
    if k <= 0:
        return math.inf
    low, high, n = scores.agg(F.min(column), F.max(column), F.count(column)).first()
    if n == 0 or k >= n:
        return low if n else -math.inf
    above = 0
    while True:
        step = (high - low) / digits
        if step <= 0 or low + step == low or high - step == high:  # next to equal: 2 * digits values at most
            near = scores.where(F.col(column).between(low, high)).groupBy(column).count().orderBy(F.desc(column))
            for value, count in near.collect():
                above += count
                if above >= k:
                    return value
        place = F.least(F.floor((F.col(column) - low) / step), F.lit(digits - 1))
        counts = dict(scores.where(F.col(column).between(low, high)).groupBy(place.alias("d")).agg(
            F.struct(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))).collect())
        for d in sorted(counts, reverse=True):
            if above + counts[d].n >= k:
                low, high = counts[d].lo, counts[d].hi
                break
            above += counts[d].n
        if low == high:
            return low


def target_sample(labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(doc_id, fold) of all labelled good documents, folds by a hash of their id."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.select("doc_id", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(folds)).cast("int").alias("fold"))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, miss: float = 0.002,
             buckets: int = BUCKETS, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Documents with log_weight, score (log weight plus Gumbel noise) and kept.

    The target model is fitted on all labelled good documents, the raw model on all
    documents. ``kept`` marks the ``k`` documents of largest score. Without ``k``, as many
    are kept as reach the score that all but a share ``miss`` of the labelled good documents
    reach, each of them under a target model fitted without its fold of ``folds``. A document
    without words has log weight 0. Rows that are repeated get the same score, and all of
    them are kept if one is. Without labelled good documents all is kept. Columns
    log_weight, score and kept of the input are replaced; others stay. An empty table gives
    an empty result.
    """
    docs = docs.drop("log_weight", "score", "kept")
    good = stored(target_sample(labels, folds), "good").select(F.col("doc_id").alias("_good"), "fold")
    small = good.count() <= SMALL_ROWS
    chosen = docs.select("doc_id", "text").join(
        F.broadcast(good) if small else good, F.col("doc_id") == F.col("_good")).select("doc_id", "text", "fold")
    if not small:  # texts are shuffled once only
        chosen = stored(chosen, "chosen")
    raw = fold_counts(docs.select("text", F.lit(None).alias("fold")), 0, buckets)
    ratios = fold_log_ratios(raw, fold_counts(chosen, folds, buckets), folds, buckets)
    score = F.col("log_weight") + gumbel(seed, "doc_id", "log_weight")
    if k is None:
        check = stored(log_weights(chosen, ratios, "fold").select(score.alias("score")), "scores")
        n = check.count()
        least = kth_largest(check, "score", n - math.floor(n * miss)) if n else -math.inf
    else:
        least = kth_largest(stored(log_weights(docs.select("doc_id", "text"), ratios[-1]).select(
            score.alias("score")), "scores"), "score", k)
    return log_weights(docs, ratios[-1]).withColumn("score", score).withColumn("kept", F.col("score") >= F.lit(least))
