"""Repeated passages by MinHash banding of paragraphs that cover all of a text.

Paragraphs are runs of ``BLOCK`` words that begin at places chosen by the words themselves: in
every window of ``WINDOW`` shingles the last smallest hash is such a place, however the text is
broken into lines. Two texts that share ``WINDOW + BLOCK - 1`` = 51 words in a row choose the
smallest hash of the first window alike, so at least one paragraph stands whole in both. Paragraphs
are banded; those that collide across documents are widened to every run of ``LEAST_WORDS`` words
around them and to runs of neighbours, and both are verified: the former as equal words, the
latter by exact Jaccard similarity. Components of the links are the clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.llm import near
from chainlens.llm.batches import bounded
from chainlens.llm.graph import components
from chainlens.llm.paragraphs import signer, tuned
from chainlens.llm.words import _PLACES, mixed, raw_text, slices, word_hashes
from chainlens.session import stored

LEAST_WORDS, WINDOW, BLOCK, WIDTH = 51, 31, 21, 5
HASHES, RECALL = 10, 0.99


def _shingles(words: np.ndarray) -> np.ndarray:
    runs = np.zeros(max(len(words) - WIDTH + 1, 0), np.uint64)
    for k in range(WIDTH):
        runs += words[k:len(runs) + k] * np.uint64(_PLACES[k])
    return mixed(runs)


def _chosen(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every window and the place it chooses, which need not have ``BLOCK`` words behind it."""
    span = WINDOW + WIDTH - 1
    if len(words) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = mixed(_shingles(words), 31)
    whole = np.flatnonzero(row[:len(words) - span + 1] == row[span - 1:])
    windows = sliding_window_view(order, WINDOW)[:, ::-1]
    at = [part + WINDOW - 1 - windows[part].argmin(axis=1) for part in np.array_split(whole, len(whole) // 100_000 + 1)]
    return whole, np.concatenate(at)


def places(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where paragraphs begin, given word hashes and the row that each word is of."""
    at = np.unique(_chosen(words, row)[1])
    at = at[at + BLOCK <= len(words)]
    return at[row[at] == row[at + BLOCK - 1]]


def paragraph_bands(docs: DataFrame, hashes: int = HASHES, recall: float = RECALL, percent: int = 80) -> DataFrame:
    """(doc_id, mark, bucket) of every paragraph and band.

    ``mark`` is the number of the paragraph's first word in the text times the number of bands, plus the band's number.
    """
    bands, rows = tuned(percent, hashes, recall)
    draws = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64), 93).reshape(2, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_text(batch.column("text"))
            for a, b in slices(offsets):
                words, first = word_hashes(data, offsets[a:b + 1])
                row = np.repeat(np.arange(b - a), np.diff(first))
                at = places(words, row)
                if not len(at):
                    continue
                shingles = _shingles(words)
                keys = np.zeros((bands, len(at)), np.uint64)
                for k in range(bands * rows):
                    permuted = mixed((shingles ^ draws[0, k]) * (draws[1, k] | np.uint64(1)))
                    least = sliding_window_view(permuted, BLOCK - WIDTH + 1)[at].min(axis=1)
                    keys[k // rows] = mixed(keys[k // rows] + least, k // rows + 1)
                ids = batch.column("doc_id").slice(a, b - a).take(pa.array(row[at]))
                for band in range(bands):
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array((at - first[row[at]]) * bands + band), pa.array(keys[band].view(np.int64))],
                        ["doc_id", "mark", "bucket"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, mark long, bucket long")


def collisions(docs: DataFrame, hashes: int = HASHES, recall: float = RECALL, percent: int = 80) -> DataFrame:
    """(doc_id, hits) of documents with paragraphs that collide with those of others; ``hits`` are their marks.

    Band keys are shuffled once: a bucket's smallest and largest document are found where its rows meet.
    """
    bucket = Window.partitionBy("bucket")
    bands = paragraph_bands(docs, hashes, recall, percent).select(
        "doc_id", "mark", F.min("doc_id").over(bucket).alias("lo"), F.max("doc_id").over(bucket).alias("hi"))
    return bands.where("lo <> hi").groupBy("doc_id").agg(F.collect_set("mark").alias("hits"))


def _ranges(hits: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """Starts of the runs of ``least`` words of a text that can stand elsewhere too.

    A run that does has the same windows there, which choose the same paragraphs. So each
    paragraph that lies in the run with a window that chose it has collided, in all bands.
    """
    n = len(words)
    if n < least:
        return np.zeros(0, np.int64)
    first, at = _chosen(words, np.zeros(n, np.int8))
    collided = np.zeros(n + 1, bool)
    collided[hits[hits < n]] = True
    lone = ~collided[at]
    first, at = first[lone], at[lone]
    low = np.maximum(np.maximum(first + WINDOW + WIDTH - 1, at + BLOCK) - least, 0)
    ruled_out = np.zeros(n + 2, np.int64)
    np.add.at(ruled_out, low[low <= first], 1)
    np.add.at(ruled_out, first[low <= first] + 1, -1)
    return np.flatnonzero(np.cumsum(ruled_out)[:n - least + 1] == 0)


def _widened(hit: DataFrame, least: int, bands: int) -> DataFrame:
    """(doc_id, at, h) of every run of ``least`` words whose paragraphs collide in all bands; h is 64 bits of its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mixed(np.arange(least, dtype=np.uint64), 51) | np.uint64(1)
        for batch in batches:
            data, offsets = raw_text(batch.column("text"))
            for a, b in slices(offsets):
                words, first = word_hashes(data, offsets[a:b + 1])
                for i in range(a, b):
                    own = words[first[i - a]:first[i - a + 1]]
                    hits, n = np.unique(np.array(batch.column("hits")[i].as_py(), np.int64) // bands, return_counts=True)
                    at = _ranges(hits[n == bands], own, least)
                    if not len(at):
                        continue
                    h = np.zeros(len(at), np.uint64)
                    for k in range(least):
                        h += own[at + k] * weights[k]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(i, 1).take(pa.array(np.zeros(len(at), np.int64))),
                         pa.array(at.astype(np.int32)), pa.array(mixed(h).view(np.int64))], ["doc_id", "at", "h"])

    kind = hit.schema["doc_id"].dataType.simpleString()
    return bounded(hit.select("doc_id", "text", "hits")).mapInArrow(run, f"doc_id {kind}, at int, h long")


def _runs(hit: DataFrame, least: int, bands: int) -> DataFrame:
    """(id, text): neighbouring colliding paragraphs, at most a window apart, as runs of ``least`` words or more.

    ``id`` is (doc_id, start, end) in words.
    """
    kind = hit.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends, texts = [], [], [], []
            for doc, text, hits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "hits"))):
                words = text.translate(_SPACES).split(" ")
                words = [w for w in words if w]
                at = np.unique(np.array(hits, np.int64) // bands)
                cut = np.flatnonzero(np.diff(at) > BLOCK + WINDOW) + 1
                for part in np.split(at, cut):
                    a, b = int(part[0]), int(part[-1]) + BLOCK
                    if b - a >= least:
                        ids.append(doc)
                        starts.append(a)
                        ends.append(b)
                        texts.append(" ".join(words[a:b]))
            if ids:
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, batch.schema.field("doc_id").type), "start": pa.array(starts, pa.int32()),
                    "end": pa.array(ends, pa.int32()), "text": pa.array(texts, pa.string())})

    out = bounded(hit.select("doc_id", "text", "hits")).mapInArrow(run, f"doc_id {kind}, start int, end int, text string")
    return out.select(F.struct("doc_id", "start", "end").alias("id"), "text")


_SPACES = {c: " " for c in (9, 10, 11, 12, 13)}


def _near(hit: DataFrame, least: int, bands: int, percent: int) -> DataFrame:
    """Rows of the result for runs linked by Jaccard similarity."""
    runs = stored(_runs(hit, least, bands), "runs")
    signed = stored(near.signatures(runs, signer(*tuned(percent)), WIDTH), "signatures")
    linked = near.linked_keys(signed, runs, percent, WIDTH)
    rows = signed.join(linked, "key", "left").withColumn("root", F.coalesce("root", "key")).select("id", "root").distinct()
    firsts = rows.groupBy("root").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where(
        "lo.doc_id <> hi.doc_id")
    return rows.join(firsts, "root").select(
        "id.doc_id", "id.start", "id.end", F.col("lo.doc_id").alias("first_doc_id"), F.col("lo.start").alias("first_start"),
        F.col("n").alias("n_passages"), (F.col("id") != F.col("lo")).alias("removed"), F.lit(False).alias("exact"))


def _equal(hit: DataFrame, least: int, bands: int) -> DataFrame:
    """(doc_id, start, end, other, other_at, later) of words that stand alike in several documents, with their first place."""
    same = Window.partitionBy("h")
    runs = _widened(hit, least, bands).select(
        "doc_id", "at", F.min(F.struct("doc_id", "at")).over(same).alias("lo"), F.max("doc_id").over(same).alias("hi"))
    rows = runs.where("lo.doc_id <> hi").select(
        "doc_id", "at", F.col("lo.doc_id").alias("other"), (F.col("lo.at") - F.col("at")).alias("shift"))
    # Runs that follow one another here and there are one; rows that come twice have one rank.
    line = Window.partitionBy("doc_id", "other", "shift").orderBy("at")
    rows = rows.withColumn("part", F.col("at") - F.dense_rank().over(line))
    return rows.groupBy("doc_id", "other", "shift", "part").agg(
        F.min("at").alias("start"), (F.max("at") + least).alias("end")).select(
        "doc_id", "start", "end", "other", (F.col("start") + F.col("shift")).alias("other_at"),
        ((F.col("doc_id") != F.col("other")) | (F.col("shift") != 0)).alias("later"))


def _clustered(links: DataFrame) -> DataFrame:
    """Rows of the result for the stretches that links cover."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = links.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn(
        "part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = stored(parts.withColumn("node", F.struct("doc_id", F.min("start").over(
        Window.partitionBy("doc_id", "part")).alias("start"))), "parts")
    passages = stored(parts.groupBy("node").agg(F.max("end").alias("end"), F.min("later").alias("removed")), "passages")
    there = passages.select(F.col("node").alias("b"), F.col("node.doc_id").alias("other"), F.col("end").alias("b_end"))
    edges = parts.select(F.col("node").alias("a"), "other", "other_at").distinct().join(there, "other").where(
        (F.col("b.start") <= F.col("other_at")) & (F.col("other_at") < F.col("b_end"))).select("a", "b")
    roots = components(edges)
    rows = passages.join(roots, passages["node"] == roots["id"])
    sizes = rows.groupBy("root").agg(F.count("*").alias("n"))
    return rows.join(sizes, "root").select(
        "node.doc_id", "node.start", "end", F.col("root.doc_id").alias("first_doc_id"),
        F.col("root.start").alias("first_start"), F.col("n").alias("n_passages"), "removed", F.lit(True).alias("exact"))


def repeated_passages(docs: DataFrame, percent: int = 80, least_words: int = LEAST_WORDS,
                      hashes: int = HASHES, recall: float = RECALL) -> DataFrame:
    """(doc_id, start, end, first_doc_id, first_start, n_passages, removed, exact) of passages of several documents.

    A passage goes from word ``start`` to ``end`` (exclusive, numbered from 0). ``exact`` ones are the longest
    stretches in which each word is in a run of ``least_words`` (51 at least) words that stands alike in
    another document; all of them are found. They are clusters where they share such runs, and
    ``removed`` says that each such run of the passage has an earlier place; the first place of a run always
    stays, so removing passages loses no words. The others are runs of ``least_words`` or more around colliding
    paragraphs, clusters by a Jaccard similarity of ``percent`` of their shingle sets, of which all but
    the first are ``removed``; a paragraph collides at that similarity as often as ``recall``, and a run ends
    where no paragraph collides, so it may be shorter than what was copied. Both may cover the same words. Clusters are named by their first passage (smallest doc_id, then start).

    Case of A-Z and white space don't count. Rows of one doc_id are one document, whose
    repeats of itself don't count; rows with a null doc_id or text, and empty and shorter
    texts, have no passages. Ties go to the smaller start. Texts of any length are read whole. Other
    columns are not looked at; an empty table gives an empty result.
    """
    if least_words < WINDOW + BLOCK - 1:
        raise ValueError(f"least_words is {WINDOW + BLOCK - 1} at least")
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    bands = tuned(percent, hashes, recall)[0]
    hit = stored(docs.join(collisions(docs, hashes, recall, percent), "doc_id"), "hits")
    return _clustered(_equal(hit, least_words, bands)).union(_near(hit, least_words, bands, percent))
