import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlens.llm import quality

from tests.llm.conftest import SCHEMA, prose


@pytest.fixture(scope="module")
def judged(spark):
    """Clean prose, shouted and marked junk; labels on half of them."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = prose(i, 80)
        if bad:
            text = " ".join(w.upper() + rng.choice(("!!", "***", "$$$")) for w in text.split())
        rows.append((i, text, "en", "a", 0))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_unlabelled_documents_are_judged(judged):
    rows = {r.doc_id: r for r in quality.resample(*judged).collect()}
    fresh = [r for i, r in rows.items() if i % 2]
    assert sum(r.kept == (r.doc_id % 5 != 0) for r in fresh) >= .97 * len(fresh)


def test_weights_match_brute_force(judged):
    docs, labels = judged
    marked = docs.join(quality.target_sample(labels).withColumnRenamed("doc_id", "t"), docs["doc_id"] == F.col("t"), "left")
    counts = quality.gram_counts(marked.select("text", F.col("t").isNotNull().alias("is_target")), 64)
    ratios = quality.log_ratios(counts, 64)
    got = {r.doc_id: r.log_weight for r in quality.log_weights(docs, ratios).collect()}
    import pyarrow as pa
    for r in docs.limit(20).collect():
        grams, _ = quality._grams(*quality.raw_text(pa.array([r.text])), 64)
        assert got[r.doc_id] == pytest.approx(sum(ratios[g] for g in grams))
    assert counts.agg({"raw": "sum"}).first()[0] == sum(
        len(quality._grams(*quality.raw_text(pa.array([r.text])), 64)[0]) for r in docs.collect())


def test_every_labelled_document_counts(spark, judged, monkeypatch):
    """Model and threshold by brute force from all good documents, however many there are."""
    import pyarrow as pa
    many = spark.range(20_500).selectExpr("id doc_id", "1 quality", "0 toxic")
    assert quality.target_sample(many).count() == 20_500
    docs, labels = judged
    folds = {r.doc_id: r.fold for r in quality.target_sample(labels).collect()}
    assert set(folds) == {r.doc_id for r in labels.collect() if r.quality}
    grams = {r.doc_id: np.bincount(quality._grams(*quality.raw_text(pa.array([r.text])), 500)[0], minlength=500)
             for r in docs.collect()}
    raw = sum(grams.values()) + 1
    counts = quality.gram_counts(docs.withColumn("is_target", F.lit(False)), 500)

    def ratios(left_out=None):
        target = sum(grams[i] for i, f in folds.items() if f != left_out) + 1
        return np.log(target / target.sum()) - np.log(raw / raw.sum())

    for rows in (quality.SMALL_ROWS, 0):
        monkeypatch.setattr(quality, "SMALL_ROWS", rows)
        got = {r.doc_id: r for r in quality.resample(docs, labels, buckets=500, miss=.1).collect()}
        assert all(got[i].log_weight == pytest.approx(float(g @ ratios())) for i, g in grams.items())
        chosen = docs.join(quality.target_sample(labels), "doc_id")
        fitted = quality.fold_log_ratios(counts, quality.fold_counts(chosen, quality.FOLDS, 500), quality.FOLDS, 500)
        # The noise follows from the bits of a weight, so it is drawn from the operator's weights.
        held = {r.doc_id: r for r in quality.log_weights(chosen, fitted, "fold").withColumn(
            "noise", quality.gumbel(quality.SEED, "doc_id", "log_weight")).collect()}
        assert set(held) == set(folds)
        assert all(r.log_weight == pytest.approx(float(grams[i] @ ratios(folds[i]))) for i, r in held.items())
        scores = sorted(r.log_weight + r.noise for r in held.values())
        least = scores[math.floor(len(scores) * .1)]
        assert all(r.kept == (r.score >= least) for r in got.values())


def test_top_k_is_exact(spark, judged):
    for k in (0, 1, 57, 400, 900):
        rows = quality.resample(*judged, k=k).collect()
        best = sorted((r.score for r in rows), reverse=True)[:k]
        assert sorted((r.score for r in rows if r.kept), reverse=True) == best
    ties = spark.createDataFrame([(x,) for x in [1.0] * 50 + [1.0 + 2 ** -52] * 3 + [-5.0, 1e9, math.pi]], "x double")
    values = sorted((r.x for r in ties.collect()), reverse=True)
    assert [quality.kth_largest(ties, "x", k, 4) for k in range(1, 56)] == values[:55]


def test_noise_is_gumbel(spark):
    x = np.array([r[0] for r in spark.range(20_000).select(quality.gumbel(1, "id")).collect()])
    assert abs(x.mean() - 0.5772) < .05 and abs(x.var() - math.pi ** 2 / 6) < .1


def test_odd_rows(spark, judged, docs, no_docs, clashing):
    labels = judged[1]
    none = spark.createDataFrame([], labels.schema)
    odd = spark.createDataFrame([(None, 1, None), (3, None, 0), (4, 1, None), (4, 1, None)], labels.schema)
    assert quality.resample(no_docs, labels).count() == 0
    assert quality.resample(docs, none).where("kept").count() == docs.count()
    rows = quality.resample(docs, odd).collect()
    assert len(rows) == docs.count() and all(r.log_weight == 0 for r in rows if not (r.text or "").strip())
    out = quality.resample(clashing, labels)
    assert out.schema["kept"].dataType.simpleString() == "boolean" and out.where("key = 'own key'").count() == docs.count()
