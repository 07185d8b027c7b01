"""Stages on a small folder of tables, each against what the operators' brute-force versions say."""

import pytest

import corpus_pipeline
from chainlens.llm import crf

from tests.llm.conftest import SCHEMA, changed, prose
from tests.llm.test_near import groups, shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, odd_rows):
    path = str(tmp_path_factory.mktemp("tables"))
    leak = prose(4444, 40)
    rows = [(i, prose(i, 60 + i % 50), "en", f"s{i % 3}", 0) for i in range(160)]
    rows += [(200 + i, changed(rows[i][1], i, i % 3), "en", "s0", 0) for i in range(20)]
    rows += [(300 + i, f"{prose(300 + i, 50)} {leak} {prose(i, 7)}", "en", "s1", 0) for i in range(10)]
    rows += [(400 + i, f"{prose(400 + i, 50)} a{i}@b.example.com 10.0.0.{i}", "en", "s2", 0) for i in range(10)]
    rows += [(500 + i, " ".join(w.upper() + "!!!" for w in prose(500 + i, 80).split()), "en", "s0", 0) for i in range(30)]
    labels = [(r[0], int(r[0] < 500), 0) for r in rows if r[0] % 2 == 0]
    spark.createDataFrame(rows + odd_rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [{(r.doc_id, r.text) for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert out.columns == docs.columns
        docs = out
        seen.append({(r.doc_id, r.text) for r in docs.collect()})
    ids = [{i for i, _ in s if i is not None} for s in seen]
    prose_ids = set(range(160)) | set(range(200, 220)) | set(range(300, 310)) | set(range(400, 410))
    assert prose_ids <= ids[1] and not ids[1] & set(range(500, 530))
    texts = {i: t for i, t in seen[1] if i is not None}
    want = groups({i: shingles(t) for i, t in texts.items()}, 85)
    assert ids[2] == {i for i, g in want.items() if i == g}
    assert ids[3] == ids[2] - set(range(300, 310))
    assert ids[4] == ids[3] and not any(crf.base_spans(t or "") for _, t in seen[4])
    assert {(i, t) for i, t in seen[3] if i is not None and i < 400} == {(i, t) for i, t in seen[4] if i is not None and i < 400}

    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    taken, size = {}, {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.words
    for r in docs.collect():
        size[r.source] = size.get(r.source, 0) + len((r.text or "").split())
    assert abs(sum(taken.values()) - sum(size.values())) <= len(size) + 1
    again = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_empty_tables(spark, folder, tmp_path, no_docs):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
