from itertools import groupby

import pytest

from chainlens.llm import passages
from tests.llm.conftest import SCHEMA, changed, prose
from tests.llm.test_near import groups, shingles, words_of


def wrapped(text, width):
    w = text.split(" ")
    return "\n".join(" ".join(w[k:k + width]) for k in range(0, len(w), width))


def stretches(texts, least=51):
    """(doc_id, start, end) of the words in runs that stand in several documents, by brute force."""
    where = {}
    for i, t in texts.items():
        w = words_of(t)
        for k in range(len(w) - least + 1):
            where.setdefault(tuple(w[k:k + least]), set()).add((i, k))
    starts = sorted({x for v in where.values() if len({i for i, _ in v}) > 1 for x in v})
    out = set()
    for i, own in groupby(starts, lambda x: x[0]):
        begin = end = None
        for _, k in own:
            if begin is not None and k >= end:
                out.add((i, begin, end))
                begin = None
            begin, end = k if begin is None else begin, k + least
        out.add((i, begin, end))
    return out


def test_wrapped_and_embedded_passages(spark, odd_rows):
    rows = []
    for k, n in enumerate([51, 52, 60, 75, 120, 50]):
        shared = prose(9000 + k, n)
        for j in range(5):
            text = f"{prose(500 + 10 * k + j, 30 + j)} {shared} {prose(700 + 10 * k + j, 17 * j)}"
            text = [text, wrapped(text, 7), text.upper(), wrapped(text, 11), shared][j]
            rows.append((10 * k + j, text, "en", "a", 0))
    docs = spark.createDataFrame(rows + odd_rows, SCHEMA).repartition(4)
    got = passages.repeated_passages(docs).where("exact").collect()
    want = stretches({r[0]: r[1] for r in rows})
    assert {(r.doc_id, r.start, r.end) for r in got} == want and len(got) == len(want)
    long = [r for r in got if r.doc_id < 50]
    assert len(long) == 25
    for r in long:
        assert r.n_passages == 5 and r.first_doc_id == r.doc_id // 10 * 10
        assert r.removed == (r.doc_id != r.first_doc_id)


def test_any_51_words_are_found(spark):
    texts = {}
    for k in range(60):
        shared = prose(100 + k, 51)
        texts[2 * k] = f"{prose(5000 + k, k)} {shared} {prose(6000 + k, 80)}"
        texts[2 * k + 1] = f"{prose(7000 + k, 90)} {shared}"
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], SCHEMA)
    got = {(r.doc_id, r.start, r.end) for r in passages.repeated_passages(docs).where("exact").collect()}
    assert got == stretches(texts) and len(got) == 120


def test_edited_passages_are_linked(spark):
    base = prose(1, 300)
    rows = [(i, f"{prose(50 + i, 40)} {changed(base, i, 2)} {prose(90 + i, 40)}", "en", "a", 0) for i in range(6)]
    rows += [(20 + i, prose(200 + i, 300), "en", "a", 0) for i in range(6)]
    got = passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).where("not exact").collect()
    sets = {(r.doc_id, r.start): shingles(" ".join(words_of(rows[r.doc_id][1])[r.start:r.end])) for r in got}
    assert len({r.doc_id for r in got} & set(range(6))) >= 5 and {r.doc_id for r in got} <= set(range(6))
    assert {(r.doc_id, r.start): (r.first_doc_id, r.first_start) for r in got} == groups(sets, 80)
    assert all(r.removed == ((r.doc_id, r.start) != (r.first_doc_id, r.first_start)) for r in got)


def test_parts_of_a_longer_passage_stay_once(spark):
    """Words are removed only where they stand in a place that stays."""
    one, two = prose(3, 60), prose(4, 70)
    texts = {1: f"{prose(5, 20)} {one}", 2: f"{one} {two}", 3: f"{two} {prose(6, 20)}"}
    got = passages.repeated_passages(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], SCHEMA)).where("exact")
    assert {(r.doc_id, r.start, r.end): (r.first_doc_id, r.first_start, r.n_passages, r.removed) for r in got.collect()} == {
        (1, 20, 80): (1, 20, 2, False), (2, 0, 60): (1, 20, 2, True),
        (2, 60, 130): (2, 60, 2, False), (3, 0, 70): (2, 60, 2, True)}


def test_band_keys_are_shuffled_once_and_runs_with_an_edit_are_not(spark, capsys):
    """Runs that hold an edit collide in some bands only; they can't stand elsewhere and are left out before the shuffle."""
    base = prose(11, 400).split(" ")
    rows = []
    for i in range(8):
        edited = [f"new{i}" if k % 20 == i * 2 else w for k, w in enumerate(base)]  # no 21 words without an edit
        rows.append((i, " ".join(edited), "en", "a", 0))
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    found = passages.collisions(docs)
    found.explain()
    assert capsys.readouterr().out.count("hashpartitioning(bucket") == 1
    bands = passages.tuned(80, passages.HASHES, passages.RECALL)[0]
    hit = docs.join(found, "doc_id").cache()
    marks = [len({m // bands for m in r.hits}) for r in hit.collect()]
    assert len(marks) == 8 and min(marks) > 10
    assert passages._widened(hit, 51, bands).count() < 100
    near = {r.doc_id for r in passages.repeated_passages(docs).collect()}
    assert stretches({r[0]: r[1] for r in rows}) == set() and near <= set(range(8))


def test_odd_tables(spark, no_docs, docs, clashing):
    assert passages.repeated_passages(no_docs).count() == 0
    assert passages.repeated_passages(clashing).exceptAll(passages.repeated_passages(docs)).count() == 0
    same = prose(8, 100)
    rows = [(1, same, "en", "a", 0), (1, same, "en", "a", 0), (None, same, "en", "a", 0), (2, None, "en", "a", 0)]
    assert passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).count() == 0
    flat = [(k, "ba " * n, "en", "a", 0) for k, n in enumerate([49, 60, 400])]
    got = {(r.doc_id, r.start, r.end) for r in passages.repeated_passages(spark.createDataFrame(flat, SCHEMA)).where("exact").collect()}
    assert got == {(1, 0, 60), (2, 0, 400)}
    with pytest.raises(ValueError):
        passages.repeated_passages(docs, least_words=50)
