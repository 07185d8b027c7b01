import re
from itertools import combinations

import numpy as np

from chainlens.llm import circulant, paragraphs
from chainlens.llm.graph import components
from chainlens.llm.words import raw_text, shingle_sets, word_hashes


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words_of(text)
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def groups(sets, percent):
    """Smallest reachable key of each, by brute force."""
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def test_words_and_pieces(monkeypatch):
    import pyarrow as pa

    from chainlens.llm import words
    texts = ["A bc  D\x0b", None, "", "longword" * 50 + " x é é", "a\tb c d e f A"]
    want = [words_of(t) for t in texts]
    for piece in (1 << 20, 64, 7):
        monkeypatch.setattr(words, "PIECE", piece)
        h, rows = word_hashes(*raw_text(pa.array(texts)))
        assert list(np.diff(rows)) == [len(w) for w in want]
        ids = {}
        for w, x in zip([w for t in want for w in t], h.tolist()):
            assert ids.setdefault(w, x) == x
        assert len(set(ids.values())) == len(ids)
        sets = shingle_sets(*raw_text(pa.array(texts)))
        assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]


def test_signature_is_circulant():
    from chainlens.llm.words import mixed
    values = np.arange(1, 400, dtype=np.uint64) ** np.uint64(7)
    sigma = mixed(values, 20)
    row = [mixed(sigma - np.uint64(k), 20 * 0x51ED2701).min() for k in range(6)]
    band = np.zeros(1, np.uint64)
    for x in row:
        band = mixed(band + x, 1)
    assert circulant.signer(1, 6)([values])[0, 0] == band[0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (105, 103), (7, 7), (200, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_match_brute_force(docs):
    rows = circulant.near_duplicates(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    want = groups({i: shingles(t) for i, t in texts.items()}, 85)
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept and r.n_shingles > 0
        else:
            assert (r.component_id, r.n_shingles) == (want[r.doc_id], len(shingles(texts[r.doc_id])))
            assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_nothing_and_of_more_columns(docs, no_docs, clashing):
    assert circulant.near_duplicates(no_docs).count() == 0
    want = circulant.near_duplicates(docs)
    assert circulant.near_duplicates(clashing).exceptAll(want).count() == 0


def test_deduplicated(docs):
    left = circulant.deduplicated(docs)
    kept = {r.doc_id for r in circulant.near_duplicates(docs).where("kept").collect()}
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == docs.columns and set(ids) == kept and len(ids) == len(set(ids))


def test_bands_are_tuned():
    bands, rows = paragraphs.tuned(80)
    assert 1 - (1 - .8 ** rows) ** bands >= .9999 > 1 - (1 - .8 ** (rows + 1)) ** (128 // (rows + 1))


def test_paragraphs_match_brute_force(spark, odd_rows):
    from tests.llm.conftest import SCHEMA, changed, prose
    shared = [prose(9000 + k, 55 + 9 * k) for k in range(6)]
    rows = []
    for i in range(60):
        lines = [prose(i, 60), changed(shared[i % 6], i, i % 4), "short line"]
        rows.append((i, "\n".join(lines if i % 2 else lines[::-1]), "en", "a", 0))
    docs = spark.createDataFrame(rows + odd_rows, SCHEMA)
    got = {((r.doc_id, r.line), (r.first_doc_id, r.first_line)) for r in paragraphs.repeated_paragraphs(docs).collect()}
    sets = {(i, k): shingles(x) for i, t, *_ in rows for k, x in enumerate(t.split("\n")) if len(words_of(x)) >= 50}
    want = groups(sets, 80)
    many = [k for k in want.values()]
    assert got == {(k, g) for k, g in want.items() if many.count(g) > 1}
    left = {r.doc_id: r.text for r in paragraphs.without_repeats(docs).collect() if r.doc_id is not None and r.doc_id < 60}
    for i, t, *_ in rows:
        gone = {k for k, g in want.items() if k[0] == i and many.count(g) > 1 and k != g}
        assert left[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)


def test_paragraphs_of_odd_tables(no_docs, clashing):
    assert paragraphs.repeated_paragraphs(no_docs).count() == 0
    out = paragraphs.without_repeats(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
