import random
import zlib

import numpy as np
import pytest

from chainlens.llm import packing

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = tokenizers.Tokenizer.from_file(PATH)


def whole_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def checked(rows, docs, length, slack):
    """Each document's ids once, sequences without gaps, little padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length > 0
    want = {}
    for d in docs:
        ids = [*TOKENIZER.encode(d.text or "", add_special_tokens=False).ids, 2]
        want.setdefault((d.doc_id, len(ids)), []).append(ids)
    assert set(by_doc) == set(want)
    for key, pieces in by_doc.items():
        copies, total = want[key], key[1]
        seen = np.zeros(total, int)
        for r in pieces:
            seen[r.start:r.start + r.length] += 1
            part = np.frombuffer(r.ids, "<u4").tolist()
            assert any(c[r.start:r.start + r.length] == part for c in copies)
        assert (seen == len(copies)).all()
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        if at & (at - 1):
            assert length - at <= slack
            padded += length - at
    return padded, by_sequence


@pytest.mark.parametrize("length, windows, slack", [(4096, 32, 16), (64, 3, 4), (16, 1, 0)])
def test_pack_keeps_every_id(docs, length, windows, slack):
    rows = packing.pack(docs, PATH, length, windows, slack).collect()
    padded, sequences = checked(rows, docs.collect(), length, slack)
    assert padded <= slack * len(sequences)
    assert sum(r.length for r in rows) <= length * len(sequences)


def test_odd_tables(spark, docs, no_docs, clashing):
    assert packing.pack(no_docs, PATH).collect() == []
    one = spark.createDataFrame([(1, None)], docs.select("doc_id", "text").schema)
    assert [tuple(r)[:3] + tuple(r)[4:5] for r in packing.pack(one, PATH).collect()] == [(1, 0, 1, 1)]
    some = clashing.where("doc_id < 20")
    checked(packing.pack(some, PATH, 64, 2, 4).collect(), some.collect(), 64, 4)


def test_ids_by_words_are_those_of_the_whole_text():
    rng = random.Random(5)
    letters = " \t\n\x0b\x1c\x85   aAbZéÉ́ͅßΣσςİı1٢2's't‍\U0001f600한가ﬁ。,.-Ÿŉ½"
    words = ["<|endoftext|>", "<|startoftext|>x", " 's", "I'LL", " ́e", "don't", "3,000", "ÀÑO"]
    ids = packing.Ids(PATH, most=50)
    for _ in range(2000):
        text = "".join(rng.choice(letters) if rng.random() < .8 else rng.choice(words) for _ in range(rng.randrange(40)))
        assert np.frombuffer(ids.of(text), "<u4").tolist() == whole_ids(text), repr(text)
    long = " ".join(rng.choice(words) + str(rng.randrange(999)) for _ in range(60_000))
    assert np.frombuffer(ids.of(long), "<u4").tolist() == whole_ids(long)


def test_windows_best_fit_and_fullest():
    state = packing.Windows(10, 2, 1)
    for k, n in enumerate((6, 7, 3, 4)):  # 3 goes where 3 are left, which closes it; 4 fills the other
        state.add((k,), 0, n)
    assert [[p[0] for _, _, p in held] for _, held in state.emitted] == [[(1,), (2,)], [(0,), (3,)]]
    state = packing.Windows(10, 2, 1)
    for k, n in enumerate((9, 5, 8)):  # none has room for 8: the window with 9 goes as it is
        state.add((k,), 0, n)
    assert [[p[0] for _, _, p in held] for _, held in state.emitted] == [[(0,)]]
    state = packing.Windows(10, 2, 1)
    for k, n in enumerate((7, 4, 8)):  # the fullest has more room than the slack: it is filled first
        state.add((k,), 0, n)
    assert state.emitted == [(1, [(0, 7, ((0,), 0)), (7, 3, ((2,), 0))])] and state.free == [(1, 2)]


def test_sequences(docs):
    pieces = packing.pack(docs, PATH, 256, 4, 8)
    rows = {r.sequence_id: r for r in packing.sequences(pieces, 256).collect()}
    for r in rows.values():
        assert len(r.ids) == 4 * (r.n_ids if not r.n_ids & (r.n_ids - 1) else 256) and sum(r.lengths) == r.n_ids
    for p in pieces.collect():
        assert rows[p.sequence_id].ids[4 * p.offset:4 * (p.offset + p.length)] == p.ids
        assert zlib.crc32(p.ids) >= 0
