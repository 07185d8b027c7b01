import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlens.llm import merkle


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def entry(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def by_hand(rows, fanout):
    """The contract's rows, one document after the other."""

    def grow(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([digest(out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
        return out

    def leaf(r, n):
        return digest(map(entry, (r.doc_id, r.source, r.lang, n, r.text)))

    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    trees = {}
    for lang, members in groups.items():
        members.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.n_chars)))
        trees[lang] = grow([leaf(r, r.n_chars) for r in members])
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    top = grow([trees[x][-1][0] for x in order])
    out = []
    for place, lang in enumerate(order):
        for i, r in enumerate(groups[lang]):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            now = leaf(r, r.n_chars + 1 if hit and r.n_chars is not None else r.n_chars)
            siblings = []
            for levels, at in ((trees[lang], i), (top, place)):
                for level in levels[:-1]:
                    first, slot = at - at % fanout, at % fanout
                    run = level[first:first + fanout]
                    siblings += run[:slot] + run[slot + 1:]
                    now = digest(run[:slot] + [now] + run[slot + 1:])
                    at //= fanout
            out.append((r.doc_id, trees[lang][0][i], trees[lang][-1][0], top[-1][0], digest(siblings), now, now == top[-1][0]))
    return sorted(map(repr, out))


def made(docs, **options):
    more = F.when(merkle.tampered(), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return sorted(repr(tuple(r)) for r in merkle.manifest(docs, {"n_chars": more}, **options).collect())


@pytest.mark.parametrize("fanout, height", [(2, 12), (2, 2), (3, 1), (5, 2)])
def test_manifest_matches_hand_made_trees(docs, fanout, height):
    assert made(docs, fanout=fanout, height=height) == by_hand(docs.collect(), fanout)


def test_states_go_on_as_the_library_does():
    raw = [hashlib.sha256(bytes([i])).digest() for i in range(5)]
    block = merkle.as_block(merkle._words(raw))
    state = merkle.started(5)
    for n in range(1, 5):
        state = merkle.resumed(state, block)
        want = [hashlib.sha256((x.hex() * n).encode()).hexdigest() for x in raw]
        assert merkle._hex(merkle.finished(state, np.full(5, n))) == want


def test_folding_needs_no_left_sibling():
    nodes = merkle._words([hashlib.sha256(bytes([i])).digest() for i in range(7)])
    root, levels = merkle.climb(nodes, 2, 4)
    for states, rights, n_right, lefts, n_left in levels:
        lefts[:] = 0
    now = nodes
    for k, (states, rights, n_right, _, n_left) in enumerate(levels):
        at = np.arange(7) // 4 ** k
        now = merkle.fold(now, states[:, at], rights[..., at], n_right[at], n_left[at])
    assert (now == root[:, None]).all()


def test_no_rows_one_row_and_clashing_columns(docs, no_docs, clashing):
    assert made(no_docs) == []
    one = docs.where("doc_id = 903")
    assert made(one) == by_hand(one.collect(), 2)
    assert made(clashing.where("doc_id < 40")) == made(docs.where("doc_id < 40"))


def test_changed_leaves_are_found(docs):
    rows = merkle.manifest(docs, {"text": F.when(F.col("doc_id") == 7, F.lit("other")).otherwise(F.col("text"))}).collect()
    assert [r.doc_id for r in rows if not r.verified] == [7]
