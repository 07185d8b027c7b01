import re

import pytest

from chainlens.llm import mixing


def targets(sizes, limit=3):
    """Shares by weight with stops, reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, out = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in out]
        rest, shared = total - sum(out.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / shared > limit * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / shared for s in open_}
        out |= {s: limit * sizes[s] for s in over}


@pytest.mark.parametrize("blocks, shards", [(512, 64), (5, 3), (1, 1)])
def test_allocation(docs, blocks, shards):
    rows = mixing.allocate(docs, blocks, shards).collect()
    source = {(r.doc_id, r.text): r.source for r in docs.collect()}
    sizes = {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert source[r.doc_id, r.text] == r.source and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(c.words for c in r.copies)
        assert all(0 <= c.shard < shards for c in r.copies)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2  # rounding, and rows that are alike share a cut evenly
    again = mixing.allocate(docs.repartition(2), blocks, shards).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_a_large_source_stops_at_three_sizes(spark):
    rows = [(i, "a " * 10, "big") for i in range(100)] + [(200 + i, "b " * 5, "tiny") for i in range(3)]
    out = mixing.allocate(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r.source: r.target for r in out.collect()} == {"big": 970.0, "tiny": 45.0}
    assert {r.source: r.s for r in out.groupBy("source").agg({"taken": "sum"}).toDF("source", "s").collect()} == {
        "big": 970, "tiny": 45}


def test_tree_keeps_all_sums(spark):
    quotas = spark.createDataFrame([("a", 40), ("b", 13), (None, 27)], "source string, n long")
    leaves = mixing.leaf_quotas(quotas, 8, 1).collect()
    by_source, by_shard = {}, {}
    for r in leaves:
        by_source[r.source] = by_source.get(r.source, 0) + r.n
        by_shard[r.shard] = by_shard.get(r.shard, 0) + r.n
    assert by_source == {"a": 40, "b": 13, None: 27} and by_shard == dict.fromkeys(range(8), 10)


def test_tree_draws_are_hypergeometric(spark):
    """Mean and variance of one source's quota in the left half, over many seeds."""
    quotas = spark.createDataFrame([("a", 12), ("b", 20)], "source string, n long")
    draws = [next((r.n for r in mixing.leaf_quotas(quotas, 2, s).collect() if (r.source, r.shard) == ("a", 0)), 0)
             for s in range(60)]
    mean = sum(draws) / 60
    variance = sum((x - mean) ** 2 for x in draws) / 59
    expected = 16 * (12 / 32) * (20 / 32) * (16 / 31)
    assert abs(mean - 6) < 4 * (expected / 60) ** .5 and .4 * expected < variance < 2 * expected


def test_mixture_rows(docs):
    plan = {(r.doc_id, r.text, c.copy): (c.shard, c.words) for r in mixing.allocate(docs).collect() for c in r.copies}
    rows = mixing.mix(docs).collect()
    for r in rows:
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.words
    whole = {k: v for k, v in plan.items()}
    assert sorted((r.shard, r.words) for r in rows if r.doc_id != 902) == sorted(v for k, v in whole.items() if k[0] != 902)


def test_odd_tables(no_docs, docs, clashing):
    assert mixing.allocate(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    plain, more = mixing.allocate(docs), mixing.allocate(clashing)
    names = ["doc_id", "size", "source_size", "target", "taken"]
    assert more.select(names).exceptAll(plain.select(names)).count() == 0
    assert {r.key for r in mixing.mix(clashing).collect()} == {"own key"}
    empty = docs.where("text is null or doc_id in (901, 903)")
    assert [r.taken for r in mixing.allocate(empty).collect()] == [0] * 3 and mixing.mix(empty).count() == 0
