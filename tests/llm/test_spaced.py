import random
import re
from itertools import combinations

from chainlens.llm import spaced

from tests.llm.conftest import SCHEMA, prose


def table(spark):
    items = [(i, prose(80_500 + i, 12 + 5 * i)) for i in range(8)] + [(20, "Seven words that are here, and rare"),
                                                                  (21, "too short"), (22, None), (23, ""), (None, prose(80_600, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], set()
    for i, text in items[:8] + items[8:9] + items[-1:]:
        words = re.sub(r"\.", "", text).split()
        for k, cut in enumerate((0, 1, len(words) // 5, len(words) // 2)):
            new = [w if j % max(1, len(words) // max(cut, 1)) or not cut else f"other{j}" for j, w in enumerate(words)]
            same = sum(a == b for a, b in zip(words, new))
            doc = 100 * (99 if i is None else i) + k
            rows.append((doc, f"{prose(doc, 40)} {' '.join(new).upper()} {prose(doc + 1, 40)}", "en", "a", 0))
            if same >= .8 * len(words) and (len(words) > 9 or same == len(words)):  # shorter ones are sought as they are
                want.add((doc, i))
    rows.append((50_000, items[5][1] * 1, "en", "a", 0))
    want.add((50_000, 5))
    words = items[6][1].split()  # a word comes between: two runs add up
    rows.append((50_001, " ".join([*words[:20], "between", *words[20:]]), "en", "a", 0))
    want.add((50_001, 6))
    return bench, rows, want


def test_overlaps(spark, odd_rows):
    bench, rows, want = table(spark)
    docs = spark.createDataFrame(rows + odd_rows, SCHEMA)
    got = {(r.doc_id, r.item_id) for r in spaced.overlaps(docs, bench).collect()}
    assert got == want
    left = spaced.clean(docs, bench)
    assert left.columns == docs.columns
    kept = [r.doc_id for r in left.collect()]
    assert sorted(map(str, kept)) == sorted(str(r[0]) for r in rows + odd_rows if r[0] not in {d for d, _ in want})


def test_broadcast_and_shuffle_agree(spark, monkeypatch):
    bench, rows, want = table(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(spaced, "SMALL_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {(r.doc_id, r.item_id) for r in spaced.overlaps(docs, bench).collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_without_id_are_told_apart(spark):
    bench = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    docs = spark.createDataFrame([(None, prose(1, 20)), (None, prose(2, 20)), (7, prose(1, 20)), (7, prose(3, 9))],
                                 "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in spaced.clean(docs, bench).collect()) == [(0, prose(2, 20)), (7, prose(3, 9))]


def test_odd_tables(spark, docs, no_docs, clashing):
    bench = spark.createDataFrame([(1, prose(1000, 20))], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert spaced.overlaps(no_docs, bench).count() == 0
    assert spaced.overlaps(docs, none).count() == 0 and spaced.clean(docs, none).count() == docs.count()
    out = spaced.clean(clashing, bench)
    assert out.columns == clashing.columns and out.count() == clashing.count() - 1


def test_substitutions_anywhere_are_found(spark):
    """Every pattern of a fifth of the tokens for items of 5 to 14 tokens; beyond, as many drawn patterns."""
    rng, bench, rows, k = random.Random(5), [], [], 0
    for n in range(5, 32):
        words = [f"i{n}w{j}" for j in range(n)]
        bench.append((n, " ".join(words)))
        every = list(combinations(range(n), n // 5))
        for gone in every if n < 15 else [rng.sample(range(n), n // 5) for _ in range(150)]:
            new = [f"x{k}y{j}" if j in gone else w for j, w in enumerate(words)]
            rows.append((100 * k + n, f"before {k} {' '.join(new)} behind {k}"))
            k += 1
        new = [f"x{n}y{j}" if j <= n // 5 else w for j, w in enumerate(words)]
        rows.append((100 * k + 99, " ".join(new)))  # one more than a fifth
        k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    found = spaced.overlaps(docs, items, tolerant_from=spaced.LEAST_TOKENS).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == sorted((d, d % 100) for d, _ in rows if d % 100 != 99)


def test_no_pattern_of_substitutions_hits_every_seed():
    """For each length, the least number of substitutions after which no mask fits, over all patterns."""
    for n in range(spaced.LEAST_TOKENS, 61):
        masks = [m for m in spaced.MASKS if len(m) <= n] + [m for m, a, b in spaced.LIGHT_MASKS if a <= n < b]
        states = {0: 0}  # last nine tokens, substituted ones as 1, and the fewest substitutions so far
        for end in range(1, n + 1):
            after = {}
            for state, count in states.items():
                for new in (0, 1):
                    window = state << 1 | new
                    if all(len(m) > end or window & int(m, 2) for m in masks):
                        after[window & 511] = min(after.get(window & 511, n), count + new)
            states = after
        assert min(states.values()) > n // 5


def test_scripts_without_spaces(spark):
    item = "\u6625\u7720\u4e0d\u89ba\u6653\u8655\u8655\u805e\u557c\u9ce5"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"abc{item}def"), (2, item[:4] + "\u4e00" + item[5:]), (3, item[:7])], "doc_id long, text string")
    got = spaced.overlaps(docs, bench, tolerant_from=spaced.LEAST_TOKENS).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_matched) for r in got) == [(1, 10, 10), (2, 10, 9)]
