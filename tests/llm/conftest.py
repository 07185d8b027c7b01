import random

import pytest

WORDS = [a + b for a in "ba de fi go ku la me ni po ru sa ti".split() for b in ("", "n", "ra", "sto", "li")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < .1 else "") for _ in range(n))


def changed(text: str, seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in each column, empty and long texts, repeated rows."""
    return [(900, None, "en", "a", None), (901, "", "en", "a", 0), (None, prose(70_001, 60), "en", "a", 0),
            (902, prose(70_002, 30), None, None, 0), (902, prose(70_002, 30), None, None, 0), (903, " \t\n ", "de", "b", 4),
            (904, prose(70_003, 40_000), "de", "b", 0), (905, "ba", "de", "b", 2), (906, "x" * 300_000, "de", "b", 0)]


@pytest.fixture(scope="session")
def docs(spark, odd_rows):
    """Prose with groups of exact and near copies, and the odd rows."""
    rows = [(i, prose(1000 + i, 20 + 7 * (i % 30)), "en" if i % 3 else "de", f"s{i % 4}", 0) for i in range(120)]
    rows += [(200 + i, rows[5][1], "en", "s0", 0) for i in range(25)]
    base = prose(77, 200)
    rows += [(300 + i, changed(base, i, i % 9), "en", "s1", 0) for i in range(40)]
    rows += [(400 + i, changed(prose(50 + i // 4, 120), i, 2 * (i % 4)), "en", "s2", 0) for i in range(40)]
    return spark.createDataFrame(rows + odd_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with more columns, named as things inside operators are."""
    from pyspark.sql import functions as F
    names = ["key", "id", "bands", "bucket", "n", "root", "size", "words", "block", "shard", "copies", "score", "kept",
             "log_weight", "spans", "media", "record", "page", "t", "item", "_id", "_hash", "_row", "_size", "doc", "c"]
    return docs.select("*", *[F.lit(f"own {x}").alias(x) for x in names])
