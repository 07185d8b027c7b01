"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A fixed mask picks some tokens of a window and ignores the others, so that a hash of
the picked tokens survives a substitution at an ignored place. Hashes of documents and
benchmark items are joined; around each hit the item is laid over the document and
compared token by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.session import stored

MASKS = ("110110011", "1010011011", "1100101011", "1001110101")
# Beside MASKS, for items of so many tokens (from, below): with these, no floor(n / 5) substitutions hit every seed.
LIGHT_MASKS = (("1101", 5, 10), ("1011", 5, 10), ("1100011", 10, 31))
LEAST_TOKENS = 5
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}&&\p{L}]"
SMALL_ROWS = 1_000_000  # of 40 bytes: seeds that may be broadcast


def tokens(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits; null text has none.

    In scripts that put no spaces between words, each letter is a token.
    """
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), UNSPACED, " $0 ")
    words = F.split(spaced, r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(array: str, at: Column, masks: tuple[str, ...], only: dict[str, Column] | None = None) -> Column:
    """The masks' hashes of the windows of ``array`` that begin at ``at``, with the mask's number.

    A mask in ``only`` is laid where its condition holds.
    """
    return F.array(*[
        F.when((at + len(m) <= F.size(array)) & (only or {}).get(m, F.lit(True)), F.xxhash64(
            F.lit(k), *[F.get(array, at + i) for i, c in enumerate(m) if c == "1"]))
        for k, m in enumerate(masks)])


def overlaps(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8,
             masks: tuple[str, ...] = MASKS, least: int = LEAST_TOKENS, tolerant_from: int = 10) -> DataFrame:
    """(doc_id, text_hash, item_id, n_tokens, n_matched) of benchmark items that a document holds.

    An item is held when at least ``similarity`` of its tokens stand in the document at
    their places around hits (substituted tokens count against it; after an inserted or
    lost token, the parts' matches add up). Items of ``tolerant_from`` tokens or more are
    found at the default masks and similarity wherever the substitutions stand; shorter
    items without a mask that fits are sought as they are. Items of fewer than ``least``
    tokens say too little and are left out, as are null texts. ``text_hash`` tells apart rows that repeat a doc_id or have
    none. Seeds of the items are broadcast only up to a counted number of rows, and
    joined by a shuffle beyond.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("t")).withColumn(
        "n", F.size("t")).where(F.col("n") >= least)
    items = stored(items.dropDuplicates(["item_id", "t"]), "items")
    longest = max(map(len, masks))
    sizes = [r.n for r in items.where(F.col("n") < max(longest, *[b for _, _, b in LIGHT_MASKS]))
             .select("n").distinct().orderBy("n").collect()]
    light = {m: (F.col("n") >= max(a, tolerant_from)) & (F.col("n") < b) for m, a, b in LIGHT_MASKS
             if any(max(a, tolerant_from) <= n < b for n in sizes)}
    every = (*masks, *["1" * n for n in sizes if n < longest], *light)
    seeds = items.select(F.xxhash64("item_id", "t").alias("item"), "n", "t",
                         F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    seeds = seeds.select("item", "n", "at", F.explode(_seeds("t", F.col("at"), every, light)).alias("seed")).where(
        "seed is not null").distinct()
    seeds = stored(seeds.withColumnsRenamed({"at": "item_at"}), "seeds")
    if seeds.count() <= SMALL_ROWS:
        seeds = F.broadcast(seeds)

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), tokens(F.col("text")).alias("t"))
    least_span = min([len(m) for m in every])
    windows = rows.where(F.size("t") >= least_span).select(
        "*", F.explode(F.sequence(F.lit(0), F.size("t") - least_span)).alias("at"))
    windows = windows.select("*", F.explode(_seeds("t", F.col("at"), every)).alias("seed"))
    start = F.col("at") - F.col("item_at")  # where the item's first token would stand
    ahead = F.greatest(F.lit(0), -start)
    hits = windows.join(seeds, "seed").select(
        "doc_id", "text_hash", "item", start.alias("start"), ahead.alias("ahead"),
        F.slice("t", F.greatest(F.lit(1), start + 1), F.col("n") - ahead).alias("part")).distinct()

    laid = hits.join(items.select(F.xxhash64("item_id", "t").alias("item"), "item_id", "n", "t"), "item")
    same = F.filter(F.transform("part", lambda w, i: F.when(w == F.get("t", i + F.col("ahead")), i + F.col("ahead"))),
                    lambda i: i.isNotNull())
    found = laid.select("doc_id", "text_hash", "item_id", "n", "item", F.explode(same).alias("i")).distinct()
    found = found.groupBy("doc_id", "text_hash", "item", "item_id", "n").agg(F.count("*").alias("n_matched"))
    return found.where(F.col("n_matched") >= F.lit(similarity) * F.col("n")).select(
        "doc_id", "text_hash", "item_id", F.col("n").alias("n_tokens"), "n_matched")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    found = overlaps(docs, benchmark, **options).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (
        F.xxhash64(docs["text"]) == found["_hash"]), "left_anti")
