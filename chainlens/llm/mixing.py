"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is dealt by a hash into blocks. A source's quota is the number of its
blocks (whole copies first, then a part of one more) that reach its target. The tree
halves the list of output shards again and again: of the quota blocks at a node, a
uniformly drawn half goes left, so that each source's left quota is hypergeometric and
all sums are exact. The leaves' quotas are then filled with disjoint runs of each
source's permuted blocks, and rows are shuffled inside their shard.

Everything but the documents is counted in blocks: at most sources x blocks x 4 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlens.session import stored

BLOCKS, SHARDS, LIMIT, SEED = 512, 64, 3, 7
PART_WORDS = 16_000_000  # of a shard that one task shuffles: about 100 MB
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(source, source_size) with weight and target: shares by weight, stopped at ``limit`` sizes.

    Sources by code point, null last, weigh 1, 2, 3, 1, 2, ... The excess over a stop is
    shared out again by weight until none is above, which is one water level for all
    that are not stopped. One row a source.
    """
    every = Window.partitionBy(F.lit(1))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    rows = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    rows = rows.withColumn("stop", F.lit(float(limit)) * F.col("source_size")).withColumn(
        "ratio", F.col("stop") / F.col("weight"))
    place = every.orderBy("ratio", F.col("source").asc_nulls_last())
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every).cast("double")
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("ratio"), F.col("level")))).over(every)
    return rows.select("source", "source_size", "weight", F.least(
        F.col("stop"), level["level"] * F.col("weight")).alias("target"))


def _sized(docs: DataFrame, blocks: int, seed: int) -> DataFrame:
    row = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    return docs.withColumn("_size", word_count(F.col("text"))).withColumn("_row", row).withColumn(
        "_block", F.pmod("_row", F.lit(blocks)).cast("int"))


def _draw(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def leaf_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, shard, n) of root quotas (source, n): every source's blocks dealt out to even shards."""
    nodes = quotas.select("source", "n", F.lit(0).alias("lo"), F.lit(shards).alias("hi"))
    for level in range((shards - 1).bit_length()):
        unit = nodes.withColumn("unit", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        node = Window.partitionBy("lo", "hi")
        unit = unit.withColumn("rank", F.row_number().over(
            node.orderBy(_draw(seed + 1000 * level, "source", "unit", "lo"), "source", "unit")))
        unit = unit.withColumn("middle", F.ceil((F.col("lo") + F.col("hi")) / 2).cast("int")).withColumn(
            "left", F.col("rank") <= F.ceil(
                F.count("*").over(node) * (F.col("middle") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
        unit = unit.select("source", F.when(F.col("left"), F.col("lo")).otherwise(F.col("middle")).alias("lo"),
                           F.when(F.col("left"), F.col("middle")).otherwise(F.col("hi")).alias("hi"))
        nodes = unit.groupBy("source", "lo", "hi").agg(F.count("*").alias("n"))
    return nodes.select("source", F.col("lo").alias("shard"), "n")


def block_plan(sized: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, limit: int = LIMIT,
               seed: int = SEED) -> DataFrame:
    """(source, block) with source_size, target, the copies to take and where the cut one ends.

    ``sized`` has source, _size, _row, _block. ``copies`` lists (copy, shard, whole); in a
    copy that is not whole, rows below ``cut_row`` are taken whole and the row there gives
    ``cut_words`` words.
    """
    by_block = stored(sized.groupBy("source", F.col("_block").alias("block")).agg(F.sum("_size").alias("words")), "blocks")
    sources = source_targets(by_block.groupBy("source").agg(F.sum("words").alias("source_size")), limit)
    goal = F.round("target").cast("long")
    sources = stored(sources.withColumn("times", F.when(
        F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("int")).withColumn(
        "rest", goal - F.col("times") * F.col("source_size")), "sources")
    order = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = by_block.withColumn("ahead", F.coalesce(F.sum("words").over(order), F.lit(0)))
    rows = rows.withColumnRenamed("source", "s").join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("ahead"))))
    rows = rows.withColumn("n", F.col("times") + (F.col("part") > 0).cast("int"))

    # The one block a source that is taken in part: the row where the taken words end.
    cut = rows.where("part > 0 and part < words").select(F.col("source").alias("s"), F.col("block").alias("b"), "part")
    at = sized.join(cut, F.col("s").eqNullSafe(F.col("source")) & (F.col("b") == F.col("_block"))).groupBy(
        "s", "b", "part", "_row").agg(F.sum("_size").alias("words"), F.count("*").alias("same"))
    inside = Window.partitionBy("s", "b").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("sum", F.sum("words").over(inside)).where("sum >= part").groupBy("s", "b").agg(
        F.min(F.struct("_row", ((F.col("part") - F.col("sum") + F.col("words")) / F.col("same")).cast("long"))).alias("at"))

    units = rows.where("words > 0 and n > 0").select(
        "source", "block", "times", (F.col("part") < F.col("words")).alias("short"),
        F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    units = stored(units.withColumn("place", F.row_number().over(
        Window.partitionBy("source").orderBy(_draw(seed, "source", "copy", "block"), "copy", "block"))), "units")
    leaves = leaf_quotas(units.groupBy("source").agg(F.count("*").alias("n")), shards, seed)
    leaves = leaves.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(
        F.col("source").alias("s"), "shard", F.row_number().over(
            Window.partitionBy("source").orderBy("shard")).alias("p"))
    dealt = units.join(leaves, F.col("s").eqNullSafe(F.col("source")) & (F.col("p") == F.col("place")))
    whole = (F.col("copy") < F.col("times")) | ~F.col("short")
    dealt = dealt.groupBy("source", "block").agg(
        F.sort_array(F.collect_list(F.struct("copy", "shard", whole.alias("whole")))).alias("copies")).select(
        F.col("source").alias("s2"), F.col("block").alias("b2"), "copies")
    plan = rows.select("source", "block", "source_size", "target").join(
        dealt, F.col("s2").eqNullSafe(F.col("source")) & (F.col("b2") == F.col("block")), "left")
    plan = plan.join(at, F.col("s").eqNullSafe(F.col("source")) & (F.col("b") == F.col("block")), "left")
    return plan.select("source", "block", "source_size", "target", "copies", F.col("at._row").alias("cut_row"),
                       F.col("at.col2").alias("cut_words"))


def allocate(docs: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, limit: int = LIMIT,
             seed: int = SEED) -> DataFrame:
    """Documents (doc_id, text, source, ...) with size, source_size, target, taken and copies.

    ``copies`` lists (copy, shard, words) of the copies that the mix takes; ``taken`` is
    the sum of their words and never over ``limit`` times the size. A source's taken
    words equal its target to rounding: one document a source is taken in part. Rows
    without words take none; a null source is a source of its own; rows that are
    repeated count each. Result columns replace columns of these names. An empty
    table gives an empty result.
    """
    return _allocated(docs, blocks, shards, limit, seed)[0]


def _allocated(docs: DataFrame, blocks: int, shards: int, limit: int, seed: int) -> tuple[DataFrame, int]:
    """:func:`allocate`, and the number of words of all documents, which is that of the mix."""
    slim = stored(_sized(docs.select("doc_id", "text", "source"), blocks, seed).select(
        "source", "_size", "_row", "_block"), "sizes")
    plan = stored(block_plan(slim, blocks, shards, limit, seed), "plan").withColumnsRenamed(
        {"source": "_source", "block": "_at"})
    # Documents travel as one struct, so that their columns' names clash with nothing here.
    rows = _sized(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("doc")), blocks, seed).join(
        plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_at")))
    words = lambda c: F.when(c["whole"] | (F.col("_row") < F.col("cut_row")), F.col("_size")).when(
        F.col("_row") == F.col("cut_row"), F.col("cut_words")).otherwise(0)
    copies = F.filter(F.transform(F.coalesce("copies", F.array().cast("array<struct<copy:int,shard:int,whole:boolean>>")),
                                  lambda c: F.struct(c["copy"], c["shard"], words(c).alias("words"))),
                      lambda c: c["words"] > 0)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    ours = ("size", "source_size", "target", "taken", "copies")
    rows = rows.withColumn("copies", copies).select(
        "doc", F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"), "copies")
    rows = rows.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in ours], *ours)
    return rows, slim.agg(F.sum("_size")).first()[0] or 0


def mix(docs: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, limit: int = LIMIT,
        seed: int = SEED, part_words: int = PART_WORDS) -> DataFrame:
    """The mixture: one row per copy taken, dealt to ``shard`` and shuffled inside it.

    Adds copy, shard, part and words to the documents' columns; ``text`` of a copy that is
    taken in part ends with its last taken word. A shard of more than ``part_words`` words
    is shuffled in parts, to which its rows are dealt by a hash, so that a task's size does
    not grow with the corpus. Edge cases as in :func:`allocate`.
    """
    ours = ("copy", "shard", "part", "words")
    rows, total = _allocated(
        docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("doc")), blocks, shards, limit, seed)
    parts = max(1, -(-total // (shards * part_words)))
    rows = rows.select("doc_id", "text", "size", "doc", F.explode("copies").alias("c")).select("*", "c.*")
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(
        F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), ""))
    place = _draw(seed + 1, "doc_id", "copy", "text")
    rows = rows.withColumn("part", F.pmod(place, F.lit(parts)).cast("int")).withColumn("text", text)
    rows = rows.repartition(shards * parts, "shard", "part").sortWithinPartitions(
        "shard", "part", _draw(seed, "doc_id", "copy", "text"))
    return rows.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns if c not in ours],
                       *ours)
