"""Groups of near-equal shingle sets: banded candidates, exact check, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.llm.batches import bounded
from chainlens.llm.graph import components
from chainlens.llm.words import digest, raw_text, shingle_sets, slices
from chainlens.session import stored

BITS = 16  # words of 64

Signer = Callable[[list[np.ndarray]], np.ndarray]


def signatures(items: DataFrame, signer: Signer, width: int = 5) -> DataFrame:
    """(id, n_shingles, key, bands) of items (id, text).

    ``key`` is a 128-bit digest of the whole set, null for an empty one; ``bands``
    are the signer's 64-bit band keys. Equal sets have equal keys and bands.
    """
    kind = items.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_text(batch.column("text"))
            for a, b in slices(offsets):
                sets = shingle_sets(data, offsets[a:b + 1], width)
                full = [s for s in sets if len(s)]
                rows = iter(signer(full).view(np.int64).tolist() if full else [])
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id").slice(a, b - a),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "key": pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    "bands": pa.array([next(rows) if len(s) else None for s in sets], pa.list_(pa.int64())),
                })

    return bounded(items.select("id", "text")).mapInArrow(
        run, f"id {kind}, n_shingles long, key binary, bands array<long>")


def full_sets(items: DataFrame, width: int = 5) -> DataFrame:
    """(key, shingles, bits) of items (id, text) that have words.

    ``bits`` has, for each of 1024 classes of shingles, whether the set holds an odd
    number of them: two sets differ in at least as many shingles as bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_text(batch.column("text"))
            for a, b in slices(offsets):
                sets = [s for s in shingle_sets(data, offsets[a:b + 1], width) if len(s)]
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array([digest(s) for s in sets], pa.binary()),
                    "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    "bits": pa.array([_parity(s) for s in sets], pa.struct([(f"w{i}", pa.int64()) for i in range(BITS)])),
                })

    kind = ", ".join(f"w{i}: long" for i in range(BITS))
    return bounded(items.select("text")).mapInArrow(run, f"key binary, shingles array<long>, bits struct<{kind}>")


def _parity(values: np.ndarray) -> dict[str, int]:
    odd = np.bincount((values % np.uint64(64 * BITS)).astype(np.int64), minlength=64 * BITS) & 1
    return {f"w{i}": w for i, w in enumerate(np.packbits(odd.astype(np.uint8)).view(np.int64).tolist())}


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose full sets reach the similarity."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select(
        "a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")


def linked_keys(signed: DataFrame, items: DataFrame, percent: int, width: int = 5) -> DataFrame:
    """(key, root) of set keys that are linked with another key, by exact Jaccard similarity.

    ``signed`` is a written result of :func:`signatures`. Equal sets are one key. In a
    bucket every key is held against two leaders first. Keys outside the bucket's largest
    group are then held against all members of the other groups. Before sets are
    compared, exact bounds of the overlap leave out pairs that can't be similar. So no
    colliding pair is left out, but keys that belong together cost one comparison each.
    """
    full = signed.where("key is not null and id is not null")
    buckets = full.select("key", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    # Buckets of more than one key, by a number of the key so that this is a hash aggregate.
    number = F.xxhash64("key")
    shared = buckets.groupBy("bucket").agg(F.min(number).alias("lo"), F.max(number).alias("hi")).where("lo <> hi")
    cand = stored(buckets.join(shared.select("bucket"), "bucket", "left_semi").distinct(), "buckets")
    wanted = stored(cand.select("key").distinct(), "keys")
    ids = full.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("id").alias("id")).select("id").distinct()
    sets = stored(full_sets(items.join(ids, "id", "left_semi"), width)
                  .join(wanted, "key", "left_semi").dropDuplicates(["key"]), "sets")

    # Shingles that stand in one set only can't be common: what is left bounds every similarity of a key.
    alone = sets.select(number.alias("k"), F.explode("shingles").alias("s")).groupBy("s").agg(
        F.count("*").alias("c"), F.min("k").alias("k")).where("c = 1").groupBy("k").agg(F.count("*").alias("alone"))
    known = sets.select("key", "bits").join(alone, number == F.col("k"), "left")
    cand = cand.join(known, "key").select(
        "bucket", "key", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("m"), "bits")
    cand = stored(cand.where(100 * F.col("m") >= percent * F.col("n")), "buckets")
    leader = F.struct("key", "n", "m", "bits")
    leaders = cand.groupBy("bucket").agg(F.min(leader).alias("lo"), F.max(leader).alias("hi")).where("lo.key <> hi.key")

    def near(a: str, b: str):
        """Whether two keys can be similar: exact bounds by common shingles and by different ones."""
        common, total = F.least(f"{a}m", f"{b}m"), F.col(f"{a}n") + F.col(f"{b}n")
        differ = sum((F.bit_count(F.col(f"{a}bits.w{i}").bitwiseXOR(F.col(f"{b}bits.w{i}"))) for i in range(BITS)), F.lit(0))
        return (100 * common >= percent * (total - common)) & (100 * (total - differ) >= percent * (total + differ))

    first = cand.join(leaders, "bucket").select("key", "n", "m", "bits", F.explode(F.array("lo", "hi")).alias("by"))
    first = first.where((F.col("key") != F.col("by.key")) & near("", "by.")).select(
        F.least("key", "by.key").alias("a"), F.greatest("key", "by.key").alias("b")).distinct()
    links = stored(_checked(first, sets, percent), "links")
    rows = stored(cand.join(_hubs(links), "key", "left").withColumn("hub", F.coalesce("hub", "key")), "buckets")
    # Keys outside the largest hub of their bucket, against all members of other hubs.
    sizes = rows.groupBy("bucket", "hub").agg(F.count("*").alias("size"))
    large = sizes.groupBy("bucket").agg(F.count("*").alias("hubs"), F.max(F.struct("size", "hub")).alias("large")).where(
        "hubs > 1").select("bucket", F.col("large.hub").alias("large"))
    mixed_ = rows.join(large, "bucket")
    member = mixed_.select("bucket", F.struct("key", "n", "m", "bits", "hub").alias("by"))
    last = mixed_.where("hub <> large").join(member, "bucket").where((F.col("hub") != F.col("by.hub")) & near("", "by.")).select(
        F.least("key", "by.key").alias("a"), F.greatest("key", "by.key").alias("b")).distinct()
    found = links.union(_checked(last, sets, percent))
    return components(found).select(F.col("id").alias("key"), "root")


def _hubs(links: DataFrame, steps: int = 4) -> DataFrame:
    """(key, hub) of linked keys: the smallest key within ``steps`` links.

    Keys of one hub are in one component; a component may have several hubs, which costs
    comparisons but loses none.
    """
    ends = links.select(F.explode(F.array(
        F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")),
        F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), F.col("b").alias("b")))).alias("e"))
    near_ = ends.select(F.col("e.a").alias("key"), F.col("e.b").alias("to"))
    hubs = near_.groupBy("key").agg(F.min("to").alias("hub"))
    for _ in range(steps - 1):
        hubs = near_.join(hubs.withColumnRenamed("key", "to"), "to").groupBy("key").agg(F.min("hub").alias("hub"))
    return hubs
