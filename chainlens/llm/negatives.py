"""Hard negatives from Hilbert-ordered blocks of vectors with zone maps.

Vectors are ordered along a Hilbert curve and written as Parquet blocks, each with the least
and largest value of every dimension. Interval arithmetic on these bounds every score a
block can hold, so a window of scores reads only the blocks that can reach it and beat
what it has already found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlens.llm.batches import bounded
from chainlens.session import stored

BLOCK, TILE, ZONES, SALTS, BITS = 256, 64, 128, 8, 2
INF = float("inf")


def quantised(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, vector) of rows (vec_id, label, embedding): components become floor(scale * x), as doubles.

    Rows with a null in vec_id, label or vector, or with a component that is null or not
    finite, are left out.
    """
    y = lambda x: x.cast("double") * float(scale)
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < INF))
    whole = F.transform("embedding", lambda x: F.when(F.abs(y(x)) < 2.0 ** 53, F.floor(y(x)).cast("double")).otherwise(y(x)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        "vec_id", "label", whole.alias("vector"))


# -- order and blocks -------------------------------------------------------------


def hilbert(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Places on the Hilbert curve of cells (n, dimensions) with ``bits`` bits each, as byte strings."""
    x = [c.copy() for c in np.asarray(cells, np.uint32).T]
    n = len(x)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        low = np.uint32(q - 1)
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(on, low, swap).astype(np.uint32)
            x[i] ^= swap if i else np.uint32(0)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(len(cells), np.uint32)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0).astype(np.uint32)
    plane = np.stack([c ^ turn for c in x], 1)
    ones = np.concatenate([(plane >> k) & 1 for k in reversed(range(bits))], 1).astype(np.uint8)
    return [row.tobytes() for row in np.packbits(ones, axis=1)]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as (n, dims) doubles; shorter vectors end in zeros."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < size[:, None]] = flat
    return out


def _put(m: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of three forms."""
    most = np.abs(m).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind.encode() + m.astype(kind).tobytes()


def _get(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, raw[:3].decode(), offset=3).reshape(-1, dims).astype(float)


def along_curve(rows: DataFrame) -> tuple[DataFrame, int]:
    """(rows with ``place``, dimensions): places on the curve, cells about each dimension's mean by its spread."""
    dims = int(rows.agg(F.max(F.size("vector"))).first()[0] or 0)
    at = [F.coalesce(F.get("vector", F.lit(i)), F.lit(0.0)) for i in range(dims)]
    # Two numbers per dimension.
    found = rows.agg(*[f(x) for x in at for f in (F.avg, F.stddev_pop)]).first() if dims else ()
    mean = np.array([x or 0.0 for x in found[0::2]])
    spread = np.array([x if x and np.isfinite(x) else 1.0 for x in found[1::2]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("vector"), dims)
            cells = np.clip(np.floor(((m - mean) / spread / 4 + 0.5) * (1 << BITS)), 0, (1 << BITS) - 1)
            places = hilbert(cells) if dims else [b""] * len(m)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.binary())], names=[*batch.schema.names, "place"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return bounded(rows).mapInArrow(run, f"{kinds}, place binary"), dims


def blocked(placed: DataFrame, dims: int, size: int) -> DataFrame:
    """(block, n, ids, labels, m, low, high, least) of rows (vec_id, label, vector, place), ``size`` rows a block.

    ``m`` holds the vectors, ``low`` and ``high`` the zone map, ``least`` the smallest vec_id.
    Within a place rows ascend by vec_id, so that equal vectors fill blocks in that order.
    """
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = placed.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, have = TaskContext.get().partitionId() << 33, [], 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal first
            rows = rows.combine_chunks()
            column = {c: rows.column(c).combine_chunks() for c in ("vec_id", "label", "vector")}
            column = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in column.items()}
            m, ids = _matrix(column["vector"], dims), column["vec_id"].to_numpy(zero_copy_only=False).astype("<i8")
            first += 1
            return pa.RecordBatch.from_pydict({
                "block": [first], "n": [len(ids)], "ids": [ids.tobytes()],
                "labels": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), column["label"]), "m": [_put(m)],
                "low": [_put(m.min(0, keepdims=True))], "high": [_put(m.max(0, keepdims=True))], "least": [int(ids.min())]})

        for batch in batches:
            held.append(batch)
            have += batch.num_rows
            while have >= size:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, size))
                held = rows.slice(size).to_batches()
                have -= size
        if have:
            yield block(pa.Table.from_batches(held))

    dealt = placed.repartitionByRange(parts, "place", "vec_id").sortWithinPartitions("place", "vec_id")
    return bounded(dealt.select("vec_id", "label", "vector")).mapInArrow(
        run, f"block long, n long, ids binary, labels array<{kind}>, m binary, low binary, high binary, least long")


def zone_maps(blocks: DataFrame, size: int = ZONES) -> DataFrame:
    """(chunk, z): the zone maps of about ``size`` neighbouring blocks as one row."""
    n = blocks.count()
    chunks = max(1, -(-n // size))
    zone = F.struct("block", "low", "high", "least", F.array_distinct("labels").alias("labels"))
    return blocks.groupBy(F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk")).agg(F.sort_array(F.collect_list(zone)).alias("z"))


# -- search -------------------------------------------------------------------------


class _Queries:
    """The windows of one tile: anchor, bounds of the score, and the worst row they hold so far."""

    def __init__(self, batch: pa.RecordBatch, dims: int, same: bool):
        self.m = _get(batch.column("m")[0].as_py(), dims)
        self.ids = np.frombuffer(batch.column("ids")[0].as_py(), "<i8")
        self.labels = np.array(batch.column("labels")[0].as_py(), object)
        q = batch.column("q")[0].values
        self.anchor, self.number = (q.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchor", "query"))
        self.lo, self.hi, self.worst = (q.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lo", "hi", "worst"))
        self.worst_id = q.field("worst_id").to_numpy(zero_copy_only=False).astype(np.int64)
        self.same = same

    def reachable(self, zones: list[dict], dims: int) -> tuple[np.ndarray, np.ndarray]:
        """(largest score within the window, whether to read), both (windows, blocks)."""
        low, high = (np.concatenate([_get(z[c], dims) for z in zones]) for c in ("low", "high"))
        up, down = np.maximum(self.m, 0), np.minimum(self.m, 0)
        most, least = (up @ high.T + down @ low.T)[self.anchor], (up @ low.T + down @ high.T)[self.anchor]
        own = self.labels[self.anchor]
        sets = [set(z["labels"]) for z in zones]
        fits = np.array([[x in s if self.same else s != {x} for s in sets] for x in own], bool).reshape(most.shape)
        within = np.minimum(most, self.hi[:, None])
        ids = np.array([z["least"] for z in zones])
        better = (within > self.worst[:, None]) | ((within == self.worst[:, None]) & (ids < self.worst_id[:, None]))
        return within, fits & (most >= self.lo[:, None]) & (least <= self.hi[:, None]) & better

    def best(self, block: dict, dims: int, k: int) -> Iterator[tuple[int, float, int]]:
        """(window, score, vec_id) of the block's first ``k`` rows of each window that beat the worst held."""
        ids, labels = np.frombuffer(block["ids"], "<i8"), np.array(block["labels"], object)
        score = (self.m @ _get(block["m"], dims).T)[self.anchor]
        same = labels[None, :] == self.labels[self.anchor][:, None]
        fits = (same if self.same else ~same) & (ids != self.ids[self.anchor][:, None])
        fits &= (score >= self.lo[:, None]) & (score <= self.hi[:, None])
        fits &= (score > self.worst[:, None]) | ((score == self.worst[:, None]) & (ids < self.worst_id[:, None]))
        for w in np.flatnonzero(fits.any(1)):
            on = np.flatnonzero(fits[w])
            for j in on[np.lexsort((ids[on], -score[w, on]))[:k]]:
                yield int(self.number[w]), float(score[w, j]), int(ids[j])


def _to_read(tiles: DataFrame, zones: DataFrame, dims: int, same: bool, seeds: bool) -> DataFrame:
    """(tile, block) to read: for each window the most promising block of each chunk, or all others it needs.

    Every tile meets every chunk of zone maps, which are a query set and a summary of all rows.
    """
    n = zones.count()
    salt = F.pmod(F.xxhash64("tile"), F.lit(SALTS))
    spread = tiles.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n - 1, 0)).cast("long")))).withColumn("salt", salt)
    copies = zones.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                zones_ = one.column("z")[0].as_py()
                asked = _Queries(one, dims, same)
                found = []
                if len(asked.number):
                    # The seeds do not depend on what windows hold, so that both calls know them.
                    held = asked.worst, asked.worst_id
                    asked.worst, asked.worst_id = np.full(len(held[0]), -INF), np.full(len(held[0]), 1 << 62)
                    within, fits = asked.reachable(zones_, dims)
                    best = np.where(fits, within, -INF).argmax(1)
                    chosen = np.zeros(len(zones_), bool)
                    chosen[best[fits.any(1)]] = True
                    if not seeds:
                        asked.worst, asked.worst_id = held
                        chosen = asked.reachable(zones_, dims)[1].any(0) & ~chosen
                    found = [zones_[j]["block"] for j in np.flatnonzero(chosen)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(one.column("tile").to_pylist() * len(found), pa.int64()), pa.array(found, pa.int64())],
                    names=["tile", "block"])

    return bounded(spread.join(copies, ["chunk", "salt"]).drop("chunk", "salt")).mapInArrow(run, "tile long, block long")


def _read(pairs: DataFrame, tiles: DataFrame, blocks: DataFrame, dims: int, same: bool, k: int) -> DataFrame:
    """(tile, query, score, vec_id) of the blocks that the tiles read. A block is shuffled once, its tiles come to it."""
    kept = blocks.select("block", F.struct("ids", "labels", "m").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                rows = list(_Queries(one, dims, same).best(one.column("b")[0].as_py(), dims, k))
                if rows:
                    query, score, ids = zip(*rows)
                    yield pa.RecordBatch.from_pydict({"tile": one.column("tile").to_pylist() * len(rows), "query": query,
                                                      "score": score, "vec_id": ids})

    joined = pairs.join(tiles, "tile").join(kept, "block")
    return bounded(joined.drop("block")).mapInArrow(run, "tile long, query long, score double, vec_id long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each window, with their ``rank``."""
    order = Window.partitionBy("tile", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(tiles: DataFrame, queries: DataFrame, blocks: DataFrame, zones: DataFrame, dims: int, same: bool,
           k: int) -> DataFrame:
    """(tile, query, rank, score, vec_id): of each window (tile, query, anchor, lo, hi) the first ``k`` rows.

    Rows of the anchor's label, or with ``same`` false of others, scores in [lo, hi], higher
    first, ties by smaller vec_id. First the most promising blocks are read; then those
    that can hold a row before the k-th found, which loses none.
    """
    anchors = tiles.select("tile", "ids", "labels", "m")

    def asking(found: DataFrame | None) -> DataFrame:
        held = queries.withColumns({"worst": F.lit(-INF), "worst_id": F.lit(1 << 62)})
        if found is not None:
            last = found.where(F.col("rank") == k).select("tile", "query", F.col("score").alias("_s"), F.col("vec_id").alias("_i"))
            held = queries.join(last, ["tile", "query"], "left").select(
                *queries.columns, F.coalesce("_s", F.lit(-INF)).alias("worst"), F.coalesce("_i", F.lit(1 << 62)).alias("worst_id"))
        # A tile has a bounded number of anchors, and these of windows.
        packed = held.groupBy("tile").agg(F.collect_list(F.struct("query", "anchor", "lo", "hi", "worst", "worst_id")).alias("q"))
        return stored(anchors.join(packed, "tile"), "windows")

    asked = asking(None)
    seen = stored(_first(_read(_to_read(asked, zones, dims, same, True), asked, blocks, dims, same, k), k), "found")
    asked = asking(seen)
    more = _read(_to_read(asked, zones, dims, same, False), asked, blocks, dims, same, k)
    return _first(seen.drop("rank").unionByName(more), k)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, vector).

    A score is the inner product with the anchor. Rows for which ``anchors`` holds have as positives
    the first ``positives`` rows of their label, and for each of these as negatives the first
    ``negatives`` rows of other labels that score between ``low`` and ``high`` per cent of it. A
    positive of negative score has an empty window. Ties go to the smaller vec_id.

    Components are whole numbers in doubles (:func:`quantised`); scores are exact while their
    sums stay below 2^53, rounded beyond, and held to 64 bits. Shorter vectors count as ended by zeros. Rows with the
    anchor's own vec_id are neither positives nor negatives of it; other repeated rows each count,
    as anchors too. Rows must have no nulls. Other columns are not looked at; an empty table, or
    one without anchors, gives an empty result.
    """
    placed, dims = along_curve(rows.select("vec_id", "label", "vector"))
    placed = stored(placed, "places")
    blocks = stored(blocked(placed, dims, block), "blocks")
    zones = stored(zone_maps(blocks), "zones")
    tiles = stored(blocked(placed.where(anchors), dims, tile).withColumnRenamed("block", "tile"), "tiles")
    each = tiles.select("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("anchor"))
    whole = each.select("tile", F.col("anchor").alias("query"), "anchor", F.lit(-INF).alias("lo"), F.lit(INF).alias("hi"))
    pos = stored(search(tiles, whole, blocks, zones, dims, True, positives), "positives").select(
        "tile", F.col("query").alias("anchor"), (F.col("query") * positives + F.col("rank") - 1).alias("query"),
        F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    share = lambda percent: F.col("positive_score") * percent / 100
    lo, hi = F.ceil(share(low)).cast("double"), F.floor(share(high)).cast("double")
    windows = pos.where("positive_score >= 0").select("tile", "query", "anchor", lo.alias("lo"), hi.alias("hi"))
    neg = search(tiles, windows, blocks, zones, dims, False, negatives)
    names = tiles.select("tile", F.posexplode(_ids("ids", "n")).alias("anchor", "anchor_id"))
    out = neg.join(pos, ["tile", "query"]).join(names, ["tile", "anchor"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                      _long("positive_score"), _long("score").alias("negative_score"))


def _long(score: str) -> Column:
    inside = F.greatest(F.least(F.col(score), F.lit(9.2e18)), F.lit(-9.2e18))
    return inside.cast("long").alias(score)


def _ids(raw: str, n: str) -> Column:
    """The 64-bit numbers of a binary column."""
    each = F.sequence(F.lit(1), F.col(n).cast("int"))
    text = F.hex(raw)
    byte = lambda i, b: F.substring(text, (i - 1) * 16 + 2 * b + 1, F.lit(2))
    return F.transform(each, lambda i: F.conv(F.concat(*[byte(i, b) for b in reversed(range(8))]), 16, -10).cast("long"))
