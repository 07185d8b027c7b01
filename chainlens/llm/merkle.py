"""Merkle manifest of a table whose parents keep SHA-256 midstates.

Digests are hashed as hexadecimal text, 64 bytes each, which is one SHA-256 block. So a
parent's hash state before each child slot is a number of eight words that can be kept in a
column: folding a changed leaf resumes that state with the replacement and the siblings
right of it, and never reads those on the left.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlens.llm.batches import bounded
from chainlens.session import stored

FANOUT, HEIGHT = 2, 12  # a subtree of FANOUT ** HEIGHT nodes is worked on as one row
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


# -- SHA-256 by blocks, many messages at a time ---------------------------------


def _roots(n: int, power: int) -> list[int]:
    """First 32 bits behind the point of the square (2) or cube (3) roots of the first n primes."""
    primes, k = [], 2
    while len(primes) < n:
        if all(k % p for p in primes):
            primes.append(k)
        k += 1
    out = []
    for p in primes:
        big, lo, hi = p << (32 * power), 0, 1 << 40
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if mid ** power <= big else (lo, mid)
        out.append(lo & 0xFFFFFFFF)
    return out


START = np.array(_roots(8, 2), np.uint32)
_ROUND = np.array(_roots(64, 3), np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def resumed(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8, n) after one more block (16, n) each, all as 32-bit words."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7]
                     + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
            w[t - 16] = None
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + _ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def as_block(digest: np.ndarray) -> np.ndarray:
    """Digests (8, n) as the blocks (16, n) of their hexadecimal text."""
    raw = np.ascontiguousarray(digest.T).astype(">u4").view(np.uint8)
    text = np.empty((len(raw), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = _HEX[raw >> 4], _HEX[raw & 15]
    return np.ascontiguousarray(text.view(">u4").astype(np.uint32).T)


def finished(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of whole blocks: the state after the block of padding."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0] = 0x80000000
    bits = np.asarray(blocks, np.uint64) * np.uint64(512)
    last[14], last[15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return resumed(state, last)


def started(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


# -- subtrees -------------------------------------------------------------------


def climb(nodes: np.ndarray, height: int, fanout: int) -> tuple[np.ndarray, list[tuple]]:
    """(root, levels) of the subtree over ``nodes`` (8, n), ``height`` levels high.

    A level has for each of its nodes the parent's state before the node's slot, the digests right
    and left of it (fanout - 1, 8, n) and how many of them there are. The node above leaf i at
    level k is i // fanout ** k.
    """
    levels = []
    for _ in range(height):
        n = nodes.shape[1]
        mine = np.arange(n)
        slot, parent = mine % fanout, mine // fanout
        count = np.bincount(parent)
        blocks, state, states = as_block(nodes), started(len(count)), np.empty_like(nodes)
        for k in range(fanout):
            child = np.flatnonzero(slot == k)
            on = parent[child]
            states[:, child] = state[:, on]  # the copy before this slot
            state[:, on] = resumed(state[:, on], blocks[:, child])
        rights = np.stack([nodes[:, np.minimum(mine + k, n - 1)] for k in range(1, fanout)])
        lefts = np.stack([nodes[:, np.minimum(mine - slot + k, n - 1)] for k in range(fanout - 1)])
        levels.append((states, rights, count[parent] - slot - 1, lefts, slot))
        nodes = finished(state, count)
    return nodes[:, 0], levels


def fold(leaf: np.ndarray, states: np.ndarray, rights: np.ndarray, n_right: np.ndarray, n_left: np.ndarray) -> np.ndarray:
    """Digests of the parents of ``leaf`` (8, n): the state before its slot, the leaf, what stands right of it."""
    return finished(appended(resumed(states, as_block(leaf)), rights, n_right), n_left + 1 + n_right)


def appended(state: np.ndarray, digests: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The states (8, n) after the first ``count`` of the digests (k, 8, n)."""
    for k in range(len(digests)):
        on = np.flatnonzero(count > k)
        if len(on):
            state = state.copy()
            state[:, on] = resumed(state[:, on], as_block(digests[k][:, on]))
    return state


def _words(raw: Sequence[bytes]) -> np.ndarray:
    joined = b"".join(raw)
    return np.ascontiguousarray(np.frombuffer(joined, ">u4").reshape(-1, 8).T.astype(np.uint32))


def _raw(digest: np.ndarray) -> list[bytes]:
    joined = np.ascontiguousarray(digest.T).astype(">u4").tobytes()
    return [joined[i:i + 32] for i in range(0, len(joined), 32)]


def _hex(digest: np.ndarray) -> list[str]:
    return [x.hex() for x in _raw(digest)]


def _steps(levels: list[tuple], n: int, fanout: int) -> list[list[dict]]:
    """What folding needs, from each of n nodes up, as records."""
    out = [[] for _ in range(n)]
    for k, (states, rights, n_right, lefts, n_left) in enumerate(levels):
        state, right, left = _raw(states), [_raw(x) for x in rights], [_raw(x) for x in lefts]
        for i in range(n):
            at = i // fanout ** k
            out[i].append({"state": state[at], "rights": [x[at] for x in right[:n_right[at]]],
                           "lefts": [x[at] for x in left[:n_left[at]]]})
    return out


def _level(step: dict, n: int, fanout: int) -> tuple:
    """One record of a path as a level that n nodes share."""

    def wide(raw: list[bytes]) -> np.ndarray:
        padded = _words([*raw, *[bytes(32)] * (fanout - 1 - len(raw))])
        return np.repeat(padded.T[:, :, None], n, axis=2)

    return (np.repeat(_words([step["state"]]), n, axis=1), wide(step["rights"]), np.full(n, len(step["rights"])),
            wide(step["lefts"]), np.full(n, len(step["lefts"])))


STEP = pa.struct([("state", pa.binary()), ("rights", pa.list_(pa.binary())), ("lefts", pa.list_(pa.binary()))])
STEPS = "array<struct<state: binary, rights: array<binary>, lefts: array<binary>>>"


# -- trees as tables --------------------------------------------------------------


def ranked(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Add ``at``, a row's place among those of its ``tree``, ascending by ``order`` (null first).

    Rows are dealt by ranges, so a tree may spread over many tasks; rows that are equal are told
    apart by a number from the scan. Only one row per task and tree is summed afterwards.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [tree, *order, "_row"]
    told = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = stored(told.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_row").withColumn(
        "_at", F.monotonically_increasing_id()), "nodes")
    part = F.shiftright("_at", 33)
    runs = placed.groupBy(tree, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(tree).orderBy("_part")) - F.col("_n")
    runs = runs.select(F.col(tree).alias("_tree"), "_part", (before - F.col("_first")).alias("_shift"))
    here = placed.withColumn("_p", part)
    return here.join(runs, (F.col("_p") == F.col("_part")) & F.col(tree).eqNullSafe(F.col("_tree"))).withColumn(
        "at", F.col("_at") + F.col("_shift")).drop("_at", "_p", "_part", "_tree", "_shift")


def subtrees(nodes: DataFrame, sizes: DataFrame, fanout: int, height: int, extra: Sequence[str] = ()) -> DataFrame:
    """(tree, block, height, m) of nodes (tree, at, digest, <extra>): runs of ``fanout ** height``, in order.

    ``sizes`` has the number of nodes of each tree (tree, n). A tree of one run is as high as
    its nodes need; all runs of a larger one have the same height.
    """
    run = F.floor(F.col("at") / fanout ** height)
    rows = nodes.groupBy("tree", run.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("at", "digest", *extra))).alias("m"))
    levels = F.lit(0)
    for k in range(height):
        levels = levels + F.when(F.col("n") > fanout ** k, 1).otherwise(0)
    high = sizes.select(F.col("tree").alias("_tree"), levels.alias("height"))
    return rows.join(high, F.col("tree").eqNullSafe(F.col("_tree"))).select("tree", "block", "height", "m")


def _each(batches: Iterator[pa.RecordBatch], fanout: int):
    """Subtrees one at a time: (batch of one row, members, nodes, root, levels)."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            members = one.column("m")[0].values
            nodes = _words(members.field("digest").to_pylist())
            yield one, members, nodes, *climb(nodes, one.column("height")[0].as_py(), fanout)


def roots_of(blocks: DataFrame, fanout: int) -> DataFrame:
    """(tree, at, digest): the root of each subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, _, _, root, _ in _each(batches, fanout):
            yield pa.RecordBatch.from_arrays([one.column("tree"), one.column("block"), pa.array(_raw(root[:, None]), pa.binary())],
                                             names=["tree", "at", "digest"])

    kind = blocks.schema["tree"].dataType.simpleString()
    return bounded(blocks).mapInArrow(run, f"tree {kind}, at long, digest binary")


def paths_of(blocks: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """(tree, at, path): for each node the states and siblings on its way up, those ``above`` its subtree included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, members, nodes, _, levels in _each(batches, fanout):
            n, rest = nodes.shape[1], one.column("path")[0].as_py()
            yield pa.RecordBatch.from_arrays([
                pa.array(one.column("tree").to_pylist() * n, one.column("tree").type), members.field("at"),
                pa.array([p + rest for p in _steps(levels, n, fanout)], pa.list_(STEP))], names=["tree", "at", "path"])

    kind = blocks.schema["tree"].dataType.simpleString()
    return bounded(with_path(blocks, above)).mapInArrow(run, f"tree {kind}, at long, path {STEPS}")


def with_path(blocks: DataFrame, above: DataFrame) -> DataFrame:
    other = above.withColumnsRenamed({"tree": "_tree", "at": "_at"})
    return blocks.join(other, blocks["tree"].eqNullSafe(other["_tree"]) & (blocks["block"] == other["_at"])).drop("_tree", "_at")


def grown(nodes: DataFrame, sizes: DataFrame, fanout: int, height: int,
          extra: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, above, roots) of trees: their subtrees, each subtree's path (tree, at, path), and (tree, root).

    Subtrees' roots are the nodes of the next round; there are as many rounds as the logarithm
    of the largest tree to the base ``fanout ** height``.
    """
    blocks = stored(subtrees(nodes, sizes, fanout, height, extra), "subtrees")
    tops = stored(roots_of(blocks, fanout), "roots")
    counts = sizes.select("tree", F.ceil(F.col("n") / fanout ** height).alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) <= 1:
        return (blocks, tops.select("tree", "at", F.array().cast(STEPS).alias("path")),
                tops.select("tree", F.col("digest").alias("root")))
    higher, above, roots = grown(tops, counts, fanout, height)
    return blocks, stored(paths_of(higher, above, fanout), "paths"), roots


# -- manifest -----------------------------------------------------------------------


def entry(column: str | Column) -> Column:
    """A value as the manifest hashes it: "-" for null, else bytes, ":" and the value."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tampered(doc_id: str = "doc_id") -> Column:
    """Whether the check changes a document: 7 divides the checksum of its number."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 0, F.lit(False))


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, columns: Sequence[str] = COLUMNS,
             group: str = "lang", key: str = "doc_id", fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents.

    A leaf hashes a document's ``columns``. Per ``group`` leaves ascend by ``key``, and every ``fanout``
    consecutive nodes, fewer at the end, become their digest until one is left; the groups' roots,
    ascending by group, do likewise. ``folded_root`` comes from the leaf with the columns ``changed``, by the
    states kept before its slot and its right siblings, up to the root, and ``verified`` says
    whether it is the root. ``proof_sha256`` hashes all siblings on the way, from the leaf up and left to right.

    Nulls have their own form in a leaf, come first in the order, and are a group of their own. Rows of
    the same key are leaves of their own in the order of their digests; equal rows may change places,
    which changes no digest. Empty and very long texts are hashed as they are, in the JVM. Other
    columns are not looked at. An empty table gives an empty result.
    """
    now = {c: F.col(c) for c in columns}
    digest = lambda values: F.unhex(F.sha2(F.concat(*[entry(values[c]) for c in columns]), 256))
    leaves = docs.select(F.col(group).alias("tree"), F.col(key).alias("key"), digest(now).alias("digest"),
                         digest(now | (changed or {})).alias("changed"))
    nodes = ranked(leaves, "tree", ["key", "digest"])
    sizes = stored(nodes.groupBy("tree").agg(F.count("*").alias("n")), "sizes")
    blocks, above, subroots = grown(nodes, sizes, fanout, height, ("key", "changed"))

    groups = ranked(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("group"), F.col("root").alias("digest")),
                    "tree", ["group"])
    groups = stored(groups, "groups")
    top_blocks, top_above, root = grown(groups.select("tree", "at", "digest"),
                                        groups.groupBy("tree").agg(F.count("*").alias("n")), fanout, height)
    top = paths_of(top_blocks, top_above, fanout).select("at", F.col("path").alias("_top"))
    # One row: the root. The others have one row per group or per subtree.
    top = top.join(groups, "at").join(F.broadcast(root.select("root")), F.lit(True)).select(
        F.col("group").alias("_group"), F.hex("digest").alias("_subroot"), F.hex("root").alias("_root"), "_top")
    above = above.join(top, F.col("tree").eqNullSafe(F.col("_group"))).select(
        "tree", "at", F.concat("path", "_top").alias("path"), F.lower("_subroot").alias("subroot"),
        F.lower("_root").alias("root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, members, nodes_, _, levels in _each(batches, fanout):
            n = nodes_.shape[1]
            folded, proof, count = _words(members.field("changed").to_pylist()), started(n), np.zeros(n, np.int64)
            path = one.column("path")[0].as_py()
            for k in range(len(levels) + len(path)):
                if k < len(levels):
                    at = np.arange(n) // fanout ** k
                    states, rights, n_right, lefts, n_left = [x[..., at] for x in levels[k]]
                else:
                    states, rights, n_right, lefts, n_left = _level(path[k - len(levels)], n, fanout)
                folded = fold(folded, states, rights, n_right, n_left)
                proof = appended(appended(proof, lefts, n_left), rights, n_right)
                count += n_left + n_right
            root_ = one.column("root")[0].as_py()
            found = _hex(folded)
            yield pa.RecordBatch.from_arrays([
                members.field("key"), pa.array(_hex(nodes_)), pa.array([one.column("subroot")[0].as_py()] * n),
                pa.array([root_] * n), pa.array(_hex(finished(proof, count))), pa.array(found),
                pa.array([x == root_ for x in found])],
                names=[key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = docs.schema[key].dataType.simpleString()
    return bounded(with_path(blocks, above)).mapInArrow(
        run, f"{key} {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
