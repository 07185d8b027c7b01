"""Spectra at many points in blocks: products of factors, and shifted kinematics.

Factors are a product of a sparse and a dense matrix, block by block.

Rows of the sparse matrix are signatures, its columns the factors that apply; the dense one has the
value of each factor at each point. A block is some thousand signatures against one chunk of
points: it gets the values of the factors that occur in it and leaves as sums per bin, so
neither the weights of signatures nor (signature x factor) rows are ever a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chainlens.operators.binning import sample_offsets

BLOCK, CELLS = 2048, 1 << 20
NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")


def _blocks(summed: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """(group, names, codes, sizes, starts, sw, sw2, <key arrays>): ``size`` signatures as one row, ordered by bin."""

    def pack(batch: pa.RecordBatch, group: int) -> pa.RecordBatch:
        by = pd.DataFrame({k: batch.column(k).to_pylist() for k in keys})
        bins = by.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(bins, kind="stable")
        batch = batch.take(pa.array(order))
        starts = np.flatnonzero(np.diff(bins[order], prepend=-1))
        lists = batch.column("factors")
        named = lists.flatten().dictionary_encode()
        raw = lambda x, kind: [np.asarray(x).astype(kind).tobytes()]
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([
            pa.array([group], pa.int64()), pa.array([named.dictionary.to_pylist()], pa.list_(pa.string())),
            *[pa.array(x, pa.binary()) for x in (
                raw(named.indices.to_numpy(zero_copy_only=False), "<i4"),
                raw(lists.value_lengths().to_numpy(zero_copy_only=False), "<i4"), raw(starts, "<i4"),
                raw(column("sw"), "<f8"), raw(column("sw2"), "<f8"))],
            *[pa.array([batch.column(k).take(pa.array(starts)).to_pylist()], pa.list_(batch.schema.field(k).type)) for k in keys]],
            names=["group", "names", "codes", "sizes", "starts", "sw", "sw2", *[f"k{i}" for i in range(len(keys))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                yield pack(batch.slice(start, size), group)
                group += 1

    kinds = dict(summed.dtypes)
    columns = ", ".join(f"k{i} array<{kinds[k]}>" for i, k in enumerate(keys))
    return summed.select(*keys, "factors", F.col("sw").cast("double"), F.col("sw2").cast("double")).mapInArrow(
        run, f"group long, names array<string>, codes binary, sizes binary, starts binary, sw binary, sw2 binary, {columns}")


def _weights(row: dict, n_points: int, first: int, chunk: int) -> np.ndarray:
    """Weights (signatures, points of the chunk): for each list the product of its factors, 1 for an empty one."""
    width = min(chunk, n_points - first)
    found = {f["factor"]: f["values"] for f in row["f"] or ()}
    for name in row["names"]:
        if name not in found:
            raise ValueError(f"no values for factor {name}")
    dense = np.array([found[n] for n in row["names"]], float).reshape(len(row["names"]), width)
    codes, sizes = np.frombuffer(row["codes"], "<i4"), np.frombuffer(row["sizes"], "<i4")
    begins, out = np.cumsum(sizes) - sizes, np.ones((len(sizes), width))
    for j in range(sizes.max(initial=0)):
        on = np.flatnonzero(sizes > j)
        out[on] *= dense[codes[begins[on] + j]]
    return out


def block_spectra(summed: DataFrame, packed: DataFrame, n_points: int, keys: Sequence[str], chunk: int,
                  size: int = BLOCK) -> DataFrame:
    """(point, keys, mc, w2) of signatures (keys, factors, sw, sw2) and factors (factor, chunk, values).

    Weights of 0 or less do not count, and a bin without any other has no row. A factor
    without values is an error. Rows of ``summed`` must come in the same order whenever they are
    read, as those of a written table do. An empty table gives an empty result.
    """
    keys = list(keys)
    last = (n_points - 1) // chunk
    blocks = _blocks(summed, keys, size)
    held = [c for c in blocks.columns if c != "group"]
    # A block's own row, and one per factor it needs; they meet again per block and chunk.
    rows = blocks.select("group", F.explode(F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("factor"), F.struct(*held).alias("own"))),
        F.transform("names", lambda n: F.struct(n.alias("factor"), F.lit(None).cast(
            blocks.select(F.struct(*held).alias("own")).schema["own"].dataType).alias("own"))))).alias("r"))
    rows = rows.select("group", "r.factor", "r.own").join(packed.select("factor", "chunk", "values"), "factor", "left")
    every = F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))
    chunks = F.when(F.col("own").isNotNull(), every).otherwise(F.array("chunk"))
    rows = rows.withColumn("c", F.explode(chunks)).where("c is not null")
    joined = rows.groupBy("group", "c").agg(
        F.first("own", ignorenulls=True).alias("own"),
        F.collect_list(F.when(F.col("values").isNotNull(), F.struct("factor", "values"))).alias("f")).select("c", "f", "own.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if not c.startswith("k")}
                first = row["c"] * chunk
                weight = _weights(row, n_points, first, chunk)
                counts = ~(weight <= 0)
                weight = np.where(counts, weight, 0.0)
                starts, sw, sw2 = (np.frombuffer(row[c], k) for c, k in (("starts", "<i4"), ("sw", "<f8"), ("sw2", "<f8")))
                mc = np.add.reduceat(sw[:, None] * weight, starts)
                w2 = np.add.reduceat(sw2[:, None] * weight * weight, starts)
                at, point = np.nonzero(np.logical_or.reduceat(counts, starts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(first + point, pa.int64()),
                    *[batch.column(f"k{k}")[i].values.take(pa.array(at)) for k in range(len(keys))],
                    pa.array(mc[at, point]), pa.array(w2[at, point])], names=["point", *keys, "mc", "w2"])

    kinds = dict(summed.dtypes)
    parts = joined.mapInArrow(run, ", ".join(["point long"] + [f"`{k}` {kinds[k]}" for k in keys] + ["mc double", "w2 double"]))
    return parts.groupBy("point", *keys).agg(F.sum("mc").alias("mc"), F.sum("w2").alias("w2"))


def shifted_spectra(events: DataFrame, shifts: dict[str, Callable[[dict], object]], points: DataFrame, axes: Sequence[dict],
                    cuts: Sequence[dict] = (), weight: str = "w0", cells: int = CELLS) -> DataFrame:
    """Spectra (point, sample_id, bin, mc, w2) with kinematic values moved by functional parameters.

    ``points`` is wide (point, <param>...); ``shifts`` maps a variable to a function of the nominal
    kinematics and the parameters of the point (arithmetic on arrays, as on Columns). ``cuts`` (lo <= x < hi, by
    sample if ``sample_id`` is given) and ``axes`` see the moved values. The same as ``shift_events``,
    ``select_events``, ``assign_bin_uniform`` and ``fill_spectra`` one after the other, but a batch of
    events is shifted, cut, binned and added up at once, and only sums per (point, bin) leave a task.

    Points and the sums of a pass are on every executor: a pass over the events takes as many points as have
    ``cells`` bins in all. Null and NaN are in no bin and pass no cut; weights of 0 or less, or null, do not count.
    Empty tables give an empty result. Other columns are not looked at.
    """
    offsets = sample_offsets(axes)
    own = {s: sorted((a for a in axes if a["sample_id"] == s), key=lambda a: a["dim"]) for s in offsets}
    edges = {s: [(a["var"], np.asarray(a["edges"], float)) for a in rows] for s, rows in own.items()}
    sizes = {s: int(np.prod([len(e) - 1 for _, e in edges[s]])) for s in edges}
    n_bins = sum(sizes.values())
    params = [c for c in points.columns if c != "point"]
    read = [c for c in events.columns if c not in ("sample_id", weight) and dict(events.dtypes)[c] in NUMBERS]
    numbers = points.select("point").orderBy("point")
    kinds = dict(events.dtypes)
    per_pass = max(1, cells // max(1, n_bins))
    bounds = [r[0] for r in numbers.select("point", F.row_number().over(Window.orderBy("point")).alias("_r")).where(
        F.col("_r") % per_pass == F.lit(1 % per_pass)).orderBy("point").collect()]

    def one_pass(rows: list[dict]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def moved(columns: dict[str, np.ndarray], row: dict) -> dict[str, np.ndarray]:
            seen = columns | {p: np.float64(np.nan if row[p] is None else row[p]) for p in params}
            n = len(columns["_w"])
            return columns | {v: np.broadcast_to(np.asarray(f(seen), float), n) for v, f in shifts.items()}

        def place(columns: dict[str, np.ndarray], sample: np.ndarray) -> np.ndarray:
            """Global bin, or -1."""
            out = np.full(len(sample), -1)
            passed = columns["_w"] > 0
            for cut in cuts:
                x = columns[cut["var"]]
                inside = (x >= float(cut["lo"])) & (x < float(cut["hi"]))
                passed &= inside if cut.get("sample_id") is None else inside | (sample != cut["sample_id"])
            for s, own_edges in edges.items():
                on = np.flatnonzero(passed & (sample == s))
                index, stride, good = np.zeros(len(on), np.int64), 1, np.ones(len(on), bool)
                for var, e in own_edges:
                    x = columns[var][on]
                    good &= (x >= e[0]) & (x < e[-1])
                    index += (np.searchsorted(e, x, "right") - 1) * stride
                    stride *= len(e) - 1
                out[on[good]] = offsets[s] + index[good]
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((3, len(rows), n_bins))
            for batch in batches:
                columns = {c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in read}
                columns["_w"] = batch.column(weight).cast(pa.float64()).to_numpy(zero_copy_only=False)
                sample = batch.column("sample_id").fill_null(-1).to_numpy(zero_copy_only=False)
                with np.errstate(all="ignore"):
                    for i, row in enumerate(rows):
                        at = place(moved(columns, row), sample)
                        on = at >= 0
                        w = columns["_w"][on]
                        for k, values in enumerate((None, w, w * w)):
                            sums[k, i] += np.bincount(at[on], values, n_bins)
            point, where = np.nonzero(sums[0])
            samples = np.repeat(list(offsets), [sizes[s] for s in offsets])
            first = np.repeat(list(offsets.values()), [sizes[s] for s in offsets])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array([r["point"] for r in rows], np.int64)[point]), pa.array(samples[where]).cast(sample_type),
                pa.array((where - first[where]).astype(np.int32)), pa.array(sums[1, point, where]), pa.array(sums[2, point, where])],
                names=["point", "sample_id", "bin", "mc", "w2"])

        return run

    sample_type = to_arrow_type(events.schema["sample_id"].dataType)
    schema = f"point long, sample_id {kinds['sample_id']}, bin int, mc double, w2 double"
    parts = []
    for start, end in zip(bounds, [*bounds[1:], None]):
        here = points.where(F.col("point") >= start)
        # The points of one pass.
        rows = [r.asDict() for r in (here if end is None else here.where(F.col("point") < end)).select("point", *params).collect()]
        parts.append(events.select("sample_id", weight, *read).mapInArrow(one_pass(rows), schema))
    if not parts:
        return events.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.union, parts).groupBy("point", "sample_id", "bin").agg(F.sum("mc").alias("mc"), F.sum("w2").alias("w2"))
