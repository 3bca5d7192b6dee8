"""Gaussian sums at many points from their values at few: the nodes of Chebyshev polynomials in cells of one bandwidth.

A sum of Gaussians of bandwidth h is so smooth inside a cell of side h that its values at NODES nodes along
each axis give it everywhere there to about the rounding of the sum itself (tests/test_smooth.py). A cell with more points than nodes
therefore asks for its nodes only; in others the points ask for themselves. Each of those that ask meets every training
edge, so no edge is cut off, and cost grows with the edges and with the points, not with their product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .blocks import BLOCK, arrays, blocked, each_pair

#: Cells of which a table is broadcast at most; training edges of a block that nodes meet; points of a cell that are one block on average.
CELLS, EDGES, POINTS = 4096, 16384, 32768
#: Nodes along each axis of a cell.
NODES = 18
PLACES = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES)) / 2
_SIGNS = (-1.0) ** np.arange(NODES) * np.sin((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))


def direct(x: np.ndarray, mid: np.ndarray, weights: np.ndarray, bandwidth: float, step: int = 1 << 20) -> np.ndarray:
    """Sums over the edges at mid of the kernel times weights(edge, column), for each x."""
    out = np.zeros((len(x), weights.shape[1]))
    scale, rows = -0.5 / (bandwidth * bandwidth), max(1, step // max(1, len(mid)))
    for i in range(0, len(x), rows):
        d = np.zeros((len(x[i : i + rows]), len(mid)))
        for c in range(x.shape[1]):
            gap = x[i : i + rows, c][:, None] - mid[:, c][None, :]
            gap *= gap
            d += gap
        d *= scale
        out[i : i + rows] = np.exp(d, out=d) @ weights
    return out


def grid(cell: np.ndarray, side: float) -> np.ndarray:
    """The nodes of a cell, the last axis running first."""
    axes = np.meshgrid(*(((c + 0.5) + PLACES) * side for c in cell), indexing="ij")
    return np.stack([a.ravel() for a in axes], 1)


def basis(x: np.ndarray, cell: np.ndarray, side: float) -> np.ndarray:
    """(points, nodes): what each node's value counts for at each point of the cell."""
    out = np.ones((len(x), 1))
    for c in range(x.shape[1]):
        gap = (x[:, c] / side - (cell[c] + 0.5))[:, None] - PLACES[None, :]
        exact = gap == 0
        part = _SIGNS / np.where(exact, 1.0, gap)
        part[exact.any(1)] = 0.0
        part[exact] = 1.0
        part /= part.sum(1, keepdims=True)
        out = (out[:, :, None] * part[:, None, :]).reshape(len(x), -1)
    return out


def sums(x: np.ndarray, mid: np.ndarray, weights: np.ndarray, bandwidth: float) -> np.ndarray:
    """direct(), by nodes in the cells of x that have more points than nodes."""
    cells = np.floor(x / bandwidth)
    if len(x) <= NODES ** x.shape[1] or not np.isfinite(cells).all():
        return direct(x, mid, weights, bandwidth)
    _, first, code, count = np.unique(cells, axis=0, return_index=True, return_inverse=True, return_counts=True)
    out, order = np.empty((len(x), weights.shape[1])), np.argsort(code.ravel(), kind="stable")
    for k, at in enumerate(np.split(order, np.cumsum(count)[:-1])):
        if len(at) <= NODES ** x.shape[1]:
            out[at] = direct(x[at], mid, weights, bandwidth)
            continue
        values = direct(grid(cells[first[k]], bandwidth), mid, weights, bandwidth)
        for i in range(0, len(at), 4096):
            some = at[i : i + 4096]
            out[some] = basis(x[some], cells[first[k]], bandwidth) @ values
    return out


def _nodes(side: float):
    def run(batches):
        for batch in batches:
            for cell in batch.column(0):
                at = grid(np.array(cell.as_py(), float), side)
                cells = pa.array([cell.as_py()] * len(at), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([cells, pa.array(np.arange(len(at), dtype=np.int32)), pa.array(list(at), pa.list_(pa.float64()))], ["cell", "place", "at"])

    return run


def _met(bandwidth: float):
    def run(a, b, _):
        u = b["u"].reshape(len(b["w"]), -1)
        found = direct(a["at"], b["mid"], np.concatenate([b["w"][:, None], u * b["w"][:, None]], 1), bandwidth)
        n = u.shape[1]
        rows = [pa.array(np.repeat(a["row"].astype(str), n).tolist()), pa.array(np.tile(np.arange(n, dtype=np.int32), len(found))), pa.array(found[:, 1:].ravel()), pa.array(np.repeat(found[:, 0], n))]
        return pa.RecordBatch.from_arrays(rows, ["row", "world", "top", "low"])

    return run


def _interpolated(carry: list[str], side: float):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cell, rows, values = (batch.column(batch.schema.get_field_index(c))[i] for c in ("cell", "rows", "values"))
                cell, x = np.array(cell.as_py(), float), arrays(batch.column(batch.schema.get_field_index("rows")), i)["at"]
                place, world, top, low = (values.values.field(c).to_numpy(zero_copy_only=False) for c in ("place", "world", "top", "low"))
                known = np.zeros((NODES ** len(cell), world.max() + 2))
                known[place, world + 1] = top
                known[place, 0] = low
                for k in range(0, len(x), 4096):
                    found = basis(x[k : k + 4096], cell, side) @ known
                    tops = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * (found.shape[1] - 1)), pa.array(found[:, 1:].ravel()))
                    yield pa.RecordBatch.from_arrays([*(rows.values.field(c).slice(k, len(found)) for c in carry), tops, pa.array(found[:, 0])], [*carry, "tops", "low"])

    return run


def asked(at: DataFrame, bandwidth: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(crowded, sparse, nodes, ask): at's rows in cells with more points than nodes and in others, the nodes(cell, place, at, row) of the former, and ask(row, at) of nodes and sparse points, which are all that edges must meet.

    at has cell, the place of its cell of side bandwidth.
    """
    sizes = at.groupBy("cell").agg((F.count(F.lit(1)) > F.pow(F.lit(float(NODES)), F.max(F.size("cell")))).alias("crowded"))
    sizes = kept(sizes, "cells")
    marked = at.join(F.broadcast(sizes) if sizes.count() <= CELLS else sizes, "cell")
    full = sizes.where("crowded").select("cell")
    nodes = full.mapInArrow(_nodes(bandwidth), "cell array<bigint>, place int, at array<double>").withColumn("row", F.concat_ws("|", F.lit("node"), F.array_join(F.col("cell").cast("array<string>"), ","), "place"))
    sparse = marked.where("not crowded").withColumn("row", F.concat_ws("|", F.lit("point"), "row"))
    return marked.where("crowded"), sparse, nodes, nodes.select("row", "at").unionByName(sparse.select("row", "at"))


def gaussian_sums(at: DataFrame, edges: DataFrame, bandwidth: float, carry: list[str]) -> DataFrame:
    """(carry, tops, low) of at(carry, row, at): sums of w K u for each response, and of w K, over all edges(row, mid, w, u array<double>)."""
    fields = list(dict.fromkeys([*carry, "row", "at"]))
    points = kept(at.select(*fields, F.transform("at", lambda v: F.floor(v / F.lit(float(bandwidth)))).alias("cell")), "points")
    blocks = max(1, -(-points.count() // POINTS))
    crowded, sparse, nodes, ask = asked(points, bandwidth)
    a, b = blocked(ask, [], "row", ["at"], BLOCK), blocked(edges, [], "row", ["mid", "w", "u"], EDGES, "block_")
    sums = each_pair(a, b, [], _met(bandwidth), "row string, world int, top double, low double").groupBy("row", "world").agg(F.sum("top").alias("top"), F.sum("low").alias("low"))
    sums = kept(sums, "sums")
    values = nodes.select("row", "cell", "place").join(sums, "row").groupBy("cell").agg(F.collect_list(F.struct("place", "world", "top", "low")).alias("values"))  # NODES of each axis
    values = values.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = crowded.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).groupBy("cell", "block").agg(F.collect_list(F.struct(*dict.fromkeys([*carry, "at"]))).alias("rows"))
    kinds = dict(points.dtypes)
    smooth = dealt.join(values.hint("merge"), ["cell", "block"]).select("cell", "rows", "values").mapInArrow(_interpolated(carry, bandwidth), ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", tops array<double>, low double")
    exact = sums.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("world", "top"))), lambda x: x["top"]).alias("tops"), F.max("low").alias("low"))  # a number for each response
    own = sparse.join(exact.withColumnRenamed("row", "row_"), F.col("row") == F.col("row_"))
    return smooth.unionByName(own.withColumn("row", F.substring_index("row", "point|", -1)).select(*carry, "tops", "low"))
