"""Gaussian sums of training edges from the nodes of the edges' own cells, which are few numbers that every task can have.

A Gaussian is as smooth in its source as in its point, so the edges of a cell of one bandwidth are summed up as weights
of the cell's Chebyshev nodes (smooth), where they lie; only these leave a task. A task that has held units takes them to the nodes of
its points' cells. Neither edges nor points are copied or dealt again, and cost follows the rows. No edge is cut off. Where the training edges fill
more cells than GATHERED numbers hold, or an edge's place is not finite, there are no sums, and smooth.gaussian_sums() is the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .blocks import Stored, arrays, columns, stored
from .pairwise import correlations
from .smooth import NODES, PLACES, basis

#: Numbers of all cells' nodes at most; they come to the driver and go to every task (16 MB).
GATHERED = 1 << 21
#: Cells of points that a task remembers, in numbers; points that are interpolated at once; held and training edges of a block of a pool.
REMEMBERED, STEP, HELD = 1 << 22, 4096, 16384


def cells_of(x: np.ndarray, side: float) -> Iterator[tuple[tuple, np.ndarray]]:
    """(cell, rows) of the points x by their cells of that side."""
    if not len(x):
        return
    cells = np.floor(x / side)
    _, first, code = np.unique(cells, axis=0, return_index=True, return_inverse=True)
    code = code.ravel()
    for k, at in enumerate(np.split(np.argsort(code, kind="stable"), np.cumsum(np.bincount(code))[:-1])):
        yield tuple(cells[first[k]].tolist()), at


def summed(mid: np.ndarray, weights: np.ndarray, side: float, found: dict) -> None:
    """Adds the weights(edge, column) of edges at mid to found, (nodes, columns) by cell."""
    for cell, at in cells_of(mid, side):
        own = found.setdefault(cell, np.zeros((NODES ** mid.shape[1], weights.shape[1])))
        for i in range(0, len(at), STEP):
            some = at[i : i + STEP]
            own += basis(mid[some], np.array(cell), side).T @ weights[some]


class Sums:
    """Sums of the kernel times the weights of edges, at any points."""

    def __init__(self, cells: np.ndarray, values: np.ndarray, side: float):
        self.cells, self.values, self.side, self.known = cells, values, side, {}

    def at_nodes(self, cell: tuple) -> np.ndarray:
        """(nodes, columns): the sums at the nodes of a cell, one axis after another."""
        out = self.values.reshape(len(self.cells), *[NODES] * len(cell), -1)
        for c, own in enumerate(cell):
            gap = (own - self.cells[:, c])[:, None, None] + PLACES[None, :, None] - PLACES[None, None, :]
            part = np.exp(-0.5 * gap * gap) @ out.reshape(len(out), NODES, -1)
            out = np.moveaxis(part.reshape(out.shape), 1, -2)
        return out.sum(0).reshape(NODES ** len(cell), -1)

    def at(self, x: np.ndarray) -> np.ndarray:
        """(points, columns); NaN where a point's place is not finite."""
        out = np.full((len(x), self.values.shape[2]), np.nan)
        fine = np.flatnonzero(np.isfinite(x).all(1))
        for cell, rows in cells_of(x[fine], self.side):
            if cell not in self.known:
                if len(self.known) * self.values[0].size > REMEMBERED:
                    self.known.clear()
                self.known[cell] = self.at_nodes(cell)
            for i in range(0, len(rows), STEP):
                some = fine[rows[i : i + STEP]]
                out[some] = basis(x[some], np.array(cell), self.side) @ self.known[cell]
        return out


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of numbers as one column, or of lists of equal length as a matrix; NaN for null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False).astype(float)[:, None]


def _gathered(side: float):
    def run(batches):
        found, n = {}, None
        for batch in batches:
            if found is None or not batch.num_rows:
                continue
            mid, w, u = (matrix(batch.column(k)) for k in range(3))
            weights, n = np.concatenate([w, u * w], 1), mid.shape[1]
            if not (np.isfinite(mid).all() and np.isfinite(weights).all() and (np.abs(mid / side) < 2**40).all()):
                found = None
                continue
            summed(mid, weights, side, found)
            if sum(x.size for x in found.values()) > GATHERED:
                found = None
        rows = [(None, None)] if found is None else [(list(map(int, k)), v.astype("<f8").tobytes()) for k, v in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.list_(pa.int64())), pa.array([v for _, v in rows], pa.binary())], ["cell", "numbers"])

    return run


def _added(batches):
    """Sums of a cell's numbers, which come one after another."""
    cell, total = None, None
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array([cell], pa.list_(pa.int64())), pa.array([None if cell is None else total.tobytes()], pa.binary())], ["cell", "numbers"])
    began = False
    for batch in batches:
        for k, v in zip(batch.column(0), batch.column(1)):
            k = k.as_py()
            if began and k != cell:
                yield batch_of()
            if not began or k != cell:
                began, cell, total = True, k, None
            if k is not None:
                x = np.frombuffer(v.as_buffer(), "<f8")
                total = x.copy() if total is None else total + x
    if began:
        yield batch_of()


def gathered(train: DataFrame, side: float) -> Sums | None:
    """Sums of train(mid, w, u array<double>), of columns w and w u; None where they can't be had."""
    parts = train.select("mid", "w", "u").mapInArrow(_gathered(side), "cell array<bigint>, numbers binary")
    rows = kept(parts.repartition("cell").sortWithinPartitions("cell").mapInArrow(_added, "cell array<bigint>, numbers binary"), "nodes")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("numbers")), F.lit(0)).alias("size"), F.count_if(F.col("cell").isNull()).alias("none")).first()
    if size["none"] or not 0 < size["size"] <= 8 * GATHERED:
        return None
    found = [(row["cell"], np.frombuffer(bytes(row["numbers"]), "<f8")) for row in rows.collect()]
    cells = np.array([c for c, _ in found], float).reshape(len(found), -1)
    n = NODES ** cells.shape[1]
    return Sums(cells, np.stack([v.reshape(n, -1) for _, v in found]), side)


def weighed(edges: DataFrame, response: str = "turnover") -> DataFrame:
    """(mid, w, u) of training edges, each unit with total weight 1 unless they bring w along; u is an array of the response or responses."""
    w = F.col("w") if "w" in edges.columns else 1.0 / F.count(F.lit(1)).over(Window.partitionBy("unit"))
    u = F.col(response) if dict(edges.dtypes)[response].startswith("array") else F.array(F.col(response).cast("double"))
    return edges.select("mid", w.alias("w"), u.alias("u"))


def steps_of(start: np.ndarray, end: np.ndarray, steps: int) -> np.ndarray:
    """The midpoints of equal parts of each edge, edge by edge."""
    t = (np.arange(steps) + 0.5) / float(steps)
    return (start[:, None] + t[None, :, None] * (end - start)[:, None]).reshape(len(start) * steps, -1)


def exposures(start: np.ndarray, end: np.ndarray, sums: Sums, strength: float, prior: float | list[float], steps: int, tiny: float, digits: int) -> np.ndarray:
    """(edges, worlds): mean over its points of the field along each edge."""
    out = []
    for i in range(0, len(start), STEP):
        found = sums.at(steps_of(start[i : i + STEP], end[i : i + STEP], steps))
        field = (found[:, 1:] + strength * np.asarray(prior)) / np.maximum(found[:, :1] + strength, tiny)
        out.append(np.round(field.reshape(-1, steps, field.shape[1]).sum(1) / steps, digits))
    return np.concatenate(out)


def world_correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Guarded rank correlation of each column of x with that of y; NaN counts as the greatest value, as in Spark's order."""
    x, y = (np.where(np.isnan(v), np.inf, v) for v in (x, y))
    return np.concatenate([correlations(x[:, [k]], y[:, k if y.shape[1] > 1 else 0]) for k in range(x.shape[1])])


def unit_scores(held: DataFrame, sums: Sums, strength: float, prior: float | list[float], steps: int, tiny: float, digits: int, response: str = "turnover") -> DataFrame:
    """(world, unit, n, score) of held(unit, start, end, response), each unit's edges in one task, which have their points' sums there; a single response stands for all worlds."""
    def edges(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(matrix(table.column(c)) for c in ("start", "end", response))

    return scored(held.select("unit", "start", "end", response), edges, sums, strength, prior, steps, tiny, digits)


def scored(rows: DataFrame, edges: Callable, sums: Sums, strength: float, prior: float | list[float], steps: int, tiny: float, digits: int) -> DataFrame:
    """unit_scores() of the (start, end, response) that edges() makes of a unit's rows, in the task that has them; a unit without edges has no score."""
    kind, cells, values, side, state = dict(rows.dtypes)["unit"], sums.cells, sums.values, sums.side, {}

    def run(table: pa.Table) -> pa.Table:
        own = state["sums"] = state.get("sums") or Sums(cells, values, side)
        start, end, y = edges(table)
        score = world_correlations(exposures(start, end, own, strength, prior, steps, tiny, digits), y) if len(y) else np.zeros(0)
        unit = table.column("unit").take(pa.array(np.zeros(len(score), np.int64)))
        return pa.table({"world": pa.array(np.arange(len(score), dtype=np.int32)), "unit": unit, "n": pa.array(np.full(len(score), len(y))), "score": pa.array(score)})

    return rows.groupBy("unit").applyInArrow(run, f"world int, unit {kind}, n long, score double")


def squares(train: Stored, cells: list[list[int]], side: float, spark: SparkSession) -> dict[tuple, np.ndarray]:
    """For each cell, the nodes' products (nodes, nodes) of the sources' own sums, added up over the sources of train(source, mid, w): a point's basis on both sides gives the sum of their squares there."""

    def run(batches):
        out = {tuple(map(float, c)): 0.0 for c in cells}
        for batch in batches:
            for k in batch.column(0).to_pylist():
                table = train.read(k)
                if table is None:
                    continue
                b = columns(table)
                names, code = np.unique(b["source"].astype(str), return_inverse=True)
                for first in range(0, len(names), 128):  # so many sources' nodes at once
                    found = {}
                    some = np.flatnonzero((code >= first) & (code < first + 128))
                    for s, at in enumerate(np.split(some[np.argsort(code[some], kind="stable")], np.cumsum(np.bincount(code[some] - first))[:-1])):
                        for cell, rows in cells_of(b["mid"][at], side):
                            own = found.setdefault(cell, np.zeros((NODES ** b["mid"].shape[1], 128)))
                            for i in range(0, len(rows), STEP):
                                part = at[rows[i : i + STEP]]
                                own[:, s] += b["w"][part] @ basis(b["mid"][part], np.array(cell), side)
                    sums = Sums(np.array(list(found)), np.stack(list(found.values())), side)
                    for cell in out:
                        known = sums.at_nodes(cell)
                        out[cell] = out[cell] + known @ known.T
        done = [(list(map(int, c)), v.tobytes()) for c, v in out.items() if np.ndim(v)]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.list_(pa.int64())), pa.array([v for _, v in done], pa.binary())], ["cell", "numbers"])

    tasks = max(1, min(train.count, spark.sparkContext.defaultParallelism))
    parts = spark.range(0, train.count, 1, tasks).mapInArrow(run, "cell array<bigint>, numbers binary")
    rows = parts.repartition("cell").sortWithinPartitions("cell").mapInArrow(_added, "cell array<bigint>, numbers binary").collect()  # bounded by the caller
    return {tuple(map(float, r["cell"])): np.frombuffer(bytes(r["numbers"]), "<f8").reshape(NODES ** len(r["cell"]), -1) for r in rows}


def cells_along(held: DataFrame, side: float, steps: int) -> list[list[int]] | None:
    """The cells of held edges' points; None where their nodes' products are more than 4 * GATHERED numbers, or a place is not finite."""

    def run(batches):
        found = set()
        for batch in batches:
            if batch.num_rows and found is not None:
                x = steps_of(matrix(batch.column(0)), matrix(batch.column(1)), steps)
                found = found | set(map(tuple, np.unique(np.floor(x / side), axis=0).tolist())) if np.isfinite(x).all() else None
                if found is not None and len(found) * NODES ** (2 * x.shape[1]) > 4 * GATHERED:
                    found = None
        yield pa.RecordBatch.from_arrays([pa.array([None] if found is None else [list(map(int, c)) for c in found], pa.list_(pa.int64()))], ["cell"])

    rows = held.select("start", "end").mapInArrow(run, "cell array<bigint>").distinct()
    most = 4 * GATHERED // NODES**2
    cells = [r["cell"] for r in rows.limit(most + 1).collect()]
    return None if not cells or None in cells or len(cells) * NODES ** (2 * len(cells[0])) > 4 * GATHERED else cells


def by_source(b: dict, cells: list[tuple], side: float) -> tuple[np.ndarray, np.ndarray]:
    """(names, numbers(source, cell, node, column)) of a block's sources: sums of w and w u at the nodes of the edges' cells."""
    names, code = np.unique(b["source"].astype(str), return_inverse=True)
    place = {c: k for k, c in enumerate(cells)}
    out = np.zeros((len(names), len(cells), NODES ** b["mid"].shape[1], 2))
    for cell, rows in cells_of(b["mid"], side):
        rows = rows[np.argsort(code[rows], kind="stable")]
        for i in range(0, len(rows), STEP):
            at = rows[i : i + STEP]
            first = np.flatnonzero(np.concatenate([[True], code[at][1:] != code[at][:-1]]))
            own = basis(b["mid"][at], np.array(cell), side) * b["w"][at][:, None]
            for c, x in enumerate((own, own * b["u"][at][:, None])):
                out[code[at][first], place[cell], :, c] += np.add.reduceat(x, first, axis=0)
    return names, out


def pooled_scores(held: DataFrame, train: DataFrame, pool: DataFrame, near: Sums, strength: float, prior: float, steps: int, tiny: float, digits: int) -> DataFrame | None:
    """(unit, n, score) of held units whose fields come from their own sources, pool(unit, source, scale), of train(source, mid, w, u); None where a unit's nodes are too many.

    A unit's sums are at nodes, as near's are, and are added up over blocks of sources; its points meet them once. A block of
    held units is one task's, which reads the blocks of sources one after another: neither edges nor points are dealt.
    """
    spark, side, kind = held.sparkSession, near.side, dict(held.dtypes)["unit"]
    units = (1 << 23) // max(1, near.values[:, :, :2].size)
    if units < 16:
        return None
    cells, least = [tuple(c) for c in near.cells.tolist()], 2 * spark.sparkContext.defaultParallelism
    left, right = stored(held.select("unit", "start", "end", "turnover"), "unit", HELD, least, min(units, 512)), stored(train.select("source", "mid", "w", "u"), "source", HELD)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    rows = pool.select(block("unit", left.count).alias("l_"), block("source", right.count).alias("r_"), "unit", "source", "scale").repartition(left.count, "l_")
    rows = rows.groupBy("l_", "r_").agg(F.collect_list(F.struct("unit", "source", "scale")).alias("pairs_")).sortWithinPartitions("l_", "r_")

    def scored_block(a: dict, names: np.ndarray, total: np.ndarray, met: np.ndarray):
        found = []
        for u in np.flatnonzero(met):
            at = np.flatnonzero(a["unit"] == names[u])
            own = Sums(np.array(cells), total[u].reshape(len(cells), -1, 2), side)
            x = exposures(a["start"][at], a["end"][at], own, strength, prior, steps, tiny, digits)
            found.append((names[u], len(at), world_correlations(x, a["turnover"][at][:, None])[0]))
        cols = [pa.array([r[0] for r in found], {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())), pa.array([r[1] for r in found], pa.int64()), pa.array([float(r[2]) for r in found], pa.float64())]
        return pa.RecordBatch.from_arrays(cols, ["unit", "n", "score"])

    def run(batches):
        now, a = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                l, r = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if l != now:
                    if a is not None:
                        yield scored_block(a, names, total, met)  # noqa: F821
                    now, table = l, left.read(l)
                    a = None if table is None else columns(table)
                    if a is not None:
                        names = np.unique(a["unit"])
                        total, met = np.zeros((len(names), len(cells) * NODES ** len(cells[0]) * 2)), np.zeros(len(names), bool)
                table = None if a is None else right.read(r)
                if table is None:
                    continue
                sources, numbers = by_source(columns(table), cells, side)
                asked, scales = arrays(batch.column(2), i), np.zeros((len(names), len(sources)))
                own = np.isin(asked["unit"], names) & np.isin(asked["source"].astype(str), sources)
                scales[np.searchsorted(names, asked["unit"][own]), np.searchsorted(sources, asked["source"][own].astype(str))] = asked["scale"][own]
                total += scales @ numbers.reshape(len(sources), -1)
                met |= scales.any(1)
        if a is not None:
            yield scored_block(a, names, total, met)

    return rows.mapInArrow(run, f"unit {kind}, n long, score double")
