"""Fields of single source units at the points of held units, as (points, sources) matrices that never leave a task.

Held units and source units are dealt to blocks whole, so that a task can rank a unit's edges under each source's field; large blocks
make few copies of either side. A unit or source is as large as a task can hold, as for ranks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import smooth
from .blocks import arrays, blocked, columns, every_two, stored  # noqa: F401

#: Held edges and training edges of a block, on average, and points where edges are not needed; numbers of a matrix of points and sources.
HELD, TRAIN, POINTS, NUMBERS = 16384, 65536, 262144, 1 << 21
EPS = 2.220446049250313e-16


def kernels(x: np.ndarray, mid: np.ndarray, weights: np.ndarray, groups: list[np.ndarray], bandwidth: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, sums(point, group, column)) over the edges of each group, some groups at a time."""
    cells = np.floor(x / bandwidth)
    parts, some = [], np.arange(len(x))
    if len(x) > smooth.NODES ** x.shape[1] and np.isfinite(cells).all():
        _, first, code, count = np.unique(cells, axis=0, return_index=True, return_inverse=True, return_counts=True)
        order = np.split(np.argsort(code.ravel(), kind="stable"), np.cumsum(count)[:-1])
        full = [k for k, n in enumerate(count) if n > smooth.NODES ** x.shape[1]]
        parts = [(order[k], cells[first[k]]) for k in full]
        some = np.concatenate([order[k] for k in range(len(count)) if k not in set(full)] or [np.zeros(0, int)])
    asks = np.concatenate([x[some], *(smooth.grid(cell, bandwidth) for _, cell in parts)])
    size, columns = max(1, NUMBERS // max(1, len(x))), weights.shape[1]
    values = np.empty((len(asks), len(groups), columns))
    for k, at in enumerate(groups):
        values[:, k] = smooth.direct(asks, mid[at], weights[at], bandwidth)
    bases = [smooth.basis(x[at], cell, bandwidth) for at, cell in parts] if len(x) * smooth.NODES ** x.shape[1] <= 4 * NUMBERS else None
    for k in range(0, len(groups), size):
        own = values[:, k : k + size]
        out = np.empty((len(x), own.shape[1], columns))
        out[some] = own[: len(some)]
        start, n = len(some), smooth.NODES ** x.shape[1]
        for p, (at, cell) in enumerate(parts):
            known = own[start : start + n].reshape(n, -1)
            for i in range(0, len(at), 4096):
                base = bases[p][i : i + 4096] if bases else smooth.basis(x[at[i : i + 4096]], cell, bandwidth)
                out[at[i : i + 4096]] = (base @ known).reshape(-1, own.shape[1], columns)
            start += n
        yield k, k + own.shape[1], out


def ranks(values: np.ndarray) -> np.ndarray:
    """Average ranks along the first axis, less their mean."""
    order = np.argsort(values, 0, kind="stable")
    ordered = np.take_along_axis(values, order, 0)
    n = len(values)
    place = np.broadcast_to(np.arange(n)[:, None], values.shape)
    new = np.concatenate([np.ones((1, values.shape[1]), bool), ordered[1:] != ordered[:-1]])
    first = np.maximum.accumulate(np.where(new, place, 0), 0)
    last = np.concatenate([new[1:], np.ones((1, values.shape[1]), bool)])
    last = np.minimum.accumulate(np.where(last, place, n)[::-1], 0)[::-1]
    out = np.empty(values.shape)
    np.put_along_axis(out, order, (first + last) / 2 - (n - 1) / 2, 0)
    return out


def correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Guarded rank correlation of each column of x with y, as ranks.spearman() has it."""
    if len(x) < 3:
        return np.full(x.shape[1], np.nan)
    u, v = ranks(x), ranks(y[:, None])
    length = np.sqrt((u * u).sum(0) * (v * v).sum(0))
    return np.where(length <= EPS, 0.0, (u * v).sum(0) / np.where(length > EPS, length, 1.0))


def points_of(a: dict, steps: int) -> np.ndarray:
    """The midpoints of equal parts of each edge, edge by edge."""
    t = (np.arange(steps) + 0.5) / float(steps)
    return (a["start"][:, None] + t[None, :, None] * (a["end"] - a["start"])[:, None]).reshape(len(a["start"]) * steps, -1)


def each(held: DataFrame, fields: list[str], train: DataFrame, fn: Callable, schema: str, pairs: DataFrame | None = None) -> DataFrame:
    """fn(held arrays, training arrays, source names, edges of each source, scales) -> record batches, for every two blocks of held(unit, fields) and train(source, mid, w, u).

    Blocks are written once, and a task reads the two that it has the numbers of: no copies of them are dealt, however many meet.

    pairs(unit, source, scale): only blocks with a pair meet, and scales are a matrix of the blocks' units, by np.unique, and sources, 0 where there is none.
    """
    spark, listed = held.sparkSession, pairs is not None
    least = math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism))
    left, right = stored(held.select("unit", *fields), "unit", HELD, least), stored(train.select("source", "mid", "w", "u"), "source", TRAIN, least)
    met = every_two(left, right, spark)
    if listed:
        block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        own = pairs.select(block("unit", left.count).alias("l_"), block("source", right.count).alias("r_"), "unit", "source", "scale")
        parts = max(1, min(left.count * right.count, 16 * spark.sparkContext.defaultParallelism, 4096))
        met = own.repartition(parts, "l_", "r_").groupBy("l_", "r_").agg(F.collect_list(F.struct("unit", "source", "scale")).alias("pairs_"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tables = left.read(batch.column(0)[i].as_py()), right.read(batch.column(1)[i].as_py())
                if None in tables:
                    continue
                a, b = (columns(t) for t in tables)
                names, code, count = np.unique(b["source"].astype(str), return_inverse=True, return_counts=True)
                groups = np.split(np.argsort(code, kind="stable"), np.cumsum(count)[:-1])
                scales = None
                if listed:
                    units, asked = np.unique(a["unit"]), arrays(batch.column(2), i)
                    scales = np.zeros((len(units), len(names)))
                    own = np.isin(asked["unit"], units) & np.isin(asked["source"].astype(str), names)
                    scales[np.searchsorted(units, asked["unit"][own]), np.searchsorted(names, asked["source"][own].astype(str))] = asked["scale"][own]
                    some = np.flatnonzero(scales.any(0))
                    names, groups, scales = names[some], [groups[k] for k in some], scales[:, some]
                if len(names):
                    yield from fn(a, b, names, groups, scales)

    return met.mapInArrow(run, schema)


def scores(bandwidth: float, strength: float, prior: float, steps: int, tiny: float, digits: int, kind: pa.DataType, without: bool, total: Callable | None = None):
    """A function for each(): (unit, source, n, score) under each source's own field or, if without, under that of all others, total less its own; total(points) gives both sums, or held has them by point."""

    def run(a, b, names, groups, scales):
        order = np.argsort(a["unit"], kind="stable")
        a = {k: v[order] for k, v in a.items()}
        units, first, count = np.unique(a["unit"], return_index=True, return_counts=True)
        weights = np.stack([b["w"], b["w"] * b["u"]], 1)
        if without and total:
            a["lows"], a["tops"] = total(points_of(a, steps)).T
        for k, end, sums in kernels(points_of(a, steps), b["mid"], weights, groups, bandwidth):
            low, top = sums[:, :, 0], sums[:, :, 1]
            if without:
                low, top = a["lows"].reshape(-1, 1) - low, a["tops"].reshape(-1, 1) - top
            field = ((top + strength * prior) / np.maximum(low + strength, tiny)).reshape(len(a["unit"]), steps, -1)
            exposure = np.round(field.sum(1) / steps, digits)
            for u, (at, n) in enumerate(zip(first, count)):
                asked = np.flatnonzero(scales[u, k:end]) if scales is not None else np.arange(end - k)
                if len(asked):
                    found = correlations(exposure[at : at + n][:, asked], a["turnover"][at : at + n])
                    cols = [pa.array(np.full(len(asked), units[u]), kind), pa.array(names[k:end][asked].tolist()), pa.array(np.full(len(asked), n)), pa.array(found)]
                    yield pa.RecordBatch.from_arrays(cols, ["unit", "source", "n", "score"])

    return run


def shares(bandwidth: float, steps: int, mass: Callable):
    """A function for each(): (source, total, most) of a source's shares of the mass at a block's points; mass(points) is that of all sources."""

    def run(a, b, names, groups, _):
        x = points_of(a, steps)
        all_ = mass(x)[:, :1]
        inverse = np.divide(1.0, all_, out=np.zeros_like(all_), where=all_ > 0)
        total, most = np.zeros(len(names)), np.zeros(len(names))
        for k, end, sums in kernels(x, b["mid"], b["w"][:, None], groups, bandwidth):
            own = sums[:, :, 0] * inverse
            total[k:end], most[k:end] = own.sum(0), own.max(0)
        yield pa.RecordBatch.from_arrays([pa.array(names.tolist()), pa.array(total), pa.array(most)], ["source", "total", "most"])

    return run


def scaled(bandwidth: float, steps: int, kind: pa.DataType):
    """A function for each(): (unit, a, b, p, top, low), sums over the sources of a unit's pool times their scales."""

    def run(a, b, names, groups, scales):
        units, code = np.unique(a["unit"], return_inverse=True)
        own = np.repeat(code, steps)
        weights, total = np.stack([b["w"], b["w"] * b["u"]], 1), np.zeros((len(own), 2))
        for k, end, sums in kernels(points_of(a, steps), b["mid"], weights, groups, bandwidth):
            total += np.einsum("psc,ps->pc", sums, scales[:, k:end][own])
        keep = np.flatnonzero(scales.any(1)[own])
        rows = [pa.array(a["unit"][keep // steps], kind), *(pa.array(a[c][keep // steps]) for c in "ab"), pa.array((keep % steps).astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*rows, pa.array(total[keep, 1]), pa.array(total[keep, 0])], ["unit", "a", "b", "p", "top", "low"])

    return run
