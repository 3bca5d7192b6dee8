"""Distance-aware residuals: an edge's response against what distance predicts from edges that share no end with it.

A rank among an edge's training edges is its rank in the unit less the excluded edges below, ties by half. Sums of
squares and products of such ranks follow from sums over the whole unit, prefix sums in the order of either value, and
counts of the edges that lie above an excluded edge in both; so an edge costs what its ends' edges are, not what
its unit has. Edges at a vertex with more than HEAVY edges are ranked among those that don't touch it, once for all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import EPS, average_rank, rank01
from .blocks import blocked, each_pair

#: Edges of a unit that a task holds at most, and target edges of a unit that it settles about; units with more edges go by blocks.
MOST, TARGETS = 1 << 20, 1 << 15
#: Edges at a vertex from which on it is taken out of the unit.
HEAVY = 256
#: Edges of a unit up to which counts are a table of all pairs of places, and pairs that are counted at once.
DENSE, PAIRS = 1024, 1 << 21


class Above:
    """How many of a set of points lie at place i or later by x and place j or later by y."""

    def __init__(self, y_at: np.ndarray):
        """y_at: the place by y of the point at each place by x."""
        self.m = m = len(y_at)
        self.table = None
        if m <= DENSE:
            t = np.zeros((m + 1, m + 1), np.int32)
            t[np.arange(m), y_at] = 1
            self.table = np.ascontiguousarray(t[::-1, ::-1].cumsum(0, dtype=np.int32).cumsum(1, dtype=np.int32)[::-1, ::-1])
            return
        self.levels = []  # bit by bit from the highest: zeros before each place, and how many zeros there are
        now = np.asarray(y_at, np.int64)
        for bit in range(m.bit_length() - 1, -1, -1):
            ones = (now >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - ones)]).astype(np.int32)
            self.levels.append((bit, zeros, int(zeros[-1])))
            now = np.concatenate([now[ones == 0], now[ones == 1]])

    def count(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[i, j]
        low, high = i.astype(np.int64), np.full(len(i), self.m, np.int64)
        found = np.zeros(len(i), np.int64)
        for bit, zeros, total in self.levels:
            one = ((j >> bit) & 1).astype(bool)
            a, b = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            found += np.where(one, 0, (high - low) - (b - a))
            low, high = np.where(one, total + low - a, a), np.where(one, total + high - b, b)
        return found + (high - low)


class Side:
    """Edges in the order of one value: the first and last place of each edge's value, average ranks, ties."""

    def __init__(self, values: np.ndarray):
        self.values, m = values, len(values)
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        self.place = np.empty(m, np.int64)
        self.place[order] = np.arange(m)
        self.low, self.high = self.places(values)
        self.rank = (self.low + self.high + 1) / 2
        self.ties = (self.high - self.low).astype(float)
        t = self.ties
        self.tied = float(((t * t - 1) / 12).sum())  # (t**3 - t) / 12 for each group of t

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.sorted, at, "left"), np.searchsorted(self.sorted, at, "right")

    def above(self, weight: np.ndarray) -> np.ndarray:
        """For each edge the sum of weight over those with a greater value, ties by half."""
        rest = np.zeros(len(weight) + 1)
        ordered = np.empty(len(weight))
        ordered[self.place] = weight
        rest[:-1] = ordered[::-1].cumsum()[::-1]
        return (rest[self.low] + rest[self.high]) / 2


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places in lists that lie one after another."""
    ends = np.cumsum(sizes)
    first = np.repeat(np.arange(ends[-1] if len(ends) else 0), np.repeat(sizes, sizes))
    second = np.arange(len(first)) - np.repeat(np.cumsum(sizes * sizes) - sizes * sizes, sizes * sizes)
    return first, np.repeat(ends - sizes, sizes * sizes) + second % np.repeat(sizes, sizes * sizes)


def _step(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """1 where `other` is less, 0.5 where it is equal."""
    return (other < mine) + 0.5 * (other == mine)


def _sums(x: Side, y: Side, lists: np.ndarray, sizes: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> np.ndarray:
    """(n, hx, hy, xx, xy) of targets, whose training edges are all edges of x and y but those of their lists (indices, one list after another).

    hx and hy: the held values' ranks among them over n + 1; xx and xy: the sums of squares and products of
    their ranks over n + 1, less one half.
    """
    m, out = len(x.values), np.empty((5, len(sizes)))
    both, above = float(x.rank @ y.rank), None
    lean = x.above(y.rank) + y.above(x.rank)
    ends = np.cumsum(sizes)
    upto = np.cumsum(sizes * sizes)
    stops = np.searchsorted(upto, np.arange(PAIRS, (upto[-1] if len(upto) else 0), PAIRS)) + 1
    start = 0
    for stop in np.unique([*stops.tolist(), len(sizes)]).tolist():
        part, few = slice(start, stop), lists[ends[start] - sizes[start] : ends[stop - 1]]
        size, which = sizes[part], np.repeat(np.arange(stop - start), sizes[part])
        n = m - size
        add = lambda v, k=which, c=stop - start: np.bincount(k, v, c)
        f, g = _pairs(size)
        owner = np.repeat(np.arange(stop - start), size * size)
        products = both - add(lean[few])
        squares, below, hold = [], [], []
        for side, held in ((x, held_x), (y, held_y)):
            v = side.values[few]
            below.append(side.rank[few] - np.bincount(f, _step(v[f], v[g]), len(few)))
            low, high = side.places(held[part])
            hold.append(((low + high + 1) / 2 - add(_step(held[part][which], v))) / (n + 1))
            if side is x:
                c, t = np.bincount(f, v[f] == v[g], len(few)), side.ties[few]
                rest = t - c  # of a group of ties that loses c members each takes a share
                squares = n * (n + 1.0) * (2 * n + 1) / 6 - side.tied + add(((t**3 - t) - (rest**3 - rest)) / 12 / c)
        if len(f):
            if above is None:
                at = np.empty(m, np.int64)
                at[x.place] = y.place
                above = Above(at)
            a, b = few[f], few[g]
            over = sum(above.count(i, j) for i in (x.low[a], x.high[a]) for j in (y.low[b], y.high[b])) / 4
            products += np.bincount(owner, over, stop - start)
        products -= add(below[0] * below[1])
        out[:, part] = n, *hold, squares / (n + 1.0) ** 2 - n / 4, products / (n + 1.0) ** 2 - n / 4
        start = stop
    return out


def unit_sums(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """(n, hx, hy, xx, xy) as _sums() has them for the target edges (indices) of a unit, each against the edges that share no end with it."""
    m = len(a)
    vertices, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    ends = ends.reshape(2, m)
    order = np.argsort(ends.ravel(), kind="stable")
    edge = order % m  # the edges of each vertex, vertex by vertex
    degree = np.bincount(ends.ravel(), minlength=len(vertices))
    first = np.cumsum(degree) - degree
    out = np.empty((5, len(targets)))
    l, r = ends[0][targets], ends[1][targets]
    swap = degree[r] > degree[l]
    l, r = np.where(swap, r, l), np.where(swap, l, r)  # l has no fewer edges
    heavy = degree[l] > HEAVY

    def lists(of: np.ndarray, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The edges of each vertex of `of`, one list after another, without an edge each."""
        size = degree[of]
        found = edge[np.repeat(first[of] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        if without is None:
            return found, size
        keep = found != np.repeat(without, size)
        return found[keep], size - 1

    light = np.flatnonzero(~heavy)
    if len(light):
        one, n_one = lists(l[light], None)
        two, n_two = lists(r[light], targets[light])
        size = n_one + n_two
        at = np.cumsum(size) - size
        found = np.empty(size.sum(), np.int64)
        found[np.repeat(at - (np.cumsum(n_one) - n_one), n_one) + np.arange(len(one))] = one
        found[np.repeat(at + n_one - (np.cumsum(n_two) - n_two), n_two) + np.arange(len(two))] = two
        out[:, light] = _sums(Side(x), Side(y), found, size, x[targets[light]], y[targets[light]])
    for v in np.unique(l[heavy]).tolist():
        mine = np.flatnonzero(heavy & (l == v))
        free = (ends != v).all(0)
        to = np.cumsum(free) - 1
        one, other = Side(x[free]), Side(y[free])
        crowded = degree[r[mine]] > HEAVY
        some = mine[~crowded]
        if len(some):
            found, size = lists(r[some], targets[some])
            out[:, some] = _sums(one, other, to[found], size, x[targets[some]], y[targets[some]])
        for k in mine[crowded].tolist():  # both ends are heavy: the edge's training edges are ranked by themselves
            rest = free & (ends != r[k]).all(0)
            e = targets[k : k + 1]
            out[:, k : k + 1] = _sums(Side(x[rest]), Side(y[rest]), np.empty(0, np.int64), np.zeros(1, np.int64), x[e], y[e])
    return out


COLUMNS = ["a", "b", "x", "y", "rx", "ry"]


def _settled(least: int, unit_type: pa.DataType):
    """Sums of the target edges of one part of one unit; its rows are all edges of the unit."""

    def run(table: pa.Table) -> pa.Table:
        a, b, x, y = (table.column(c).to_numpy() for c in ("a", "b", "x", "y"))
        targets = np.flatnonzero(table.column("own").to_numpy(zero_copy_only=False))
        order = np.lexsort((b[targets], a[targets]))
        targets = targets[order]
        n, hx, hy, xx, xy = unit_sums(a, b, x, y, targets)
        same = bool((Side(x).rank == Side(y).rank).all())
        keep = n >= least
        unit = table.column("unit")[0].as_py()
        cols = [pa.array([unit] * int(keep.sum()), unit_type), pa.array(a[targets][keep]), pa.array(b[targets][keep]), pa.array(n[keep].astype(np.int64))]
        cols += [pa.array(v[keep]) for v in (hx, hy, xx, xy)] + [pa.array(np.full(int(keep.sum()), same))]
        return pa.Table.from_arrays(cols, ["unit", "a", "b", "n_training", "hx", "hy", "xx", "xy", "same"])

    return run


def crossfit_residuals(edges: DataFrame, distance: str, response: str, least: int = 5, most: int = MOST) -> DataFrame:
    """(unit, a, b, n_training, observed, expected, residual, turnover) for edges(unit, a, b, distance, response).

    For each edge the training edges of its unit share neither end with it. Response and distance
    are ranks among these over their number plus one; expected is their regression line at the
    edge's own distance rank; turnover is rank01 of the residual. Edges with fewer than `least`
    training edges are left out. Where both ranks agree on a whole unit, residuals are 0 and
    turnover 0.5. Edges of a unit are distinct and join two different vertices.

    A task holds the edges of one unit, `most` at most, and settles a part of them; units with more edges than that
    are settled by blocks that meet each other.
    """
    kind = dict(edges.dtypes)["unit"]
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    rows = edges.select("unit", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col(distance).cast("double").alias("x"), F.col(response).cast("double").alias("y"))
    sizes = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("m"))
    sized = rows.join(sizes, "unit")
    parts = F.ceil(F.col("m") / F.lit(float(TARGETS))).cast("int")
    spread = sized.where(F.col("m") <= most).withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("a", "b"), F.col("parts")) == F.col("part")).select("unit", "part", "a", "b", "x", "y", "own")
    schema = f"unit {kind}, a long, b long, n_training long, hx double, hy double, xx double, xy double, same boolean"
    sums = spread.groupBy("unit", "part").applyInArrow(_settled(least, arrow), schema)
    if not sizes.where(F.col("m") > most).isEmpty():
        sums = sums.unionByName(_by_blocks(sized.where(F.col("m") > most), least, arrow, schema))
    beta = F.when(F.col("xx") > EPS, F.col("xy") / F.when(F.col("xx") > EPS, F.col("xx"))).otherwise(0.0)
    found = sums.withColumn("expected", F.when(F.col("same"), F.col("hx")).otherwise(0.5 + beta * (F.col("hx") - 0.5)))
    found = found.withColumn("observed", F.when(F.col("same"), F.col("hx")).otherwise(F.col("hy"))).withColumn("residual", F.round(F.col("observed") - F.col("expected"), 12))
    return found.select("unit", "a", "b", "n_training", "observed", "expected", "residual", rank01(F.col("residual"), F.col("unit")).alias("turnover"))


# ---- units of any size -------------------------------------------------------------------------


#: Targets whose ranks among a block's edges are taken at once.
FEW = 64


def _partial(unit_type: pa.DataType):
    def run(targets, edges, unit):
        size = np.array([len(v) for v in targets["ex"]])
        ends, n, m = np.cumsum(size), targets["m"] - size, len(edges["a"])
        order = {c: np.argsort(edges[c], kind="stable") for c in "xy"}
        gone = {c: np.concatenate([np.zeros(0), *targets["e" + c]]) for c in "xy"}
        own = {c: _own(gone[c], size, targets[c], targets["r" + c]) / (n + 1) for c in "xy"}
        at = {c: [np.searchsorted(edges[c][order[c]], gone[c], side) for side in ("left", "right")] for c in "xy"}
        xx, xy = np.zeros(len(n)), np.zeros(len(n))
        for i in range(0, len(n), FEW):
            j = min(len(n), i + FEW)
            part = slice(ends[i] - size[i], ends[j - 1])
            row = np.repeat(np.arange(j - i), size[i:j]) * (m + 1)
            d = {}
            for c in "xy":
                # an excluded value lowers all ranks above it by one and those that tie with it by half
                steps = sum(np.bincount(row + x[part], minlength=(j - i) * (m + 1)) for x in at[c])
                below = np.empty((j - i, m))
                below[:, order[c]] = np.cumsum(steps.reshape(j - i, m + 1)[:, :m], 1) / 2
                d[c] = (edges["r" + c] - below) / (n[i:j, None] + 1) - 0.5
            a, b = targets["a"][i:j, None], targets["b"][i:j, None]
            d["x"] *= (edges["a"] != a) & (edges["a"] != b) & (edges["b"] != a) & (edges["b"] != b)
            xx[i:j], xy[i:j] = (d["x"] * d["x"]).sum(1), (d["x"] * d["y"]).sum(1)
        cols = [pa.array([unit["unit"]] * len(n), unit_type), *(pa.array(np.asarray(v, np.int64)) for v in (targets["a"], targets["b"], n)), *(pa.array(v) for v in (own["x"], own["y"], xx, xy))]
        return pa.RecordBatch.from_arrays(cols, ["unit", "a", "b", "n", "hx", "hy", "xx", "xy"])

    return run


def _own(values: np.ndarray, size: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Ranks of `at` less how many of its own excluded values, of which there are `size`, lie below, ties by half."""
    which = np.repeat(np.arange(len(size)), size)
    mine = at[which]
    below = (values < mine) + 0.5 * (values == mine)
    return rank - np.bincount(which, below, len(size))


def _by_blocks(rows: DataFrame, least: int, arrow: pa.DataType, schema: str) -> DataFrame:
    """The same sums, where blocks of targets meet all blocks of their unit's edges."""
    rows = rows.withColumns({"rx": average_rank(F.col("x"), F.col("unit")), "ry": average_rank(F.col("y"), F.col("unit")), "row": F.concat_ws("|", "unit", "a", "b")})
    same = rows.groupBy("unit").agg(F.bool_and(F.col("rx") == F.col("ry")).alias("same"))
    touching = rows.select("unit", F.explode(F.array("a", "b")).alias("v"), F.struct("row", "x", "y").alias("e")).groupBy("unit", "v").agg(F.collect_list("e").alias("es"))
    targets = rows
    for end in ("a", "b"):
        targets = targets.join(touching.withColumnsRenamed({"v": end, "es": f"es_{end}"}), ["unit", end])
    excluded = F.array_distinct(F.concat("es_a", "es_b"))  # the edge itself is in both
    targets = targets.withColumn("ex_", excluded).withColumns({"ex": F.transform("ex_", lambda e: e["x"]), "ey": F.transform("ex_", lambda e: e["y"])})
    targets = targets.where(F.col("m") - F.size("ex") >= least)
    left = blocked(targets, ["unit"], "row", [*COLUMNS, "ex", "ey", "m"], 512)
    right = blocked(rows, ["unit"], "row", COLUMNS, name="block_")
    sums = each_pair(left, right, ["unit"], _partial(arrow), schema.replace("n_training", "n").replace(", same boolean", ""))
    sums = sums.groupBy("unit", "a", "b").agg(F.max("n").alias("n_training"), F.max("hx").alias("hx"), F.max("hy").alias("hy"), F.sum("xx").alias("xx"), F.sum("xy").alias("xy"))
    return sums.join(same, "unit")
