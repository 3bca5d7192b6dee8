"""Variants and diagnostics of the transfer score: many responses at once, transported weights, a unit's own field, breadth."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import rank_direction, spearman
from ..functions.scalars import crossing_probability
from . import nodes, smooth
from .blocks import blocked, each_pair
from .field import DIGITS, TINY, kernel_sums, own_sums, points, training
from .graph import parted


# ---- many response worlds on one geometry --------------------------------------------------------


def world_scores(train: DataFrame, held: DataFrame, bandwidth: float, strength: float = 0.25, prior: float = 0.5) -> DataFrame:
    """(world, unit, n, score): transfer scores of many responses, whose kernel is computed once for all.

    turnover is an array in both edge tables, one number for each world.
    """
    near = nodes.gathered(nodes.weighed(train), bandwidth) if strength > 0 else None
    if near:
        return nodes.unit_scores(held, near, strength, prior, 5, TINY, DIGITS)
    edges = train.select(F.concat_ws("|", "unit", "a", "b").alias("row"), "mid", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("unit"))).alias("w"), F.col("turnover").alias("u"))
    sums = smooth.gaussian_sums(points(held), edges, bandwidth, ["unit", "a", "b"])
    value = F.transform("tops", lambda top: (top + strength * prior) / F.greatest(F.col("low") + strength, F.lit(TINY)))
    each = sums.groupBy("unit", "a", "b").agg(F.collect_list(value).alias("values"))  # a list for each of an edge's points
    mean = lambda k: F.aggregate(F.transform("values", lambda v: F.element_at(v, k + 1)), F.lit(0.0), lambda s, v: s + v) / F.size("values")
    found = each.select("unit", "a", "b", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(F.col("values")[0]) - 1), lambda k: F.round(mean(k), DIGITS))).alias("world", "exposure"))
    response = held.select("unit", "a", "b", F.posexplode("turnover").alias("world", "turnover"))
    return spearman(found.join(response, ["world", "unit", "a", "b"]), "exposure", "turnover", ["world", "unit"], "score")


def increments(base: DataFrame, conditioned: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """(keys, increment): conditioned less base score where both are there; NaN stays NaN."""
    return conditioned.select(*keys, F.col(score).alias("c_")).join(base.select(*keys, F.col(score).alias("b_")), keys).select(*keys, (F.col("c_") - F.col("b_")).alias("increment"))


# ---- weights by sampling density -----------------------------------------------------------------


def transport_weights(train: DataFrame, held: DataFrame, bandwidth: float, mode: str) -> DataFrame:
    """(unit, a, b, weight): training weights from densities of edge midpoints, adding up to 1 in each unit.

    pooled: against the density of all training midpoints; self: against the unit's own; ratio:
    the density of held midpoints over that of training ones. Units count alike in a density.
    """
    at = train.select(F.concat_ws("|", "unit", "a", "b").alias("row"), F.col("unit").cast("string").alias("unit_"), "unit", "a", "b", F.col("mid").alias("at"))
    density = lambda edges: kernel_sums(at, training(edges, "length"), bandwidth)
    if mode == "self":
        own = own_sums(at.withColumnRenamed("unit_", "source"), training(train, "length"), bandwidth)
        raw = at.join(own, "row").select("unit", "a", "b", (1 / F.greatest("low", F.lit(TINY))).alias("raw"))
    else:
        raw = at.join(density(train).select("row", F.greatest("low", F.lit(TINY)).alias("t")), "row").withColumn("raw", 1 / F.col("t"))
        if mode == "ratio":
            raw = raw.join(density(held).select("row", F.greatest("low", F.lit(TINY)).alias("h")), "row").withColumn("raw", F.col("h") / F.col("t"))
        elif mode != "pooled":
            raise ValueError(f"no transport mode {mode}")
    return raw.select("unit", "a", "b", (F.col("raw") / F.sum("raw").over(Window.partitionBy("unit"))).alias("weight"))


def effective_edges(weights: DataFrame) -> DataFrame:
    """(unit, edges, effective): how many equal weights spread as a unit's do."""
    return weights.groupBy("unit").agg(F.count(F.lit(1)).alias("edges"), (F.sum("weight") * F.sum("weight") / F.sum(F.col("weight") * F.col("weight"))).alias("effective"))


# ---- a unit's own field --------------------------------------------------------------------------


def _own_sums(bandwidth: float, unit_type: pa.DataType):
    scale = -0.5 / (bandwidth * bandwidth)

    def run(a, b, unit):
        free = np.ones((len(a["row"]), len(b["row"])), bool)
        for x in ("a", "b"):
            for y in ("a", "b"):
                free &= a[x][:, None] != b[y][None, :]
        d = sum((a["at"][:, c][:, None] - b["mid"][:, c][None, :]) ** 2 for c in range(a["at"].shape[1]))
        k = np.exp(scale * d) * free
        cols = [pa.array([unit["unit"]] * len(k), unit_type), pa.array(a["row"].astype(str).tolist()), pa.array(k @ b["u"]), pa.array(k.sum(1)), pa.array(free.sum(1))]
        return pa.RecordBatch.from_arrays(cols, ["unit", "row", "top", "low", "n"])

    return run


#: Edges of a unit whose own field is one task's, and of them so many at once.
OWN, AT_ONCE = 1024, 64


def _own_fields(edges: DataFrame, bandwidth: float, strength: float, prior: float, least: int, kind: str) -> DataFrame:
    """(unit, exposure, turnover) of the edges of units with OWN edges at most, each unit's in one task."""
    scale, parts = -0.5 / (bandwidth * bandwidth), 5

    def run(table: pa.Table) -> pa.Table:
        m = table.num_rows
        start, end, mid = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(m, -1) for c in ("start", "end", "mid"))
        a, b, u = (table.column(c).to_numpy() for c in ("a", "b", "turnover"))
        out, counts = np.zeros(m), np.zeros(m, np.int64)
        for i in range(0, m, AT_ONCE):
            of = slice(i, i + AT_ONCE)
            free = (a[of, None] != a) & (a[of, None] != b) & (b[of, None] != a) & (b[of, None] != b)
            counts[of] = n = free.sum(1)
            for p in range(parts):
                at = start[of] + (p + 0.5) / parts * (end[of] - start[of])
                k = np.exp(scale * sum((at[:, c, None] - mid[None, :, c]) ** 2 for c in range(at.shape[1]))) * free
                out[of] += (k @ u / np.maximum(n, 1) + strength * prior) / np.maximum(k.sum(1) / np.maximum(n, 1) + strength, TINY)
        some = (counts >= least) & (counts > 0)
        return pa.table({"unit": table.column("unit").filter(pa.array(some)), "exposure": pa.array(out[some] / parts), "turnover": pa.array(u[some])})

    rows = edges.select("unit", "a", "b", "start", "end", "mid", F.col("turnover").cast("double").alias("turnover"))
    return rows.groupBy("unit").applyInArrow(run, f"unit {kind}, exposure double, turnover double")


def self_scores(edges: DataFrame, bandwidth: float, strength: float = 0.25, prior: float = 0.5, least: int = 1, most: int | None = None) -> DataFrame:
    """(unit, n, score): how well a unit's edges are foretold by its own that share no end with them.

    Edges with fewer than `least` such others are left out. A unit of OWN edges or fewer is one task's; larger ones go by blocks.
    most: a number of edges that no unit exceeds, if one is known (graph.parted).
    """
    kind = dict(edges.dtypes)["unit"]
    small, edges = parted(edges.select("unit", "a", "b", "start", "end", "mid", "turnover"), OWN, most)
    fields = _own_fields(small, bandwidth, strength, prior, least, kind).withColumn("exposure", F.round("exposure", DIGITS))
    if edges is None:
        return spearman(fields, "exposure", "turnover", ["unit"], "score")
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    at = points(edges)
    own = edges.select("unit", F.concat_ws("|", "unit", "a", "b").alias("row"), "a", "b", "mid", F.col("turnover").alias("u"))
    pairs = each_pair(blocked(at, ["unit"], "row", ["a", "b", "at"], 1024), blocked(own, ["unit"], "row", ["a", "b", "mid", "u"], name="block_"), ["unit"], _own_sums(bandwidth, arrow), f"unit {kind}, row string, top double, low double, n long")
    sums = pairs.groupBy("unit", "row").agg(F.sum("top").alias("top"), F.sum("low").alias("low"), F.sum("n").alias("n_")).where(F.col("n_") >= least)
    field = (F.col("top") / F.col("n_") + strength * prior) / F.greatest(F.col("low") / F.col("n_") + strength, F.lit(TINY))
    found = at.join(sums.drop("unit"), "row").groupBy("unit", "a", "b").agg(F.round(F.avg(field), DIGITS).alias("exposure"))
    found = found.join(edges.select("unit", "a", "b", "turnover"), ["unit", "a", "b"]).select("unit", "exposure", "turnover")
    return spearman(fields.unionByName(found), "exposure", "turnover", ["unit"], "score")


# ---- geometry-only expectations ------------------------------------------------------------------


def phase_propensity(edges: DataFrame, centre: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """edges with propensity, that a front of uniform phase about the centre parts the ends, and expected, its centred half: the mean of the centred rank of a two-valued turnover."""
    angle = lambda c: F.atan2(F.col(c)[1] - centre[1], F.col(c)[0] - centre[0])
    rows = edges.withColumn("propensity", crossing_probability(angle("start"), angle("end")))
    return rows.withColumn("expected", 0.5 * (F.col("propensity") - F.avg("propensity").over(Window.partitionBy("unit"))))


def pooled_frame(records: DataFrame, dimensions: int) -> DataFrame:
    """(axis, centre, scale): median and standard deviation of every coordinate over all records."""
    rows = records.select(F.posexplode(F.slice("coords", 1, dimensions)).alias("axis", "v"))
    return rows.groupBy("axis").agg(F.median("v").alias("centre"), F.stddev_pop("v").alias("scale"))


def radial_distance(records: DataFrame, edges: DataFrame, dimensions: int = 2) -> DataFrame:
    """(unit, a, b, radius): distance of each midpoint from the unit's median place, in pooled standard deviations."""
    scale = {r["axis"]: r["scale"] or 1.0 for r in pooled_frame(records, dimensions).collect()}  # one row for each axis
    middle = records.groupBy("unit").agg(*(F.median(F.col("coords")[k]).alias(f"m{k}") for k in range(dimensions)))
    z = [(F.col("mid")[k] - F.col(f"m{k}")) / F.lit(scale.get(k, 1.0)) for k in range(dimensions)]
    return edges.join(middle, "unit").select("unit", "a", "b", F.sqrt(sum((v * v for v in z), F.lit(0.0))).alias("radius"))


def _front_contrasts(start: np.ndarray, end: np.ndarray, centre: list[float], ways: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Sum of the contrasts of edges across fronts, and which fronts some edge sees by `least` or more."""
    total, seen = 0.0, np.zeros(ways.shape[1], bool)
    for i in range(0, len(start), 512):
        places, which = np.unique(np.concatenate([start[i : i + 512], end[i : i + 512]]), axis=0, return_inverse=True)
        side, which = np.tanh((places - centre) @ ways), which.reshape(2, -1)
        for j in range(0, which.shape[1], 32):
            v = np.abs(side[which[0, j : j + 32]] - side[which[1, j : j + 32]]) / 2
            total += v.sum()
            seen |= v.max(0) >= least
    return total, seen


def observability(edges: DataFrame, records: DataFrame, directions: int = 2048, width: float = 0.2, least: float = 0.25, seed: int = 20260912) -> DataFrame:
    """(unit, contrast, share): mean contrast of edge ends across seeded random fronts, and the share of fronts that some edge sees by `least` or more.

    Edges of a unit may lie anywhere: every task adds up what its own edges see, a bit for each front. A
    place's side of the fronts is computed once for all edges of its unit that a task has at once.
    """
    kind = dict(edges.dtypes)["unit"]
    frame = {r["axis"]: r for r in pooled_frame(records, 2).collect()}
    centre, scale = ([frame[k][c] if k in frame else 0.0 for k in range(2)] for c in ("centre", "scale"))
    angles = np.random.default_rng(seed).uniform(0, 2 * math.pi, directions)
    ways = np.stack([np.cos(angles), np.sin(angles)]) / (np.array([s or 1.0 for s in scale])[:, None] * width)
    words = -(-directions // 64)

    def run(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            ends = [np.array(pdf[c].to_list(), float).reshape(len(pdf), -1)[:, :2] for c in ("start", "end")]
            for at in pdf.groupby("unit", dropna=False).indices.values():
                total, seen = _front_contrasts(*(e[at] for e in ends), centre, ways, least)
                bits = np.packbits(np.pad(seen, (0, 64 * words - directions)), bitorder="little").view(np.int64)
                unit = batch.column(batch.schema.get_field_index("unit")).take(pa.array(at[:1]))
                yield pa.RecordBatch.from_arrays([unit, pa.array([len(at)], pa.int64()), pa.array([total]), pa.array([bits.tolist()], pa.list_(pa.int64()))], ["unit", "n", "total", "seen"])

    sums = edges.select("unit", "start", "end").mapInArrow(run, f"unit {kind}, n long, total double, seen array<long>")
    found = sums.groupBy("unit").agg((F.sum("total") / F.sum("n") / directions).alias("contrast"), *(F.bit_or(F.col("seen")[i]).alias(f"seen{i}") for i in range(words)))
    share = sum((F.bit_count(f"seen{i}") for i in range(words)), F.lit(0)) / F.lit(float(directions))
    return found.select("unit", "contrast", share.alias("share"))


# ---- breadth and factorization -------------------------------------------------------------------


def breadth(scores: DataFrame, group: str, value: str, least: int) -> DataFrame:
    """(group, n, mean, without, included, balanced, overall): a group's mean, the mean without it, and means over units and over groups of `least` units or more."""
    by = scores.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("s"))
    everything = Window.partitionBy()  # over groups, which are few
    n, s = F.sum("n").over(everything), F.sum("s").over(everything)
    rows = by.withColumns({"without": F.when(n > F.col("n"), (s - F.col("s")) / F.when(n > F.col("n"), n - F.col("n"))), "included": F.col("n") >= least, "overall": s / n})
    return rows.withColumn("balanced", F.avg(F.when(F.col("included"), F.col("mean"))).over(everything)).drop("s")


def expected_rank_correlation(left: DataFrame, right: DataFrame) -> DataFrame:
    """(expected): mean rank correlation of a random left and a random right vector, from draws(draw, entry, value, weight).

    Correlation is the product of rank directions, so the mean over independent draws is the
    product of their mean directions; weights are shares of the draws' total.
    """
    def direction(draws: DataFrame, out: str) -> DataFrame:
        rows = rank_direction(draws, "value", ["draw"], "u")
        total = draws.groupBy("draw").agg(F.max("weight").alias("w")).agg(F.sum("w").alias("total"))
        return rows.crossJoin(F.broadcast(total)).groupBy("entry").agg(F.sum(F.col("u") * F.col("weight") / F.col("total")).alias(out))

    return direction(left, "l").join(direction(right, "r"), "entry").agg(F.sum(F.col("l") * F.col("r")).alias("expected"))


def finite_rows(rows: DataFrame, nodata: dict[str, float]) -> DataFrame:
    """Rows whose named columns are neither null nor NaN nor their layer's mark for no data."""
    ok: Column = F.lit(True)
    for c, mark in nodata.items():
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.col(c) != mark)
    return rows.where(ok)
