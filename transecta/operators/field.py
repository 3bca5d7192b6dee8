"""Kernel fields: responses of training edges, smoothed over space, scored on edges of other units.

The field at x is (sum w K u + strength * prior) / max(sum w K + strength, tiny) with
K = exp(-d * d / (2 h * h)) and w = 1 / edges of the training unit. There is no cut-off: sums at many points
come from sums over every training edge at the nodes of their cells (smooth), and only sums leave a task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import spearman
from ..sources.shared import kept
from . import nodes, pairwise, smooth
from .blocks import BLOCK, blocked, each_pair, stored

TINY = 2.2250738585072014e-308
DIGITS = 12  # of exposures before they are ranked, so that the order of additions does not part ties


def training(edges: DataFrame, response: str = "turnover") -> DataFrame:
    """(row, unit, mid, w, u): one row for each training edge, each unit with total weight 1."""
    w = 1.0 / F.count(F.lit(1)).over(Window.partitionBy("unit"))
    return edges.select(F.concat_ws("|", "unit", "a", "b").alias("row"), F.col("unit").cast("string").alias("source"), "mid", w.alias("w"), F.col(response).cast("double").alias("u"))


def points(edges: DataFrame, segment_points: int = 5) -> DataFrame:
    """(row, unit, a, b, p, at): the midpoints of equal parts of each edge."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(segment_points - 1)), lambda i: (i + 0.5) / F.lit(float(segment_points)))
    rows = edges.select("unit", "a", "b", "start", "end", F.posexplode(steps).alias("p", "t"))
    at = F.zip_with("start", "end", lambda x, y: x + F.col("t") * (y - x))
    return rows.select(F.concat_ws("|", "unit", "a", "b", "p").alias("row"), "unit", "a", "b", "p", at.alias("at"))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


def _sums(bandwidth: float, by_source: bool):
    scale = -0.5 / (bandwidth * bandwidth)

    def run(a, b, _):
        rows, sources, top, low = [], [], [], []
        names, which = np.unique(b["source"].astype(str) if by_source else np.full(len(b["w"]), ""), return_inverse=True)
        share = np.zeros((len(which), len(names) if by_source else 1))
        share[np.arange(len(which)), which if by_source else 0] = b["w"]
        for i in range(0, len(a["row"]), 512):
            d = np.zeros((min(512, len(a["row"]) - i), len(which)))
            for c in range(a["at"].shape[1]):
                step = a["at"][i : i + 512, c][:, None] - b["mid"][:, c][None, :]
                d += step * step
            k = np.exp(scale * d)
            low.append(k @ share)
            top.append(k @ (share * b["u"][:, None]))
        low, top = np.concatenate(low), np.concatenate(top)
        n = len(names) if by_source else 1
        rows = np.repeat(a["row"].astype(str), n)
        sources = np.tile(names, len(a["row"])) if by_source else np.full(len(rows), "")
        return pa.RecordBatch.from_arrays([pa.array(rows.tolist()), pa.array(sources.tolist()), pa.array(top.ravel()), pa.array(low.ravel())], ["row", "source", "top", "low"])

    return run


def kernel_sums(at: DataFrame, train: DataFrame, bandwidth: float, by_source: bool = False) -> DataFrame:
    """(row, source, top, low): sums of w K u and w K at each point over the training edges, by source unit or over all."""
    if not by_source:
        found = smooth.gaussian_sums(at, train.withColumn("u", F.array("u")), bandwidth, ["row"])
        return found.select("row", F.lit("").alias("source"), F.col("tops")[0].alias("top"), "low")
    # a source's edges lie in as few blocks as they fill, so that each block gives few sums to a point
    n = F.count(F.lit(1)).over(Window.partitionBy("source"))
    edges, row = train.withColumn("part", F.concat_ws("|", "source", F.pmod(F.xxhash64("row"), F.ceil(n / BLOCK)))), "part"
    a, b = blocked(at, [], "row", ["at"]), blocked(edges, [], row, ["source", "mid", "w", "u"], name="block_")
    found = each_pair(a, b, [], _sums(bandwidth, by_source), "row string, source string, top double, low double")
    return found.groupBy("row", "source").agg(F.sum("top").alias("top"), F.sum("low").alias("low"))


def own_sums(at: DataFrame, train: DataFrame, bandwidth: float, by_source: bool = False) -> DataFrame:
    """(row, top, low), by source too if asked for, of kernel_sums() with each point, at(row, source, at), meeting only its own source's edges."""
    a, b = blocked(at, ["source"], "row", ["at"]), blocked(train, ["source"], "row", ["mid", "w", "u"], name="block_")

    def run(x, y, unit):
        out = _sums(bandwidth, False)(x, y, unit)
        return out.set_column(1, "source", pa.array([unit["source"]] * out.num_rows, pa.string()))

    found = each_pair(a, b, ["source"], run, "row string, source string, top double, low double")
    return found.groupBy("row", *["source"] * by_source).agg(F.sum("top").alias("top"), F.sum("low").alias("low"))


def exposures(at: DataFrame, sums: DataFrame, strength: float, prior: float, keys: list[str]) -> DataFrame:
    """Mean over its points of the field along each edge, by keys, from sums(row, top, low)."""
    field = (F.col("top") + strength * prior) / F.greatest(F.col("low") + strength, F.lit(TINY))
    return at.join(sums, "row").groupBy(*keys).agg(F.round(F.avg(field), DIGITS).alias("exposure"))


def transfer_scores(train: DataFrame, held: DataFrame, bandwidth: float, strength: float = 0.25, prior: float = 0.5, segment_points: int = 5, response: str = "turnover") -> DataFrame:
    """(unit, n, score): rank correlation of exposure and turnover for each unit of `held` edges; NaN under three edges."""
    near = nodes.gathered(nodes.weighed(train, response), bandwidth) if strength > 0 else None
    if near:
        return nodes.unit_scores(held, near, strength, prior, segment_points, TINY, DIGITS, response).select("unit", "n", "score")
    sums = smooth.gaussian_sums(points(held, segment_points), training(train, response).withColumn("u", F.array("u")), bandwidth, ["unit", "a", "b"])
    field = (F.col("tops")[0] + strength * prior) / F.greatest(F.col("low") + strength, F.lit(TINY))
    found = sums.groupBy("unit", "a", "b").agg(F.round(F.avg(field), DIGITS).alias("exposure"))
    return spearman(found.join(held.select("unit", "a", "b", response), ["unit", "a", "b"]), "exposure", response, ["unit"], "score")


def response_scores(train: DataFrame, held: DataFrame, bandwidth: float, responses: dict[str, float], strength: float = 0.25, segment_points: int = 5) -> DataFrame:
    """(unit, a column for each response): transfer_scores() of the held units' turnover under fields of several training responses, each with its prior, from one geometry."""
    near = nodes.gathered(nodes.weighed(train.withColumn("u_", F.array(*(F.col(c).cast("double") for c in responses))), "u_"), bandwidth) if strength > 0 else None
    if near:
        scores = nodes.unit_scores(held, near, strength, list(responses.values()), segment_points, TINY, DIGITS)
        return scores.groupBy("unit").agg(*(F.max(F.when(F.col("world") == k, F.col("score"))).alias(c) for k, c in enumerate(responses)))
    plain = lambda c: train.withColumn("turnover", F.col(c))
    each = [transfer_scores(plain(c), held, bandwidth, strength, prior, segment_points).select("unit", F.col("score").alias(c)) for c, prior in responses.items()]
    return reduce(lambda x, y: x.join(y, "unit"), each)


def statistic(scores: DataFrame, score: str = "score") -> DataFrame:
    """(units, statistic): mean of the finite scores."""
    finite = scores.where(~F.isnan(score) & F.col(score).isNotNull())
    return finite.agg(F.count(F.lit(1)).alias("units"), F.avg(score).alias("statistic"))


def pool_sums(held: DataFrame, edges: DataFrame, pool: DataFrame, bandwidth: float, segment_points: int = 5) -> DataFrame:
    """(unit, a, b, p, top, low): kernel sums where each point of held edges meets only the edges of its unit's sources, pool(target, source, scale)."""
    kinds = dict(held.dtypes)
    ours = pool.select(F.col("target").cast(kinds["unit"]).alias("unit"), F.col("source").cast("string").alias("source"), "scale")
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("unit", "a", "b")) + ", p int, top double, low double"
    found = pairwise.each(held, ["a", "b", "start", "end"], edges, pairwise.scaled(bandwidth, segment_points, _arrow(kinds["unit"])), schema, ours)
    return found.groupBy("unit", "a", "b", "p").agg(F.sum("top").alias("top"), F.sum("low").alias("low"))


def pooled_transfer_scores(train: DataFrame, held: DataFrame, pool: DataFrame, bandwidth: float, strength: float = 0.25, prior: float = 0.5, segment_points: int = 5) -> DataFrame:
    """transfer_scores() where a target's field comes from its own sources, pool(target, source).

    A target's sources are weighted by all training units over the pool's, so that the strength
    of the prior means the same. Only points and edges of a pool meet.
    """
    edges = training(train)
    n = edges.agg(F.countDistinct("source").alias("n_train"))
    sizes = pool.groupBy("target").agg(F.count(F.lit(1)).alias("n_pool")).crossJoin(F.broadcast(n))  # one row
    scaled = pool.join(sizes, "target").select("target", "source", (F.col("n_train") / F.col("n_pool")).alias("scale"))
    near = nodes.gathered(nodes.weighed(train), bandwidth) if strength > 0 else None
    kind = dict(held.dtypes)["unit"]
    ours = scaled.select(F.col("target").cast(kind).alias("unit"), F.col("source").cast("string").alias("source"), "scale")
    found = nodes.pooled_scores(held, edges, ours, near, strength, prior, segment_points, TINY, DIGITS) if near else None
    if found is not None:
        return found
    field = (F.col("top") + strength * prior) / F.greatest(F.col("low") + strength, F.lit(TINY))
    found = pool_sums(held, edges, scaled, bandwidth, segment_points).groupBy("unit", "a", "b").agg(F.round(F.avg(field), DIGITS).alias("exposure"))
    return spearman(found.join(held.select("unit", "a", "b", "turnover"), ["unit", "a", "b"]), "exposure", "turnover", ["unit"], "score")


def pair_scores(train: DataFrame, held: DataFrame, bandwidth: float, strength: float = 0.25, prior: float = 0.0, segment_points: int = 5, pairs: DataFrame | None = None) -> DataFrame:
    """(unit, source, n, score): score of each held unit's edges under the field of each single source unit, or of those of pairs(unit, source) only."""
    ours = None if pairs is None else pairs.select("unit", F.col("source").cast("string").alias("source"), F.lit(1.0).alias("scale")).distinct()
    kind = dict(held.dtypes)["unit"]
    run = pairwise.scores(bandwidth, strength, prior, segment_points, TINY, DIGITS, _arrow(kind), False)
    return pairwise.each(held, ["turnover", "start", "end"], training(train), run, f"unit {kind}, source string, n long, score double", ours)


def _by_block(bandwidth: float):
    """Reductions of w K over the points of one block, by source, and over the sources of the other, by point.

    Sources that lie in one block whole are reduced here: their shares of each point's mass to (source, sum, largest),
    their masses to (row, squares). Of others each point's mass is given, to be added up first.
    """
    def run(a, b, _):
        names, which, count = np.unique(b["source"].astype(str), return_inverse=True, return_counts=True)
        whole = np.zeros(len(names), bool)
        whole[which] = b["whole"].astype(bool)
        groups, mass = np.split(np.argsort(which, kind="stable"), np.cumsum(count)[:-1]), a["mass"][:, None]
        total, most, squares, parts = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(mass)), []
        for k, end, sums in pairwise.kernels(a["at"], b["mid"], b["w"][:, None], groups, bandwidth):
            low = sums[:, :, 0]
            shares = np.divide(low, mass, out=np.zeros_like(low), where=mass > 0)
            total[k:end], most[k:end] = shares.sum(0), shares.max(0)
            squares += (low[:, whole[k:end]] ** 2).sum(1)
            parts.append(low[:, ~whole[k:end]])
        parts = np.concatenate(parts, 1)
        rows, left = a["row"].astype(str).tolist(), names[~whole].tolist()
        done = names[whole].tolist()
        cols = [
            pa.array([None] * len(done) + rows + np.repeat(rows, len(left)).tolist(), pa.string()), pa.array(done + [None] * len(rows) + left * len(rows), pa.string()),
            pa.array(np.concatenate([total[whole], squares, parts.ravel()])), pa.array(np.concatenate([most[whole], np.zeros(len(squares) + parts.size)])),
        ]
        return pa.RecordBatch.from_arrays(cols, ["row", "source", "x", "most"])

    return run


def _spread(at: DataFrame, train: DataFrame, bandwidth: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(by point, by source, points): (row, mass, squares) of each point, (source, total, most) shares of each source, and how many points there are.

    Two passes over the kernel: masses of points, then what _by_block() gives; a row for each point and source is made
    only of sources with more than BLOCK edges.
    """
    edges = training(train)
    mass = kernel_sums(at, edges, bandwidth).select("row", F.col("low").alias("mass"))
    n = F.count(F.lit(1)).over(Window.partitionBy("source"))
    dealt = edges.withColumns({"whole": (n <= BLOCK).cast("int"), "part": F.concat_ws("|", "source", F.pmod(F.xxhash64("row"), F.ceil(n / BLOCK)))})
    points_ = kept(at.select("row", "at").join(mass, "row"), "masses")
    a, b = pairwise.blocked(points_, [], "row", ["at", "mass"], pairwise.POINTS), pairwise.blocked(dealt, [], "part", ["source", "mid", "w", "whole"], pairwise.TRAIN, "block_")
    found = kept(each_pair(a, b, [], _by_block(bandwidth), "row string, source string, x double, most double"), "shares")
    parts = found.where("row IS NOT NULL AND source IS NOT NULL").groupBy("row", "source").agg(F.sum("x").alias("low")).join(points_.select("row", "mass"), "row")
    share = F.when(F.col("mass") > 0, F.col("low") / F.when(F.col("mass") > 0, F.col("mass"))).otherwise(0.0)
    by_source = found.where("row IS NULL").select("source", F.col("x").alias("total"), "most").unionByName(parts.select("source", share.alias("total"), share.alias("most")))
    by_source = by_source.groupBy("source").agg(F.sum("total").alias("total"), F.max("most").alias("most"))
    squares = found.where("source IS NULL").select("row", "x").unionByName(parts.select("row", (F.col("low") * F.col("low")).alias("x"))).groupBy("row").agg(F.sum("x").alias("squares"))
    return points_.select("row", "mass").join(squares, "row"), by_source, points_.agg(F.count(F.lit(1)).alias("points"))


def training_leverage(train: DataFrame, held: DataFrame, bandwidth: float) -> DataFrame:
    """(source, mean_share, max_share): a training unit's share of the kernel mass at the held edges' points."""
    near = nodes.gathered(nodes.weighed(train.withColumn("u_", F.lit(0.0)), "u_"), bandwidth)
    if near:
        found = pairwise.each(held, ["start", "end"], training(train.withColumn("u_", F.lit(0.0)), "u_"), pairwise.shares(bandwidth, 5, near.at), "source string, total double, most double")
        by_source = found.groupBy("source").agg(F.sum("total").alias("total"), F.max("most").alias("most"))
        count = held.agg((5 * F.count(F.lit(1))).alias("points"))
    else:
        _, by_source, count = _spread(points(held), train, bandwidth)
    return by_source.crossJoin(F.broadcast(count)).select("source", (F.col("total") / F.col("points")).alias("mean_share"), F.col("most").alias("max_share"))  # one row


def support_overlap(train: DataFrame, held: DataFrame, bandwidth: float) -> DataFrame:
    """(unit, mean_opportunity, effective_sources): kernel mass at a unit's points and how many sources share it."""
    near = nodes.gathered(nodes.weighed(train.withColumn("u_", F.lit(0.0)), "u_"), bandwidth)
    cells = nodes.cells_along(held, bandwidth, 5) if near else None
    if cells:
        sources = stored(training(train.withColumn("u_", F.lit(0.0)), "u_").select("source", "mid", "w"), "source", pairwise.TRAIN // 4, held.sparkSession.sparkContext.defaultParallelism)
        products, kind = nodes.squares(sources, cells, bandwidth, held.sparkSession), dict(held.dtypes)["unit"]

        def run(table: pa.Table) -> pa.Table:
            x = nodes.steps_of(nodes.matrix(table.column("start")), nodes.matrix(table.column("end")), 5)
            mass, squares = near.at(x)[:, 0], np.zeros(len(x))
            for cell, rows in nodes.cells_of(x, bandwidth):
                for i in range(0, len(rows), nodes.STEP):
                    base = smooth.basis(x[rows[i : i + nodes.STEP]], np.array(cell), bandwidth)
                    squares[rows[i : i + nodes.STEP]] = ((base @ products[cell]) * base).sum(1)
            effective = np.divide(mass * mass, squares, out=np.zeros(len(x)), where=squares > 0)
            return pa.table({"unit": table.column("unit").slice(0, 1), "mean_opportunity": [mass.mean()], "effective_sources": [effective.mean()]})

        return held.select("unit", "start", "end").groupBy("unit").applyInArrow(run, f"unit {kind}, mean_opportunity double, effective_sources double")
    at = points(held)
    by_point, _, _ = _spread(at, train, bandwidth)
    effective = F.when(F.col("squares") > 0, F.col("mass") * F.col("mass") / F.when(F.col("squares") > 0, F.col("squares"))).otherwise(0.0)
    return at.select("row", "unit").join(by_point, "row").groupBy("unit").agg(F.avg("mass").alias("mean_opportunity"), F.avg(effective).alias("effective_sources"))


def leave_one_out(train: DataFrame, held: DataFrame, bandwidth: float, strength: float = 0.25, prior: float = 0.5) -> DataFrame:
    """(source, units, statistic): the mean score of the held units when a training unit is left out, its own sums taken off the total's."""
    edges, kind = training(train), dict(held.dtypes)["unit"]
    near = nodes.gathered(nodes.weighed(train), bandwidth) if strength > 0 else None
    if near:
        run = pairwise.scores(bandwidth, strength, prior, 5, TINY, DIGITS, _arrow(kind), True, near.at)
        return _left_out(pairwise.each(held, ["turnover", "start", "end"], edges, run, f"unit {kind}, source string, n long, score double"))
    total = smooth.gaussian_sums(points(held), edges.withColumn("u", F.array("u")), bandwidth, ["unit", "a", "b", "p"])
    total = total.groupBy("unit", "a", "b").agg(F.sort_array(F.collect_list(F.struct("p", F.col("tops")[0].alias("top"), "low"))).alias("x"))  # an edge's points
    both = held.join(total.select("unit", "a", "b", F.col("x.top").alias("tops"), F.col("x.low").alias("lows")), ["unit", "a", "b"])
    run = pairwise.scores(bandwidth, strength, prior, 5, TINY, DIGITS, _arrow(kind), True)
    return _left_out(pairwise.each(both, ["turnover", "start", "end", "tops", "lows"], edges, run, f"unit {kind}, source string, n long, score double"))


def _left_out(scores: DataFrame) -> DataFrame:
    return scores.where(~F.isnan("score")).groupBy("source").agg(F.count(F.lit(1)).alias("units"), F.avg(F.round("score", 6)).alias("statistic"))


def grouped_scores(train: DataFrame, held: DataFrame, group: str, bandwidth: float, strength: float = 0.25, prior: float = 0.5, segment_points: int = 5) -> DataFrame:
    """(group, unit, n, score): transfer_scores() of many worlds at once, where held units meet the training edges of their own group only. Unit names are unique over all groups."""
    at = points(held, segment_points).join(held.select("unit", group).distinct(), "unit").withColumn("source", F.col(group).cast("string"))
    w = 1.0 / F.count(F.lit(1)).over(Window.partitionBy("unit"))
    edges = train.select(F.concat_ws("|", "unit", "a", "b").alias("row"), F.col(group).cast("string").alias("source"), "mid", w.alias("w"), F.col("turnover").alias("u"))
    found = exposures(at, own_sums(at, edges, bandwidth), strength, prior, [group, "unit", "a", "b"])
    return spearman(found.join(held.select("unit", "a", "b", "turnover"), ["unit", "a", "b"]), "exposure", "turnover", [group, "unit"], "score")
