"""Fronts with a direction: where the relation of two states changes most, and on which side they differ more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import rank01
from ..functions.scalars import dissimilarity, relative_state
from . import graph, inference
from .diagnostics import world_scores

TINY = 2.2250738585072014e-308


def weighted_median(rows: DataFrame, value: str, weight: str, by: list[str], out: str = "median") -> DataFrame:
    """(by, out): the least value at which the running sum of weights reaches half of their total; the plain median where all weights are 0."""
    sums = rows.groupBy(*by, value).agg(F.sum(weight).alias("w_"))
    run = F.sum("w_").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("w_").over(Window.partitionBy(*by))
    reached = sums.withColumns({"run_": run, "total_": total}).groupBy(*by).agg(F.min(F.when(F.col("run_") >= 0.5 * F.col("total_"), F.col(value))).alias("m_"), F.max("total_").alias("total_"))
    plain = rows.groupBy(*by).agg(F.median(value).alias("p_"))
    return reached.join(plain, by).select(*by, F.when(F.col("total_") > TINY, F.col("m_")).otherwise(F.col("p_")).alias(out))


def paired_edges(records: DataFrame, edges: DataFrame, mismatch: Column | None = None, relation: Column | None = None) -> DataFrame:
    """edges with start, end, mid, length, difference (of the relation, raw) and turnover, an array of the turnovers of mismatch and of relation.

    records(unit, i, coords, state_a, state_b), and orientation where it is wanted: middle_orientation is the ends'
    mean. The mismatch of a record's states is their distance and their relation the vector between them,
    unless columns over records say otherwise.
    """
    ends = _states(records, mismatch, relation).select("unit", "i", "coords", "m", "r", "g")
    rows = edges.select("unit", "a", "b").join(ends.toDF("unit", "a", "start", "m_a", "r_a", "g_a"), ["unit", "a"]).join(ends.toDF("unit", "b", "end", "m_b", "r_b", "g_b"), ["unit", "b"])
    return _paired(rows)


def neighbour_pairs(records: DataFrame, k: int = 4, mismatch: Column | None = None, relation: Column | None = None) -> DataFrame:
    """paired_edges() of the k nearest neighbours, whose edges bring their ends along."""
    rows = graph.knn_edges(_states(records, mismatch, relation), k, carry=["coords", "m", "r", "g"])
    ends = [F.col(f"{x}.{c}").alias(name) for x, end, first in (("l", "a", "start"), ("r", "b", "end")) for c, name in (("coords", first), ("m", f"m_{end}"), ("r", f"r_{end}"), ("g", f"g_{end}"))]
    return _paired(rows.select("unit", "a", "b", *ends))


def _states(records: DataFrame, mismatch: Column | None, relation: Column | None) -> DataFrame:
    """(unit, i, coords, m, r, g): a record's mismatch, relation and orientation."""
    m = dissimilarity(F.col("state_a"), F.col("state_b"), True) if mismatch is None else mismatch
    r = relative_state(F.col("state_a"), F.col("state_b")) if relation is None else relation
    oriented = F.col("orientation") if "orientation" in records.columns else F.lit(None).cast("double")
    return records.select("unit", "i", "coords", m.alias("m"), r.alias("r"), oriented.alias("g"))


def _paired(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"by_mismatch": F.abs(F.col("m_a") - F.col("m_b")), "difference": dissimilarity(F.col("r_a"), F.col("r_b"), True)})
    turnover = F.array(rank01(F.col("by_mismatch"), F.col("unit")), rank01(F.col("difference"), F.col("unit")))
    return rows.withColumn("turnover", turnover).select(
        "unit", "a", "b", "start", "end", F.zip_with("start", "end", lambda x, y: (x + y) / 2).alias("mid"), dissimilarity(F.col("start"), F.col("end"), True).alias("length"),
        "difference", ((F.col("g_a") + F.col("g_b")) * 0.5).alias("middle_orientation"), "turnover",
    )


def front_centre(edges: DataFrame, fraction: float = 0.15) -> DataFrame:
    """(units, centre): median over units of where their front lies: the weighted median orientation of a unit's edges of greatest raw difference.

    A unit gives its `fraction` of edges, three at least; of equal differences the later edge comes first.
    """
    w = Window.partitionBy("unit")
    place = F.row_number().over(w.orderBy(F.desc("difference"), F.desc("a"), F.desc("b")))
    top = edges.withColumns({"place_": place, "n_": F.count(F.lit(1)).over(w)}).where(F.col("place_") <= F.greatest(F.lit(3), F.ceil(F.lit(fraction) * F.col("n_"))))
    by = weighted_median(top, "middle_orientation", "difference", ["unit"], "centre")
    return by.agg(F.count(F.lit(1)).alias("units"), F.median("centre").alias("centre"))


def oriented_deltas(records: DataFrame, centre: DataFrame, window: float, least: int = 4) -> DataFrame:
    """(unit, before, after, delta): mean mismatch just after the centre less that just before it, for units with `least` records on each side.

    records(unit, orientation, mismatch); centre(centre) is one row. A record at the centre is on neither side.
    """
    rows = records.crossJoin(F.broadcast(centre.select("centre")))  # one row
    low = (F.col("orientation") >= F.col("centre") - window) & (F.col("orientation") < F.col("centre"))
    high = (F.col("orientation") > F.col("centre")) & (F.col("orientation") <= F.col("centre") + window)
    found = rows.groupBy("unit").agg(F.count_if(low).alias("before"), F.count_if(high).alias("after"), (F.avg(F.when(high, F.col("mismatch"))) - F.avg(F.when(low, F.col("mismatch")))).alias("delta"))
    return found.where((F.col("before") >= least) & (F.col("after") >= least))


def paired_test(scores: DataFrame, resamples: int = 1999, seed: int = 0) -> DataFrame:
    """(estimand, n, mean, t, p) of scores(world, unit, score): world 0 is mismatch, 1 coupling, each with its own null."""
    parts = [inference.bootstrap_test(scores.where(F.col("world") == k).withColumn("estimand", F.lit(name)), "score", ["estimand"], resamples, seed + k) for k, name in enumerate(("mismatch", "coupling"))]
    return parts[0].unionByName(parts[1])


def directional_test(train: DataFrame, held: DataFrame, records: DataFrame, bandwidth: float, window: float, fraction: float = 0.15, agree: float = 0.75, alpha: float = 0.05, resamples: int = 1999, seed: int = 0) -> DataFrame:
    """(centre, n, coupling_p, breakdown_p, recoupling_p, positive, negative, detected, breakdown, recoupling): one row.

    train and held are paired_edges() of disjoint units; records(unit, orientation, mismatch) those of the held ones. A
    label needs a transferable relation front, a contrast of one sign and so many units that agree with it.
    """
    coupling = paired_test(world_scores(train, held, bandwidth), resamples, seed).where("estimand = 'coupling'").select(F.col("p").alias("coupling_p"))
    centre = front_centre(train, fraction)
    deltas = oriented_deltas(records, centre, window).withColumns({"one": F.lit(1), "minus": -F.col("delta")})
    down = inference.bootstrap_test(deltas, "delta", ["one"], resamples, seed + 10_000).select("n", F.col("p").alias("breakdown_p"))
    up = inference.bootstrap_test(deltas, "minus", ["one"], resamples, seed + 20_000).select(F.col("p").alias("recoupling_p"))
    shares = deltas.agg(F.avg((F.col("delta") > 0).cast("double")).alias("positive"), F.avg((F.col("delta") < 0).cast("double")).alias("negative"))
    row = centre.select("centre").crossJoin(coupling).crossJoin(down).crossJoin(up).crossJoin(shares)  # one row each
    row = row.withColumn("detected", F.col("coupling_p") < alpha)
    return row.withColumns({
        "breakdown": F.col("detected") & (F.col("breakdown_p") < alpha) & (F.col("positive") >= agree),
        "recoupling": F.col("detected") & (F.col("recoupling_p") < alpha) & (F.col("negative") >= agree),
    })
