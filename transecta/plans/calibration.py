"""Calibration: how often a held-out test rejects over a grid of sharedness and amplitude, in seeded worlds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_key, wilson
from ..operators import field, graph, inference, worlds
from .transfer import TransferPlan

INFERENCE = ("heldout_bootstrap", "trait_permutation")


def _roles(records: DataFrame, group: str, master: int) -> DataFrame:
    """(unit, group, role): half of each group's units in hash order are training units."""
    units = records.select("unit", group).distinct()
    key = hash_key("split", F.lit(master), F.col("unit"))
    w = Window.partitionBy(group)
    place, n = F.row_number().over(w.orderBy(key, "unit")), F.count(F.lit(1)).over(w)
    return units.withColumn("role", F.when(place <= F.floor(n / 2), "train").otherwise("held"))


def group_scores(records: DataFrame, group: str, plan: TransferPlan, master: int = 0) -> DataFrame:
    """(group, unit, n, score) of the held units of every group, each group a world of its own whose units have names of their own."""
    edges = graph.neighbour_table(records, plan.k)
    rows = edges.join(_roles(records, group, master), "unit")
    train, held = (rows.where(F.col("role") == r).drop("role") for r in ("train", "held"))
    return field.grouped_scores(train, held, group, plan.bandwidth, plan.strength, plan.prior, plan.segment_points)


def world_tests(records: DataFrame, group: str, plan: TransferPlan, method: str = INFERENCE[0], resamples: int = 199, master: int = 0) -> DataFrame:
    """(group, statistic, p) of every group's test: of the mean held score against 0 by bootstrap, or against shuffled traits on the same graph."""
    if method not in INFERENCE:
        raise ValueError(f"no inference {method}")
    if method == INFERENCE[0]:
        tests = inference.bootstrap_test(group_scores(records, group, plan, master), "score", [group], resamples, master)
        return tests.select(group, F.col("mean").alias("statistic"), "p")
    drawn = inference.permuted(records.select("unit", group, "i", "coords", "trait"), resamples, ["unit"], "trait", master).withColumn("replicate", F.col("replicate") + 1)
    all_ = records.select("unit", group, "i", "coords", "trait").withColumn("replicate", F.lit(0)).unionByName(drawn)
    named = all_.withColumns({"world_": F.concat_ws("#", group, "replicate"), "unit": F.concat_ws("#", "unit", "replicate")})
    # a unit's role does not depend on the shuffle
    roles = _roles(records, group, master).select(F.col("unit").alias("plain_"), "role")
    edges = graph.neighbour_table(named, plan.k).withColumn("plain_", F.regexp_extract("unit", r"^(.*)#\d+$", 1)).join(roles, "plain_")
    edges = edges.join(named.select("unit", "world_", group, "replicate").distinct(), "unit")
    train, held = (edges.where(F.col("role") == r).drop("role", "plain_") for r in ("train", "held"))
    scores = field.grouped_scores(train, held, "world_", plan.bandwidth, plan.strength, plan.prior, plan.segment_points)
    stats = scores.where(~F.isnan("score")).groupBy("world_").agg(F.avg("score").alias("s"))
    stats = stats.join(named.select("world_", group, "replicate").distinct(), "world_")
    seen = stats.where("replicate = 0").select(group, F.col("s").alias("statistic"))
    null = stats.where("replicate > 0").join(seen, group).groupBy(group).agg(((1 + F.count_if(F.col("s") >= F.col("statistic"))) / (1 + F.count(F.lit(1)))).alias("p"))
    return seen.join(null, group)


def grid(
    spark: SparkSession, shared: list[float], amplitudes: list[float], replicates: int, plan: TransferPlan, master: int = 20260907, units: int = 40, records: int = 60,
    method: str = INFERENCE[0], resamples: int = 199, alpha: float = 0.05,
) -> DataFrame:
    """(shared_fraction, amplitude, replicates, rejections, statistic, low, high) of every cell of the grid, with the rejection rate's Wilson bounds.

    Worlds are drawn in workers, each by a seed of its cell and number, and all are scored in one job.
    """
    cells = [{"shared": s, "amplitude": a} for s in shared for a in amplitudes]
    drawn = worlds.worlds(spark, cells, replicates, master, units, records)
    drawn = drawn.withColumn("world", F.concat_ws("|", "config", "world")).withColumn("unit", F.concat_ws("|", "world", "unit"))
    tests = world_tests(drawn, "world", plan, method, resamples, master).withColumn("config", F.split("world", r"\|")[0].cast("int"))
    names = spark.createDataFrame([(k, float(c["shared"]), float(c["amplitude"])) for k, c in enumerate(cells)], "config int, shared_fraction double, amplitude double")
    found = tests.groupBy("config").agg(F.count(F.lit(1)).alias("replicates"), F.count_if(F.col("p") <= alpha).alias("rejections"), F.avg("statistic").alias("statistic"))
    low, high = wilson(F.col("rejections"), F.col("replicates"))
    return found.join(F.broadcast(names), "config").select("shared_fraction", "amplitude", "replicates", "rejections", "statistic", low.alias("low"), high.alias("high"))  # a row for each cell
