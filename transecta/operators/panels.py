"""Panels of units: hash-ordered choice, caps, splits and thinning, and ledgers of why rows are left out."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import EARTH_KM, ecef_km, hash_key, haversine_km
from ..sources.shared import kept
from .graph import parted


def ledger(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """rows with status: the name of the first rule that a row fails, else eligible. A rule that is null fails."""
    status = F.lit("eligible")
    for name, ok in reversed(rules):
        status = F.when(F.coalesce(ok, F.lit(False)), status).otherwise(F.lit(name))
    return rows.withColumn("status", status)


def hash_order(rows: DataFrame, tag: str, name: str) -> DataFrame:
    """rows with their hash key and place, from 1, in its order.

    Keys are dealt by their first three digits, and the counts of those 4096 ranges give each its start, so
    that no task sees all rows.
    """
    keyed = rows.withColumn("key", hash_key(tag, F.col(name))).withColumn("part_", F.substring("key", 1, 3))
    sizes = keyed.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(F.substring("part_", 1, 0)).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    starts = sizes.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    inside = F.row_number().over(Window.partitionBy("part_").orderBy("key", name))
    return keyed.withColumn("place", inside).join(starts, "part_").withColumn("place", F.col("place") + F.col("start_")).drop("part_", "start_")


def capped(rows: DataFrame, tag: str, name: str, most: int) -> DataFrame:
    """The first rows in hash order."""
    return rows.withColumn("key", hash_key(tag, F.col(name))).orderBy("key", name).limit(most)


def half_split(units: DataFrame, tag: str, name: str = "unit", fraction: float = 0.5) -> DataFrame:
    """units with role train for the first part in hash order and held for the rest."""
    n = units.agg(F.count(F.lit(1)).alias("n_"))
    role = F.when(F.col("place") <= F.floor(F.col("n_") * fraction), "train").otherwise("held")
    return hash_order(units, tag, name).crossJoin(F.broadcast(n)).withColumn("role", role).drop("place", "n_")  # one row


def stratified_split(units: DataFrame, tag: str, name: str, group: str, fraction: float = 0.5) -> DataFrame:
    """units with role by hash order within each group."""
    keyed = units.withColumn("key", hash_key(tag, F.col(name)))
    place, n = F.row_number().over(Window.partitionBy(group).orderBy("key", name)), F.count(F.lit(1)).over(Window.partitionBy(group))
    return keyed.withColumn("role", F.when(place <= F.floor(n * fraction), "train").otherwise("held"))


def one_per_group(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("place_", place).where("place_ = 1").drop("place_")


def retained(rows: DataFrame, tag: str, unit: str, name: str, fractions: list[float], least: int) -> DataFrame:
    """(rows, level): for each fraction the first ceil(f * n) in hash order within a unit, `least` at least; smaller levels lie in larger ones."""
    place = F.row_number().over(Window.partitionBy(unit).orderBy(hash_key(tag, F.col(unit), F.col(name)), name))
    n = F.count(F.lit(1)).over(Window.partitionBy(unit))
    levels = F.explode(F.array(*(F.lit(float(f)) for f in fractions)))
    out = rows.withColumns({"place_": place, "n_": n}).withColumn("level", levels)
    return out.where(F.col("place_") <= F.least(F.col("n_"), F.greatest(F.lit(least), F.ceil(F.col("level") * F.col("n_"))))).drop("place_", "n_")


def dedup_places(rows: DataFrame, unit: str, place: list[str], key: str) -> DataFrame:
    """The row of the least key at each exact place of a unit."""
    return one_per_group(rows, [unit, *place], [F.col(key)])


#: Places of a unit that one task thins.
THIN = 1024


def _thinned_at_once(rows: DataFrame, least_km: float, most: int, kinds: dict[str, str]) -> DataFrame:
    """thinned() of rows(unit, key, lat, lon, h) of units with THIN places at most, each unit's in one task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("h", "ascending"), ("key", "ascending")]))
        p, q = (np.radians(table.column(c).to_numpy()) for c in ("lat", "lon"))
        h = np.sin((p[:, None] - p) / 2) ** 2 + np.cos(p)[:, None] * np.cos(p) * np.sin((q[:, None] - q) / 2) ** 2
        near, left, taken = 2 * EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(h))) < least_km, np.ones(len(p), bool), []
        for i in range(len(p)):
            if left[i]:
                taken.append(i)
                left &= ~near[i]
        taken = taken[:most]
        return table.select(["unit", "key", "lat", "lon"]).take(pa.array(taken, pa.int64())).append_column("rank", pa.array(range(len(taken)), pa.int64()))

    return rows.groupBy("unit").applyInArrow(run, f"unit {kinds['unit']}, key {kinds['key']}, lat double, lon double, rank long")


def thinned(rows: DataFrame, tag: str, least_km: float, most: int) -> DataFrame:
    """(unit, key, lat, lon, rank): places taken in hash order if they lie least_km or more from all taken before, at most `most`.

    rows(unit, key, lat, lon), one for each place. A unit of THIN places or fewer is one task's; larger ones go by rounds.
    """
    k = dict(rows.dtypes)
    digest = F.unhex(hash_key(tag, F.col("unit"), F.col("key"))).alias("h")
    small, large = parted(rows.select("unit", "key", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), digest), THIN, keep=False)
    found = _thinned_at_once(small, least_km, most, k)
    return found if large is None else found.unionByName(_by_rounds(large.drop("h"), tag, least_km, most))


def _by_rounds(rows: DataFrame, tag: str, least_km: float, most: int) -> DataFrame:
    """thinned() of units of any size, all at once, in rounds.

    The first open place of
    each cell of space is taken if no open place nearer than least_km comes before it; then the open places near
    it go. That is what taking them one after another gives, and as their order is a hash, a few
    rounds settle them. A place meets the one place of each cell around it, however many its own holds.
    """
    k = dict(rows.dtypes)
    chord = 2 * EARTH_KM * math.sin(min(math.pi / 2, least_km / (2 * EARTH_KM))) * (1 + 1e-9)
    cell = F.array(*(F.floor(x / chord).cast("int") for x in ecef_km(F.col("lat"), F.col("lon"))))
    order = F.struct(hash_key(tag, F.col("unit"), F.col("key")).alias("h"), F.col("key"))
    left = kept(rows.select("unit", "key", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), order.alias("order")).withColumn("cell", cell), "places")
    taken = None
    while not left.isEmpty():
        first = left.groupBy("unit", "cell").agg(F.min(F.struct("order", "key", "lat", "lon")).alias("x")).select("unit", "cell", "x.*")
        steps = F.explode(F.array(*(F.array(*(F.col("cell")[c] + s for c, s in enumerate(step))) for step in itertools.product((-1, 0, 1), repeat=3)))).alias("cell")
        asks = first.select("unit", F.struct("order", "lat", "lon").alias("f"), steps)
        near = left.join(asks, ["unit", "cell"]).where(haversine_km(F.col("f.lat"), F.col("f.lon"), F.col("lat"), F.col("lon")) < least_km)
        near = kept(near.select("unit", "f", "order"), "near")
        blocked = near.where(F.col("order") < F.col("f.order")).select("unit", F.col("f.order").alias("o_")).distinct()
        new = near.where(F.col("order") == F.col("f.order")).join(blocked, (near["unit"] == blocked["unit"]) & (F.col("f.order") == F.col("o_")), "left_anti").select("unit", F.col("f.order").alias("order"))
        new = kept(new, "taken")
        gone = near.join(new.withColumnRenamed("order", "o_").withColumnRenamed("unit", "u_"), (F.col("unit") == F.col("u_")) & (F.col("f.order") == F.col("o_"))).select("unit", "order").distinct()
        here = left.join(new, ["unit", "order"], "left_semi")
        taken = here if taken is None else taken.unionByName(here)
        left = kept(left.join(gone, ["unit", "order"], "left_anti"), "left")
    if taken is None:
        return rows.select("unit", "key", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.lit(0).cast("long").alias("rank")).limit(0)
    place = F.row_number().over(Window.partitionBy("unit").orderBy("order"))
    return taken.withColumn("rank", place.cast("long") - 1).where(F.col("rank") < most).select("unit", F.col("key").cast(k["key"]).alias("key"), "lat", "lon", "rank")


def balanced_schedule(labels: list[str], realizations: int, each: int, seed: int) -> list[tuple[str, ...]]:
    """Draws without repeats within a realization whose counts over all differ by at most one."""
    if not 0 < each <= len(labels) or len(set(labels)) != len(labels):
        raise ValueError("labels must be distinct and enough for a realization")
    rng, used, out = np.random.default_rng(seed), {x: 0 for x in labels}, []
    for _ in range(realizations):
        jitter = dict(zip(labels, rng.random(len(labels))))
        chosen = sorted(labels, key=lambda x: (used[x], jitter[x], x))[:each]
        for x in chosen:
            used[x] += 1
        out.append(tuple(sorted(chosen)))
    return out


def inclusion_counts(schedule: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n) over schedule(realization, members array<string>), zeros kept."""
    counts = schedule.select(F.explode("members").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return labels.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def seeded_split(labels: list[str], fraction: float, seed: int) -> tuple[list[str], list[str]]:
    """(train, held): a random part of the sorted labels, of at least one and at most all but one, from a seeded generator on the driver."""
    ordered = sorted(labels)
    if len(set(ordered)) != len(ordered) or len(ordered) < 2 or not 0 < fraction < 1:
        raise ValueError("two different labels or more, and a fraction between 0 and 1, are wanted")
    n = min(len(ordered) - 1, max(1, round(fraction * len(ordered))))
    chosen = set(np.random.default_rng(seed).permutation(len(ordered))[:n].tolist())
    return [x for i, x in enumerate(ordered) if i not in chosen], [x for i, x in enumerate(ordered) if i in chosen]
