"""Synthetic worlds: seeded responses on circular, planar or given geometry, drawn in workers.

One generator for each world, seeded by its configuration and number, so that a world is the same
whichever task draws it.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "world int, unit string, i long, coords array<double>, trait double, state_a array<double>, state_b array<double>"


def seed_for(master: int, *parts) -> int:
    """First eight bytes, least significant first, of the SHA-256 of the parts joined by bars."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, (master, *parts))).encode()).digest()[:8], "little")


def circular_world(seed: int, units: int = 40, records: int = 60, shared: float = 0.5, amplitude: float = 2.0, noise: float = 0.8, width: float = 0.2) -> pd.DataFrame:
    """Units on a circle whose trait steps at a front; a share of units, drawn at random, has the common front at phase 0, others one of their own anywhere on half the circle."""
    if units < 4 or records < 8 or not 0 <= shared <= 1:
        raise ValueError("four units of eight records or more, and a share between 0 and 1, are wanted")
    rng = np.random.default_rng(seed)
    common = set(rng.permutation(units)[: int(round(units * shared))].tolist())
    private = rng.uniform(0, np.pi, units)
    rows = []
    for u in range(units):
        front = 0.0 if u in common else private[u]
        angle = rng.uniform(-np.pi, np.pi, records)
        trait = amplitude * np.tanh(np.sin(angle - front) / width) + rng.normal(0, noise, records)
        rows += [(f"u{u:03d}", i, [float(np.cos(a)), float(np.sin(a))], float(t)) for i, (a, t) in enumerate(zip(angle, trait))]
    return pd.DataFrame(rows, columns=["unit", "i", "coords", "trait"])


#: How the second state of a paired world follows the first.
PAIRED_MODES = ("independent", "private_front", "shared_mismatch", "shared_relation", "state_only", "coupled")


def paired_world(seed: int, mode: str, units: int = 40, records: int = 60, amplitude: float = 2.0, noise: float = 0.2, width: float = 0.2) -> pd.DataFrame:
    """Units on a circle with two states of a record whose mismatch or relation steps at a front, by mode."""
    rng = np.random.default_rng(seed)
    common, rows = rng.uniform(-np.pi, np.pi), []
    for u in range(units):
        own = rng.uniform(-np.pi, np.pi)
        front = own if mode in ("independent", "private_front") else common
        angle = rng.uniform(-np.pi, np.pi, records)
        step = np.tanh(np.sin(angle - front) / width)
        a = rng.normal(0, 1, (records, 2))
        lag = {"independent": 0 * step, "coupled": 0 * step, "state_only": 0 * step, "shared_relation": amplitude * step}.get(mode, amplitude * (1 + step) / 2)
        if mode == "state_only":
            a[:, 0] += amplitude * step
        b = a - np.stack([lag, 0 * lag], 1) + rng.normal(0, noise, (records, 2)) if mode != "independent" else rng.normal(0, 1, (records, 2))
        rows += [(f"u{u:03d}", i, [float(np.cos(t)), float(np.sin(t))], x.tolist(), y.tolist()) for i, (t, x, y) in enumerate(zip(angle, a, b))]
    return pd.DataFrame(rows, columns=["unit", "i", "coords", "state_a", "state_b"])


def distance_world(edges: pd.DataFrame, seed: int, shared: float, amplitude: float, strength: float = 1.0, noise: float = 0.1, width: float = 0.2) -> np.ndarray:
    """A distance for every edge(unit, mid, length): isolation by distance, a step across a shared or private front, and noise."""
    rng = np.random.default_rng(seed)
    mid = np.stack(edges["mid"].to_numpy())
    centre, scale = np.median(mid, 0), np.maximum(mid.std(0), 1e-12)
    z = (mid - centre) / scale
    units = sorted(edges["unit"].unique())
    common, out = rng.normal(size=z.shape[1]), np.zeros(len(edges))
    for k, u in enumerate(units):
        own = rng.normal(size=z.shape[1])
        way = common if k < round(shared * len(units)) else own
        at = (edges["unit"] == u).to_numpy()
        near = np.exp(-0.5 * ((z[at] @ (way / np.linalg.norm(way))) / width) ** 2)
        length = edges["length"].to_numpy()[at]
        out[at] = strength * length / max(length.mean(), 1e-12) + amplitude * near + noise * np.abs(rng.normal(size=at.sum()))
    return out


def worlds(spark: SparkSession, configurations: list[dict], replicates: int, master: int, units: int = 40, records: int = 60) -> DataFrame:
    """(config, world, unit, i, coords, trait) of every configuration(shared, amplitude) and replicate, drawn in parallel."""
    table = [(k, r, float(c["shared"]), float(c["amplitude"])) for (k, c), r in itertools.product(enumerate(configurations), range(replicates))]
    cells = spark.createDataFrame(table, "config int, world int, shared double, amplitude double").repartition(max(1, len(table)), "config", "world")

    def run(frames):
        for pdf in frames:
            for c in pdf.itertuples():
                out = circular_world(seed_for(master, c.shared, c.amplitude, c.world), units, records, c.shared, c.amplitude)
                out.insert(0, "world", c.world)
                out.insert(0, "config", c.config)
                yield out

    return cells.mapInPandas(run, "config int, world int, unit string, i long, coords array<double>, trait double")


def mismatch(records: DataFrame, relation: bool = False) -> DataFrame:
    """records(state_a, state_b) with trait: the Euclidean mismatch of the states, or their difference as a vector."""
    from ..functions.scalars import dissimilarity, relative_state

    trait = relative_state(F.col("state_a"), F.col("state_b")) if relation else dissimilarity(F.col("state_a"), F.col("state_b"), True)
    return records.withColumn("trait", trait)


def dyads(seed: int, sources: int = 20, targets: int = 20, effect: float = 0.0, private: float = 0.0, noise: float = 0.32) -> pd.DataFrame:
    """A complete design with source and target intercepts, one predictor, and a response with the effect."""
    rng = np.random.default_rng(seed)
    s, t = np.repeat(np.arange(sources), targets), np.tile(np.arange(targets), sources)
    x = rng.normal(size=len(s))
    slope = effect + private * rng.normal(size=sources)[s]
    y = 0.18 * rng.normal(size=sources)[s] + 0.18 * rng.normal(size=targets)[t] + slope * x + noise * rng.normal(size=len(s))
    return pd.DataFrame({"source": [f"s{i:03d}" for i in s], "target": [f"t{i:03d}" for i in t], "x": x, "y": y})


def detectability(spark: SparkSession, effects: list[float], private: list[float], each: int, master: int, sources: int = 20, targets: int = 20, alpha: float = 0.05) -> DataFrame:
    """(private_amplitude, effect, worlds, rejections) of clustered one-sided tests on complete designs, cells drawn in parallel."""
    table = [(float(a), float(e), r) for a in private for e in effects for r in range(each)]
    cells = spark.createDataFrame(table, "private_amplitude double, effect double, replicate int").repartition(spark.sparkContext.defaultParallelism, "replicate", "effect")

    def run(frames):
        import math

        for pdf in frames:
            p = []
            for c in pdf.itertuples():
                d = dyads(seed_for(master, c.private_amplitude, c.effect, c.replicate), sources, targets, c.effect, c.private_amplitude)
                x, y = (v.reshape(sources, targets) for v in (d.x.to_numpy(), d.y.to_numpy()))
                x, y = (v - v.mean(0) - v.mean(1)[:, None] + v.mean() for v in (x, y))
                beta = (x * y).sum() / (x * x).sum()
                h = x / (x * x).sum() * (y - beta * x)
                n = x.size
                v = (n - 1) / (n - 1) * (sources / (sources - 1) * (h.sum(1) ** 2).sum() + targets / (targets - 1) * (h.sum(0) ** 2).sum()) - n / (n - 1) * (h * h).sum()
                p.append(0.5 * math.erfc(beta / math.sqrt(max(v, 1e-300)) / math.sqrt(2)))
            yield pdf.assign(reject=[q <= alpha for q in p])

    found = cells.mapInPandas(run, "private_amplitude double, effect double, replicate int, reject boolean")
    return found.groupBy("private_amplitude", "effect").agg(F.count(F.lit(1)).alias("worlds"), F.count_if("reject").alias("rejections"))


# ---- further generators: seed, units, records -> (unit, i, coords, trait) --------------------------


def _frame(parts) -> pd.DataFrame:
    return pd.concat([pd.DataFrame({"unit": f"u{u:03d}", "i": range(len(t)), "coords": c.tolist(), "trait": t}) for u, (c, t) in enumerate(parts)], ignore_index=True)


def boundary_world(seed: int, units: int = 40, records: int = 60, shared: float = 1.0, amplitude: float = 2.0, noise: float = 0.8, width: float = 0.2, coords: list[np.ndarray] | None = None) -> pd.DataFrame:
    """Units on given or uniform planar places, whose trait steps across a line that a share of units has in common."""
    rng = np.random.default_rng(seed)
    places = coords or [rng.uniform(-1, 1, (records, 2)) for _ in range(units)]
    every = np.concatenate(places)
    centre, scale = np.median(every, 0), np.maximum(every.std(0), 1e-12)
    line = lambda: (lambda v, o: (v / np.linalg.norm(v), o))(rng.normal(size=2), rng.uniform(-0.5, 0.5))
    common, members = line(), set(rng.permutation(len(places))[: round(shared * len(places))].tolist())
    parts = []
    for u, c in enumerate(places):
        way, offset = common if u in members else line()
        side = ((c - centre) / scale) @ way - offset
        parts.append((c, amplitude * np.tanh(side / width) + rng.normal(0, noise, len(c))))
    return _frame(parts)


#: What a directional world's mismatch does along its orientation, and whether fronts are shared.
DIRECTIONS = {
    "none": (0, True), "breakdown": (1, True), "recoupling": (-1, True), "private_breakdown": (1, False), "private_recoupling": (-1, False), "mixed": (2, True), "private_mixed": (2, False),
}


def directional_world(seed: int, units: int = 40, records: int = 60, mode: str = "breakdown", low: float = 1.0, high: float = 3.0, noise: float = 0.25, width: float = 0.12) -> pd.DataFrame:
    """Units along an oriented axis whose mismatch, the trait, passes from low to high at a front, or back, or either by unit."""
    sign, shared = DIRECTIONS[mode]
    rng = np.random.default_rng(seed)
    common, parts = rng.uniform(-0.2, 0.2), []
    for u in range(units):
        front, way = common if shared else rng.uniform(-0.8, 0.8), (1 - 2 * (u % 2)) if sign == 2 else sign
        g = np.sort(rng.uniform(-1, 1, records))
        share = 0.5 * (1 + way * np.tanh((g - front) / width)) if way else np.full(records, 0.5)
        parts.append((np.stack([g, rng.uniform(-0.1, 0.1, records)], 1), low + (high - low) * share + rng.normal(0, noise, records)))
    return _frame(parts)


def heterogeneous_world(seed: int, units: int = 40, records: int = 60, shared: float = 1.0, amplitude: float = 2.0) -> pd.DataFrame:
    """Units of unequal size, place, spread, amplitude and noise, whose front is common to a share of them."""
    rng = np.random.default_rng(seed)
    members, parts = set(rng.permutation(units)[: round(shared * units)].tolist()), []
    for u in range(units):
        n = int(rng.integers(max(8, records // 3), 2 * records))
        arc = rng.uniform(1.0, np.pi)
        angle = rng.uniform(-np.pi, np.pi) + rng.uniform(-arc, arc, n)
        front = 0.0 if u in members else rng.uniform(0, np.pi)
        parts.append((np.stack([np.cos(angle), np.sin(angle)], 1), amplitude * rng.uniform(0.5, 1.5) * np.tanh(np.sin(angle - front) / rng.uniform(0.1, 0.4)) + rng.normal(0, rng.uniform(0.2, 1.0), n)))
    return _frame(parts)


#: Which of size, arc, amplitude, noise and width vary between units.
FACTORS = ("size", "arc", "amplitude", "noise", "width")


def factor_world(seed: int, units: int = 40, records: int = 60, vary: tuple[str, ...] = ("arc",), shared: float = 1.0) -> pd.DataFrame:
    """A circular world in which the named factors vary between units and the others are those of a plain one."""
    if set(vary) - set(FACTORS):
        raise ValueError(f"factors are {FACTORS}")
    rng = np.random.default_rng(seed)
    members, parts = set(rng.permutation(units)[: round(shared * units)].tolist()), []
    for u in range(units):
        draw = dict(zip(FACTORS, rng.uniform(size=len(FACTORS))))  # drawn whether used or not, so that worlds differ by the factor alone
        at = lambda f, plain, low, high, draw=draw: low + draw[f] * (high - low) if f in vary else plain
        n, arc = int(at("size", records, max(8, records // 3), 2 * records)), at("arc", np.pi, 1.0, np.pi)
        angle = rng.uniform(-arc, arc, n)
        front = 0.0 if u in members else rng.uniform(0, np.pi)
        trait = at("amplitude", 2.0, 1.0, 3.0) * np.tanh(np.sin(angle - front) / at("width", 0.2, 0.1, 0.4)) + rng.normal(0, at("noise", 0.8, 0.2, 1.2), n)
        parts.append((np.stack([np.cos(angle), np.sin(angle)], 1), trait))
    return _frame(parts)


def grouped_world(seed: int, units: int = 40, records: int = 60, groups: int = 4, amplitude: float = 2.0, private: float = 0.0) -> pd.DataFrame:
    """Units in groups with a front for each group, moved for each unit by as much as `private` of half the circle."""
    rng = np.random.default_rng(seed)
    fronts, parts = rng.uniform(0, np.pi, groups), []
    for u in range(units):
        angle = rng.uniform(-np.pi, np.pi, records)
        front = fronts[u % groups] + private * rng.uniform(-np.pi / 2, np.pi / 2)
        parts.append((np.stack([np.cos(angle), np.sin(angle)], 1), amplitude * np.tanh(np.sin(angle - front) / 0.2) + rng.normal(0, 0.8, records)))
    return _frame(parts)


def identical_circle(seed: int, units: int = 40, records: int = 60) -> pd.DataFrame:
    """The negative control: every unit on the same evenly spaced circle, turned once, without any trait."""
    turn = np.random.default_rng(seed).uniform(0, 2 * np.pi)
    angle = turn + np.linspace(0, 2 * np.pi, records, endpoint=False)
    c = np.stack([np.cos(angle), np.sin(angle)], 1)
    return _frame([(c, np.zeros(records))] * units)


GENERATORS = {
    "circular": circular_world, "boundary": boundary_world, "directional": directional_world, "heterogeneous": heterogeneous_world, "factor": factor_world, "grouped": grouped_world, "identical": identical_circle,
}


def generated(spark: SparkSession, plan: list[tuple[str, int]], master: int, units: int = 40, records: int = 60) -> DataFrame:
    """(generator, world, unit, i, coords, trait) of so many worlds of each named generator, drawn in parallel."""
    table = [(name, k) for name, n in plan for k in range(n)]
    cells = spark.createDataFrame(table, "generator string, world int").repartition(max(1, len(table)), "generator", "world")

    def run(frames):
        for pdf in frames:
            for c in pdf.itertuples():
                out = GENERATORS[c.generator](seed_for(master, c.generator, c.world), units, records)
                out.insert(0, "world", c.world)
                out.insert(0, "generator", c.generator)
                yield out

    return cells.mapInPandas(run, "generator string, world int, unit string, i long, coords array<double>, trait double")
