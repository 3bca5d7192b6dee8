"""Greedy choices in parallel rounds against the loops that take one after another."""

import hashlib
import math
import random

import numpy as np
import pytest

from transecta.operators import joins, panels
from transecta.sources.shared import kept


def serial_match(rows):
    out = set()
    for target in {r[0] for r in rows}:
        own, taken = [r for r in rows if r[0] == target], set()
        lefts = {left: sorted((c, right) for _, x, right, c in own if x == left) for left in {r[1] for r in own}}
        for left in sorted(lefts, key=lambda x: (len(lefts[x]), x)):
            for cost, right in lefts[left]:
                if right not in taken:
                    taken.add(right)
                    out.add((target, left, right, cost))
                    break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matching_in_rounds(spark, seed):
    rng = random.Random(seed)
    rows = [(t, f"l{i}", f"r{j}", float(rng.randint(0, 4))) for t in range(6) for i in range(rng.randint(1, 12)) for j in range(rng.randint(1, 12)) if rng.random() < 0.6]
    rows += [(99, f"l{i:02}", f"r{j:02}", float(j)) for i in range(12) for j in range(12)]  # all want the same, one round each
    df = spark.createDataFrame(rows, "target int, left string, right string, cost double").repartition(4)
    found = joins.greedy_match(df)
    assert {tuple(r) for r in found.select("target", "left", "right", "cost").collect()} == serial_match(rows)


def far(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def serial_thin(rows, tag, least, most):
    out = set()
    for unit in {r[0] for r in rows}:
        taken = []
        for _, key, lat, lon in sorted((r for r in rows if r[0] == unit), key=lambda r: (hashlib.sha256(f"{tag}|{r[0]}|{r[1]}".encode()).hexdigest(), r[1])):
            if all(far((lat, lon), x) >= least for x in taken):
                out.add((unit, key, lat, lon, len(taken)))
                taken.append((lat, lon))
                if len(taken) == most:
                    break
    return out


@pytest.mark.parametrize("least, most", [(50.0, 1000), (400.0, 1000), (50.0, 7), (3000.0, 1000), (30_000.0, 5)])
def test_thinning_in_rounds(spark, least, most):
    rng = np.random.default_rng(int(least))
    rows = [("even", i, float(a), float(o)) for i, (a, o) in enumerate(rng.uniform((-90, -180), (90, 180), (80, 2)))]
    rows += [("poles", i, float(a), float(o)) for i, (a, o) in enumerate(rng.uniform((85, -180), (90, 180), (60, 2)))]
    rows += [("edge", i, float(a), float(o)) for i, (a, o) in enumerate(np.stack([rng.uniform(-1, 1, 60), np.where(rng.random(60) < 0.5, rng.uniform(179, 180, 60), rng.uniform(-180, -179, 60))], 1))]
    rows += [("dense", i, float(a), float(o)) for i, (a, o) in enumerate(rng.normal(50, 0.3, (150, 2)))] + [("one", 0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "unit string, key long, lat double, lon double").repartition(4)
    assert {tuple(r) for r in panels.thinned(df, "places", least, most).collect()} == serial_thin(rows, "places", least, most)


def serial_pools(at, same, different):
    """The loop that looks at all that is left each time."""
    small, large = (sorted(same), sorted(different)) if len(same) <= len(different) else (sorted(different), sorted(same))
    out = []
    while small and large:
        nearest = [(*min((float(np.linalg.norm(at[a] - at[p])), p) for p in large), a) for a in small]
        hardest = max(d for d, _, _ in nearest)
        d, p, a = min((x for x in nearest if x[0] == hardest), key=lambda x: (x[2], x[1]))
        out.append((a, p, d) if len(same) <= len(different) else (p, a, d))
        small.remove(a)
        large.remove(p)
    return out


def test_hardest_first_matching():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (3, 8), (8, 3), (20, 20), (0, 4), (5, 0), (15, 40)):
        names = [f"s{k}" for k in rng.permutation(n + m)]
        at = {x: rng.integers(0, 4, 2).astype(float) for x in names}  # ties
        assert joins.matched(names[:n], names[n:], at) == serial_pools(at, names[:n], names[n:])


def test_pools_matched_by_geometry(spark):
    rng = np.random.default_rng(5)
    sources, targets = {f"s{k}": rng.random((rng.integers(3, 9), 2)) for k in range(14)}, {f"t{k}": rng.random((rng.integers(3, 9), 2)) for k in range(3)}
    label = {x: ("a", "b", "", None)[k % (2 if k < 11 else 4)] for k, x in enumerate([*sources, *targets])} | {"t0": "a", "t1": "b", "t2": ""}
    places = {x: int(rng.integers(2, 30)) for x in label}
    frame = lambda found: spark.createDataFrame([(u, i, float(x), float(y)) for u, rows in found.items() for i, (x, y) in enumerate(rows)], "unit string, i int, x double, y double")
    counts = lambda found: spark.createDataFrame([(u, places[u]) for u in found], "unit string, n int")
    features = joins.pool_features(frame(targets), frame(sources), counts(targets), counts(sources), ["x", "y"], 0.3, 0.4)
    found = joins.matched_pools(features, spark.createDataFrame(list(label.items()), "unit string, grp string"), 2).collect()

    cover = lambda a, b: float(np.mean([(((b - x) ** 2).sum(1) <= 0.09).any() for x in a]))
    want = set()
    for t, mid in targets.items():
        own = {s: np.array([cover(mid, m), cover(m, mid), np.log1p(np.linalg.norm(m.mean(0) - mid.mean(0)) / 0.3), np.log(len(m) / len(mid)), np.log(places[s] / places[t])]) for s, m in sources.items() if cover(mid, m) >= 0.4}
        if not label[t] or not own:
            continue
        x = np.stack(list(own.values()))
        spread = x.std(0)
        spread[spread <= np.sqrt(np.finfo(float).eps)] = 1
        at = {s: (v - x.mean(0)) / spread for s, v in own.items()}
        same, other = [s for s in own if label[s] and label[s] == label[t]], [s for s in own if label[s] and label[s] != label[t]]
        if min(len(same), len(other)) >= 2:
            want |= {(t, k, a, b, round(d, 9)) for k, (a, b, d) in enumerate(serial_pools(at, same, other), 1)}
    assert want and {(r["target"], r["step"], r["same"], r["different"], round(r["distance"], 9)) for r in found} == want


def test_nothing_to_choose(spark):
    assert joins.greedy_match(spark.createDataFrame([], "target int, left string, right string, cost double")).collect() == []
    assert panels.thinned(spark.createDataFrame([], "unit string, key long, lat double, lon double"), "x", 10.0, 5).collect() == []


def test_small_units_are_thinned_in_one_shuffle_and_large_ones_by_rounds(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(u, i, rng.random(), rng.random()) for u, n in (("a", 1), ("b", 30), ("c", 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "unit string, key long, lat double, lon double")
    tables = []
    monkeypatch.setattr(panels, "kept", lambda df, name: tables.append(name) or kept(df, name))
    found = panels.thinned(df, "places", 15.0, 25)
    assert not tables and found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in found.collect()} == serial_thin(rows, "places", 15.0, 25)
    monkeypatch.setattr(panels, "THIN", 40)
    assert {tuple(r) for r in panels.thinned(df, "places", 15.0, 25).collect()} == serial_thin(rows, "places", 15.0, 25) and tables
