"""Queries and operators that SQL cannot say, against computations of their own."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from transecta.operators import diagnostics, direction, dyadic, inference, niche, worlds
from transecta.plans import calibration, inputs
from transecta.plans.transfer import TransferPlan

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def run(spark, name):
    return __spark_entry__.queries()[name](spark, FOLDER).collect()


def plain_bootstrap(values, resamples, seed):
    x = sorted(v for v in values if math.isfinite(v))
    n, mean = len(x), sum(x) / len(x)

    def t(v):
        m = sum(v) / n
        sd = math.sqrt(sum((a - m) ** 2 for a in v) / (n - 1))
        return m / (sd / math.sqrt(n)) if sd > 0 else math.copysign(math.inf, m)

    seen = t(x)
    draws = np.random.default_rng(seed).integers(0, n, size=(resamples, n)).tolist()
    above = sum(t([x[i] - mean for i in row]) >= seen for row in draws)
    return mean, seen, (1 + above) / (1 + resamples)


@needs_tables
def test_bootstrap_queries(spark):
    groups = {}
    for r in run(spark, "spearman_by_unit"):
        groups.setdefault(r["unit"] % 4, []).append(r["rho"])
    tests = {r["grp"]: r for r in run(spark, "bootstrap_tests")}
    intervals = {r["grp"]: r for r in run(spark, "bootstrap_intervals")}
    for g, values in groups.items():
        values = [v for v in values if math.isfinite(v)]
        assert tests[g]["n"] == len(values)
        if len(values) >= 6:
            mean, t, p = plain_bootstrap(values, 1999, 0)
            assert abs(tests[g]["mean"] - mean) < 1e-5 and abs(tests[g]["t"] - t) < 1e-3 and abs(tests[g]["p"] - p) < 0.01
        x = np.sort(values)
        means = x[np.random.default_rng(0).integers(0, len(x), size=(1999, len(x)))].mean(1)
        assert abs(intervals[g]["low"] - np.quantile(means, 0.025)) < 1e-5 and abs(intervals[g]["high"] - np.quantile(means, 0.975)) < 1e-5


@needs_tables
def test_whole_tests_follow_from_their_scores(spark):
    scores = [r["score"] for r in run(spark, "transfer_scores")]
    mean, t, p = plain_bootstrap(scores, 1999, 0)
    (r,) = run(spark, "transfer_test")
    assert abs(r["mean"] - mean) < 1e-5 and abs(r["t"] - t) < 1e-3 and abs(r["p"] - p) < 0.01
    worlds_ = run(spark, "paired_transfer_scores")
    for k, name in enumerate(("mismatch", "coupling")):
        (r,) = (x for x in run(spark, "paired_bootstrap_tests") if x["estimand"] == name)
        mean, t, p = plain_bootstrap([x["score"] for x in worlds_ if x["world"] == k], 1999, k)
        assert abs(r["mean"] - mean) < 1e-5 and abs(r["p"] - p) < 0.01
    (d,) = run(spark, "directional_test")
    deltas = [x["delta"] for x in run(spark, "oriented_deltas")]
    assert abs(d["centre"] - run(spark, "front_centre")[0]["centre"]) < 1e-5 and d["n"] == len(deltas)
    assert abs(d["positive"] - np.mean(np.array(deltas) > 0)) < 1e-5 and abs(d["breakdown_p"] - plain_bootstrap(deltas, 1999, 10_000)[2]) < 0.01


@needs_tables
def test_components_are_those_of_the_singular_values(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"][:4] for r in rows], float)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    v = v[:2] * np.sign(v[np.arange(2), np.abs(v[:2]).argmax(1)])[:, None]
    w = z @ v.T / (s[:2] / math.sqrt(len(z) - 1))
    found = {r["i"]: (r["w1"], r["w2"]) for r in run(spark, "whitened_components")}
    assert np.allclose([found[r["vec_id"]] for r in rows], w, atol=1e-4)


@needs_tables
def test_calibration_tells_shared_fronts_from_private_ones(spark):
    cells = {(r["shared_fraction"], r["amplitude"]): r for r in run(spark, "calibration_grid")}
    assert len(cells) == 4 and all(r["replicates"] == 6 for r in cells.values())
    assert cells[1.0, 2.0]["rejections"] >= 5 and cells[0.0, 0.0]["rejections"] + cells[1.0, 0.0]["rejections"] <= 3
    for r in cells.values():
        k, n, z = r["rejections"], 6, 1.959963984540054
        centre, half = (k / n + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n)
        assert abs(r["low"] - max(0, centre - half)) < 1e-5 and abs(r["high"] - min(1, centre + half)) < 1e-5


def test_grouped_scores_are_those_of_each_world_alone(spark):
    frames = [worlds.circular_world(s, 8, 16, 1.0, 2.0, 0.3) for s in (1, 2)]
    rows = [(f"w{k}", f"w{k}|{r.unit}", int(r.i), r.coords, r.trait) for k, f in enumerate(frames) for r in f.itertuples()]
    records = spark.createDataFrame(rows, "world string, unit string, i long, coords array<double>, trait double")
    plan = TransferPlan(bandwidth=0.3)
    both = {(r["world"], r["unit"]): r["score"] for r in calibration.group_scores(records, "world", plan, 5).collect()}
    for k in range(2):
        alone = calibration.group_scores(records.where(F.col("world") == f"w{k}"), "world", plan, 5).collect()
        assert len(alone) == 4 and all(abs(both[f"w{k}", r["unit"]] - r["score"]) < 1e-9 for r in alone)
    tests = calibration.world_tests(records, "world", plan, "trait_permutation", 9, 5).collect()
    assert {r["world"] for r in tests} == {"w0", "w1"} and all(0.1 <= r["p"] <= 1 for r in tests)
    with pytest.raises(ValueError, match="no inference"):
        calibration.world_tests(records, "world", plan, "guess")


def test_permutation_test_counts_worlds_not_below(spark):
    frame = worlds.circular_world(3, 10, 14, 1.0, 3.0, 0.2)
    records = spark.createDataFrame([(r.unit, int(r.i), r.coords, r.trait) for r in frame.itertuples()], "unit string, i long, coords array<double>, trait double")
    plan = TransferPlan(bandwidth=0.3)
    stats = {r["world"]: r["statistic"] for r in plan.permutation_statistics(records, 6).collect()}
    (r,) = plan.permutation_test(records, 6).collect()
    assert r["permutations"] == 6 and abs(r["p"] - (1 + sum(v >= stats[0] for k, v in stats.items() if k)) / 7) < 1e-12
    assert abs(stats[0] - plan.scores(plan.edges(records)).agg(F.avg("score")).first()[0]) < 1e-5 and len(set(stats.values())) == 7


def test_resamples_do_not_depend_on_blocks(monkeypatch):
    whole = np.concatenate(list(inference.resamples_of(7, 50, 3)))
    monkeypatch.setattr(inference, "DRAWS", 20)
    assert (np.concatenate(list(inference.resamples_of(7, 50, 3))) == whole).all()


def test_intervals_of_correlations_and_differences(spark):
    rng = random.Random(8)
    rows = [(g, rng.choice([0.0, 1.0, 2.0, rng.random()]), rng.random() + g, rng.random() < 0.4) for g in range(2) for _ in range(40)]
    df = spark.createDataFrame(rows, "g int, x double, y double, s boolean")

    def rank(v):
        return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]

    def rho(pairs):
        u, v = (rank([p[k] for p in pairs]) for k in range(2))
        return float(np.corrcoef(u, v)[0, 1]) if len(set(u)) > 1 and len(set(v)) > 1 else 0.0

    for r in inference.correlation_interval(df, "x", "y", ["g"], 99, 4).collect():
        pairs = sorted((x, y) for g, x, y, _ in rows if g == r["g"])
        draws = [rho([pairs[i] for i in at]) for at in np.random.default_rng(4).integers(0, 40, size=(99, 40))]
        assert abs(r["rho"] - rho(pairs)) < 1e-9 and np.allclose([r["low"], r["high"]], np.quantile(draws, [0.025, 0.975]))
    for r in inference.difference_interval(df, "y", "s", ["g"], 99, 4).collect():
        sides = [np.sort([y for g, _, y, s in rows if g == r["g"] and s == side]) for side in (True, False)]
        means = [v[np.random.default_rng(4 + k).integers(0, len(v), size=(99, len(v)))].mean(1) for k, v in enumerate(sides)]
        assert abs(r["difference"] - (sides[0].mean() - sides[1].mean())) < 1e-9 and np.allclose([r["low"], r["high"]], np.quantile(means[0] - means[1], [0.025, 0.975]))


def test_absorption_equals_dummy_regression_on_incomplete_designs(spark):
    rng = random.Random(5)
    rows = [(f"s{i}", f"t{j}", rng.random(), rng.random()) for i in range(9) for j in range(6) if rng.random() < 0.5 or j == i % 6 or j == 0]
    for swap, most in ((False, 4096), (True, 4096), (False, 1)):  # by the driver, by steps over tables
        df = spark.createDataFrame(rows, "target string, source string, y double, z double" if swap else "source string, target string, y double, z double")
        x = np.array([[float(r[0] == f"s{i}") for i in range(9)] + [float(r[1] == f"t{j}") for j in range(6)] for r in rows])
        found = {(r["source"], r["target"]): (r["y"], r["z"]) for r in dyadic.absorbed(df, ["y", "z"], most=most).collect()}
        for k in range(2):
            y = np.array([r[2 + k] for r in rows])
            left = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
            assert np.allclose([found[(r[1], r[0]) if swap else (r[0], r[1])][k] for r in rows], left, atol=1e-9)
    apart = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "z", 3.0), ("b", "w", 1.0)], "source string, target string, y double")
    with pytest.raises(ValueError, match="not connected"):
        dyadic.absorbed(apart, ["y"])
    with pytest.raises(ValueError, match="not connected"):
        dyadic.absorbed(apart, ["y"], most=1)
    assert dyadic.absorbed(apart.limit(0), ["y"]).collect() == []


def test_steps_over_tables_equal_the_exact_solution(spark):
    rng = np.random.default_rng(8)
    rows = {(int(a), int(b)) for a, b in zip(rng.integers(0, 400, 3000), rng.integers(0, 300, 3000))} | {(i, i % 300) for i in range(400)} | {(i, (i + 1) % 300) for i in range(400)}
    df = spark.createDataFrame([(a, b, float(rng.normal()), float(a == 7)) for a, b in sorted(rows)], "source long, target long, y double, z double")
    exact, steps = ({(r["source"], r["target"]): (r["y"], r["z"]) for r in dyadic.absorbed(df, ["y", "z"], most=most).collect()} for most in (4096, 10))
    assert exact.keys() == steps.keys() and max(abs(a - b) for k in exact for a, b in zip(exact[k], steps[k])) < 1e-9
    assert dyadic.connected(df.selectExpr("source AS b_", "target AS f_"))
    assert not dyadic.connected(spark.createDataFrame([(k, k) for k in range(40)], "b_ long, f_ long"))
    assert dyadic.connected(spark.createDataFrame([(k // 2, (k + 1) // 2) for k in range(60)], "b_ long, f_ long"))


def test_simulated_dyads_are_tested_as_the_operator_does(spark):
    found = worlds.detectability(spark, [0.2], [0.0], 5, 3, 6, 5).collect()
    rejections = 0
    for k in range(5):
        d = worlds.dyads(worlds.seed_for(3, 0.0, 0.2, k), 6, 5, 0.2, 0.0)
        (r,) = dyadic.clustered_test(spark.createDataFrame(d), "y", ["x"]).collect()
        rejections += r["p"] <= 0.05
    assert (found[0]["worlds"], found[0]["rejections"]) == (5, rejections)


def test_weighted_medians(spark):
    rng = random.Random(6)
    rows = [(g, float(rng.randrange(6)), rng.choice([0.0, 1.0, rng.random()])) for g in range(20) for _ in range(rng.randint(1, 9))] + [(99, 3.0, 0.0), (99, 5.0, 0.0)]
    found = {r["g"]: r["median"] for r in direction.weighted_median(spark.createDataFrame(rows, "g int, v double, w double"), "v", "w", ["g"]).collect()}
    for g in found:
        own = sorted((v, w) for k, v, w in rows if k == g)
        total, run_ = sum(w for _, w in own), 0.0
        if total == 0:
            assert found[g] == np.median([v for v, _ in own])
            continue
        for v in sorted({v for v, _ in own}):
            run_ += sum(w for x, w in own if x == v)
            if run_ >= total / 2 - 1e-12:
                assert found[g] == v
                break


def test_generators_draw_the_same_worlds_anywhere(spark):
    plan = [(name, 2) for name in sorted(worlds.GENERATORS)]
    key = lambda d: sorted((r["generator"], r["world"], r["unit"], r["i"], r["trait"]) for r in d.collect())
    one = key(worlds.generated(spark, plan, 1, 6, 12))
    assert one == key(worlds.generated(spark, plan[::-1], 1, 6, 12)) and one != key(worlds.generated(spark, plan, 2, 6, 12))
    flat = worlds.circular_world(4, 10, 30, 0.4, 2.0, 0.0)
    common = sum(np.allclose([t for t in g.trait], [2 * math.tanh(c[1] / math.hypot(*c) / 0.2) for c in g.coords], atol=1e-9) for _, g in flat.groupby("unit"))
    assert common == 4
    low, high = (worlds.directional_world(5, 4, 200, m).assign(x=lambda d: [c[0] for c in d.coords]) for m in ("breakdown", "recoupling"))
    assert low[low.x > 0.5].trait.mean() - low[low.x < -0.5].trait.mean() > 1.5 and high[high.x > 0.5].trait.mean() - high[high.x < -0.5].trait.mean() < -1.5
    with pytest.raises(ValueError, match="factors are"):
        worlds.factor_world(1, vary=("colour",))


def test_density_at_points_is_the_plain_sum(spark):
    rng = np.random.default_rng(2)
    rows = [(f"u{k % 2}", *map(float, rng.normal(size=3))) for k in range(30)]
    asked = [(k, *map(float, rng.normal(size=3))) for k in range(5)]
    found = {(r["unit"], r["query"]): r["density"] for r in niche.density_at(spark.createDataFrame(rows, "unit string, a double, b double, c double"), spark.createDataFrame(asked, "query long, a double, b double, c double"), ["a", "b", "c"]).collect()}
    for u in ("u0", "u1"):
        own = np.array([r[1:] for r in rows if r[0] == u])
        h = len(own) ** (-1 / 7)
        for q in asked:
            d2 = ((own - np.array(q[1:])) ** 2).sum(1)
            assert abs(found[u, str(q[0])] - np.exp(-d2 / (2 * h * h)).mean() / ((2 * math.pi) ** 1.5 * h**3)) < 1e-12


@needs_tables
def test_world_scores_of_one_response_are_the_transfer_scores(spark):
    plan = TransferPlan()
    edges = plan.edges(inputs.records(spark, FOLDER)).withColumn("turnover", F.array("turnover"))
    train, held = (edges.where(F.col("role") == r).drop("role") for r in ("train", "held"))
    one = {r["unit"]: r["score"] for r in diagnostics.world_scores(train, held, plan.bandwidth).collect()}
    assert all(abs(one[r["unit"]] - r["score"]) < 1e-5 for r in run(spark, "transfer_scores"))


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(12)
    rows = [("even", i, float(x)) for i, x in enumerate(rng.normal(0.05, 1, 900))] + [("skewed", i, float(x)) for i, x in enumerate(rng.exponential(1, 400) - 0.95)]
    rows += [("few", i, float(i)) for i in range(5)] + [("same", i, 2.0) for i in range(9)] + [("even", 10_000, float("nan")), ("even", 10_001, None)]
    return rows, spark.createDataFrame(rows, "g string, i long, x double")


def test_a_bootstrap_without_a_group_in_a_task(groups, monkeypatch):
    rows, df = groups
    want = {r["g"]: r for r in inference.bootstrap_test(df.where("g <> 'few'"), "x", ["g"], 1999, 3).collect()}
    for most in (1 << 16, 50):
        monkeypatch.setattr(inference, "RESAMPLED", most)
        found = {r["g"]: r for r in inference.spread_bootstrap_test(df, "x", ["g"], "i", 1999, 3).collect()}
        assert set(found) == {"even", "skewed", "few", "same"} and found["few"]["t"] is None and found["few"]["p"] is None
        for g, r in want.items():
            assert found[g]["n"] == r["n"] and abs(found[g]["mean"] - r["mean"]) < 1e-12 and (g == "same" or abs(found[g]["t"] - r["t"]) < 1e-9)
            assert abs(found[g]["p"] - r["p"]) < 4 * math.sqrt(r["p"] * (1 - r["p"]) / 1999 * 2) + 1e-3
        again = {r["g"]: r["p"] for r in inference.spread_bootstrap_test(df.repartition(7).orderBy("x"), "x", ["g"], "i", 1999, 3).collect()}
        assert again == {g: r["p"] for g, r in found.items()}


def test_resamples_have_the_spread_of_a_mean(groups, monkeypatch):
    rows, df = groups
    monkeypatch.setattr(inference, "RESAMPLED", 60)
    for r in inference.spread_mean_interval(df.where("g <> 'few'"), "x", ["g"], "i", 1999, 5).collect():
        x = np.array([v for g, _, v in rows if g == r["g"] and v is not None and np.isfinite(v)])
        half = 1.96 * x.std() / math.sqrt(len(x))
        assert abs(r["low"] - (x.mean() - half)) < 0.15 * half + 1e-12 and abs(r["high"] - (x.mean() + half)) < 0.15 * half + 1e-12
    sums = inference.resampled_sums(df.where("g = 'same'"), "x", ["g"], "i", 99, 1).collect()
    assert len(sums) == 99 and all(r["s1"] == 0 and r["s2"] == 0 for r in sums)


def test_splits_of_a_group_are_one_row_for_each_block():
    """What a block's task needs of its group is its own draws: no list of all blocks beside each row, and each binomial drawn once."""
    import pyarrow as pa

    sizes = [5, 0, 40, 1] * 300
    batch = pa.RecordBatch.from_pydict({"g": ["a"], "group_": pa.array([-7], pa.int64()), "sizes_": pa.array([sizes], pa.list_(pa.int32()))})
    found = list(inference._splits(50, 3, ["g"])([batch]))
    assert [b.column(1)[0].as_py() for b in found] == [k for k, n in enumerate(sizes) if n] and all(b.num_rows == 1 and b.num_columns == 3 for b in found)
    drawn = np.array([np.frombuffer(b.column(2)[0].as_py(), np.int64) for b in found])
    assert (drawn.sum(0) == sum(sizes)).all() and drawn[1::3].mean() == pytest.approx(40, rel=0.02)


def test_permuted_rows_are_dealt_before_they_are_multiplied(spark):
    rows = spark.createDataFrame([(u, i, float(i * u % 7)) for u in range(1, 5) for i in range(3 * u)], "unit long, i long, trait double")
    out = inference.permuted(rows, 4, ["unit"], "trait", 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    found = {}
    for r in out.collect():
        found.setdefault((r["replicate"], r["unit"]), []).append((r["i"], r["trait"]))
    assert len(found) == 16
    for (replicate, u), moved in found.items():
        order = sorted(range(3 * u), key=lambda i: hashlib.sha256(f"permute|2|{replicate}|{i}".encode()).hexdigest())
        assert sorted(moved) == [(k, float(i * u % 7)) for k, i in enumerate(order)]


def test_a_ladder_makes_its_dyads_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rng = random.Random(4)
    rows = spark.createDataFrame([(s, t, rng.random(), rng.random(), rng.random()) for s in range(6) for t in range(6) if s != t], "source long, target long, x double, y double, z double")

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    layers = [("one", "x", ["y"]), ("two", "x", ["y", "z"])]
    found = dyadic.ladder(rows.mapInArrow(counted, rows.schema), layers).orderBy("layer").collect()
    assert seen.value == 30 and [r["dyads"] for r in found] == [30, 30] and found[1]["survival"] < 1


def test_ridge_adds_up_units_not_windows(spark, monkeypatch):
    """Each unit counts alike, by sums for each unit: rows are not dealt by unit to be weighted."""
    rng = np.random.default_rng(6)
    unit = np.repeat(np.arange(5), [2, 5, 9, 14, 30])
    x, z = rng.normal(size=(2, 60))
    y = 2 * x - z + rng.normal(size=60)
    monkeypatch.setattr(dyadic, "Window", None)
    beta, mean, moments = dyadic.ridge(spark.createDataFrame([tuple(map(float, r)) for r in zip(unit, x, z, y)], "unit double, x double, z double, y double"), "y", ["x", "z"])
    w = 1.0 / np.bincount(unit)[unit]
    s = [(v - np.average(v, weights=w)) / np.sqrt(np.cov(v, aweights=w, ddof=0)) for v in (x, z)]
    m = np.stack(s, 1) * np.sqrt(w)[:, None]
    want = np.linalg.solve(m.T @ m + np.eye(2), m.T @ (np.sqrt(w) * (y - np.average(y, weights=w))))
    assert [beta["x"], beta["z"]] == pytest.approx(list(want)) and mean == pytest.approx(np.average(y, weights=w))
