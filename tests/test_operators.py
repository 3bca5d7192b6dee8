import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from transecta.operators import blocks, diagnostics, dyadic, field, graph, inference, joins, niche, panels, residual, sequence, worlds
from transecta.plans.transfer import TransferPlan


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(3)
    rows = []
    for u in range(14):
        for i in range(rng.choice([1, 2, 9, 20])):
            rows.append((f"u{u:02d}", i, [round(rng.random(), 2), round(rng.random(), 2)], rng.random()))
    return spark.createDataFrame(rows, "unit string, i long, coords array<double>, trait double")


def plain(records):
    out = {}
    for r in sorted(records.collect(), key=lambda r: (r["unit"], r["i"])):
        out.setdefault(r["unit"], []).append(r)
    return out


def plain_edges(points, k):
    found = set()
    for p in points:
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(p["coords"], q["coords"]))), q["i"]) for q in points if q["i"] != p["i"])
        found |= {(min(p["i"], j), max(p["i"], j)) for _, j in near[:k]}
    return found


@pytest.mark.parametrize("size", [3, 2048])
def test_knn_in_blocks_of_any_size(records, monkeypatch, size):
    monkeypatch.setattr(graph, "blocked", lambda *a, **k: blocks.blocked(*a, size=size, **k))
    got = {}
    for r in graph.knn_edges(records, 3).collect():
        got.setdefault(r["unit"], set()).add((r["a"], r["b"]))
    assert got == {u: e for u, ps in plain(records).items() if (e := plain_edges(ps, 3))}


def test_edges_do_not_depend_on_partitions(records):
    key = lambda d: sorted(map(tuple, graph.edge_table(records, d).select("unit", "a", "b", "length", "turnover").collect()))
    assert key(graph.knn_edges(records.coalesce(1))) == key(graph.knn_edges(records.repartition(7)))


def test_disjoint_counts_and_localities(spark):
    edges = spark.createDataFrame([("u", 0, 1), ("u", 1, 2), ("u", 2, 3), ("u", 3, 4)], "unit string, a long, b long")
    assert {(r["a"], r["b"]): r["n_disjoint"] for r in graph.disjoint_counts(edges).collect()} == {(0, 1): 2, (1, 2): 1, (2, 3): 1, (3, 4): 2}
    rows = spark.createDataFrame([("u", [2.0]), ("u", [1.0]), ("u", [2.0])], "unit string, coords array<double>")
    assert sorted(map(tuple, graph.localities(rows).select("loc", "n_records").collect())) == [(0, 1), (1, 2)]


def average(values):
    order = sorted(values)
    return np.array([(order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in values])


def plain_scores(train, held, h, strength, prior):
    weight = pd.Series([r["unit"] for r in train]).value_counts()
    out = {}
    for u in sorted({r["unit"] for r in held}):
        rows = [r for r in held if r["unit"] == u]
        exposure = []
        for r in rows:
            values = []
            for t in (0.1, 0.3, 0.5, 0.7, 0.9):
                x = [a + t * (b - a) for a, b in zip(r["start"], r["end"])]
                k = [math.exp(-sum((a - b) ** 2 for a, b in zip(x, q["mid"])) / (2 * h * h)) / weight[q["unit"]] for q in train]
                values.append((sum(w * q["turnover"] for w, q in zip(k, train)) + strength * prior) / (sum(k) + strength))
            exposure.append(round(sum(values) / 5, 12))
        a, b = average(exposure), average([r["turnover"] for r in rows])
        a, b = a - a.mean(), b - b.mean()
        low = math.sqrt((a @ a) * (b @ b))
        out[u] = math.nan if len(rows) < 3 else 0.0 if low < 1e-15 else a @ b / low
    return out


def same(a, b):
    return a.keys() == b.keys() and all((math.isnan(a[k]) and math.isnan(b[k])) or abs(a[k] - b[k]) < 1e-9 for k in a)


def test_transfer_scores_against_plain_sums(records, monkeypatch):
    plan = TransferPlan()
    edges = plan.edges(records).cache()
    train, held = ([r for r in edges.collect() if r["role"] == role] for role in ("train", "held"))
    assert train and held and not {r["unit"] for r in train} & {r["unit"] for r in held}
    want = plain_scores(train, held, 0.25, 0.25, 0.5)
    assert same({r["unit"]: r["score"] for r in plan.scores(edges).collect()}, want)
    monkeypatch.setattr(field, "blocked", lambda *a, **k: blocks.blocked(*a, size=10, **k))
    assert same({r["unit"]: r["score"] for r in plan.scores(edges).collect()}, want)
    everyone = edges.select("unit").where("role = 'held'").distinct().withColumnRenamed("unit", "target").crossJoin(edges.where("role = 'train'").select(F.col("unit").alias("source")).distinct())
    parts = edges.where("role = 'train'").drop("role"), edges.where("role = 'held'").drop("role")
    assert same({r["unit"]: r["score"] for r in field.pooled_transfer_scores(*parts, everyone, 0.25).collect()}, want)
    shares = field.training_leverage(*parts, 0.25).collect()
    assert abs(sum(r["mean_share"] for r in shares) - 1) < 1e-9
    statistic = field.statistic(plan.scores(edges)).first()
    finite = [v for v in want.values() if not math.isnan(v)]
    assert statistic["units"] == len(finite) and abs(statistic["statistic"] - sum(finite) / len(finite)) < 1e-9


def plain_residuals(rows, least=5):
    out = {}
    for e in rows:
        f = [q for q in rows if not {q["a"], q["b"]} & {e["a"], e["b"]}]
        if len(f) < least:
            continue
        n = len(f)
        x, y = (average([q[c] for q in f]) / (n + 1) for c in ("length", "difference"))
        against = lambda c: (sum(q[c] < e[c] for q in f) + 0.5 * sum(q[c] == e[c] for q in f) + 0.5) / (n + 1)
        xc, yc = x - x.mean(), y - y.mean()
        beta = xc @ yc / (xc @ xc) if xc @ xc > 1e-15 else 0.0
        out[e["a"], e["b"]] = against("difference") - (y.mean() + beta * (against("length") - x.mean()))
    return out


@pytest.mark.parametrize("digits", [6, 1])
def test_crossfit_residuals_with_ties(records, digits):
    edges = graph.edge_table(records, graph.knn_edges(records)).withColumns({c: F.round(c, digits) for c in ("length", "difference")})
    got = residual.crossfit_residuals(edges, "length", "difference").collect()
    by = {}
    for r in edges.collect():
        by.setdefault(r["unit"], []).append(r)
    want = {(u, *k): v for u, rows in by.items() for k, v in plain_residuals(rows).items()}
    assert {(r["unit"], r["a"], r["b"]) for r in got} == set(want) and got
    assert all(abs(r["residual"] - want[r["unit"], r["a"], r["b"]]) < 1e-9 for r in got)
    exact = residual.crossfit_residuals(edges.withColumn("difference", F.col("length") * 2), "length", "difference").collect()
    assert {(r["residual"], r["turnover"]) for r in exact} == {(0.0, 0.5)}


def test_coverage_meets_every_neighbouring_cell(spark):
    rng = random.Random(2)
    rows = [(f"u{i % 4}", i, rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "unit string, i long, x double, y double")
    want = {}
    for t, s in itertools.permutations(sorted({r[0] for r in rows}), 2):
        target, source = ([r for r in rows if r[0] == u] for u in (t, s))
        n = sum(any((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 0.01 for b in source) for a in target)
        if n:
            want[t, s] = n / len(target)
    assert {(r["target"], r["source"]): r["coverage"] for r in joins.pair_coverage(df, df, ["x", "y"], 0.1).collect()} == want


def test_lookups_matching_and_audits(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "zz", "x"), (4, "zz", "y"), (5, None, "x")], "i int, k1 string, k2 string")
    right = spark.createDataFrame([("a", "p", 1), ("b", "q", 2), ("b", "r", 3), ("c", "x", 4)], "k1 string, k2 string, v int")
    got = {r["i"]: (r["v"], r["matched_by"]) for r in joins.unique_lookup(left, right, ["k1", "k2"], ["v"]).collect()}
    assert got == {1: (1, "k1"), 2: (None, None), 3: (4, "k2"), 4: (None, None), 5: (4, "k2")}
    with pytest.raises(ValueError):
        joins.checked_merge(right.select("k1"), right, ["k1"])
    c = spark.createDataFrame([("t", "a", "x", 1.0), ("t", "a", "y", 2.0), ("t", "b", "x", 0.5)], "target string, left string, right string, cost double")
    assert sorted((r["left"], r["right"]) for r in joins.greedy_match(c).collect()) == [("a", "y"), ("b", "x")]
    rows = spark.createDataFrame([("c", 0), ("c", 1), ("c", 1), ("d", 0)], "l string, r int")
    assert {r["l"]: (r["found"], r["duplicates"], r["complete"]) for r in joins.shard_audit(rows, "l", "r", 2).collect()} == {"c": (2, 1, False), "d": (1, 0, False)}


def test_thinning_keeps_a_maximal_set_of_far_places(spark):
    rows = spark.createDataFrame([("u", i, 0.2 * i / 2, 10.0) for i in range(1, 40)], "unit string, key long, lat double, lon double")
    kept = sorted(r["lat"] for r in panels.thinned(rows, "t", 30.0, 100).collect())
    gaps = [(b - a) * 111.195 for a, b in zip(kept, kept[1:])]
    assert min(gaps) >= 30 - 1e-6 and max(gaps) < 61
    assert panels.thinned(rows, "t", 30.0, 3).count() == 3


def test_schedules_are_balanced():
    draws = panels.balanced_schedule(list("abcdefg"), 11, 3, 5)
    counts = [sum(x in d for d in draws) for x in "abcdefg"]
    assert max(counts) - min(counts) <= 1 and all(len(set(d)) == 3 for d in draws)


def test_nested_thinning_levels_lie_in_each_other(spark):
    rows = spark.createDataFrame([("u", i) for i in range(50)], "unit string, i long")
    out = panels.retained(rows, "t", "unit", "i", [0.25, 0.5, 1.0], 12).collect()
    level = {f: {r["i"] for r in out if r["level"] == f} for f in (0.25, 0.5, 1.0)}
    assert level[0.25] < level[0.5] < level[1.0] and [len(level[f]) for f in (0.25, 0.5, 1.0)] == [13, 25, 50]


def test_two_way_effects_and_clustered_test_against_least_squares(spark):
    rng = np.random.default_rng(8)
    s, t = (v.ravel() for v in np.meshgrid(np.arange(12), np.arange(10), indexing="ij"))
    keep = rng.random(len(s)) > 0.1  # not complete
    s, t = s[keep], t[keep]
    x1, x2 = rng.normal(size=(2, len(s)))
    y = 0.3 * s + 0.2 * t + 0.6 * x1 + 0.1 * x2 + 0.2 * rng.normal(size=len(s))
    df = spark.createDataFrame(pd.DataFrame({"source": s, "target": t, "x1": x1, "x2": x2, "y": y}))
    dummies = np.hstack([np.eye(12)[s], np.eye(10)[t][:, 1:]])
    hat = lambda v: v - dummies @ np.linalg.lstsq(dummies, v, rcond=None)[0]
    got = dyadic.absorbed(df, ["y"]).orderBy("source", "target").toPandas()["y"].to_numpy()
    assert np.abs(got - hat(y)).max() < 1e-9
    x, r = np.stack([hat(x1), hat(x2)], 1), hat(y)
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ r
    h = (x @ bread[:, 0]) * (r - x @ beta)
    n, p = x.shape
    square = lambda by: sum(h[by == v].sum() ** 2 for v in np.unique(by))
    v = 12 / 11 * (n - 1) / (n - p) * square(s) + 10 / 9 * (n - 1) / (n - p) * square(t) - n / (n - p) * (h * h).sum()
    row = dyadic.clustered_test(df, "y", ["x1", "x2"]).first()
    assert abs(row["coefficient"] - beta[0]) < 1e-9 and abs(row["standard_error"] - math.sqrt(v)) < 1e-9 and row["p"] < 0.05
    left, info = dyadic.unique_information(df, "x1", ["x2"])
    z = hat(x1) - hat(x2) * (hat(x1) @ hat(x2)) / (hat(x2) @ hat(x2))
    assert abs(info.first()["total_fraction"] - (z @ z) / ((x1 - x1.mean()) @ (x1 - x1.mean()))) < 1e-9
    support = dyadic.signal_support(left, "residual").first()
    share = z * z / (z @ z)
    assert abs(support["effective_dyads"] - 1 / (share @ share)) < 1e-6


def test_bootstrap_p_values_and_envelopes(spark):
    rng = np.random.default_rng(1)
    assert inference.studentized_bootstrap(rng.normal(1, 0.5, 40))[2] < 0.01 < 0.2 < inference.studentized_bootstrap(rng.normal(-0.5, 0.5, 40))[2]
    assert inference.studentized_bootstrap(np.ones(8))[1] == math.inf
    with pytest.raises(ValueError):
        inference.studentized_bootstrap(np.ones(5))
    ref = spark.createDataFrame([("a", float(i)) for i in range(99)] + [("b", 5.0)] * 9, "label string, value double")
    seen = spark.createDataFrame([(1, 98.0), (2, 5.0), (3, 200.0)], "k int, value double")
    p = inference.exceedance(seen, ref, ["k"])
    assert {(r["k"], r["label"]): r["p"] for r in p.collect()} == {(1, "a"): 0.02, (1, "b"): 0.1, (2, "a"): 0.95, (2, "b"): 1.0, (3, "a"): 0.01, (3, "b"): 0.1}
    assert {r["k"]: (r["p"], r["label"]) for r in inference.envelope(p, ["k"]).collect()} == {1: (0.1, "b"), 2: (1.0, "b"), 3: (0.1, "b")}


def test_permutations_keep_each_units_values(spark, records):
    out = inference.permuted(records.select("unit", "i", "trait"), 3, ["unit"], "trait").collect()
    data = plain(records)
    for r in range(3):
        for u, rows in data.items():
            assert sorted(x["trait"] for x in out if x["replicate"] == r and x["unit"] == u) == sorted(x["trait"] for x in rows)


def test_densities_overlaps_and_components(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
    df = spark.createDataFrame(pd.DataFrame({"unit": np.repeat(["a", "b", "c"], 30), "v1": x[:, 0], "v2": x[:, 1], "v3": x[:, 2]}))
    fitted = niche.components(df, ["v1", "v2", "v3"])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    assert np.allclose(sorted(np.linalg.eigvalsh(np.cov(z.T)))[::-1][:2], fitted["values"])
    w = niche.whitened(df, fitted)
    moments = w.agg(F.var_samp("w1").alias("a"), F.covar_samp("w1", "w2").alias("b")).first()
    assert abs(moments["a"] - 1) < 1e-9 and abs(moments["b"]) < 1e-9
    centres = niche.grid(w, ["w1", "w2"], 20)
    p = niche.densities(w.repartition(5), ["w1", "w2"], centres)
    assert all(abs(r["s"] - 1) < 1e-9 for r in p.groupBy("unit").agg(F.sum("p").alias("s")).collect())
    d = {(r["source"], r["target"]): r["d"] for r in niche.overlaps(p).collect()}
    assert len(d) == 6 and all(0 <= v <= 1 and abs(v - d[t, s]) < 1e-12 for (s, t), v in d.items())


def test_sequences(spark):
    seqs = spark.createDataFrame([("u", 0, "ACGT"), ("u", 0, "ACGA"), ("u", 1, "ACCT"), ("u", 2, "NNNN")], "unit string, loc long, sequence string")
    edges = spark.createDataFrame([("u", 0, 1), ("u", 1, 2)], "unit string, a long, b long")
    got = {(r["a"], r["b"]): (r["n_pairs"], r["distance"], r["comparable"]) for r in sequence.edge_sequence_distances(seqs, edges, 2).collect()}
    assert got == {(0, 1): (2, 0.375, 4), (1, 2): (0, None, 0)}


def test_worlds_are_the_same_wherever_they_are_drawn(spark):
    cells = [{"shared": 1.0, "amplitude": 2.0}]
    a, b = (sorted(map(str, worlds.worlds(spark, cells, 2, 5, 6, 10).repartition(n).collect())) for n in (1, 4))
    assert a == b and len(a) == 120
    for mode in worlds.PAIRED_MODES:
        one = worlds.paired_world(1, mode, 4, 5)
        assert len(one) == 20 and one.equals(worlds.paired_world(1, mode, 4, 5))


def test_shared_fronts_transfer_and_private_ones_do_not(spark):
    plan = TransferPlan(k=4, bandwidth=0.25)
    shared, private = (spark.createDataFrame(worlds.circular_world(11, 20, 40, s, 2.0, 0.5, 0.15)) for s in (1.0, 0.0))
    assert plan.test(shared).first()["p"] < 0.05 < plan.test(private).first()["p"]


def test_detectability_grows_with_the_effect(spark):
    rows = {r["effect"]: r["rejections"] for r in worlds.detectability(spark, [0.0, 0.3], [0.0], 30, 3, 10, 10).collect()}
    assert rows[0.0] <= 6 < 25 <= rows[0.3]


def test_streamed_batches_score_touched_units(spark, tmp_path):
    from transecta.streaming.arrivals import rescore

    source = tmp_path / "in"
    for k, rows in enumerate(([("a", 1.0), ("b", 2.0)], [("a", 3.0)])):
        spark.createDataFrame(rows, "unit string, v double").coalesce(1).write.parquet(f"{source}/{k}")
    stream = spark.readStream.schema("unit string, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    query = rescore(stream, f"{tmp_path}/store", lambda d: d.groupBy("unit").agg(F.sum("v").alias("v")), f"{tmp_path}/out", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out").groupBy("unit").agg(F.max("v").alias("v")).collect()
    assert {r["unit"]: r["v"] for r in out} == {"a": 4.0, "b": 2.0}


def test_worlds_scored_together_equal_each_alone(records):
    plan = TransferPlan()
    edges = plan.edges(records).withColumn("other", F.round(F.col("turnover") * F.col("length"), 9))
    parts = lambda e: (e.where("role = 'train'").drop("role"), e.where("role = 'held'").drop("role"))
    both = diagnostics.world_scores(*parts(edges.withColumn("turnover", F.array("turnover", "other"))), 0.25)
    got = {k: {r["unit"]: r["score"] for r in both.where(F.col("world") == k).collect()} for k in (0, 1)}
    alone = {r["unit"]: r["score"] for r in plan.scores(edges).collect()}
    other = {r["unit"]: r["score"] for r in plan.scores(edges.withColumn("turnover", F.col("other"))).collect()}
    assert same(got[0], alone) and same(got[1], other)
    assert {r["increment"] for r in diagnostics.increments(plan.scores(edges), plan.scores(edges), ["unit"]).collect() if not math.isnan(r["increment"])} == {0.0}


@pytest.mark.parametrize("mode", ["pooled", "self", "ratio"])
def test_transported_weights_add_up_in_every_unit(records, mode):
    edges = TransferPlan().edges(records)
    train, held = edges.where("role = 'train'").drop("role"), edges.where("role = 'held'").drop("role")
    weights = diagnostics.transport_weights(train, held, 0.25, mode)
    assert weights.count() == train.count()
    assert all(abs(r["s"] - 1) < 1e-9 for r in weights.groupBy("unit").agg(F.sum("weight").alias("s")).collect())
    assert all(0 < r["effective"] <= r["edges"] + 1e-9 for r in diagnostics.effective_edges(weights).collect())


def test_expected_rank_correlation_is_the_mean_over_all_pairs(spark):
    rng = np.random.default_rng(4)
    left, right = rng.integers(0, 5, (3, 6)), rng.normal(size=(4, 6))
    w = [0.5, 0.3, 0.2]
    table = lambda m, ws: spark.createDataFrame([(d, e, float(v), ws[d]) for d, row in enumerate(m) for e, v in enumerate(row)], "draw int, entry int, value double, weight double")

    def rho(x, y):
        a, b = (v - v.mean() for v in (average(list(x)), average(list(y))))
        return a @ b / math.sqrt((a @ a) * (b @ b))

    want = sum(w[i] * 0.25 * rho(x, y) for i, x in enumerate(left) for y in right)
    assert abs(diagnostics.expected_rank_correlation(table(left, w), table(right, [1.0] * 4)).first()["expected"] - want) < 1e-9
