"""Sums from the nodes of the edges' cells, and scores that are made where a unit's edges are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from transecta.operators import diagnostics, field, nodes, smooth
from transecta.plans.transfer import TransferPlan


def drawn(units, edges, worlds, seed=1):
    rng, rows = np.random.default_rng(seed), []
    for u in range(units):
        for e in range(edges + u):
            start, end = rng.random(2), rng.random(2) + 0.1
            rows.append((u, e, e + 1, start.tolist(), end.tolist(), ((start + end) / 2).tolist(), [float(x) for x in np.round(rng.random(worlds), 2)]))
    return rows, "unit long, a long, b long, start array<double>, end array<double>, mid array<double>, turnover array<double>"


def records(spark, units=6, n=20):
    rng = np.random.default_rng(3)
    rows = [(u, u * 100 + i, rng.random(2).tolist(), float(rng.integers(0, 9))) for u in range(units) for i in range(n)]
    return spark.createDataFrame(rows, "unit long, i long, coords array<double>, trait double")


@pytest.mark.parametrize("axes, side", [(1, 0.3), (2, 0.25), (3, 0.7)])
def test_sums_from_nodes_of_both_sides_are_the_direct_sums(axes, side):
    rng = np.random.default_rng(2)
    x, mid, weights, found = rng.random((300, axes)) * 2 - 1, rng.random((500, axes)) * 2 - 1, rng.random((500, 3)), {}
    nodes.summed(mid, weights, side, found)
    sums = nodes.Sums(np.array(list(found)), np.stack(list(found.values())), side)
    true = smooth.direct(x, mid, weights, side)
    assert np.abs(sums.at(x) / true - 1).max() < 1e-12
    assert np.isnan(sums.at(np.full((1, axes), np.nan))).all()


def test_world_scores_deal_no_points_and_equal_the_sums_by_blocks(spark, monkeypatch):
    df = spark.createDataFrame(*drawn(6, 40, 3)).cache()
    train, held = df.where("unit < 3"), df.where("unit >= 3")
    got = lambda: {(r["world"], r["unit"]): (r["n"], round(r["score"], 9)) for r in diagnostics.world_scores(train, held, 0.3).collect()}
    with monkeypatch.context() as m:
        m.setattr(smooth, "gaussian_sums", lambda *a, **k: pytest.fail("points are dealt"))
        found = got()
    monkeypatch.setattr(nodes, "GATHERED", 100)  # too many cells
    assert found == got() and len(found) == 9


def test_several_responses_have_one_geometry(spark, monkeypatch):
    df = spark.createDataFrame(*drawn(6, 30, 2)).withColumns({"other": F.col("turnover")[1], "turnover": F.col("turnover")[0]})
    train, held = df.where("unit < 3"), df.where("unit >= 3")
    once, gathered = [], nodes.gathered
    monkeypatch.setattr(nodes, "gathered", lambda *a: (once.append(1), gathered(*a))[1])
    found = {r["unit"]: (r["turnover"], r["other"]) for r in field.response_scores(train, held, 0.3, {"turnover": 0.5, "other": 0.0}).collect()}
    assert len(once) == 1
    for k, (c, prior) in enumerate((("turnover", 0.5), ("other", 0.0))):
        for r in field.transfer_scores(train.withColumn("turnover", F.col(c)), held, 0.3, prior=prior).collect():
            assert found[r["unit"]][k] == pytest.approx(r["score"], abs=1e-12)


def test_permuted_worlds_are_not_dealt(spark, monkeypatch):
    plan = TransferPlan(bandwidth=0.3)
    rows = records(spark).withColumn("trait", F.when(F.col("i") % 11 == 0, None).when(F.col("i") % 13 == 0, float("nan")).otherwise(F.col("trait")))
    want = {(r["world"], r["unit"]): (r["n"], r["score"]) for r in diagnostics.world_scores(*plan.permutation_worlds(rows, 3), 0.3).collect()}
    monkeypatch.setattr(TransferPlan, "permutation_worlds", lambda *a, **k: pytest.fail("a row for each edge and world"))
    found = {(r["world"], r["unit"]): (r["n"], r["score"]) for r in plan.permutation_scores(rows, 3).collect()}
    assert set(found) == set(want) and len(found) == 12
    assert all(found[k][0] == want[k][0] and found[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)


def test_halves_are_the_edges_of_each_role(spark):
    plan = TransferPlan(bandwidth=0.3)
    keys = ["unit", "a", "b", "turnover"]
    edges, halves = plan.edges(records(spark)), plan.halves(records(spark))
    for role, half in zip(("train", "held"), halves):
        assert {tuple(r) for r in half.select(*keys).collect()} == {tuple(r) for r in edges.where(F.col("role") == role).select(*keys).collect()}
