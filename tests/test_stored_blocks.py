"""Blocks that are written once: no copies of them, and no counts, are dealt."""

import numpy as np
import pytest

from transecta.operators import field, joins, pairwise


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def points(spark, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(u, k, float(x), float(y)) for u in range(12) for k, (x, y) in enumerate(np.round(rng.random((15, 2)), 2))]
    return rows, spark.createDataFrame([*rows, (3, 99, float("nan"), 0.5), (4, 99, None, 0.5)], "unit long, i long, x double, y double")


@pytest.mark.parametrize("least", [0.0, 0.4])
def test_coverage_both_ways_without_a_count_dealt(spark, least):
    rows, df = points(spark)
    own = {u: np.array([r[2:] for r in rows if r[0] == u]) for u in range(12)}
    size = {u: len(x) + (u in (3, 4)) for u, x in own.items()}
    near = lambda a, b: int((((own[a][:, None] - own[b][None]) ** 2).sum(2) <= 0.1 * 0.1).any(1).sum())
    want = {(t, s): (near(t, s), near(t, s) / size[t], near(s, t) / size[s]) for t in own for s in own if t != s and near(t, s) and near(t, s) / size[t] >= least}
    found = joins.mutual_coverage(df, df, ["x", "y"], 0.1, least)
    assert {(r["target"], r["source"]): (r["covered"], r["coverage"], r["reverse"]) for r in found.collect()} == want
    assert "Exchange" not in plan_of(joins.pair_coverage(df, df, ["x", "y"], 0.1))


def test_cells_far_apart_have_numbers_of_their_own():
    side = lambda x: {"x": np.array(x, float), "unit": np.arange(len(x)), "units": len(x)}
    found = joins._counts(side([[0, 0], [1e12, -1e12], [5, 5]]), side([[0.05, 0], [1e12, -1e12]]), ["x", "y"], 0.1)
    assert found.tolist() == [[1, 0], [0, 1], [0, 0]]


def test_fields_of_single_sources_deal_no_blocks(spark, monkeypatch):
    rng, rows = np.random.default_rng(4), []
    for u in range(6):
        for e in range(20):
            start, end = rng.random(2), rng.random(2)
            rows.append((u, e, e + 1, start.tolist(), end.tolist(), ((start + end) / 2).tolist(), float(rng.random())))
    df = spark.createDataFrame(rows, "unit long, a long, b long, start array<double>, end array<double>, mid array<double>, turnover double")
    monkeypatch.setattr(pairwise, "HELD", 20)
    monkeypatch.setattr(pairwise, "TRAIN", 20)
    found = field.pair_scores(df.where("unit < 3"), df.where("unit >= 3"), 0.3)
    assert found.count() == 9 and "Exchange" not in plan_of(found)
