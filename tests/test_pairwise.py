import numpy as np
import pytest

from transecta.operators import field, pairwise, smooth, spatial


def test_kernels_of_each_group_are_the_direct_sums(monkeypatch):
    rng = np.random.default_rng(2)
    x, mid, weights = rng.random((3000, 2)), rng.random((90, 2)), rng.random((90, 2))
    groups = np.split(rng.permutation(90), [10, 11, 60])
    monkeypatch.setattr(pairwise, "NUMBERS", 6000)  # two groups at a time
    for k, end, sums in pairwise.kernels(x, mid, weights, groups, 0.4):
        for g in range(k, end):
            assert np.abs(sums[:, g - k] - smooth.direct(x, mid[groups[g]], weights[groups[g]], 0.4)).max() < 1e-12


def test_ranks_share_places_among_ties():
    found = pairwise.ranks(np.array([[3.0, 1], [1, 1], [3, 1], [2, 1]]))
    assert found.T.tolist() == [[1.0, -1.5, 1.0, -0.5], [0.0] * 4]


def test_held_units_meet_sources_in_few_large_blocks(spark, monkeypatch):
    rng, rows = np.random.default_rng(4), []
    for u in range(8):
        for e in range(20 + u):
            start, end = rng.random(2), rng.random(2)
            rows.append((u, e, e + 1, start.tolist(), end.tolist(), ((start + end) / 2).tolist(), float(rng.random())))
    df = spark.createDataFrame(rows, "unit long, a long, b long, start array<double>, end array<double>, mid array<double>, turnover double")
    train, held = df.where("unit < 4"), df.where("unit >= 4")
    monkeypatch.setattr(field, "blocked", lambda *a, **k: pytest.fail("copies of points in small blocks"))
    got = lambda: {(r["unit"], r["source"]): (r["n"], round(r["score"], 9)) for r in field.pair_scores(train, held, 0.3).collect()}
    once = got()
    monkeypatch.setattr(pairwise, "HELD", 10)
    monkeypatch.setattr(pairwise, "TRAIN", 10)
    assert got() == once and len(once) == 16
    listed = spark.createDataFrame([(4, 1), (6, 3), (6, 0)], "unit long, source long")
    assert {(r["unit"], r["source"]): (r["n"], round(r["score"], 9)) for r in field.pair_scores(train, held, 0.3, pairs=listed).collect()} == {k: once[k] for k in [(4, "1"), (6, "3"), (6, "0")]}


def test_nearest_distances_by_cells(spark, monkeypatch):
    rng = np.random.default_rng(6)
    there = np.concatenate([rng.random((300, 2)) * 0.01, rng.random((40, 2))])
    asks = np.concatenate([rng.random((50, 2)), [[40.0, -7.0]], there[:5], rng.random((20, 2)) * 0.01])
    frame = lambda x: spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "row string, coords array<double>")
    monkeypatch.setattr(spatial, "blocked", lambda *a, **k: pytest.fail("all with all"))
    found = {int(r["row"]): r["distance"] for r in spatial.nearest_distances(frame(asks), frame(there)).collect()}
    want = np.sqrt(((asks[:, None] - there[None]) ** 2).sum(2)).min(1)
    assert len(found) == len(asks) and all(found[i] == pytest.approx(w, abs=1e-12) for i, w in enumerate(want))
