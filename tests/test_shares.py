"""Leverage and overlap by blocks against every point's mass by source."""

import numpy as np
import pytest

from transecta.operators import field


@pytest.mark.parametrize("block", [2048, 16])
def test_shares_of_sources_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(field, "BLOCK", block)
    rng, rows = np.random.default_rng(3), []
    for unit, n in (("t1", 9), ("t2", 60), ("t3", 17), ("h1", 8), ("h2", 21)):
        for e in range(n):
            start, end = rng.random(2), rng.random(2)
            rows.append((unit, e, e + 1, start.tolist(), end.tolist(), ((start + end) / 2).tolist(), float(rng.random())))
    rows.append(("h3", 0, 1, [1e6, 1e6], [1e6, 1e6], [1e6, 1e6], 0.5))  # no mass reaches it
    df = spark.createDataFrame(rows, "unit string, a long, b long, start array<double>, end array<double>, mid array<double>, turnover double")
    train, held = df.where("unit LIKE 't%'"), df.where("unit LIKE 'h%'")
    low, owner = [], []
    for u, _, _, start, end, _, _ in (r for r in rows if r[0][0] == "h"):
        for i in range(5):
            at = np.array(start) + (i + 0.5) / 5 * (np.array(end) - np.array(start))
            own = {s: [np.exp(-0.5 * ((at - np.array(r[5])) ** 2).sum() / 0.09) for r in rows if r[0] == s] for s in ("t1", "t2", "t3")}
            low.append([float(np.mean(v)) for v in own.values()])
            owner.append(u)
    low, owner = np.array(low), np.array(owner)
    mass = low.sum(1, keepdims=True)
    share = np.divide(low, mass, out=np.zeros_like(low), where=mass > 0)
    found = {r["source"]: (r["mean_share"], r["max_share"]) for r in field.training_leverage(train, held, 0.3).collect()}
    assert set(found) == {"t1", "t2", "t3"} and all(np.allclose(found[s], (share[:, k].mean(), share[:, k].max()), atol=1e-12) for k, s in enumerate(("t1", "t2", "t3")))
    squares = (low * low).sum(1)
    effective = np.divide(mass[:, 0] ** 2, squares, out=np.zeros(len(low)), where=squares > 0)
    for r in field.support_overlap(train, held, 0.3).collect():
        assert np.allclose([r["mean_opportunity"], r["effective_sources"]], [mass[owner == r["unit"]].mean(), effective[owner == r["unit"]].mean()], atol=1e-12)
