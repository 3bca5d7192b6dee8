"""Residuals by prefix sums against ranking every edge's training edges anew, with ties, hubs and large units."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from transecta.functions.ranks import EPS
from transecta.operators import residual


def ranks(v):
    return residual.Side(v).rank


def brute(a, b, x, y, targets):
    out = []
    for e in targets:
        free = ~((a == a[e]) | (a == b[e]) | (b == a[e]) | (b == b[e]))
        n = free.sum()
        rx, ry = (ranks(v[free]) / (n + 1) - 0.5 for v in (x, y))
        hx, hy = (((v[free] < v[e]).sum() + 0.5 * (v[free] == v[e]).sum() + 0.5) / (n + 1) for v in (x, y))
        out.append((n, hx, hy, (rx * rx).sum(), (rx * ry).sum()))
    return np.array(out).reshape(-1, 5).T


@st.composite
def graphs(draw):
    n = draw(st.integers(2, 12))
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    edges = draw(st.lists(st.sampled_from(pairs), unique=True, min_size=1, max_size=40))
    if draw(st.booleans()):
        edges = sorted(set(edges) | {(0, j) for j in range(1, n)})  # a hub
    values = st.lists(st.integers(0, draw(st.sampled_from([0, 2, 1000]))), min_size=len(edges), max_size=len(edges))
    return np.array(edges), np.array(draw(values), float), np.array(draw(values), float)


@settings(max_examples=150, deadline=None)
@given(graphs(), st.sampled_from([256, 3, 1]), st.sampled_from([1024, 2]), st.sampled_from([1 << 21, 20]))
def test_sums_equal_ranking_anew(graph, heavy, dense, pairs):
    edges, x, y = graph
    old = residual.HEAVY, residual.DENSE, residual.PAIRS
    residual.HEAVY, residual.DENSE, residual.PAIRS = heavy, dense, pairs
    try:
        targets = np.arange(len(edges))[::-1]
        found = residual.unit_sums(edges[:, 0], edges[:, 1], x, y, targets)
    finally:
        residual.HEAVY, residual.DENSE, residual.PAIRS = old
    assert np.allclose(found, brute(edges[:, 0], edges[:, 1], x, y, targets), atol=1e-9)


def test_counts_above():
    rng = np.random.default_rng(2)
    for m in (1, 2, 7, 64, 1500):
        y_at = rng.permutation(m)
        for dense in (0, 1 << 20):
            old, residual.DENSE = residual.DENSE, dense
            try:
                above = residual.Above(y_at)
            finally:
                residual.DENSE = old
            i, j = rng.integers(0, m + 1, 200), rng.integers(0, m + 1, 200)
            assert above.count(i, j).tolist() == [int((y_at[a:] >= b).sum()) for a, b in zip(i, j)]


def chain(m, rng):
    a = np.arange(m) // 2
    edges = np.unique(np.sort(np.stack([a, a + 1 + rng.integers(0, 4, m)], 1), axis=1), axis=0)
    return edges, rng.random(len(edges)), rng.random(len(edges))


def test_an_edge_costs_what_its_ends_have():
    rng, took = np.random.default_rng(3), []
    for m in (100_000, 800_000):
        edges, x, y = chain(m, rng)
        began = time.time()
        residual.unit_sums(edges[:, 0], edges[:, 1], x, y, np.arange(4000))
        took.append(time.time() - began)
    assert took[1] < 20 * took[0] + 2  # reading and sorting the unit itself is most of it


def test_a_hub_of_many_edges():
    rng, n = np.random.default_rng(4), 100_000
    edges = np.concatenate([np.stack([np.zeros(n, int), np.arange(1, n + 1)], 1), np.stack([np.arange(1, n), np.arange(2, n + 1)], 1)])
    x, y = rng.integers(0, 5000, len(edges)).astype(float), rng.random(len(edges))
    began = time.time()
    targets = np.arange(20_000)
    found = residual.unit_sums(edges[:, 0], edges[:, 1], x, y, targets)
    assert time.time() - began < 20
    some = targets[:: 4000]
    assert np.allclose(found[:, some], brute(edges[:, 0], edges[:, 1], x, y, some), rtol=1e-9)


@pytest.mark.parametrize("most, targets", [(1 << 20, 1 << 15), (1 << 20, 16), (100, 16)])
def test_units_of_any_size_settle_alike(spark, monkeypatch, most, targets):
    monkeypatch.setattr(residual, "TARGETS", targets)
    rng, rows = np.random.default_rng(6), []
    for unit, m in (("small", 30), ("large", 240), ("same", 60), ("two", 2)):
        edges, x, y = chain(m, rng)
        y = x if unit == "same" else np.round(y, 1)
        rows += [(unit, int(a), int(b), float(u), float(v)) for (a, b), u, v in zip(edges, x, y)]
    df = spark.createDataFrame(rows, "unit string, a long, b long, length double, difference double").repartition(4)
    found = {(r["unit"], r["a"], r["b"]): r for r in residual.crossfit_residuals(df, "length", "difference", most=most).collect()}
    count = 0
    for unit in ("small", "large", "same", "two"):
        own = [r for r in rows if r[0] == unit]
        a, b, x, y = (np.array([r[k] for r in own]) for k in (1, 2, 3, 4))
        for k, (n, hx, hy, xx, xy) in enumerate(brute(a, b, x, y, range(len(own))).T):
            r = found.get((unit, own[k][1], own[k][2]))
            assert (r is None) == (n < 5)
            if r is not None:
                count += 1
                expected = hx if unit == "same" else 0.5 + (xy / xx if xx > EPS else 0.0) * (hx - 0.5)
                assert r["n_training"] == n and abs(r["expected"] - expected) < 1e-9 and abs(r["observed"] - (hx if unit == "same" else hy)) < 1e-9
                assert r["turnover"] == 0.5 or unit != "same"
    assert count == len(found)
