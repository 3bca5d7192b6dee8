import numpy as np
import pytest
from pyspark.sql import functions as F

from transecta.operators import smooth


def drawn(points, edges, seed=5):
    rng = np.random.default_rng(seed)
    x, mid = (np.stack([rng.random(n), rng.exponential(0.1, n)], 1) for n in (points, edges))
    return x, mid, rng.random((edges, 3)) / 100


def test_sums_by_nodes_are_the_direct_sums():
    x, mid, weights = drawn(20_000, 500)
    x[:50] += 3.0  # a few far off, in cells of few points
    mid[:20] -= 2.0
    found, true = smooth.sums(x, mid, weights, 0.25), smooth.direct(x, mid, weights, 0.25)
    assert np.abs(found - true).max() < 1e-14 * true.max() and np.abs(found[50:] / true[50:] - 1).max() < 1e-13


def test_a_point_on_a_node_has_its_value():
    at = smooth.grid(np.array([2.0, -1.0]), 0.5)
    assert np.allclose(smooth.basis(at, np.array([2.0, -1.0]), 0.5), np.eye(len(at)), atol=1e-12)


def table(spark, x, columns):
    return spark.createDataFrame([(str(i), *(float(v) for v in row)) for i, row in enumerate(x)], "row string, " + ", ".join(f"{c} double" for c in columns))


def test_points_of_crowded_cells_do_not_meet_the_edges(spark):
    x, _, _ = drawn(4000, 1)
    x[0] = 7.0
    at = table(spark, x, "xy").select("row", F.array("x", "y").alias("at")).withColumn("cell", F.transform("at", lambda v: F.floor(v / 0.5)))
    ask = smooth.asked(at, 0.5)[3]
    cells, counts = np.unique(np.floor(x / 0.5), axis=0, return_counts=True)
    most = smooth.NODES**2
    assert ask.count() == sum(most if n > most else n for n in counts) < len(x)


@pytest.mark.parametrize("side", [0.25, 0.03])
def test_gaussian_sums_of_many_responses(spark, side):
    x, mid, weights = drawn(4000, 300)
    at = table(spark, x, "xy").select((F.col("row").cast("int") % 7).alias("k"), "row", F.array("x", "y").alias("at"))
    edges = table(spark, np.concatenate([mid, weights], 1), ["x", "y", "w", "u", "v"]).select("row", F.array("x", "y").alias("mid"), "w", F.array("u", "v").alias("u"))
    found = {int(r["row"]): r for r in smooth.gaussian_sums(at, edges, side, ["k", "row"]).collect()}
    true = smooth.direct(x, mid, weights[:, :1] * np.concatenate([np.ones((300, 1)), weights[:, 1:]], 1), side)
    assert len(found) == len(x) and all(found[i]["k"] == i % 7 for i in found)
    got = np.array([[found[i]["low"], *found[i]["tops"]] for i in range(len(x))])
    assert np.abs(got - true).max() < 1e-13
