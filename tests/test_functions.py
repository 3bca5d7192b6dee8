import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from transecta.functions import ranks, scalars


def average(values):
    order = sorted(values)
    return [(order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in values]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(u, i, float(rng.randint(0, 6)), rng.random(), rng.random()) for u, n in (("a", 30), ("b", 5), ("c", 2), ("d", 1)) for i in range(n)]
    data += [("e", i, 3.0, rng.random(), rng.random()) for i in range(6)]
    return spark.createDataFrame(data, "unit string, i long, x double, y double, z double")


def by_unit(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["unit"], r["i"])):
        out.setdefault(r["unit"], []).append(r)
    return out


def test_average_ranks_in_both_forms(rows):
    keys = [F.col("unit")]
    one = rows.withColumn("r", ranks.average_rank(F.col("x"), *keys)).withColumn("s", ranks.rank01(F.col("x"), *keys))
    two = ranks.spread_ranks(rows.repartition(5), ["unit"], "x", "r")
    for found in (by_unit(one), by_unit(two)):
        for rs in found.values():
            assert [r["r"] for r in rs] == average([r["x"] for r in rs])
    assert all(0 < r["s"] < 1 for rs in by_unit(one).values() for r in rs)


def rho(x, y):
    a, b = np.array(average(x)), np.array(average(y))
    a, b = a - a.mean(), b - b.mean()
    low = math.sqrt((a @ a) * (b @ b))
    return float("nan") if len(x) < 3 else 0.0 if low <= 1e-15 else float(a @ b / low)


def test_spearman_with_ties_constants_and_few_rows(rows):
    data = by_unit(rows)
    for r in ranks.spearman(rows, "x", "y", ["unit"]).collect():
        want = rho([q["x"] for q in data[r["unit"]]], [q["y"] for q in data[r["unit"]]])
        assert (math.isnan(want) and math.isnan(r["rho"])) or abs(want - r["rho"]) < 1e-12


@pytest.mark.parametrize("controls", [["z"], ["z", "x"]])
def test_partial_spearman_is_the_correlation_of_residuals(rows, controls):
    data = by_unit(rows.where("unit = 'a'").withColumn("p", F.col("x") + F.col("y")))["a"]
    got = ranks.partial_spearman(rows.where("unit = 'a'").withColumn("p", F.col("x") + F.col("y")), "p", "y", controls, ["unit"]).first()["rho"]
    c = lambda v: np.array(average(v)) - (len(v) + 1) / 2
    q = np.stack([c([r[k] for r in data]) for k in controls], 1)
    res = lambda v: v - q @ np.linalg.lstsq(q, v, rcond=None)[0]
    a, b = res(c([r["p"] for r in data])), res(c([r["y"] for r in data]))
    assert abs(got - a @ b / math.sqrt((a @ a) * (b @ b))) < 1e-9


def test_length_orthogonalized_turnover_has_no_length_left(rows):
    out = by_unit(ranks.length_orthogonalized(rows, "y", "z", ["unit"], "free"))
    a = np.array([r["free"] for r in out["a"]])
    z = np.array(average([r["z"] for r in out["a"]]))
    n = len(a)
    assert abs(a @ (z - z.mean())) < 1e-9 and abs(a.std() - math.sqrt((n * n - 1) / (12 * n * n))) < 1e-12
    assert [r["free"] for r in out["d"]] == [0.0]


def test_scalar_expressions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    lit = F.lit
    assert abs(get(scalars.haversine_km(lit(0.0), lit(0.0), lit(0.0), lit(180.0))) - math.pi * 6371.0088) < 1e-6
    assert abs(scalars.chord_km(1e-3) - 1e-3) < 1e-9
    assert [get(scalars.density_scaled_k(lit(n))) for n in (2, 3, 10, 30, 70)] == [1, 2, 2, 5, 11]
    low, high = scalars.wilson(lit(0), lit(50))
    assert abs(get(low)) < 1e-12 and abs(get(high) - 0.0713) < 1e-3
    p, q = F.array(*map(lit, (0.5, 0.5, 0.0, 0.0))), F.array(*map(lit, (0.0, 0.0, 0.5, 0.5)))
    assert get(scalars.jensen_shannon(p, q)) == 1.0 and get(scalars.jensen_shannon(p, p)) == 0.0
    assert get(scalars.masked_distance(lit("ACGTN-acg"), lit("ACCTNAACT"), 3)) == pytest.approx(2 / 7)
    assert get(scalars.masked_distance(lit("AC"), lit("AC"), 3)) is None
    assert get(scalars.normalized_token(lit(" cox1__a-b  c"))) == "COX1 A B C" and get(scalars.normalized_name(lit("  A\t b "))) == "a b"
    assert get(scalars.without_prefix(lit("Abies alba COI"), lit("Abies alba"))) == "COI"
    assert [get(scalars.retention_label(lit(x))) for x in (0.5, 1.0, 0.125)] == ["0.5", "1", "0.125"]
    for lat, lon, ok in ((0.0, 0.0, False), (91.0, 1.0, False), (None, 1.0, False), (float("nan"), 1.0, False), (10.0, -180.0, True)):
        assert get(scalars.valid_coordinate(lit(lat).cast("double"), lit(lon).cast("double"))) is ok
    assert get(scalars.crossing_probability(lit(3.0), lit(-3.0))) == pytest.approx((2 * math.pi - 6) / math.pi)


def test_seeds_agree_with_the_generators(spark):
    from transecta.operators.worlds import seed_for

    got = spark.range(1).select(scalars.seed(F.lit(7), "a", F.lit(3)).alias("s")).first()["s"]
    assert int(got) == seed_for(7, "a", 3)
