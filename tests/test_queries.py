"""Every query with SQL against DuckDB on the smallest tables, and that the others run there."""

import math
import os

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "none" if x is None else "nan"
    if isinstance(x, (bool, str)):
        return str(x)
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return [cell(v) for v in x]
    return f"{float(x):.6g}"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([cell(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    found = sql.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, found.fetchall())


def test_front_observability_takes_2048_fronts(spark):
    import numpy as np

    from transecta.operators import graph
    from transecta.plans import inputs

    records = inputs.records(spark, FOLDER)
    places = np.array([r["coords"][:2] for r in records.collect()])
    centre, scale = np.median(places, 0), places.std(0)
    angles = np.random.default_rng(20260912).uniform(0, 2 * math.pi, 2048)
    ways = np.stack([np.cos(angles), np.sin(angles)])
    ends = {}
    for r in graph.edge_table(records, graph.knn_edges(records)).collect():
        ends.setdefault(r["unit"], []).append((r["start"][:2], r["end"][:2]))
    found = {r["unit"]: r for r in __spark_entry__.queries()["front_observability"](spark, FOLDER).collect()}
    assert set(found) == set(ends)
    for unit, pairs in ends.items():
        z = (np.array(pairs) - centre) / scale
        v = np.abs(np.diff(np.tanh(z @ ways / 0.2), axis=1))[:, 0] / 2
        assert abs(found[unit]["contrast"] - v.mean()) < 1e-5 and abs(found[unit]["share"] - (v.max(0) >= 0.25).mean()) < 1e-5
