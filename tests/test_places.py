import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from transecta import schema
from transecta.functions import ranks, scalars
from transecta.operators import blocks, joins, niche, panels, sequence, spatial
from transecta.sources import strict


def test_block_pairs_are_many_keys(spark):
    """One unit with all rows, or none named, spreads over tasks without any broadcast."""
    rows = spark.range(4000).select(F.col("id").alias("row"), F.lit("u").alias("unit"), F.rand(1).alias("x"))
    for unit in ([], ["unit"]):
        a, b = blocks.blocked(rows, unit, "row", ["x"], 200), blocks.blocked(rows, unit, "row", ["x"], 400, "block_")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            pairs = blocks.paired(a, b, unit)
            where = pairs.groupBy(F.spark_partition_id()).count().collect()
            assert sum(r["count"] for r in where) == 200 and len(where) == 4 and max(r["count"] for r in where) < 100
            assert pairs.select("l_", "r_").distinct().count() == 200
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("places, sources, targets, distances", [(4096, 16384, 2048, 1 << 21), (1, 16384, 2048, 1 << 21), (4096, 7, 5, 40), (2, 3, 4, 9)])
def test_coverage_in_crowded_cells(spark, monkeypatch, places, sources, targets, distances):
    for name, value in (("PLACES", places), ("SOURCES", sources), ("TARGETS", targets), ("DISTANCES", distances), ("GATHERED", 30)):
        monkeypatch.setattr(joins, name, value)
    rng = np.random.default_rng(4)
    rows = [(f"u{k % 4}", k, float(x), float(y)) for k, (x, y) in enumerate(rng.random((120, 2)).round(2))]
    df = spark.createDataFrame(rows, "unit string, i long, x double, y double")
    found = {(r["target"], r["source"]): r["covered"] for r in joins.pair_coverage(df, df, ["x", "y"], 0.1).collect()}
    expected = {}
    for t in rows:
        for u in {r[0] for r in rows} - {t[0]}:
            expected[t[0], u] = expected.get((t[0], u), 0) + any((t[2] - s[2]) ** 2 + (t[3] - s[3]) ** 2 <= 0.1 * 0.1 for s in rows if s[0] == u)
    assert found == {k: v for k, v in expected.items() if v}


def test_places_in_hash_order_and_seeded_splits(spark):
    rows = spark.createDataFrame([(f"n{i}",) for i in range(500)], "name string")
    found = panels.hash_order(rows, "t", "name").orderBy("place").collect()
    assert [r["place"] for r in found] == list(range(1, 501)) and [r["key"] for r in found] == sorted(r["key"] for r in found)
    train, held = panels.seeded_split([f"n{i}" for i in range(10)], 0.3, 4)
    assert len(held) == 3 and sorted(train + held) == [f"n{i}" for i in range(10)] and (train, held) == panels.seeded_split([f"n{i}" for i in range(9, -1, -1)], 0.3, 4)
    with pytest.raises(ValueError, match="two different labels"):
        panels.seeded_split(["a", "a"], 0.5, 1)


def test_spread_ranks_with_nulls_ties_and_one_value(spark):
    rows = [("a", float(i % 7)) for i in range(50)] + [("b", 1.0)] * 5
    df = spark.createDataFrame(rows, "g string, v double")
    found = sorted((r["g"], r["v"], r["p"]) for r in ranks.spread_ranks(df, ["g"], "v", "p").collect())
    assert found == sorted((g, v, sum(x < v for h, x in rows if h == g) + (sum(x == v for h, x in rows if h == g) + 1) / 2) for g, v in rows)
    assert ranks.spread_ranks(df.limit(0), ["g"], "v", "p").collect() == []
    assert {(r["g"], r["mode"], r["n"]) for r in ranks.most_frequent(df, "v", ["g"]).collect()} == {("a", 0.0, 8), ("b", 1.0, 5)}


def test_polygons_from_text_to_labels(spark):
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    features = [
        {"type": "Feature", "properties": {"realm": "one"}, "geometry": {"type": "Polygon", "coordinates": [square(0, 0, 4), square(1, 1, 2)]}},
        {"type": "Feature", "properties": {"realm": "two"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(3, 3, 2)], [square(10, 10, 1)]]}},
        {"type": "Feature", "properties": {"realm": "none"}, "geometry": None},
    ]
    polygons = strict.geojson(spark.createDataFrame([(json.dumps({"type": "FeatureCollection", "features": features}),)], "text string"), "realm")
    assert polygons.count() == 3
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 3.5, 3.5), (4, 10.5, 10.5), (5, -1.0, 0.0), (6, None, 1.0)], "k int, x double, y double")
    found = {}
    for r in spatial.in_polygons(points, polygons, "x", "y", 0.7).collect():
        found.setdefault(r["k"], set()).add(r["label"])
    assert found == {1: {"one"}, 3: {"one", "two"}, 4: {"two"}}
    labels = {r["k"]: r["label"] for r in spatial.spatial_labels(points, polygons, "k", "x", "y", "TWO", 0.7).collect()}
    assert labels == {1: "one", 2: None, 3: "two", 4: "two", 5: None, 6: None}


def test_recurrence_leaves_out_what_is_no_number(spark):
    rows = [(0, "a", 1.0), (0, "b", 2.0), (0, "c", float("nan")), (1, "a", 3.0), (1, "b", None), (1, "c", 3.0), (2, "d", None), (1, "e", float("inf"))]
    found = {r["cell"]: (r["valid"], r["probability"]) for r in spatial.recurrence(spark.createDataFrame(rows, "realization int, cell string, value double"), 0.1).collect()}
    assert found["a"] == (2, 0.5) and found["b"] == (1, 1.0) and found["c"] == (1, 1.0) and found["d"][0] == 0 and np.isnan(found["d"][1]) and found["e"][0] == 0
    with pytest.raises(ValueError, match="between 0 and 1"):
        spatial.recurrence(spark.range(0), 1.0)


def test_strict_json(spark):
    texts = ['{"b": 1, "a": {"c": [1.5, null, "é"]}}', '{"a": 1, "a": 2}', '[{"x": {"y": 1, "y": 1}}]', "[NaN]", "[-Infinity]", "[1e999]", "{", None, '"s"']
    found = strict.strict_json(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect()
    assert [r["ok"] for r in found] == [True, False, False, False, False, False, False, False, True]
    assert found[0]["canonical"] == '{"a":{"c":[1.5,null,"é"]},"b":1}' and "repeated key" in found[1]["error"]


def test_archives_raw_rows_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "a.zip", "w") as z:
        z.writestr("x/one.txt", "1")
        z.writestr("two.csv", "22")
    (tmp_path / "three.txt").write_text("333")
    with tarfile.open(tmp_path / "in" / "b.tar.gz", "w:gz") as t:
        t.add(tmp_path / "three.txt", "three.txt")
    found = {(r["member"], r["size"], bytes(r["content"])) for r in strict.archive_members(spark, str(tmp_path / "in"), r"\.txt$").collect()}
    assert found == {("x/one.txt", 1, b"1"), ("three.txt", 3, b"333")}
    (tmp_path / "r.json").write_text('{"p": 0.5}')
    assert strict.receipts(spark, str(tmp_path / "r.json")).first()["canonical"] == '{"p":0.5}'
    lines = spark.createDataFrame([("a\tX  \t1",), ("b\tY\t2",), ("short",), ("c\tX  \t",)], "value string")
    assert sorted(r["value"] for r in strict.raw_rows(lines, 1, ["X  "]).collect()) == ["a\tX  \t1", "c\tX  \t"]
    for kind in ("csv", "json", "orc", "parquet"):
        strict.sink(lines, str(tmp_path / kind), kind)
        assert spark.read.format(kind).options(header=True).load(str(tmp_path / kind)).count() == 4
        with pytest.raises(Exception, match="exists"):
            strict.sink(lines, str(tmp_path / kind), kind)
    with pytest.raises(ValueError, match="no sink"):
        strict.sink(lines, str(tmp_path / "x"), "npz")


def test_shards(spark):
    rows = spark.range(23).toDF("k")
    parts = [{r["k"] for r in strict.sharded(rows, "k", i, 4).collect()} for i in range(4)]
    assert set().union(*parts) == set(range(23)) and sum(map(len, parts)) == 23
    assert strict.ranges(10, 4) == [(0, 3), (3, 6), (6, 8), (8, 10)] and strict.ranges(0, 2) == [(0, 0), (0, 0)]
    with pytest.raises(ValueError, match="no such shard"):
        strict.sharded(rows, "k", 4, 4)


def test_schema_checks(spark):
    good = spark.createDataFrame([(f"u{k % 4}", k, [0.0, float(k)]) for k in range(8)], "unit string, i long, coords array<double>")
    assert schema.checked(good).count() == 8 and schema.faults(good).collect() == []
    bad = good.unionByName(spark.createDataFrame([("u0", 0, [0.0, 1.0]), (None, 9, [float("nan"), 1.0]), ("u1", 11, [1.0])], good.schema))
    assert {(r["fault"], r["n"]) for r in schema.faults(bad, 6).collect()} == {("repeated", 1), ("unnamed", 1), ("not_finite", 1), ("axes", 1), ("units_lacking", 2)}
    with pytest.raises(ValueError, match="repeated: 1"):
        schema.checked(bad)
    with pytest.raises(ValueError, match="no column"):
        schema.checked(good.drop("coords"))
    units = good.select("unit").distinct()
    schema.disjoint(units.where("unit < 'u2'"), units.where("unit >= 'u2'"), "unit")
    schema.subset(units.where("unit < 'u2'"), units, "unit")
    with pytest.raises(ValueError, match="both tables"):
        schema.disjoint(units, units, "unit")
    with pytest.raises(ValueError, match="not always"):
        schema.subset(units, units.where("unit < 'u2'"), "unit")


def test_gates(spark):
    row = spark.createDataFrame([(0.5, float("nan"), None)], "a double, b double, c double")
    found = {r["name"]: r for r in schema.gates(row, [("a", ">=", 0.5), ("b", "<", 1.0), ("c", ">", 0.0)]).collect()}
    assert found["a"]["passed"] and not found["b"]["passed"] and not found["c"]["passed"] and found["a"]["status"] == "NOT_EVALUABLE"
    assert schema.gates(row, [("a", "<=", 0.5)]).first()["status"] == "EVALUABLE"


def test_measures_matches_and_transforms(spark):
    row = spark.createDataFrame([(300.15, " k", "Homo  Sapiens", 5, "exact", "species", "homo sapiens")], "v double, u string, n string, k long, m string, r string, c string")
    got = row.select(
        scalars.harmonized(F.col("v"), F.col("u")).alias("h"), scalars.harmonized(F.col("v"), F.lit("X")).alias("x"), scalars.name_match(F.col("n"), F.col("k"), F.col("m"), F.col("r"), F.col("c")).alias("a"),
        scalars.name_match(F.col("n"), F.lit(None), F.col("m"), F.col("r"), F.col("c")).alias("b"), scalars.vector_displacement(F.array(F.lit(3.0)), F.array(F.lit(1.0))).alias("d"),
        scalars.response(F.col("v"), "identity").alias("i"), scalars.response(F.lit(0.5)).alias("t"),
    ).first()
    assert abs(got["h"] - 27) < 1e-9 and got["x"] is None and got["a"] == (True, "exact_canonical_species") and got["b"] == (False, "missing_usage_key")
    assert got["d"] == [2.0] and got["i"] == 300.15 and abs(got["t"] - np.tanh(0.5)) < 1e-12
    with pytest.raises(ValueError, match="no response"):
        scalars.response(F.lit(1), "cube")


def test_digests_do_not_depend_on_order_or_partitions(spark):
    import hashlib

    rows = [("g", i, f"t{i}") for i in (5, 1, 2500, 3)] + [("h", 7, None)]
    df = spark.createDataFrame(rows, "g string, i long, t string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = {r["g"]: r["sha256"] for r in sequence.ordered_digest(df.where("t is not null"), ["g"], "i", "t").collect()}
    assert found == {"g": sha("\n".join([sha("\n".join(sha(f"t{i}") for i in (1, 3, 5))), sha(sha("t2500"))]))}
    places = df.select(F.col("g").alias("unit"), "i", F.array(F.lit(0.1), F.col("i") / 7).alias("coords"))
    one, other = sequence.fingerprint(places).first(), sequence.fingerprint(places.repartition(7)).first()
    assert one == other and (one["units"], one["records"]) == (2, 5) and one != sequence.fingerprint(places.where("i < 2500")).first()


@pytest.mark.parametrize("units", [64, 3])
def test_overlaps_of_units_that_lack_cells(spark, monkeypatch, units):
    monkeypatch.setattr(niche, "UNITS", units)
    rng = np.random.default_rng(2)
    rows = [(u, int(c), float(p)) for u in range(11) for c, p in zip(rng.permutation(9)[: 4 + u % 5], rng.dirichlet(np.ones(4 + u % 5)))]
    df = spark.createDataFrame(rows, "unit int, cell int, p double").repartition(3)
    full = np.zeros((11, 9))
    for u, c, p in rows:
        full[u, c] = p
    found = {(r["source"], r["target"]): r["d"] for r in niche.overlaps(df).collect()}
    assert set(found) == {(a, b) for a in range(11) for b in range(11) if a != b}
    assert all(abs(d - (1 - np.abs(full[a] - full[b]).sum() / 2)) < 1e-12 for (a, b), d in found.items())
    some = niche.overlaps(df, spark.createDataFrame([(1, 2), (5, 3)], "source int, target int")).collect()
    assert {(r["source"], r["target"]): round(r["d"], 12) for r in some} == {k: round(found[k], 12) for k in ((1, 2), (5, 3))}
    assert niche.overlaps(df.limit(0)).collect() == []
