"""Packed sequence planes against letters compared one by one."""

import random

from pyspark.sql import functions as F

from transecta.functions.scalars import masked_distance
from transecta.operators import sequence


def test_planes_count_what_letters_do(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ACGTacgtN-?é") for _ in range(n)) for n in (0, 1, 63, 64, 65, 128, 200, 1000) for _ in range(6)] + ["A" * 64, "T" * 64, None]
    rows = [(a, b) for a in texts for b in rng.sample(texts, 8)]
    df = spark.createDataFrame(rows, "l string, r string")
    found = df.select("l", "r", sequence.compared(sequence.planes(F.col("l")), sequence.planes(F.col("r"))).alias("x"), masked_distance(F.col("l"), F.col("r"), 1).alias("d")).collect()
    for r in found:
        if r["l"] is None or r["r"] is None:
            continue
        pairs = [(a, b) for a, b in zip(r["l"].upper(), r["r"].upper()) if a in "ACGT" and b in "ACGT"]
        assert r["x"]["comparable"] == len(pairs) and r["x"]["equal"] == sum(a == b for a, b in pairs)
        assert (r["d"] is None and not pairs) or abs(r["d"] - (1 - r["x"]["equal"] / len(pairs))) < 1e-12


def test_edges_without_a_pair_and_nulls(spark):
    rows = spark.createDataFrame([("u", 0, "ACGT" * 20), ("u", 0, "ACGA" * 20), ("u", 1, "acgt" * 20), ("u", 2, "NNNN"), ("u", 3, None)], "unit string, loc int, sequence string")
    edges = spark.createDataFrame([("u", 0, 1), ("u", 0, 2), ("u", 1, 3)], "unit string, a int, b int")
    found = {(r["a"], r["b"]): (r["n_pairs"], r["distance"], r["comparable"]) for r in sequence.edge_sequence_distances(rows, edges, 10).collect()}
    assert found[0, 1] == (2, 0.125, 80) and found[0, 2] == (0, None, 0) and found[1, 3][:2] == (0, None)
