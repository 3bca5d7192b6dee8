"""Composed tests: graph, turnover, field, scores and inference over records of many units."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import length_orthogonalized, rank01
from ..operators import diagnostics, field, graph, inference, nodes
from ..operators.panels import half_split


def _parts(edges: DataFrame | tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    return edges if isinstance(edges, tuple) else tuple(edges.where(F.col("role") == r).drop("role") for r in ("train", "held"))


@dataclass(frozen=True)
class TransferPlan:
    """Frozen choices of a held-out test; geometry is prepared once and responses vary."""

    tag: str = "split"
    k: int = 4
    bandwidth: float = 0.25
    strength: float = 0.25
    prior: float = 0.5
    segment_points: int = 5

    def edges(self, records: DataFrame, vector: bool = False) -> DataFrame:
        """Edge table with role train or held by a hash-ordered half split of units."""
        roles = half_split(records.select("unit").distinct(), self.tag).select("unit", "role")
        made = graph.neighbour_table(records, self.k, vector=vector)
        return made.join(roles, "unit")

    def halves(self, records: DataFrame, vector: bool = False) -> tuple[DataFrame, DataFrame]:
        """(train, held) of edges(), each graph made of its own half's records only."""
        return tuple(graph.neighbour_table(rows, self.k, vector=vector) for rows in self.record_halves(records))

    def record_halves(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(train, held) records."""
        roles = half_split(records.select("unit").distinct(), self.tag)
        return tuple(records.join(roles.where(F.col("role") == r), "unit", "left_semi") for r in ("train", "held"))

    def scores(self, edges: DataFrame | tuple[DataFrame, DataFrame]) -> DataFrame:
        """Scores of the held units; edges as edges() or halves() give them."""
        train, held = _parts(edges)
        return field.transfer_scores(train, held, self.bandwidth, self.strength, self.prior, self.segment_points)

    def length_conditioned_scores(self, edges: DataFrame | tuple[DataFrame, DataFrame], rescale: bool = True) -> DataFrame:
        """Training turnover made orthogonal to edge length, with prior 0; held units scored as they are. Without rescale residuals keep their own spread."""
        train, held = _parts(edges)
        train = length_orthogonalized(train, "turnover", "length", ["unit"], "free", rescale).drop("turnover").withColumnRenamed("free", "turnover")
        return field.transfer_scores(train, held, self.bandwidth, self.strength, 0.0, self.segment_points)

    def normalization_bias(self, edges: DataFrame | tuple[DataFrame, DataFrame], digits: int = 6) -> DataFrame:
        """(unit, normalized, unscaled, difference): scores with and without the residuals' final scaling, on one geometry."""
        train, held = _parts(edges)
        for rescale, name in ((True, "normalized"), (False, "unscaled")):
            train = length_orthogonalized(train, "turnover", "length", ["unit"], name, rescale)
        found = field.response_scores(train, held, self.bandwidth, {"normalized": 0.0, "unscaled": 0.0}, self.strength, self.segment_points)
        return found.select("unit", *(F.round(c, digits).alias(c) for c in ("normalized", "unscaled"))).withColumn("difference", F.col("normalized") - F.col("unscaled"))

    def conditioning_increments(self, edges: DataFrame | tuple[DataFrame, DataFrame], digits: int = 6) -> DataFrame:
        """(unit, increment): length-conditioned less plain scores, on one geometry."""
        train, held = _parts(edges)
        train = length_orthogonalized(train, "turnover", "length", ["unit"], "free")
        found = field.response_scores(train, held, self.bandwidth, {"turnover": self.prior, "free": 0.0}, self.strength, self.segment_points)
        return found.select("unit", (F.round("free", digits) - F.round("turnover", digits)).alias("increment"))

    def permutation_worlds(self, records: DataFrame, permutations: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
        """(train, held) edges with turnover, an array of the observed one and of one for each shuffle of the traits within units, on one graph."""
        places = records.select("unit", "i", "coords")
        edges = graph.neighbour_table(records, self.k)
        traits = records.select("unit", "i", "trait", F.lit(0).alias("replicate"))
        if permutations:
            moved = inference.permuted(records.select("unit", "i", "trait"), permutations, ["unit"], "trait", seed)
            traits = traits.unionByName(moved.select("unit", "i", "trait", (F.col("replicate") + 1).alias("replicate")))
        rows = edges.select("unit", "a", "b").join(traits.toDF("unit", "a", "x", "replicate"), ["unit", "a"]).join(traits.toDF("unit", "b", "y", "replicate"), ["unit", "b", "replicate"])
        rows = rows.withColumn("t", rank01(F.abs(F.col("x") - F.col("y")), F.col("unit"), F.col("replicate")))
        worlds = rows.groupBy("unit", "a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("replicate", "t"))), lambda x: x["t"]).alias("turnover"))  # one number for each shuffle
        roles = half_split(places.select("unit").distinct(), self.tag).select("unit", "role")
        both = edges.drop("turnover").join(worlds, ["unit", "a", "b"]).join(roles, "unit")
        return tuple(both.where(F.col("role") == r).drop("role") for r in ("train", "held"))

    def permutation_scores(self, records: DataFrame, permutations: int, seed: int = 0) -> DataFrame:
        """(world, unit, n, score) of permutation_worlds(). The task that makes a small unit's graph shuffles its traits and, if it is held, scores it: no edge is dealt again, nor multiplied by the worlds."""
        plain = lambda rows: diagnostics.world_scores(*self.permutation_worlds(rows, permutations, seed), self.bandwidth, self.strength, self.prior)
        if dict(records.dtypes)["i"] not in ("bigint", "int") or dict(records.dtypes)["trait"].startswith("array") or graph.largest(records) > graph.SMALL or self.strength <= 0:
            return plain(records)
        train, held = (graph.placed(x, F.col("trait").cast("double").alias("trait")) for x in self.record_halves(records))
        k = self.k

        def weighed(table: pa.Table) -> pa.Table:
            _, _, mid, u = graph.shuffled(table, k, permutations, seed)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (mid, u)]
            return pa.table({"mid": lists[0], "w": pa.array(np.full(len(u), 1.0 / max(1, len(u)))), "u": lists[1]})

        def edges(table: pa.Table) -> tuple:
            start, end, _, u = graph.shuffled(table, k, permutations, seed)
            return start, end, u

        near = nodes.gathered(train.groupBy("unit").applyInArrow(weighed, "mid array<double>, w double, u array<double>"), self.bandwidth)
        return nodes.scored(held, edges, near, self.strength, self.prior, 5, field.TINY, field.DIGITS) if near else plain(records)

    def permutation_statistics(self, records: DataFrame, permutations: int, seed: int = 0, digits: int = 6) -> DataFrame:
        """(world, units, statistic): world 0 is what was observed; in the others traits are shuffled, the field fitted and held units scored again."""
        scores = self.permutation_scores(records, permutations, seed)
        finite = scores.where(~F.isnan("score"))
        return finite.groupBy("world").agg(F.count(F.lit(1)).alias("units"), F.avg(F.round("score", digits)).alias("statistic"))

    def permutation_test(self, records: DataFrame, permutations: int = 199, seed: int = 0) -> DataFrame:
        """(statistic, permutations, p): the share of worlds, the observed one counted in, whose statistic is not below it."""
        rows = self.permutation_statistics(records, permutations, seed)
        seen = rows.where("world = 0").select(F.col("statistic").alias("seen"))
        null = rows.where("world > 0").crossJoin(F.broadcast(seen))  # one row
        counts = null.agg(F.count(F.lit(1)).alias("permutations"), F.count_if(F.col("statistic") >= F.col("seen")).alias("above"))
        return seen.crossJoin(counts).select(F.col("seen").alias("statistic"), "permutations", ((1 + F.col("above")) / (1 + F.col("permutations"))).alias("p"))

    def test(self, records: DataFrame, resamples: int = 1999, seed: int = 0) -> DataFrame:
        """(n, mean, t, p) of the held units' scores: the whole test from records to a p value."""
        return inference.bootstrap_test(self.scores(self.edges(records)).withColumn("test", F.lit(0)), "score", ["test"], resamples, seed).drop("test")
