"""Resampling and Monte-Carlo inference on scores, and gates on its results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import bucket
from ..functions.scalars import hash_key, wilson


#: Numbers that a block of resamples draws at most.
DRAWS = 1 << 20


def resamples_of(n: int, resamples: int, seed: int):
    """Index matrices of `resamples` draws of n from n in all, in blocks of DRAWS numbers about; the draws don't depend on the blocks."""
    rng, each = np.random.default_rng(seed), max(1, DRAWS // max(1, n))
    for start in range(0, resamples, each):
        yield rng.integers(0, n, size=(min(each, resamples - start), n))


def studentized_bootstrap(x: np.ndarray, resamples: int = 1999, seed: int = 0) -> tuple[float, float, float]:
    """Mean, its t value and the one-sided p value of a mean above 0, from resampling centred scores."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    if len(x) < 6 or resamples < 99:
        raise ValueError("a bootstrap needs at least six finite scores and 99 resamples")
    n, tiny = len(x), np.finfo(float).tiny

    def t_values(means, spreads):
        se = spreads / math.sqrt(n)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(se > tiny, means / np.where(se > tiny, se, 1), np.sign(means) * np.inf)

    seen = float(np.nan_to_num(t_values(x.mean(), x.std(ddof=1)), nan=0.0, posinf=np.inf, neginf=0.0))
    centred, above = x - x.mean(), 0
    for at in resamples_of(n, resamples, seed):
        null = t_values(centred[at].mean(1), centred[at].std(1, ddof=1))
        above += np.count_nonzero(np.nan_to_num(null, nan=0.0, posinf=np.inf, neginf=-np.inf) >= seen)
    return float(x.mean()), seen, float((1 + above) / (resamples + 1))


def bootstrap_test(scores: DataFrame, score: str, by: list[str], resamples: int = 1999, seed: int = 0) -> DataFrame:
    """(by, n, mean, t, p): studentized_bootstrap() of a group's scores in order of value.

    A group holds one score for each held-out unit, which are few beside the rows they come from.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[score].to_numpy(float)[np.isfinite(pdf[score].to_numpy(float))])
        found = studentized_bootstrap(x, resamples, seed) if len(x) >= 6 else (float("nan"),) * 3
        return pd.DataFrame([[*pdf[by].iloc[0].tolist(), len(x), *found]], columns=[*by, "n", "mean", "t", "p"])

    kinds = dict(scores.dtypes)
    return scores.groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "n long", "mean double", "t double", "p double"]))


#: Rows of a group that one task resamples, on average.
RESAMPLED = 1 << 16


def _splits(resamples: int, seed: int, keys: list[str]):
    def run(batches):
        """For each block of a group how many of each resample's draws fall on it, one block after another."""
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            for i in range(batch.num_rows):
                sizes, group = np.array(column("sizes_")[i].as_py(), np.int64), column("group_")[i].as_py() & (1 << 63) - 1
                splits, left = np.random.default_rng([seed, group]), np.full(resamples, sizes.sum())
                later = np.cumsum(sizes[::-1])[::-1]
                for k, size in enumerate(sizes):
                    mine = splits.binomial(left, size / max(1, later[k]))
                    left = left - mine
                    if size:
                        cols = [*(column(c).slice(i, 1) for c in keys), pa.array([k], pa.int32()), pa.array([mine.astype(np.int64).tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, [*keys, "block_", "mine_"])

    return run


def _drawn_sums(resamples: int, seed: int, keys: list[str]):
    def run(table: pa.Table, split: pa.Table) -> pa.Table:
        """Sums of one block's part of every resample."""
        order = np.argsort(table.column("row_").to_numpy(zero_copy_only=False), kind="stable")
        x, block = table.column("x_").to_numpy()[order], table.column("block_")[0].as_py()
        group, mine = table.column("group_")[0].as_py() & (1 << 63) - 1, np.frombuffer(split.column("mine_")[0].as_py(), np.int64)
        rng, sums = np.random.default_rng([seed, group, block]), np.empty((2, resamples))
        each = max(1, DRAWS // max(1, int(mine.max())))
        for at in range(0, resamples, each):
            n = mine[at : at + each]
            drawn = x[rng.integers(0, len(x), n.sum())]
            ends = np.cumsum(n)
            for out, v in zip(sums, (drawn, drawn * drawn)):
                upto = np.append(0.0, np.cumsum(v))
                out[at : at + each] = upto[ends] - upto[ends - n]
        first = table.slice(0, 1)
        cols = [pa.concat_arrays([first.column(c).combine_chunks()]).take(pa.array(np.zeros(resamples, np.int64))) for c in keys]
        return pa.Table.from_arrays([*cols, pa.array(np.arange(resamples, dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])], [*keys, "replicate", "s1", "s2"])

    return run


def resampled_sums(scores: DataFrame, score: str, by: list[str], row: str, resamples: int = 1999, seed: int = 0) -> DataFrame:
    """(by, replicate, s1, s2): sums of the scores and of their squares in each of so many resamples of a group with replacement, less the group's mean.

    A group of any size is dealt to blocks by a hash of `row`, which tells its rows apart. A resample's draws
    are split over the blocks by binomials from the seed and the group, a row for each block, which meets the block's rows;
    each block draws its own. So no task sees a group, and nothing depends on partitions. Scores that are null or not finite are left out.
    """
    kinds, name = dict(scores.dtypes), F.col(row).cast("string")
    x = F.col(score).cast("double")
    rows = scores.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))).select(*by, name.alias("row_"), x.alias("x_"))
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_"), F.avg("x_").alias("mean_"))
    blocks = F.ceil(F.col("n_") / F.lit(float(RESAMPLED))).cast("int")
    group = F.xxhash64(*(F.col(c).cast("string") for c in by)).alias("group_")
    dealt = rows.join(counts, by).withColumn("block_", F.pmod(F.xxhash64("row_"), blocks).cast("int")).withColumn("of_", blocks)
    filled = dealt.groupBy(*by, "of_", "block_").agg(F.count(F.lit(1)).alias("m_")).groupBy(*by, "of_").agg(F.map_from_entries(F.collect_list(F.struct("block_", "m_"))).alias("m_"))
    sizes = filled.select(*by, group, F.transform(F.sequence(F.lit(0), F.col("of_") - 1), lambda k: F.coalesce(F.col("m_")[k], F.lit(0))).alias("sizes_"))
    own = [f"{c} {kinds[c]}" for c in by]
    splits = sizes.mapInArrow(_splits(resamples, seed, by), ", ".join([*own, "block_ int, mine_ binary"]))
    ready = dealt.select(*by, "row_", (F.col("x_") - F.col("mean_")).alias("x_"), "block_", group)
    drawn = ready.groupBy(*by, "block_").cogroup(splits.groupBy(*by, "block_")).applyInArrow(_drawn_sums(resamples, seed, by), ", ".join([*own, "replicate int, s1 double, s2 double"]))
    return drawn.groupBy(*by, "replicate").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))


def spread_bootstrap_test(scores: DataFrame, score: str, by: list[str], row: str, resamples: int = 1999, seed: int = 0) -> DataFrame:
    """(by, n, mean, t, p): bootstrap_test() by resampled_sums(), for groups of any size; t and p are null under six scores."""
    x = F.col(score).cast("double")
    finite = scores.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    seen = finite.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    t = lambda mean, sd: F.when(sd / F.sqrt("n") > 2.2250738585072014e-308, mean / (sd / F.sqrt("n"))).when(mean == 0, 0.0).otherwise(F.signum(mean) * F.lit(float("inf")))
    seen = seen.withColumn("t", t(F.col("mean"), F.col("sd"))).drop("sd")
    null = resampled_sums(scores, score, by, row, resamples, seed).join(seen, by)
    mean = F.col("s1") / F.col("n")
    sd = F.sqrt(F.greatest((F.col("s2") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)))
    counts = null.groupBy(*by).agg(((1 + F.count_if(t(mean, sd) >= F.col("t"))) / (resamples + 1)).alias("p"))
    enough = F.col("n") >= 6
    return seen.join(counts, by).select(*by, "n", "mean", F.when(enough, F.col("t")).alias("t"), F.when(enough, F.col("p")).alias("p"))


def spread_mean_interval(scores: DataFrame, score: str, by: list[str], row: str, resamples: int = 1999, seed: int = 0) -> DataFrame:
    """(by, n, mean, low, high): percentile_interval() by resampled_sums(), for groups of any size."""
    x = F.col(score).cast("double")
    seen = scores.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"))
    means = resampled_sums(scores, score, by, row, resamples, seed).join(seen, by).withColumn("m_", F.col("mean") + F.col("s1") / F.col("n"))
    return means.groupBy(*by).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.percentile("m_", 0.025).alias("low"), F.percentile("m_", 0.975).alias("high"))


def _intervals(scores: DataFrame, by: list[str], name: str, seen, drawn) -> DataFrame:
    """(by, n, name, low, high): a statistic of a group's rows and the 2.5 and 97.5 percentiles of its resamples."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, value = seen(pdf)
        draws = drawn(pdf) if n else np.array([np.nan])
        return pd.DataFrame([[*pdf[by].iloc[0].tolist(), n, value, *np.quantile(draws, [0.025, 0.975])]], columns=[*by, "n", name, "low", "high"])

    kinds = dict(scores.dtypes)
    return scores.groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "n long", f"{name} double", "low double", "high double"]))


def percentile_interval(scores: DataFrame, score: str, by: list[str], resamples: int = 1999, seed: int = 0) -> DataFrame:
    """(by, n, mean, low, high): percentile bootstrap interval of the mean, 95 percent."""
    values = lambda pdf: np.sort(pdf[score].dropna().to_numpy(float))

    def drawn(pdf):
        x = values(pdf)
        return np.concatenate([x[at].mean(1) for at in resamples_of(len(x), resamples, seed)])

    return _intervals(scores, by, "mean", lambda pdf: (len(values(pdf)), float(np.mean(values(pdf))) if len(values(pdf)) else np.nan), drawn)


def _row_ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks along the rows of a matrix."""
    order = np.argsort(x, 1, kind="stable")
    s = np.take_along_axis(x, order, 1)
    new = np.concatenate([np.ones((len(x), 1), bool), s[:, 1:] != s[:, :-1]], 1)
    place = np.broadcast_to(np.arange(x.shape[1]), x.shape)
    first = np.maximum.accumulate(np.where(new, place, 0), 1)
    ends = np.concatenate([new[:, 1:], np.ones((len(x), 1), bool)], 1)
    last = np.minimum.accumulate(np.where(ends, place, x.shape[1])[:, ::-1], 1)[:, ::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, 1)
    return out


def rank_correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rank correlation of each row of x with that row of y; 0 where either does not vary."""
    u, v = (r - r.mean(1, keepdims=True) for r in (_row_ranks(x), _row_ranks(y)))
    length = np.sqrt((u * u).sum(1) * (v * v).sum(1))
    return np.where(length > 2.220446049250313e-16, (u * v).sum(1) / np.where(length > 0, length, 1), 0.0)


def correlation_interval(rows: DataFrame, x: str, y: str, by: list[str], resamples: int = 1999, seed: int = 0) -> DataFrame:
    """(by, n, rho, low, high): percentile bootstrap interval of the rank correlation over a group's pairs, 95 percent."""

    def values(pdf):
        return pdf[[x, y]].dropna().sort_values([x, y]).to_numpy(float)

    def drawn(pdf):
        v = values(pdf)
        return np.concatenate([rank_correlations(v[at, 0], v[at, 1]) for at in resamples_of(len(v), resamples, seed)])

    return _intervals(rows, by, "rho", lambda pdf: (len(values(pdf)), float(rank_correlations(values(pdf)[None, :, 0], values(pdf)[None, :, 1])[0]) if len(values(pdf)) else np.nan), drawn)


def difference_interval(rows: DataFrame, value: str, second: str, by: list[str], resamples: int = 1999, seed: int = 0) -> DataFrame:
    """(by, n, difference, low, high): percentile bootstrap interval of the mean of the rows where `second` is true less that of the others, each drawn for itself."""

    def sides(pdf):
        kept = pdf[[value, second]].dropna()
        return [np.sort(kept[value][kept[second].astype(bool) == s].to_numpy(float)) for s in (True, False)]

    def drawn(pdf):
        one, other = sides(pdf)
        if not len(one) or not len(other):
            return np.array([np.nan])
        means = [np.concatenate([v[at].mean(1) for at in resamples_of(len(v), resamples, seed + k)]) for k, v in enumerate((one, other))]
        return means[0] - means[1]

    def seen(pdf):
        one, other = sides(pdf)
        return len(one) + len(other), float(one.mean() - other.mean()) if len(one) and len(other) else np.nan

    return _intervals(rows, by, "difference", seen, drawn)


def exceedance(observed: DataFrame, reference: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(observed columns, label, p): (1 + references not below) / (references + 1) for each observation and reference label.

    observed(keys, value), reference(label, value), where references join all observations. Labels
    are the few configurations of a null family. Both tables go through one window over a label's
    ranges of values, and the ranges' counts give what lies above, so that no pair of them is made and no
    label is one task.
    """
    refs = reference.select("label", F.col(value).alias("v"))
    part = bucket(refs, "v")
    seen = observed.crossJoin(F.broadcast(refs.select("label").distinct())).select(*keys, "label", F.col(value).alias("v"), F.lit(0).alias("is_ref"))
    refs = refs.select(*(F.lit(None).cast(dict(observed.dtypes)[k]).alias(k) for k in keys), "label", "v", F.lit(1).alias("is_ref"))
    w = Window.partitionBy("label", "part").orderBy(F.desc("v"), F.desc("is_ref")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = seen.unionByName(refs).withColumn("part", part).withColumn("above", F.sum("is_ref").over(w))
    sizes = both.groupBy("label", "part").agg(F.sum("is_ref").alias("n"))
    higher = Window.partitionBy("label").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("label", "part", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("label")).alias("n"))
    return both.where("is_ref = 0").join(sizes, ["label", "part"]).select(*keys, "label", ((1 + F.col("start") + F.col("above")) / (F.col("n") + 1)).alias("p"))


def envelope(component: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, label): the largest component p value; ties go to the first label."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("p"), "label"))
    return component.withColumn("place", place).where("place = 1").select(*keys, "p", "label")


def profile_distances(references: DataFrame, observed_strength: Column, profile_draws: int, floor: float = 1e-6) -> DataFrame:
    """(config, median, scale, distance) from the strengths of each configuration's first draws, references(config, replicate, strength)."""
    first = references.where(F.col("replicate") < profile_draws)
    medians = first.groupBy("config").agg(F.median("strength").alias("median"))
    spread = first.join(medians, "config").groupBy("config", "median").agg(F.median(F.abs(F.col("strength") - F.col("median"))).alias("mad"))
    scale = F.greatest(1.4826 * F.col("mad"), F.lit(floor))
    return spread.select("config", "median", scale.alias("scale"), (F.abs(observed_strength - F.col("median")) / scale).alias("distance"))


def profiled_p(references: DataFrame, statistic: float, strength: float, profile_draws: int, selected: int = 2) -> DataFrame:
    """(config, distance, p, chosen_p): the nearest configurations by strength, their p values on later draws, and the largest."""
    place = F.row_number().over(Window.orderBy("distance", "config"))
    near = profile_distances(references, F.lit(strength), profile_draws).orderBy("distance", "config").limit(selected).withColumn("place", place).drop("place")
    later = references.where(F.col("replicate") >= profile_draws).join(F.broadcast(near.select("config", "distance")), "config")
    found = later.groupBy("config", "distance").agg(((1 + F.count_if(F.col("statistic") >= statistic)) / (F.count(F.lit(1)) + 1)).alias("p"))
    return found.withColumn("chosen_p", F.max("p").over(Window.partitionBy()))


#: Rows of all replicates that a task shuffles within units, on average.
SHUFFLED = 1 << 20


def permuted(records: DataFrame, replicates: int, by: list[str], trait: str, seed: int = 0) -> DataFrame:
    """records once for each replicate, from 0, with the trait shuffled within `by` by the order of hash keys of (seed, replicate, i).

    Rows are dealt by `by` before they are multiplied, to as many tasks as their number asks for, and nothing is dealt
    again: at each place the row that gives its trait there comes right before the one that takes it.
    """
    keys, others = ["replicate", *by], [c for c in records.columns if c not in (*by, trait)]
    parts = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(records.count() * replicates / SHUFFLED))
    at = F.row_number().over(Window.partitionBy(*by).orderBy("i"))
    worlds = records.repartition(parts, *by).withColumn("at_", at).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    source = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_key("permute", F.lit(seed), F.col("replicate"), F.col("i")), "i"))
    roles = worlds.withColumn("from_", source).withColumn("takes_", F.explode(F.array(F.lit(False), F.lit(True))))
    roles = roles.withColumn("place_", F.when(F.col("takes_"), F.col("at_")).otherwise(F.col("from_")))
    moved = roles.withColumn("moved_", F.lag(trait).over(Window.partitionBy(*keys).orderBy("place_", "takes_"))).where("takes_")
    return moved.select(*keys, *others, F.col("moved_").alias(trait))


def qualification(cells: DataFrame, moderate: float, ceiling: float = 0.1, floor: float = 0.8, bounds: bool = True) -> DataFrame:
    """(max_null, min_power, qualified) over cells(shared_fraction, amplitude, rejections, replicates).

    With bounds the null cells' upper and the moderate shared cells' lower Wilson bound count, else
    the rates.
    """
    low, high = wilson(F.col("rejections"), F.col("replicates")) if bounds else (F.col("rejections") / F.col("replicates"),) * 2
    rows = cells.withColumns({"low_": low, "high_": high})
    null = F.max(F.when((F.col("shared_fraction") == 0) & (F.col("amplitude") > 0), F.col("high_")))
    power = F.min(F.when((F.col("shared_fraction") == 1) & (F.col("amplitude") == moderate), F.col("low_")))
    return rows.agg(null.alias("max_null"), power.alias("min_power")).withColumn("qualified", (F.col("max_null") <= ceiling) & (F.col("min_power") >= floor))


def minimum_detectable(surface: DataFrame, power: float = 0.8, type1: float = 0.05) -> DataFrame:
    """(private_amplitude, null_upper, calibrated, raw_mde, mde) over surface(private_amplitude, effect, rejections, worlds)."""
    low, high = wilson(F.col("rejections"), F.col("worlds"), clamp=False)
    rows = surface.withColumns({"low_": low, "high_": high}).groupBy("private_amplitude").agg(
        F.max(F.when(F.col("effect") == 0, F.col("high_"))).alias("null_upper"), F.min(F.when((F.col("effect") > 0) & (F.col("low_") >= power), F.col("effect"))).alias("raw_mde")
    )
    rows = rows.withColumn("calibrated", F.col("null_upper") <= type1)
    return rows.select("private_amplitude", "null_upper", "calibrated", "raw_mde", F.when(F.col("calibrated"), F.col("raw_mde")).alias("mde"))
