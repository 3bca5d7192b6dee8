"""Rank transforms by unit as window expressions, and rank correlations as guarded aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def average_rank(value: Column, *by: Column) -> Column:
    """1-based rank within `by`, ties sharing the mean of their places."""
    first = F.rank().over(Window.partitionBy(*by).orderBy(value))
    return first + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)


def rank01(value: Column, *by: Column) -> Column:
    """(average rank - 0.5) / n, which lies strictly between 0 and 1."""
    return (average_rank(value, *by) - 0.5) / F.count(F.lit(1)).over(Window.partitionBy(*by))


def centred_rank(value: Column, *by: Column) -> Column:
    """Average rank less its mean, (n + 1) / 2."""
    return average_rank(value, *by) - (F.count(F.lit(1)).over(Window.partitionBy(*by)) + 1) / F.lit(2.0)


def rank_direction(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Centred ranks scaled to length 1 within `by`; 0 where all values are equal."""
    keys = [F.col(k) for k in by]
    ranked = df.withColumn(out, centred_rank(F.col(value), *keys))
    length = F.sqrt(F.sum(F.col(out) * F.col(out)).over(Window.partitionBy(*keys)))
    return ranked.withColumn("length_", length).withColumn(out, F.when(F.col("length_") > EPS, F.col(out) / F.col("length_")).otherwise(0.0)).drop("length_")


def bucket(df: DataFrame, value: str, parts: int = 64) -> Column:
    """The number of a value's range among `parts` or fewer of about equal counts in df; numbers rise with values.

    The driver gets the limits, which are literals of the plan, so that each use of it deals rows alike.
    """
    limits = df.agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    limits = sorted({float(x) for x in limits if x is not None})
    return F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x < F.col(value))) if limits else F.lit(0)


def spread_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """average_rank as a column without ever bringing a whole unit into one task.

    Distinct values are dealt out by ranges, counted in each, and the ranges' counts (one row for
    each unit and range) give every range its start. Equal values are one row throughout, so ties
    cannot be parted.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_"))
    dealt = counts.withColumn("part_", bucket(df, value))
    inside = Window.partitionBy("part_", *by).orderBy(value)
    inner = dealt.withColumn("upto_", F.sum("n_").over(inside))
    sizes = dealt.groupBy("part_", *by).agg(F.sum("n_").alias("size_"))
    before = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start_", F.coalesce(F.sum("size_").over(before), F.lit(0))).drop("size_")
    rank = F.col("start_") + F.col("upto_") - (F.col("n_") - 1) / F.lit(2.0)
    ranks = inner.join(starts, ["part_", *by]).select(*by, value, rank.alias(out))
    return df.join(ranks, [*by, value])


def pearson(df: DataFrame, x: str, y: str, by: list[str], out: str = "rho", least: int = 3) -> DataFrame:
    """Correlation by unit: NaN under `least` rows, 0 where either side does not vary."""
    mx, my = (F.avg(c).over(Window.partitionBy(*by)) for c in (x, y))
    centred = df.select(*by, (F.col(x) - mx).alias("u_"), (F.col(y) - my).alias("v_"))
    sums = centred.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in (("u_", "u_"), ("v_", "v_"), ("u_", "v_"))))
    length = F.sqrt(F.col("u_u_") * F.col("v_v_"))
    rho = F.when(F.col("n") < least, F.lit(float("nan"))).when(length <= EPS, F.lit(0.0)).otherwise(F.col("u_v_") / F.when(length > EPS, length))
    return sums.select(*by, "n", rho.alias(out))


def spearman(df: DataFrame, x: str, y: str, by: list[str], out: str = "rho") -> DataFrame:
    """Rank correlation by unit with the guards of pearson()."""
    keys = [F.col(k) for k in by]
    ranked = df.select(*by, centred_rank(F.col(x), *keys).alias("x_"), centred_rank(F.col(y), *keys).alias("y_"))
    return pearson(ranked, "x_", "y_", by, out)


def _project(df: DataFrame, value: str, nuisance: str, by: list[str], out: str) -> DataFrame:
    """value less its projection on nuisance within `by`; both are centred."""
    w = Window.partitionBy(*by)
    top, low = F.sum(F.col(value) * F.col(nuisance)).over(w), F.sum(F.col(nuisance) * F.col(nuisance)).over(w)
    rows = df.withColumns({"top_": top, "low_": low})
    beta = F.when(F.col("low_") > EPS, F.col("top_") / F.when(F.col("low_") > EPS, F.col("low_"))).otherwise(0.0)
    return rows.withColumn(out, F.col(value) - beta * F.col(nuisance)).drop("top_", "low_")


def rank_residual(df: DataFrame, value: str, nuisances: list[str], by: list[str], out: str) -> DataFrame:
    """Centred ranks of value after projection off the centred ranks of the nuisances, one after another made orthogonal."""
    keys = [F.col(k) for k in by]
    rows = df.withColumn("z_", centred_rank(F.col(value), *keys))
    names = []
    for i, n in enumerate(nuisances):
        rows = rows.withColumn(f"q{i}_", centred_rank(F.col(n), *keys))
        for q in names:
            rows = _project(rows, f"q{i}_", q, by, f"q{i}_")
        names.append(f"q{i}_")
    return reduce(lambda d, q: _project(d, "z_", q, by, "z_"), names, rows).withColumn(out, F.col("z_")).drop("z_", *names)


def partial_spearman(df: DataFrame, prediction: str, target: str, nuisances: list[str], by: list[str], out: str = "rho", target_nuisances: list[str] | None = None) -> DataFrame:
    """Correlation of rank residuals by unit. target_nuisances: for the target, if not the same as the prediction's."""
    rows = rank_residual(df, prediction, nuisances, by, "p_")
    rows = rank_residual(rows, target, nuisances if target_nuisances is None else target_nuisances, by, "t_")
    # what is left of a vector that its nuisances explain is rounding, not signal
    clean = lambda c: F.when(F.abs(F.col(c)) < 1e-9, 0.0).otherwise(F.col(c))
    return pearson(rows.withColumns({"p_": clean("p_"), "t_": clean("t_")}), "p_", "t_", by, out)


def length_orthogonalized(df: DataFrame, turnover: str, length: str, by: list[str], out: str, rescale: bool = True) -> DataFrame:
    """Centred rank01 of turnover off that of length; if rescale, with the spread of untied ranks, sqrt((n*n-1)/(12*n*n)).

    A residual without spread is 0 throughout.
    """
    rows = rank_residual(df, turnover, [length], by, out)
    w = Window.partitionBy(*by)
    rows = rows.withColumns({"n_": F.count(F.lit(1)).over(w)}).withColumn(out, F.col(out) / F.col("n_"))
    if not rescale:
        return rows.drop("n_")
    rows = rows.withColumn("sd_", F.stddev_pop(out).over(w))
    aim = F.sqrt((F.col("n_") * F.col("n_") - 1) / (12.0 * F.col("n_") * F.col("n_")))
    return rows.withColumn(out, F.when(F.col("sd_") > 1e-12, F.col(out) * aim / F.when(F.col("sd_") > 1e-12, F.col("sd_"))).otherwise(0.0)).drop("n_", "sd_")


def most_frequent(df: DataFrame, value: str, by: list[str], out: str = "mode") -> DataFrame:
    """(by, out, n): the value that occurs most often, the least of several."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_"))
    w = Window.partitionBy(*by).orderBy(F.desc("n_"), value)
    return counts.withColumn("place_", F.row_number().over(w)).where("place_ = 1").select(*by, F.col(value).alias(out), F.col("n_").alias("n"))
