"""Dyads of sources and targets: two-way fixed effects, clustered tests, unique information and its support."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import spearman
from ..sources.shared import kept


#: Levels of the smaller side of a design up to which the driver solves its normal equations; beyond, they are solved by steps over tables.
MOST_LEVELS = 4096
#: Of the normal equations' right-hand sides what may be left at the end, and steps at most.
TOLERANCE, STEPS = 1e-13, 1000


def absorbed(dyads: DataFrame, columns: list[str], source: str = "source", target: str = "target", most: int = MOST_LEVELS) -> DataFrame:
    """dyads with the columns' residuals on source and target effects in place of them, for any connected design.

    The larger side's effects are eliminated by aggregation over the cells of the design. The normal equations of the
    smaller side are solved by the driver if it has `most` levels at most, else by conjugate gradients with a table as the
    vector, until TOLERANCE certifies what is left of them. A design that is not connected is an error.
    """
    dyads = kept(dyads, "dyads")
    cells = dyads.groupBy(F.col(source).alias("s_"), F.col(target).alias("t_")).agg(F.count(F.lit(1)).alias("n_"), *(F.sum(c).alias(f"y{i}_") for i, c in enumerate(columns)))
    cells = kept(cells, "cells")
    sizes = cells.agg(F.count_distinct("s_").alias("s"), F.count_distinct("t_").alias("t")).first()
    if not sizes["s"]:
        return dyads
    big, few = ("s_", "t_") if sizes["s"] >= sizes["t"] else ("t_", "s_")
    cells = cells.withColumnsRenamed({big: "b_", few: "f_"})
    totals = cells.groupBy("b_").agg(F.sum("n_").alias("all_"), *(F.sum(f"y{i}_").alias(f"m{i}_") for i in range(len(columns))))
    right = cells.join(totals, "b_").groupBy("f_").agg(F.sum("n_").cast("double").alias("n"), *(F.sum(F.col(f"y{i}_") - F.col("n_") * F.col(f"m{i}_") / F.col("all_")).alias(f"v{i}") for i in range(len(columns))))
    names = {"s_": source, "t_": target}
    if min(sizes) <= most:
        effects = F.broadcast(_solved(cells, totals, right, len(columns)))  # at most `most` rows
    else:
        effects = _stepped(cells, totals, kept(right, "right"), len(columns))
    effects = effects.withColumnRenamed("f_", names[few])
    out = dyads.join(effects, names[few]).withColumns({c: F.col(c) - F.col(f"e{i}_") for i, c in enumerate(columns)}).drop(*(f"e{i}_" for i in range(len(columns))))
    means = out.groupBy(names[big]).agg(*(F.avg(c).alias(f"m{i}_") for i, c in enumerate(columns)))
    out = out.join(means, names[big]).withColumns({c: F.col(c) - F.col(f"m{i}_") for i, c in enumerate(columns)})
    return out.select(*dyads.columns)


def _solved(cells: DataFrame, totals: DataFrame, right: DataFrame, columns: int) -> DataFrame:
    """(f_, e0_, ...): the effects by the driver; of the symmetric equations one triangle comes as Arrow columns."""
    side = right.orderBy("f_").toArrow()
    level = side.column("f_").to_pylist()
    numbers = cells.sparkSession.createDataFrame(list(enumerate(level)), f"k int, f_ {dict(cells.dtypes)['f_']}")
    rows = cells.join(F.broadcast(numbers), "f_").join(totals.select("b_", "all_"), "b_").select("b_", "k", "n_", "all_")
    other = rows.select("b_", F.col("k").alias("g"), F.col("n_").alias("o_"))
    shared = rows.join(other, "b_").where(F.col("k") <= F.col("g")).groupBy("k", "g").agg(F.sum(F.col("n_") * F.col("o_") / F.col("all_")).alias("x")).toArrow()
    k, g, x = (shared.column(c).to_numpy() for c in ("k", "g", "x"))
    normal = np.diag(side.column("n").to_numpy())
    np.subtract.at(normal, (k, g), x)
    off = k != g
    np.subtract.at(normal, (g[off], k[off]), x[off])
    value = np.stack([side.column(f"v{i}").to_numpy() for i in range(columns)], 1)
    effects = np.zeros_like(value)
    if len(level) > 1:
        spread = np.linalg.eigvalsh(normal[:-1, :-1])
        if spread[0] <= 1e-10 * max(1.0, spread[-1]):
            raise ValueError("the design of sources and targets is not connected")
        effects[:-1] = np.linalg.solve(normal[:-1, :-1], value[:-1])
    found = [(x, *map(float, e)) for x, e in zip(level, effects)]
    return cells.sparkSession.createDataFrame(found, f"f_ {dict(cells.dtypes)['f_']}, " + ", ".join(f"e{i}_ double" for i in range(columns)))


def connected(cells: DataFrame) -> bool:
    """Whether all levels of cells(b_, f_) hang together: each takes the least label of those that it shares a cell with, until none changes."""
    pairs = cells.select("b_", "f_").distinct()
    labels = kept(pairs.select("f_").distinct().withColumn("label", F.monotonically_increasing_id()), "labels")
    while True:
        least = pairs.join(labels, "f_").groupBy("b_").agg(F.min("label").alias("label"))
        for _ in range(3):  # a few steps for each table that is written
            near = pairs.join(least, "b_").groupBy("f_").agg(F.min("label").alias("label"))
            least = pairs.join(near, "f_").groupBy("b_").agg(F.min("label").alias("label"))
        new = kept(pairs.join(least, "b_").groupBy("f_").agg(F.min("label").alias("new")).join(labels, "f_"), "labels")
        if new.where("new < label").isEmpty():
            return new.agg(F.count_distinct("new")).first()[0] <= 1
        labels = new.select("f_", F.col("new").alias("label"))


def _stepped(cells: DataFrame, totals: DataFrame, right: DataFrame, columns: int) -> DataFrame:
    """(f_, e0_, ...): the effects by conjugate gradients, each level's equation over its count; the driver sees a few numbers for each step."""
    if not connected(cells):
        raise ValueError("the design of sources and targets is not connected")
    rows = cells.select("b_", "f_", "n_")
    every = range(columns)
    size = right.agg(*(F.sum(F.col(f"v{i}") * F.col(f"v{i}") / F.col("n")).alias(f"r{i}") for i in every)).first()
    start, rz = [size[f"r{i}"] for i in every], [size[f"r{i}"] for i in every]
    now = right.select("f_", "n", *(c for i in every for c in (F.lit(0.0).alias(f"x{i}"), F.col(f"v{i}").alias(f"r{i}"), (F.col(f"v{i}") / F.col("n")).alias(f"p{i}"))))
    for _ in range(STEPS):
        if all(a <= TOLERANCE * TOLERANCE * b for a, b in zip(rz, start)):
            break
        means = rows.join(now.select("f_", *(f"p{i}" for i in every)), "f_").groupBy("b_").agg(*(F.sum(F.col("n_") * F.col(f"p{i}")).alias(f"w{i}") for i in every))
        means = means.join(totals.select("b_", "all_"), "b_").select("b_", *((F.col(f"w{i}") / F.col("all_")).alias(f"w{i}") for i in every))
        taken = rows.join(means, "b_").groupBy("f_").agg(*(F.sum(F.col("n_") * F.col(f"w{i}")).alias(f"w{i}") for i in every))
        now = kept(now.join(taken, "f_").withColumns({f"q{i}": F.col("n") * F.col(f"p{i}") - F.col(f"w{i}") for i in every}).drop(*(f"w{i}" for i in every)), "step")
        pq = now.agg(*(F.sum(F.col(f"p{i}") * F.col(f"q{i}")).alias(f"s{i}") for i in every)).first()
        alpha = [rz[i] / pq[f"s{i}"] if pq[f"s{i}"] else 0.0 for i in every]
        now = now.withColumns({f"x{i}": F.col(f"x{i}") + alpha[i] * F.col(f"p{i}") for i in every} | {f"r{i}": F.col(f"r{i}") - alpha[i] * F.col(f"q{i}") for i in every})
        new = now.agg(*(F.sum(F.col(f"r{i}") * F.col(f"r{i}") / F.col("n")).alias(f"s{i}") for i in every)).first()
        beta = [new[f"s{i}"] / rz[i] if rz[i] else 0.0 for i in every]
        rz = [new[f"s{i}"] for i in every]
        now = now.withColumns({f"p{i}": F.col(f"r{i}") / F.col("n") + beta[i] * F.col(f"p{i}") for i in every}).drop(*(f"q{i}" for i in every))
    else:
        raise ValueError(f"effects are not settled after {STEPS} steps")
    return now.select("f_", *(F.col(f"x{i}").alias(f"e{i}_") for i in every))


def _gram(rows: DataFrame, columns: list[str]) -> np.ndarray:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = rows.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs)).first()
    out = np.zeros((len(columns), len(columns)))
    for a, b in pairs:
        out[columns.index(a), columns.index(b)] = out[columns.index(b), columns.index(a)] = sums[f"{a}|{b}"] or 0.0
    return out


def clustered_test(dyads: DataFrame, response: str, predictors: list[str], source: str = "source", target: str = "target") -> DataFrame:
    """(coefficient, standard_error, z, p): the first predictor's effect after two-way effects, clustered both ways, p one-sided.

    Variance is that of source clusters and target clusters less that of dyads, each with its
    small-sample factor. The driver solves a system as large as there are predictors.
    """
    rows = absorbed(dyads.select(source, target, *predictors, response), [*predictors, response], source, target)
    gram = _gram(rows, [*predictors, response])
    p = len(predictors)
    bread = np.linalg.inv(gram[:p, :p])
    beta = bread @ gram[:p, p]
    residual = F.col(response) - sum((float(b) * F.col(c) for b, c in zip(beta, predictors)), F.lit(0.0))
    weight = sum((float(w) * F.col(c) for w, c in zip(bread[:, 0], predictors)), F.lit(0.0))
    h = rows.select(source, target, (weight * residual).alias("h"))

    def clusters(by: str) -> tuple[float, int]:
        found = h.groupBy(by).agg(F.sum("h").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.count(F.lit(1)).alias("n")).first()
        return found["ss"], found["n"]

    (ss, ns), (st, nt) = clusters(source), clusters(target)
    own = h.agg(F.sum(F.col("h") * F.col("h")).alias("ss"), F.count(F.lit(1)).alias("n")).first()
    n = own["n"]
    variance = ns / (ns - 1) * (n - 1) / (n - p) * ss + nt / (nt - 1) * (n - 1) / (n - p) * st - n / (n - p) * own["ss"]
    se = math.sqrt(max(variance, np.finfo(float).tiny))
    z = float(beta[0]) / se
    return dyads.sparkSession.createDataFrame([(float(beta[0]), se, z, 0.5 * math.erfc(z / math.sqrt(2)))], "coefficient double, standard_error double, z double, p double")


def unique_information(dyads: DataFrame, primary: str, controls: list[str], source: str = "source", target: str = "target") -> tuple[DataFrame, DataFrame]:
    """Residual of primary on two-way effects and controls, and (dyads, fe_fraction, conditional_fraction, total_fraction).

    The fractions are of sums of squares: after effects in all, after controls in those, and both.
    """
    total = dyads.agg(F.var_pop(primary).alias("v"), F.count(F.lit(1)).alias("n")).first()
    rows = absorbed(dyads.select(source, target, primary, *controls), [primary, *controls], source, target)
    gram = _gram(rows, [*controls, primary])
    k = len(controls)
    coef = np.linalg.lstsq(gram[:k, :k], gram[:k, k], rcond=None)[0] if k else np.zeros(0)
    left = rows.select(source, target, (F.col(primary) - sum((float(b) * F.col(c) for b, c in zip(coef, controls)), F.lit(0.0))).alias("residual"))
    raw, fe = total["v"] * total["n"], gram[k, k]
    unique = left.agg(F.sum(F.col("residual") * F.col("residual")).alias("ss"))
    share = F.col("ss") / F.lit(raw)
    return left, unique.select(F.lit(total["n"]).cast("long").alias("dyads"), F.lit(float(fe / raw)).alias("fe_fraction"), (F.col("ss") / F.lit(float(fe) or 1.0)).alias("conditional_fraction"), share.alias("total_fraction"))


def signal_support(rows: DataFrame, residual: str, source: str = "source", target: str = "target") -> DataFrame:
    """(effective_dyads, effective_sources, effective_targets, max_source_share, max_target_share) of squared residuals."""
    total = F.sum("s").over(Window.partitionBy())
    shares = rows.select(source, target, (F.col(residual) * F.col(residual)).alias("s")).withColumn("s", F.col("s") / total)
    by = lambda c: shares.groupBy(c).agg(F.sum("s").alias("s")).agg((1 / F.sum(F.col("s") * F.col("s"))).alias(f"effective_{c}s"), F.max("s").alias(f"max_{c}_share"))
    dyad = shares.agg((1 / F.sum(F.col("s") * F.col("s"))).alias("effective_dyads"))
    return dyad.crossJoin(by(source)).crossJoin(by(target))  # one row each


def ladder(dyads: DataFrame, layers: list[tuple[str, str, list[str]]], source: str = "source", target: str = "target") -> DataFrame:
    """(layer, dyads, fe_fraction, conditional_fraction, total_fraction, partial_sd, effective_dyads, effective_sources, effective_targets, max_source_share, max_target_share, survival).

    Each of layers(name, primary, controls) is what is left of the primary relation after endpoint effects and the
    controls; partial_sd is in units of the primary's; survival is the layer's sum of squares over that of the
    layer before, where both have one primary and the controls only grow, else null.
    """
    out, before, dyads = None, None, kept(dyads, "ladder")  # what makes the dyads is done once
    for place, (name, primary, controls) in enumerate(layers):
        left, unique = unique_information(dyads, primary, controls, source, target)
        square = left.agg(F.sum(F.col("residual") * F.col("residual")).alias("ss")).first()["ss"]
        nested = before is not None and before[0] == primary and set(before[1]) <= set(controls) and before[2] > 0
        survival = F.lit(float(square / before[2]) if nested else None).cast("double")
        row = unique.crossJoin(signal_support(left, "residual", source, target))  # one row each
        row = row.withColumns({"layer": F.lit(name), "partial_sd": F.sqrt("total_fraction"), "survival": survival})
        out = row if out is None else out.unionByName(row)
        before = (primary, controls, square)
    return out


def competing_spaces(train: DataFrame, held: DataFrame, response: str, spaces: dict[str, list[str]], unit: str = "unit", penalty: float = 1.0, digits: int = 12) -> DataFrame:
    """(unit, one column for each space): rank correlation in each held unit of the response with what a ridge on the space's columns, fitted on train, predicts."""
    out = None
    for name, columns in spaces.items():
        fitted = predicted(held, ridge(train, response, columns, unit, penalty)).withColumn("prediction", F.round("prediction", digits))
        one = spearman(fitted, "prediction", response, [unit], name).drop("n")
        out = one if out is None else out.join(one, unit)
    return out


def repeatability(rows: DataFrame, dyad: str, value: str) -> DataFrame:
    """(replicates, dyads, icc, between, within, median_sd) of a balanced design: one-way random effects, clipped to 0 and 1."""
    by = rows.groupBy(dyad).agg(F.count(F.lit(1)).alias("k"), F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.stddev_samp(value).alias("sd"))
    found = by.agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("n"), F.var_samp("m").alias("vm"), F.sum(F.col("v") * F.col("k")).alias("ssw"), F.median("sd").alias("median_sd"))
    msb, msw = F.col("k") * F.col("vm"), F.col("ssw") / (F.col("n") * (F.col("k") - 1))
    found = found.withColumns({"msb": msb, "msw": msw})
    low = F.col("msb") + (F.col("k") - 1) * F.col("msw")
    icc = F.when(low > 2.220446049250313e-16, (F.col("msb") - F.col("msw")) / F.when(low > 2.220446049250313e-16, low)).otherwise(0.0)
    return found.select(
        F.col("k").alias("replicates"), F.col("n").alias("dyads"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), icc)).alias("icc"),
        F.greatest(F.lit(0.0), (F.col("msb") - F.col("msw")) / F.col("k")).alias("between"), F.col("msw").alias("within"), "median_sd",
    )


def ridge(rows: DataFrame, response: str, columns: list[str], unit: str = "unit", penalty: float = 1.0) -> tuple[dict[str, float], float, dict[str, tuple[float, float]]]:
    """Coefficients on standardized columns, intercept and (mean, sd) of each, every unit with equal weight.

    The driver solves a system as large as there are columns.
    """
    def weighted(sums: dict) -> dict:
        """Sums over rows, each unit's over its count, from one row for each unit."""
        by = rows.groupBy(unit).agg(F.count(F.lit(1)).alias("n_"), *(F.sum(c).alias(name) for name, c in sums.items()))
        return by.agg(F.count(F.lit(1)).alias("units"), *(F.sum(F.col(name) / F.col("n_")).alias(name) for name in sums)).first().asDict()

    first = weighted({"y": F.col(response)} | {f"m_{c}": F.col(c) for c in columns} | {f"s_{c}": F.col(c) * F.col(c) for c in columns})
    moments = {c: (first[f"m_{c}"] / first["units"], math.sqrt(max(0.0, first[f"s_{c}"] / first["units"] - (first[f"m_{c}"] / first["units"]) ** 2)) or 1.0) for c in columns}
    mean = first["y"] / first["units"]
    z = [*((F.col(c) - m) / s for c, (m, s) in moments.items()), F.col(response) - mean]
    second = weighted({f"g{i}_{j}": z[i] * z[j] for i in range(len(z)) for j in range(i, len(z))})
    gram = np.array([[second[f"g{min(i, j)}_{max(i, j)}"] for j in range(len(z))] for i in range(len(z))])
    k = len(columns)
    beta = np.linalg.solve(gram[:k, :k] + penalty * np.eye(k), gram[:k, k])
    return dict(zip(columns, map(float, beta))), mean, moments


def predicted(rows: DataFrame, fitted: tuple[dict[str, float], float, dict[str, tuple[float, float]]], out: str = "prediction") -> DataFrame:
    beta, mean, moments = fitted
    return rows.withColumn(out, F.lit(mean) + sum((b * (F.col(c) - moments[c][0]) / moments[c][1] for c, b in beta.items()), F.lit(0.0)))
