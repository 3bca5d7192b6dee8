"""Environmental niches: pooled components, whitened axes, densities on a grid, and overlaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import blocked, each_pair
from .dyadic import _gram


def components(rows: DataFrame, columns: list[str], axes: int = 2) -> dict:
    """Means, deviations and the first principal axes of standardized columns; an axis' largest loading is positive.

    Only moments of the columns reach the driver.
    """
    first = rows.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"s_{c}") for c in columns)).first()
    mean = np.array([first[f"m_{c}"] for c in columns])
    sd = np.array([first[f"s_{c}"] or 1.0 for c in columns])
    z = rows.select(*(((F.col(c) - float(m)) / float(s)).alias(c) for c, m, s in zip(columns, mean, sd)))
    values, vectors = np.linalg.eigh(_gram(z, columns) / max(1, first["n"] - 1))
    order = np.argsort(-values, kind="stable")[:axes]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    return {"columns": columns, "mean": mean, "sd": sd, "values": values, "vectors": vectors}


def whitened(rows: DataFrame, fitted: dict) -> DataFrame:
    """rows with w1, w2, ...: the standardized columns on each axis over the square root of its variance."""
    out = {}
    for i, (value, vector) in enumerate(zip(fitted["values"], fitted["vectors"].T)):
        score = sum((float(v) * (F.col(c) - float(m)) / float(s) for c, m, s, v in zip(fitted["columns"], fitted["mean"], fitted["sd"], vector)), F.lit(0.0))
        out[f"w{i + 1}"] = score / float(np.sqrt(max(value, np.finfo(float).tiny)))
    return rows.withColumns(out)


def grid(rows: DataFrame, axes: list[str], cells: int = 50) -> list[tuple[float, float]]:
    """Centres of cells x cells cells between the 0.5 and 99.5 percentiles of the axes, widened by a tenth of the span on each side."""
    q = rows.agg(*(F.percentile(c, F.array(F.lit(0.005), F.lit(0.995))).alias(c) for c in axes)).first()
    sides = []
    for c in axes:
        low, high = q[c]
        pad = 0.1 * (high - low)
        edges = np.linspace(low - pad, high + pad, cells + 1)
        sides.append((edges[1:] + edges[:-1]) / 2)
    return [(float(x), float(y)) for x in sides[0] for y in sides[1]]


def densities(rows: DataFrame, axes: list[str], centres: list[tuple[float, float]]) -> DataFrame:
    """(unit, cell, p): Gaussian kernel density of each unit's points on the cells, bandwidth n^(-1/6), adding up to 1.

    Rows of a unit may lie anywhere: every task adds up what its own rows give to each cell.
    """
    kind = dict(rows.dtypes)["unit"]
    sizes = rows.groupBy("unit").agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(-1 / 6)).alias("h"))
    points = rows.select("unit", *(F.col(c).alias(f"x{i}") for i, c in enumerate(axes))).join(sizes, "unit")
    at = np.array(centres)
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())

    def run(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            for unit, rows_ in pdf.groupby("unit"):
                total, h = np.zeros(len(at)), rows_.h.iloc[0]
                for i in range(0, len(rows_), 1024):
                    d = sum((at[:, k][:, None] - rows_[f"x{k}"].to_numpy()[None, i : i + 1024]) ** 2 for k in range(at.shape[1]))
                    total += np.exp(-0.5 * d / (h * h)).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array([unit] * len(at), arrow), pa.array(np.arange(len(at)), pa.int32()), pa.array(total)], ["unit", "cell", "s"])

    sums = points.mapInArrow(run, f"unit {kind}, cell int, s double").groupBy("unit", "cell").agg(F.sum("s").alias("s"))
    whole = F.sum("s").over(Window.partitionBy("unit"))
    return sums.select("unit", "cell", (F.col("s") / whole).alias("p"))


#: Units whose densities meet those of as many others at once.
UNITS = 64


def _matrices(a: dict, b: dict) -> tuple[np.ndarray, np.ndarray]:
    """Densities of two blocks of units over the cells of both; a cell that a unit lacks has none."""
    if all(x["cells"].ndim == 2 and x["cells"].shape[1] == a["cells"].shape[-1] and (x["cells"] == a["cells"][0]).all() for x in (a, b)):  # one grid
        return a["ps"], b["ps"]
    cells = np.unique(np.concatenate([np.concatenate(x["cells"]).astype(str) for x in (a, b)]))
    out = []
    for x in (a, b):
        full = np.zeros((len(x["row"]), len(cells)))
        for i, (own, p) in enumerate(zip(x["cells"], x["ps"])):
            full[i, np.searchsorted(cells, own.astype(str))] = p
        out.append(full)
    return out[0], out[1]


def _overlap(a, b, _):
    one, other = _matrices(a, b)
    d = np.stack([np.clip(1 - 0.5 * np.abs(row - other).sum(1), 0, 1) for row in one])
    names = a["row"].astype(str), b["row"].astype(str)
    i, j = np.nonzero(names[0][:, None] != names[1][None, :])
    return pa.RecordBatch.from_arrays([pa.array(names[0][i].tolist(), pa.string()), pa.array(names[1][j].tolist(), pa.string()), pa.array(d[i, j])], ["source", "target", "d"])


def overlaps(density: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(source, target, d): Schoener's overlap, 1 less half the sum of differences, of the pairs of units, or of all ordered pairs.

    For all pairs blocks of units meet, each with its densities as an array, so that a row is made for a pair and
    not for its cells. Listed pairs are joined by cell. density(unit, cell, p) has all cells of a unit, or those that are not 0.
    """
    if pairs is not None:
        a = density.select(F.col("unit").alias("source"), "cell", F.col("p").alias("p_"))
        b = density.select(F.col("unit").alias("target"), "cell", F.col("p").alias("q_"))
        both = pairs.select("source", "target").distinct()
        cells = both.join(a, "source").select("source", "target", "cell", "p_", F.lit(0.0).alias("q_")).unionByName(both.join(b, "target").select("source", "target", "cell", F.lit(0.0).alias("p_"), "q_"))
        cells = cells.groupBy("source", "target", "cell").agg(F.sum("p_").alias("p_"), F.sum("q_").alias("q_"))
        d = 1 - 0.5 * F.sum(F.abs(F.col("p_") - F.col("q_")))
        return cells.groupBy("source", "target").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), d)).alias("d"))
    kind = dict(density.dtypes)["unit"]
    lists = density.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct(F.col("cell").cast("string").alias("cell"), "p"))).alias("x"))  # the cells of a grid
    units = lists.select(F.col("unit").cast("string").alias("row"), F.col("x.cell").alias("cells"), F.col("x.p").alias("ps"))
    left, right = blocked(units, [], "row", ["cells", "ps"], UNITS), blocked(units, [], "row", ["cells", "ps"], UNITS, "block_")
    found = each_pair(left, right, [], _overlap, "source string, target string, d double")
    return found.select(F.col("source").cast(kind).alias("source"), F.col("target").cast(kind).alias("target"), "d")


def extrapolation(rows: DataFrame, pooled: DataFrame, columns: list[str]) -> DataFrame:
    """(share): of rows outside the pooled range in any column."""
    bounds = pooled.agg(*(F.min(c).alias(f"lo_{c}") for c in columns), *(F.max(c).alias(f"hi_{c}") for c in columns))
    outside = F.lit(False)
    for c in columns:
        outside = outside | (F.col(c) < F.col(f"lo_{c}")) | (F.col(c) > F.col(f"hi_{c}"))
    return rows.select(*columns).crossJoin(F.broadcast(bounds)).agg(F.avg(outside.cast("double")).alias("share"))


def density_at(rows: DataFrame, queries: DataFrame, axes: list[str]) -> DataFrame:
    """(unit, query, density): Gaussian kernel density of each unit's points at each query(query, axes), in any number of axes, bandwidth n^(-1 / (axes + 4)) and with its norm.

    Blocks of queries meet blocks of a unit's points, and only sums leave a task.
    """
    d = len(axes)
    kind = dict(rows.dtypes)["unit"]
    h = F.pow(F.count(F.lit(1)).over(Window.partitionBy("unit")).cast("double"), F.lit(-1.0 / (d + 4)))
    points = rows.select("unit", F.monotonically_increasing_id().alias("row"), F.array(*axes).alias("at"), h.alias("h"))
    asked = rows.select("unit").distinct().crossJoin(queries.select(F.col("query").cast("string").alias("row"), F.array(*axes).alias("at")))  # by definition each unit at each query
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())

    def run(a, b, unit):
        out, width = np.zeros(len(a["row"])), b["h"][0]
        for i in range(0, len(out), 512):
            dist = sum((a["at"][i : i + 512, c][:, None] - b["at"][:, c][None]) ** 2 for c in range(d))
            out[i : i + 512] = np.exp(-0.5 * dist / (width * width)).sum(1)
        norm = (2 * np.pi) ** (d / 2) * width**d
        cols = [pa.array([unit["unit"]] * len(out), arrow), pa.array(a["row"].astype(str).tolist()), pa.array(out / norm), pa.array([len(b["row"])] * len(out), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["unit", "query", "s", "n"])

    pairs = each_pair(blocked(asked, ["unit"], "row", ["at"]), blocked(points, ["unit"], "row", ["at", "h"], name="block_"), ["unit"], run, f"unit {kind}, query string, s double, n long")
    return pairs.groupBy("unit", "query").agg((F.sum("s") / F.sum("n")).alias("density"))


def suitability(rows: DataFrame, queries: DataFrame, axes: list[str]) -> DataFrame:
    """(unit, query, p): density_at() over its sum in the unit, 0 where all is 0."""
    total = F.sum("density").over(Window.partitionBy("unit"))
    return density_at(rows, queries, axes).select("unit", "query", F.when(total > 0, F.col("density") / F.when(total > 0, total)).otherwise(0.0).alias("p"))
