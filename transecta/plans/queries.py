"""Queries of the analysis operators over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranks, scalars
from ..operators import diagnostics, dyadic, field, graph, inference, joins, niche, panels, projection, residual, sequence, worlds
from ..sources.readers import genbank_records
from ..sources import records
from ..sources.ledger import Run
from ..sources.shared import folder, kept
from . import inputs
from .inputs import DYADS, EDGES, FREE, HALF, KERNEL, RECORDS, ROLES, TRAIN, VECTORS, sql_edge_table, sql_fields, sql_near, sql_points, sql_rank, sql_spearman, table
from .transfer import TransferPlan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


SCORES = f"{TRAIN},\n{sql_points()},\n{sql_fields({'exposure': ('turnover', 0.125)})}"


# ---- ranks -------------------------------------------------------------------------------------


@query(f"SELECT event_id, round(({sql_rank('value', 'user_id')} - {HALF}) / count(*) OVER (PARTITION BY user_id), 8) AS rank01 FROM events")
def rank01_by_unit(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(ranks.rank01(F.col("value"), F.col("user_id")), 8).alias("rank01"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {sql_rank('l_extendedprice', 'l_returnflag')} AS place FROM lineitem")
def average_rank_of_large_units(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice")
    return ranks.spread_ranks(rows, ["l_returnflag"], "l_extendedprice", "place").select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query(f"WITH {RECORDS} {sql_spearman('records', 'y', 'trait')}")
def spearman_by_unit(spark, sf):
    return rounded(ranks.spearman(inputs.records(spark, sf), "y", "trait", ["unit"]), "rho")


def _partial_sql() -> str:
    c = lambda v: f"{sql_rank(v, 'unit')} - (count(*) OVER (PARTITION BY unit) + 1) / CAST(2 AS DOUBLE)"
    return f"""WITH {RECORDS}, c AS (SELECT unit, {c('y')} AS p, {c('trait')} AS t, {c('x')} AS z FROM records),
m AS (SELECT unit, count(*) AS n, sum(p * p) AS pp, sum(t * t) AS tt, sum(z * z) AS zz, sum(p * t) AS pt, sum(p * z) AS pz, sum(t * z) AS tz FROM c GROUP BY unit)
SELECT unit, n, round((pt - pz * tz / zz) / sqrt((pp - pz * pz / zz) * (tt - tz * tz / zz)), 6) AS rho FROM m"""


@query(_partial_sql())
def partial_spearman_by_unit(spark, sf):
    return rounded(ranks.partial_spearman(inputs.records(spark, sf), "y", "trait", ["x"], ["unit"]), "rho")


@query(
    f"""WITH {RECORDS}, c AS (SELECT unit, {sql_rank('y', 'unit')} - (count(*) OVER (PARTITION BY unit) + 1) / CAST(2 AS DOUBLE) AS p, {sql_rank('trait', 'unit')} - (count(*) OVER (PARTITION BY unit) + 1) / CAST(2 AS DOUBLE) AS t,
  {sql_rank('x', 'unit')} - (count(*) OVER (PARTITION BY unit) + 1) / CAST(2 AS DOUBLE) AS x, {sql_rank('(x * y)', 'unit')} - (count(*) OVER (PARTITION BY unit) + 1) / CAST(2 AS DOUBLE) AS z FROM records),
q AS (SELECT *, z - sum(x * z) OVER (PARTITION BY unit) / sum(x * x) OVER (PARTITION BY unit) * x AS q FROM c),
m AS (SELECT unit, count(*) AS n, sum(p * p) AS pp, sum(t * t) AS tt, sum(x * x) AS xx, sum(q * q) AS qq, sum(p * t) AS pt, sum(p * x) AS px, sum(t * x) AS tx, sum(p * q) AS pq, sum(t * q) AS tq FROM q GROUP BY unit)
SELECT unit, n, round((pt - px * tx / xx - pq * tq / qq) / sqrt((pp - px * px / xx - pq * pq / qq) * (tt - tx * tx / xx - tq * tq / qq)), 6) AS rho FROM m"""
)
def partial_spearman_two_controls(spark, sf):
    rows = inputs.records(spark, sf).withColumn("z", F.col("x") * F.col("y"))
    return rounded(ranks.partial_spearman(rows, "y", "trait", ["x", "z"], ["unit"]), "rho")


@query(f"WITH {RECORDS} SELECT unit, rho AS inner_product FROM ({sql_spearman('records', 'x', 'trait')})")
def rank_inner_product(spark, sf):
    rows = ranks.rank_direction(ranks.rank_direction(inputs.records(spark, sf), "x", ["unit"], "u"), "trait", ["unit"], "v")
    return rows.groupBy("unit").agg(F.round(F.sum(F.col("u") * F.col("v")), 6).alias("inner_product"))


# ---- graphs ------------------------------------------------------------------------------------


@query(f"WITH {RECORDS}, {sql_near('records')} SELECT unit, a, b FROM edges")
def knn_edges(spark, sf):
    return graph.knn_edges(inputs.records(spark, sf))


@query(f"WITH {RECORDS}, {sql_near('records', 'least(n - 1, greatest(2, CAST(floor(0.15 * n + 0.5) AS BIGINT)))')} SELECT unit, count(*) AS edges FROM edges GROUP BY unit")
def density_scaled_graph(spark, sf):
    rows = inputs.records(spark, sf)
    k = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).select("unit", scalars.density_scaled_k(F.col("n")).alias("k"))
    most = k.agg(F.max("k")).first()[0] or 1
    return graph.knn_edges(rows, k_by_unit=k, k_most=most).groupBy("unit").agg(F.count(F.lit(1)).alias("edges"))


@query(f"WITH {EDGES} SELECT unit, a, b, round(length, 8) AS length, round(turnover, 8) AS turnover FROM edge_table")
def edge_turnover(spark, sf):
    rows = inputs.records(spark, sf)
    return rounded(graph.neighbour_table(rows), "length", "turnover", digits=8).select("unit", "a", "b", "length", "turnover")


@query(
    f"WITH {VECTORS}, {sql_near('vectors')}, {sql_edge_table('vectors', 'sqrt(list_sum(list_transform(range(1, 9), lambda k: (l.trait[k] - r.trait[k]) * (l.trait[k] - r.trait[k]))))')} "
    "SELECT unit, a, b, round(turnover, 8) AS turnover FROM edge_table"
)
def vector_turnover(spark, sf):
    rows = inputs.vectors(spark, sf)
    return graph.neighbour_table(rows, vector=True).select("unit", "a", "b", F.round("turnover", 8).alias("turnover"))


@query("SELECT p_brand AS unit, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS loc, p_size AS size, n AS n_records FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)")
def exact_localities(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("unit"), F.array("p_size").alias("coords"))
    return graph.localities(rows).select("unit", "loc", F.col("coords")[0].alias("size"), "n_records")


@query(f"WITH {RECORDS}, {sql_near('records')} SELECT e.unit, e.a, e.b, count(f.a) AS n_disjoint FROM edges e LEFT JOIN edges f ON e.unit = f.unit AND f.a NOT IN (e.a, e.b) AND f.b NOT IN (e.a, e.b) GROUP BY ALL")
def endpoint_disjoint_counts(spark, sf):
    return graph.disjoint_counts(graph.knn_edges(inputs.records(spark, sf)).select("unit", "a", "b"))


COHERENCE = f"""WITH {EDGES}, numbered AS (SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY a, b) - 1 AS i, mx, my, turnover FROM edge_table),
mid_near AS (SELECT unit, i, j, z FROM (SELECT l.unit, l.i, r.i AS j, r.turnover AS z,
  row_number() OVER (PARTITION BY l.unit, l.i ORDER BY sqrt((l.mx - r.mx) * (l.mx - r.mx) + (l.my - r.my) * (l.my - r.my)), r.i) AS place
  FROM numbered l JOIN numbered r ON l.unit = r.unit AND l.i <> r.i) WHERE place <= 4),
both_ AS (SELECT n.unit, n.turnover AS y, avg(z) AS z FROM numbered n JOIN mid_near m ON n.unit = m.unit AND n.i = m.i GROUP BY n.unit, n.i, n.turnover),
c AS (SELECT unit, y - avg(y) OVER (PARTITION BY unit) AS u, z - avg(z) OVER (PARTITION BY unit) AS v FROM both_)
SELECT unit, count(*) AS n, round(sum(u * v) / sqrt(sum(u * u) * sum(v * v)), 6) AS coherence FROM c GROUP BY unit"""


@query(COHERENCE)
def midpoint_coherence(spark, sf):
    rows = inputs.records(spark, sf)
    return rounded(graph.midpoint_coherence(graph.neighbour_table(rows), most=4 * graph.largest(rows)), "coherence")


@query(
    f"SELECT round(avg(coherence), 6) AS strength, count(*) AS units FROM ({COHERENCE})"
)
def training_strength(spark, sf):
    rows = inputs.records(spark, sf)
    found = rounded(graph.midpoint_coherence(graph.neighbour_table(rows), most=4 * graph.largest(rows)), "coherence")
    return rounded(found.agg(F.avg("coherence").alias("strength"), F.count(F.lit(1)).alias("units")), "strength")


# ---- fields ------------------------------------------------------------------------------------


def _edges(spark, sf) -> DataFrame:
    return TransferPlan().edges(inputs.records(spark, sf))


def _halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    return TransferPlan().halves(inputs.records(spark, sf))


def _roles(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(edges.where(F.col("role") == r).drop("role") for r in ("train", "held"))


@query(f"WITH {EDGES}, {ROLES}, {SCORES} {sql_spearman('scored', 'exposure', 'turnover', out='score')}")
def transfer_scores(spark, sf):
    return rounded(TransferPlan().scores(_halves(spark, sf)), "score")


@query(f"WITH {EDGES}, {ROLES}, {SCORES}, by_unit AS ({sql_spearman('scored', 'exposure', 'turnover', out='score')}) SELECT count(*) AS units, round(avg(score), 6) AS statistic FROM by_unit WHERE NOT isnan(score)")
def transfer_statistic(spark, sf):
    return rounded(field.statistic(rounded(TransferPlan().scores(_halves(spark, sf)), "score")), "statistic")


@query(
    f"""WITH {EDGES}, c AS (SELECT unit, a, b, ({sql_rank('turnover', 'unit')} - (count(*) OVER (PARTITION BY unit) + 1) / CAST(2 AS DOUBLE)) AS t,
  ({sql_rank('length', 'unit')} - (count(*) OVER (PARTITION BY unit) + 1) / CAST(2 AS DOUBLE)) AS z, count(*) OVER (PARTITION BY unit) AS n FROM edge_table),
r AS (SELECT *, (t - sum(t * z) OVER (PARTITION BY unit) / sum(z * z) OVER (PARTITION BY unit) * z) / n AS e FROM c)
SELECT unit, a, b, round(e * sqrt((n * n - 1) / (CAST(12 AS DOUBLE) * n * n)) / stddev_pop(e) OVER (PARTITION BY unit), 6) AS free FROM r"""
)
def length_orthogonalized_turnover(spark, sf):
    rows = inputs.records(spark, sf)
    edges = graph.neighbour_table(rows)
    return rounded(ranks.length_orthogonalized(edges, "turnover", "length", ["unit"], "free"), "free").select("unit", "a", "b", "free")


@query(
    f"WITH {EDGES}, {ROLES}, {FREE}, {sql_points()}, {sql_fields({'exposure': ('free', 0.0)})} {sql_spearman('scored', 'exposure', 'turnover', out='score')}"
)
def length_conditioned_scores(spark, sf):
    return rounded(TransferPlan().length_conditioned_scores(_halves(spark, sf)), "score")


@query()
def transfer_test(spark, sf):
    return rounded(TransferPlan().test(inputs.records(spark, sf)), "mean", "t", "p")


@query(
    f"""WITH {EDGES}, {ROLES}, {TRAIN}, held AS (SELECT e.* FROM edge_table e JOIN roles r ON e.unit = r.unit AND role = 'held'), {sql_points()},
covered AS (SELECT h.unit AS target, t.unit AS source, count(DISTINCT h.a || '|' || h.b) AS n FROM held h JOIN train t ON (h.mx - t.mx) * (h.mx - t.mx) + (h.my - t.my) * (h.my - t.my) <= CAST(0.05 AS DOUBLE) * CAST(0.05 AS DOUBLE) GROUP BY 1, 2),
enough AS (SELECT c.*, count(*) OVER (PARTITION BY target) AS n_pool FROM covered c JOIN (SELECT unit AS target, count(*) AS m FROM held GROUP BY 1) USING (target) WHERE n / CAST(m AS DOUBLE) >= 0.5),
pool AS (SELECT target, source, (SELECT count(DISTINCT unit) FROM train) / CAST(n_pool AS DOUBLE) AS scale FROM enough WHERE n_pool >= 5),
{sql_fields({'exposure': ('turnover', 0.125)}, 'points q JOIN pool o ON q.unit = o.target JOIN train t ON t.unit = o.source', weight='scale * w')} {sql_spearman('scored', 'exposure', 'turnover', out='score')}"""
)
def pooled_transfer_scores(spark, sf):
    train, held = (kept(x, "edges") for x in _halves(spark, sf))  # read for the pool and for its fields
    middle = lambda e: e.select("unit", F.concat_ws("|", "unit", "a", "b").alias("i"), F.col("mid")[0].alias("x"), F.col("mid")[1].alias("y"))
    pool = joins.pools(joins.pair_coverage(middle(held), middle(train), ["x", "y"], 0.05), 0.5, 5).select("target", "source")
    return rounded(field.pooled_transfer_scores(train, held, pool, 0.25), "score")


_COVERS = """count(DISTINCT {0}.a || '|' || {0}.b) FILTER ((h.mx - t.mx) * (h.mx - t.mx) + (h.my - t.my) * (h.my - t.my) <= CAST(0.05 AS DOUBLE) * CAST(0.05 AS DOUBLE)) / CAST(max({0}.n) AS DOUBLE)"""


@query(
    f"""WITH {EDGES}, {ROLES}, e AS (SELECT x.*, role, count(*) OVER (PARTITION BY x.unit) AS n, avg(mx) OVER (PARTITION BY x.unit) AS cx, avg(my) OVER (PARTITION BY x.unit) AS cy FROM edge_table x JOIN roles r ON x.unit = r.unit),
p AS (SELECT h.unit AS target, t.unit AS source, {_COVERS.format('h')} AS forward, {_COVERS.format('t')} AS reverse, max(h.n) AS hn, max(t.n) AS tn, max(h.cx) AS hx, max(h.cy) AS hy, max(t.cx) AS tx, max(t.cy) AS ty
  FROM e h JOIN e t ON h.role = 'held' AND t.role = 'train' GROUP BY 1, 2), c AS (SELECT unit, count(DISTINCT (x, y)) AS n FROM records GROUP BY 1)
SELECT target, source, round(forward, 6) AS forward, round(reverse, 6) AS reverse, round(ln(1 + sqrt((hx - tx) * (hx - tx) + (hy - ty) * (hy - ty)) / CAST(0.05 AS DOUBLE)), 6) AS apart, round(ln(tn / CAST(hn AS DOUBLE)), 6) AS edges_ratio, round(ln(s.n / CAST(c.n AS DOUBLE)), 6) AS localities_ratio
FROM p JOIN c ON c.unit = target JOIN c AS s ON s.unit = source WHERE forward >= 0.5"""
)
def pool_geometry_features(spark, sf):
    """What same- and different-group sources are matched by: coverage both ways, centroids, edges and localities."""
    return rounded(_pool_features(spark, sf), *joins.FEATURES)


def _pool_features(spark, sf) -> DataFrame:
    rows = inputs.records(spark, sf)
    train, held = _halves(spark, sf)
    middle = lambda e: kept(e.select("unit", F.concat_ws("|", "unit", "a", "b").alias("i"), F.col("mid")[0].alias("x"), F.col("mid")[1].alias("y")), "middles")
    places = rows.groupBy("unit").agg(F.count_distinct("coords").alias("n"))
    return joins.pool_features(middle(held), middle(train), places, places, ["x", "y"], 0.05, 0.5)


@query()
def geometry_matched_pools(spark, sf):
    """Sources of a target's group, by the unit's number modulo 3, each with one of another group that is like it in geometry."""
    groups = inputs.records(spark, sf).select("unit").distinct().withColumn("grp", (F.col("unit") % 3).cast("string"))
    return rounded(joins.matched_pools(_pool_features(spark, sf), groups, 5), "distance")


@query(
    f"WITH {EDGES}, {ROLES}, {TRAIN}, {sql_points()}, {sql_fields({'exposure': ('turnover', 0.0)}, keys=', t.unit AS source')}, named AS (SELECT * REPLACE (CAST(source AS VARCHAR) AS source) FROM scored) {sql_spearman('named', 'exposure', 'turnover', by='unit, source', out='score')}"
)
def pair_transfer_scores(spark, sf):
    train, held = _halves(spark, sf)
    return rounded(field.pair_scores(train, held, 0.25), "score")


@query(
    f"""WITH {EDGES}, {ROLES}, {TRAIN}, {sql_points()}, s AS (SELECT q.unit, q.a, q.b, q.p, t.unit AS source, sum(w * {KERNEL}) AS low FROM points q CROSS JOIN train t GROUP BY ALL),
h AS (SELECT source, CASE WHEN sum(low) OVER (PARTITION BY unit, a, b, p) > 0 THEN low / sum(low) OVER (PARTITION BY unit, a, b, p) ELSE 0 END AS share FROM s)
SELECT CAST(source AS VARCHAR) AS source, round(avg(share), 6) AS mean_share, round(max(share), 6) AS max_share FROM h GROUP BY 1"""
)
def training_leverage(spark, sf):
    return rounded(field.training_leverage(*_halves(spark, sf), 0.25), "mean_share", "max_share")


@query(
    f"""WITH {EDGES}, {ROLES}, {TRAIN}, {sql_points()}, s AS (SELECT q.unit, q.a, q.b, q.p, t.unit AS source, sum(w * {KERNEL}) AS low FROM points q CROSS JOIN train t GROUP BY ALL),
m AS (SELECT unit, a, b, p, sum(low) AS mass, sum(low * low) AS squares FROM s GROUP BY ALL)
SELECT unit, round(avg(mass), 6) AS mean_opportunity, round(avg(CASE WHEN squares > 0 THEN mass * mass / squares ELSE 0 END), 6) AS effective_sources FROM m GROUP BY unit"""
)
def support_overlap(spark, sf):
    return rounded(field.support_overlap(*_halves(spark, sf), 0.25), "mean_opportunity", "effective_sources")


def _residual_sql() -> str:
    rank = lambda v: f"(rank() OVER (PARTITION BY t.unit, t.a, t.b ORDER BY f.{v}) + (count(*) OVER (PARTITION BY t.unit, t.a, t.b, f.{v}) - 1) / CAST(2 AS DOUBLE))"
    return f"""WITH {EDGES}, pairs AS (
  SELECT t.unit, t.a, t.b, t.length AS tx, t.difference AS ty, f.length AS x, f.difference AS y, {rank('length')} AS rx, {rank('difference')} AS ry,
         count(*) OVER (PARTITION BY t.unit, t.a, t.b) AS n
  FROM edge_table t JOIN edge_table f ON t.unit = f.unit AND f.a NOT IN (t.a, t.b) AND f.b NOT IN (t.a, t.b)),
fit AS (SELECT unit, a, b, max(n) AS n, sum((rx / (n + 1) - {HALF}) * (rx / (n + 1) - {HALF})) AS xx, sum((rx / (n + 1) - {HALF}) * (ry / (n + 1) - {HALF})) AS xy,
  sum(CASE WHEN x < tx THEN 1 WHEN x = tx THEN {HALF} ELSE 0 END) AS bx, sum(CASE WHEN y < ty THEN 1 WHEN y = ty THEN {HALF} ELSE 0 END) AS by_ FROM pairs GROUP BY ALL),
res AS (SELECT unit, a, b, n, (by_ + {HALF}) / (n + 1) AS observed, {HALF} + xy / xx * ((bx + {HALF}) / (n + 1) - {HALF}) AS expected FROM fit WHERE n >= 5)
SELECT unit, a, b, n AS n_training, round(observed, 6) AS observed, round(expected, 6) AS expected, round(observed - expected, 6) AS residual FROM res"""


@query(_residual_sql())
def crossfit_residuals(spark, sf):
    rows = inputs.records(spark, sf)
    edges = graph.neighbour_table(rows)
    return rounded(residual.crossfit_residuals(edges, "length", "difference").drop("turnover"), "observed", "expected", "residual")


SELF = f"""pts AS (SELECT unit, a, b, turnover, p, ax + (p + {HALF}) / 5 * (bx - ax) AS px, ay + (p + {HALF}) / 5 * (by_ - ay) AS py FROM edge_table CROSS JOIN generate_series(0, 4) AS g(p)),
sums AS (SELECT q.unit, q.a, q.b, q.p, sum(exp(-0.5 * ((px - mx) * (px - mx) + (py - my) * (py - my)) / CAST(0.0625 AS DOUBLE)) * t.turnover) / count(*) AS top,
  sum(exp(-0.5 * ((px - mx) * (px - mx) + (py - my) * (py - my)) / CAST(0.0625 AS DOUBLE))) / count(*) AS low
  FROM pts q JOIN edge_table t ON q.unit = t.unit AND t.a NOT IN (q.a, q.b) AND t.b NOT IN (q.a, q.b) GROUP BY ALL),
exposed AS (SELECT unit, a, b, round(avg((top + CAST(0.125 AS DOUBLE)) / (low + CAST(0.25 AS DOUBLE))), 12) AS exposure FROM sums GROUP BY ALL),
scored AS (SELECT x.*, e.turnover FROM exposed x JOIN edge_table e ON x.unit = e.unit AND x.a = e.a AND x.b = e.b)"""


@query(f"WITH {EDGES}, {SELF} {sql_spearman('scored', 'exposure', 'turnover', out='score')}")
def self_detectability(spark, sf):
    rows = inputs.records(spark, sf)
    return rounded(diagnostics.self_scores(graph.neighbour_table(rows), 0.25, most=4 * graph.largest(rows)), "score")


@query(
    f"""WITH {EDGES}, {ROLES}, second AS (SELECT e.unit, e.a, e.b, l.trait * l.trait + r.trait AS difference FROM edges e JOIN records l ON e.unit = l.unit AND e.a = l.i JOIN records r ON e.unit = r.unit AND e.b = r.i),
other AS (SELECT unit, a, b, ({sql_rank('difference', 'unit')} - {HALF}) / count(*) OVER (PARTITION BY unit) AS t1 FROM second),
train AS (SELECT e.*, t1, 1 / CAST(count(*) OVER (PARTITION BY e.unit) AS DOUBLE) AS w FROM edge_table e JOIN roles r ON e.unit = r.unit AND role = 'train' JOIN other o ON e.unit = o.unit AND e.a = o.a AND e.b = o.b),
{sql_points()}, {sql_fields({'x0': ('turnover', 0.125), 'x1': ('t1', 0.125)})},
long AS (SELECT 0 AS world, unit, x0 AS exposure, turnover FROM scored UNION ALL SELECT 1, s.unit, x1, t1 FROM scored s JOIN other o ON s.unit = o.unit AND s.a = o.a AND s.b = o.b)
{sql_spearman('long', 'exposure', 'turnover', by='world, unit', out='score')}"""
)
def response_world_scores(spark, sf):
    train, held = _two_worlds(spark, sf)
    return rounded(diagnostics.world_scores(train, held, TransferPlan().bandwidth), "score")


def _two_worlds(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(train, held) edges with turnover, an array of two responses."""
    rows = inputs.records(spark, sf)
    differences = F.abs(F.col("l.trait") - F.col("r.trait")), F.pow(F.col("l.trait"), 2) + F.col("r.trait")
    return tuple(_with_ends(part).withColumn("turnover", F.array(*(ranks.rank01(d, F.col("unit")) for d in differences))).drop("l", "r") for part in TransferPlan().record_halves(rows))


def _with_ends(rows: DataFrame) -> DataFrame:
    """Edges of the nearest neighbours with start, end, mid and the ends' own l and r."""
    mid = F.zip_with("l.coords", "r.coords", lambda x, y: (x + y) / 2)
    return graph.knn_edges(rows, carry=["coords", "trait"]).withColumns({"start": F.col("l.coords"), "end": F.col("r.coords"), "mid": mid})


@query(ORACLE_SQL["response_world_scores"])
def stored_response_scores(spark, sf):
    """The same from a store of points, whose responses come later."""
    train, held = _two_worlds(spark, sf)
    store = projection.prepared_points(train, held, TransferPlan().bandwidth)
    return rounded(projection.point_scores(store, train, held), "score")


WORLDS = 64


@query()
def stored_world_scores(spark, sf):
    """64 responses, tones of the trait, on one store: what a batch of a calibration costs."""
    tone = lambda k: F.abs(F.cos((k + 1) * F.col("l.trait") / 50.0 + k * F.col("l.coords")[0]) - F.cos((k + 1) * F.col("r.trait") / 50.0 + k * F.col("r.coords")[0]))
    responses = F.array(*(F.round(tone(k), 9) for k in range(WORLDS)))  # of edges that have been dealt by unit, so that they stay where they are made
    train, held = (_with_ends(part).repartition("unit").withColumn("turnover", responses).drop("l", "r") for part in TransferPlan().record_halves(inputs.records(spark, sf)))
    store = projection.prepared_points(train, held, TransferPlan().bandwidth)
    return rounded(projection.point_scores(store, train, held), "score")


@query(
    f"""WITH {EDGES}, {ROLES}, {FREE}, {sql_points()}, {sql_fields({'x0': ('turnover', 0.125), 'x1': ('free', 0.0)})},
base AS ({sql_spearman('scored', 'x0', 'turnover', out='score')}), other AS ({sql_spearman('scored', 'x1', 'turnover', out='score')})
SELECT unit, round(other.score - base.score, 6) AS increment FROM base JOIN other USING (unit)"""
)
def conditioning_increments(spark, sf):
    return rounded(TransferPlan().conditioning_increments(_halves(spark, sf)), "increment")


@query(
    f"""WITH {EDGES}, k AS (SELECT t.unit, t.a, t.b, 1 / (sum(exp(-0.5 * ((t.mx - s.mx) * (t.mx - s.mx) + (t.my - s.my) * (t.my - s.my)) / CAST(0.0625 AS DOUBLE))) / count(*)) AS raw
  FROM edge_table t JOIN edge_table s ON t.unit = s.unit GROUP BY ALL), w AS (SELECT unit, raw / sum(raw) OVER (PARTITION BY unit) AS w FROM k)
SELECT unit, count(*) AS edges, round(sum(w) * sum(w) / sum(w * w), 6) AS effective FROM w GROUP BY unit"""
)
def transport_effective_edges(spark, sf):
    rows = inputs.records(spark, sf)
    edges = graph.neighbour_table(rows)
    return rounded(diagnostics.effective_edges(diagnostics.transport_weights(edges, edges, 0.25, "self")), "effective")


@query(
    f"""WITH {EDGES}, {ROLES}, {TRAIN}, held AS (SELECT e.*, 1 / CAST(count(*) OVER (PARTITION BY e.unit) AS DOUBLE) AS w FROM edge_table e JOIN roles r ON e.unit = r.unit AND role = 'held'),
t AS (SELECT q.unit, q.a, q.b, sum(s.w * exp(-0.5 * ((q.mx - s.mx) * (q.mx - s.mx) + (q.my - s.my) * (q.my - s.my)) / CAST(0.0625 AS DOUBLE))) AS t FROM train q CROSS JOIN train s GROUP BY ALL),
h AS (SELECT q.unit, q.a, q.b, sum(s.w * exp(-0.5 * ((q.mx - s.mx) * (q.mx - s.mx) + (q.my - s.my) * (q.my - s.my)) / CAST(0.0625 AS DOUBLE))) AS h FROM train q CROSS JOIN held s GROUP BY ALL),
w AS (SELECT unit, h / t / sum(h / t) OVER (PARTITION BY unit) AS w FROM t JOIN h USING (unit, a, b))
SELECT unit, count(*) AS edges, round(sum(w) * sum(w) / sum(w * w), 6) AS effective FROM w GROUP BY unit"""
)
def transport_target_ratio(spark, sf):
    train, held = _halves(spark, sf)
    return rounded(diagnostics.effective_edges(diagnostics.transport_weights(train, held, 0.25, "ratio")), "effective")


@query(
    f"""WITH {EDGES}, p AS (SELECT unit, a, b, abs(atan2(sin(atan2(by_ - {HALF}, bx - {HALF}) - atan2(ay - {HALF}, ax - {HALF})), cos(atan2(by_ - {HALF}, bx - {HALF}) - atan2(ay - {HALF}, ax - {HALF})))) / pi() AS propensity FROM edge_table)
SELECT unit, a, b, round(propensity, 8) AS propensity, round({HALF} * (propensity - avg(propensity) OVER (PARTITION BY unit)), 8) AS expected FROM p"""
)
def phase_propensity(spark, sf):
    rows = inputs.records(spark, sf)
    out = diagnostics.phase_propensity(graph.neighbour_table(rows), (0.5, 0.5))
    return rounded(out, "propensity", "expected", digits=8).select("unit", "a", "b", "propensity", "expected")


@query(
    f"""WITH {EDGES}, f AS (SELECT stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM records), m AS (SELECT unit, median(x) AS ux, median(y) AS uy FROM records GROUP BY unit)
SELECT unit, a, b, round(sqrt((mx - ux) / sx * ((mx - ux) / sx) + (my - uy) / sy * ((my - uy) / sy)), 6) AS radius FROM edge_table JOIN m USING (unit), f"""
)
def midpoint_radial_distance(spark, sf):
    rows = inputs.records(spark, sf)
    return rounded(diagnostics.radial_distance(rows, graph.neighbour_table(rows)), "radius")


@query()
def front_observability(spark, sf):
    rows = inputs.records(spark, sf)
    return rounded(diagnostics.observability(graph.neighbour_table(rows), rows), "contrast", "share")


@query(
    f"""WITH {RECORDS}, s AS (SELECT unit % 7 AS grp, rho FROM ({sql_spearman('records', 'y', 'trait')})), g AS (SELECT grp, count(*) AS n, avg(rho) AS m, sum(rho) AS s FROM s GROUP BY grp)
SELECT grp, n, round(m, 6) AS mean, round((sum(s) OVER () - s) / (sum(n) OVER () - n), 6) AS without, n >= 22 AS included, round(sum(s) OVER () / sum(n) OVER (), 6) AS overall, round(avg(CASE WHEN n >= 22 THEN m END) OVER (), 6) AS balanced FROM g"""
)
def group_breadth(spark, sf):
    scores = rounded(ranks.spearman(inputs.records(spark, sf), "y", "trait", ["unit"]), "rho").withColumn("grp", F.col("unit") % 7)
    return rounded(diagnostics.breadth(scores, "grp", "rho", 22), "mean", "without", "overall", "balanced")


@query(
    f"""WITH d AS (SELECT s_nationkey AS draw, l_linenumber AS entry, round(avg(l_quantity), 6) AS q, round(avg(l_extendedprice), 6) AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
c AS (SELECT draw, entry, {sql_rank('q', 'draw')} - (count(*) OVER (PARTITION BY draw) + 1) / CAST(2 AS DOUBLE) AS u, {sql_rank('p', 'draw')} - (count(*) OVER (PARTITION BY draw) + 1) / CAST(2 AS DOUBLE) AS v FROM d),
n AS (SELECT draw, entry, u / sqrt(sum(u * u) OVER (PARTITION BY draw)) AS u, v / sqrt(sum(v * v) OVER (PARTITION BY draw)) AS v, count(*) OVER () AS k FROM c),
m AS (SELECT entry, sum(u) / (SELECT count(DISTINCT draw) FROM d) AS u, sum(v) / (SELECT count(DISTINCT draw) FROM d) AS v FROM n GROUP BY entry)
SELECT round(sum(u * v), 8) AS expected FROM m"""
)
def expected_rank_correlation(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    draws = lambda c: rows.groupBy(F.col("s_nationkey").alias("draw"), F.col("l_linenumber").alias("entry")).agg(F.round(F.avg(c), 6).alias("value")).withColumn("weight", F.lit(1.0))
    return rounded(diagnostics.expected_rank_correlation(draws("l_quantity"), draws("l_extendedprice")), "expected", digits=8)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0")
def layer_validity(spark, sf):
    return diagnostics.finite_rows(table(spark, sf, "lineitem"), {"l_discount": 0.0, "l_tax": 0.0}).select("l_orderkey", "l_linenumber", "l_partkey")


# ---- joins -------------------------------------------------------------------------------------

NEAR = "(t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) <= CAST(0.02 AS DOUBLE) * CAST(0.02 AS DOUBLE)"
COVERAGE = f"""coverage AS (SELECT target, source, covered, points, covered / CAST(points AS DOUBLE) AS coverage FROM (
  SELECT t.unit AS target, s.unit AS source, count(DISTINCT t.i) AS covered FROM records t JOIN records s ON t.unit <> s.unit AND {NEAR} GROUP BY 1, 2)
  JOIN (SELECT unit AS target, count(*) AS points FROM records GROUP BY 1) USING (target))"""


@query(f"WITH {RECORDS}, {COVERAGE} SELECT target, source, covered, points, round(coverage, 6) AS coverage FROM coverage")
def pair_coverage(spark, sf):
    rows = inputs.records(spark, sf)
    return rounded(joins.pair_coverage(rows, rows, ["x", "y"], 0.02), "coverage")


@query(f"WITH {RECORDS}, {COVERAGE} SELECT target, source, round(coverage, 6) AS coverage FROM (SELECT *, count(*) OVER (PARTITION BY target) AS n FROM coverage WHERE coverage >= CAST(0.3 AS DOUBLE) AND target % 5 = source % 5) WHERE n >= 2")
def same_group_pools(spark, sf):
    rows = inputs.records(spark, sf)
    groups = rows.select("unit").distinct().withColumn("grp", F.col("unit") % 5)
    return rounded(joins.pools(joins.pair_coverage(rows, rows, ["x", "y"], 0.02), 0.3, 2, groups, True), "coverage")


@query(f"WITH {RECORDS} SELECT t.i FROM records t WHERE EXISTS (SELECT 1 FROM records s WHERE s.trait < 50 AND {NEAR}) AND t.trait >= 50")
def covered_points(spark, sf):
    rows = inputs.records(spark, sf)
    return joins.within(rows.where("trait >= 50"), rows.where("trait < 50"), ["x", "y"], 0.02).select("i")


@query(
    """WITH r AS (SELECT p_partkey % 1500 AS id, p_partkey + 100000 AS acc, p_retailprice AS price FROM part),
l AS (SELECT l_orderkey, l_linenumber, l_partkey AS id, l_partkey + 100000 AS acc FROM lineitem),
k AS (SELECT id, count(*) AS n, max(price) AS price FROM r GROUP BY id), a AS (SELECT acc, count(*) AS n, max(price) AS price FROM r GROUP BY acc)
SELECT l.l_orderkey, l.l_linenumber, l.id, l.acc, CASE WHEN k.n = 1 THEN k.price WHEN k.n IS NULL AND a.n = 1 THEN a.price END AS price,
       CASE WHEN k.n = 1 THEN 'id' WHEN k.n IS NULL AND a.n = 1 THEN 'acc' END AS matched_by FROM l LEFT JOIN k ON l.id = k.id LEFT JOIN a ON l.acc = a.acc"""
)
def unique_only_lookup(spark, sf):
    right = table(spark, sf, "part").select((F.col("p_partkey") % 1500).alias("id"), (F.col("p_partkey") + 100000).alias("acc"), F.col("p_retailprice").alias("price"))
    left = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("id"), (F.col("l_partkey") + 100000).alias("acc"))
    return joins.unique_lookup(left, right, ["id", "acc"], ["price"])


@query(
    """SELECT c_custkey, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN v END AS o_orderpriority
FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n, min(o_orderpriority) AS v FROM orders GROUP BY 1) ON c_custkey = o_custkey"""
)
def ambiguity_classification(spark, sf):
    left = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("k"))
    right = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    return joins.classified(left, right, "k", "o_orderpriority").drop("k")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS p FROM events) WHERE p = 1")
def latest_of_retries(spark, sf):
    return joins.latest(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, count(*) AS found, CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) = 5 AND sum(n - 1) = 0 AS complete FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def shard_audit(spark, sf):
    return joins.shard_audit(table(spark, sf, "events"), "user_id", "event_type", 5)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def missing_partners(spark, sf):
    large = table(spark, sf, "orders").where("o_totalprice > 300000")
    return joins.missing(table(spark, sf, "customer").select("c_custkey"), large.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def checked_merge(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region").withColumnRenamed("r_regionkey", "k")
    labels = n.join(r, F.col("n_regionkey") == F.col("k")).select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    one = suppliers.join(labels, "s_nationkey").select("s_suppkey", "n_name", "r_name")
    return joins.checked_merge(suppliers.select("s_suppkey"), one, ["s_suppkey"])


@query(
    f"""WITH RECURSIVE {DYADS}, costs AS (SELECT l.source AS target, l.target AS l, r.target AS r, round(abs(l.q - r.q), 9) AS cost FROM dyads l JOIN dyads r ON l.source = r.source AND l.target % 2 = 0 AND r.target % 2 = 1 WHERE round(abs(l.q - r.q), 9) <= 2),
options AS (SELECT target, l, list({{'r': r, 'cost': cost}} ORDER BY cost, r) AS found, row_number() OVER (PARTITION BY target ORDER BY count(*), l) AS k FROM costs GROUP BY target, l),
steps AS (SELECT DISTINCT target, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS l, CAST(NULL AS STRUCT(r BIGINT, cost DOUBLE)) AS pick FROM options
  UNION ALL SELECT s.target, o.k, CASE WHEN len(list_filter(o.found, lambda x: NOT list_contains(s.taken, x.r))) > 0 THEN list_append(s.taken, list_filter(o.found, lambda x: NOT list_contains(s.taken, x.r))[1].r) ELSE s.taken END,
    o.l, list_filter(o.found, lambda x: NOT list_contains(s.taken, x.r))[1] FROM steps s JOIN options o ON s.target = o.target AND o.k = s.k + 1)
SELECT target, l AS "left", pick.r AS "right", pick.cost AS cost FROM steps WHERE pick IS NOT NULL"""
)
def greedy_matching(spark, sf):
    d = inputs.dyads(spark, sf)
    left = d.select(F.col("source").alias("target"), F.col("target").alias("left"), "q").where("left % 2 = 0")
    right = d.select(F.col("source").alias("target"), F.col("target").alias("right"), F.col("q").alias("r")).where("right % 2 = 1")
    costs = left.join(right, "target").select("target", "left", "right", F.round(F.abs(F.col("q") - F.col("r")), 9).alias("cost")).where("cost <= 2")
    return joins.greedy_match(costs)


# ---- records and runs --------------------------------------------------------------------------


@query("SELECT doc_id, sha256(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))) AS sequence_sha256, true AS placed FROM documents")
def numbered_records(spark, sf):
    """Letters of documents as records of files, read in byte ranges; placed: whether a record has its place in its file as number."""
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "").alias("s"))
    lines = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(F.concat(F.lit(">"), "doc_id", F.lit("\n"), F.regexp_replace("s", "(.{60})", "$1\n")))
    path = f"{folder(spark)}/records-{uuid.uuid4().hex}"
    lines.write.text(path)
    found = records.numbered(spark, path, split=1 << 18)
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.col("header").cast("long"))) - 1
    return found.select(F.col("header").cast("long").alias("doc_id"), F.sha2(F.col("sequence").cast("binary"), 256).alias("sequence_sha256"), (F.col("number") == place).alias("placed"))


@query("SELECT event_type AS label, user_id % 8 AS replicate, count(*) AS events, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def resumed_shards(spark, sf):
    """Figures of events in shards of type and user, from a run that is stopped after its first batch and started again."""
    events = table(spark, sf, "events").select(F.col("event_type").alias("label"), (F.col("user_id") % 8).alias("replicate"), "value")
    plan, path = events.select("label", "replicate").distinct(), f"{folder(spark)}/run-{uuid.uuid4().hex}"
    compute = lambda shards: events.join(shards, ["label", "replicate"]).groupBy("label", "replicate").agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("value"), 6).alias("mean_value"))
    schema = "label string, replicate long, events long, mean_value double"
    first = Run(spark, path, schema)
    some = plan.where("replicate < 4")
    first.commit(some, compute(some))
    Run(spark, path, schema).resume(plan, compute, 24)
    return Run(spark, path, schema).results()


# ---- panels ------------------------------------------------------------------------------------


@query("SELECT c_custkey AS unit, sha256('roles|' || c_custkey) AS key, CASE WHEN row_number() OVER (ORDER BY sha256('roles|' || c_custkey), c_custkey) <= floor(count(*) OVER () * 0.5) THEN 'train' ELSE 'held' END AS role FROM customer")
def hash_half_split(spark, sf):
    return panels.half_split(table(spark, sf, "customer").select(F.col("c_custkey").alias("unit")), "roles")


@query("SELECT c_custkey, c_mktsegment, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('class|' || c_custkey), c_custkey) <= floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.5) THEN 'train' ELSE 'held' END AS role FROM customer")
def stratified_split(spark, sf):
    return panels.stratified_split(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "class", "c_custkey", "c_mktsegment").drop("key")


@query("SELECT p_partkey, sha256('cap|' || p_partkey) AS key FROM part ORDER BY sha256('cap|' || p_partkey), p_partkey LIMIT 250")
def hash_ordered_cap(spark, sf):
    return panels.capped(table(spark, sf, "part").select("p_partkey"), "cap", "p_partkey", 250)


@query(
    """SELECT user_id AS unit, event_id, level FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY sha256('thin|' || user_id || '|' || event_id), event_id) AS place,
count(*) OVER (PARTITION BY user_id) AS n FROM events) CROSS JOIN (VALUES (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(1 AS DOUBLE))) AS v(level) WHERE place <= least(n, greatest(12, ceil(level * n)))"""
)
def nested_thinning(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("unit"), "event_id")
    return panels.retained(rows, "thin", "unit", "event_id", [0.25, 0.5, 1.0], 12)


@query(
    """SELECT o_orderkey, CASE WHEN NOT o_totalprice > 50000 THEN 'small' WHEN NOT o_orderstatus <> 'F' THEN 'finished' WHEN NOT substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 'not_urgent' ELSE 'eligible' END AS status FROM orders"""
)
def eligibility_ledger(spark, sf):
    rules = [("small", F.col("o_totalprice") > 50000), ("finished", F.col("o_orderstatus") != "F"), ("not_urgent", F.substring("o_orderpriority", 1, 1).isin("1", "2", "3"))]
    return panels.ledger(table(spark, sf, "orders"), rules).select("o_orderkey", "status")


@query("SELECT p_brand, p_size, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS p FROM part) WHERE p = 1")
def dedup_exact_places(spark, sf):
    return panels.dedup_places(table(spark, sf, "part"), "p_brand", ["p_size"], "p_partkey").select("p_brand", "p_size", "p_partkey")


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS p FROM customer) WHERE p = 1")
def best_of_group(spark, sf):
    return panels.one_per_group(table(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT n_name AS label, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal < 0 GROUP BY 1")
def inclusion_counts(spark, sf):
    n = table(spark, sf, "nation")
    chosen = table(spark, sf, "customer").where("c_acctbal < 0").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    schedule = chosen.select(F.col("c_custkey").alias("realization"), F.array("n_name").alias("members"))
    return panels.inclusion_counts(schedule, n.select(F.col("n_name").alias("label")))


@query(
    f"""WITH RECURSIVE {RECORDS}, places AS (SELECT unit, i, x * 4 AS lat, y * 4 AS lon, row_number() OVER (PARTITION BY unit ORDER BY sha256('places|' || unit || '|' || i), i) AS k FROM records),
steps AS (SELECT DISTINCT unit, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(i BIGINT, lat DOUBLE, lon DOUBLE)[]) AS taken FROM places
  UNION ALL SELECT s.unit, p.k, CASE WHEN len(s.taken) >= 50 OR len(list_filter(s.taken, lambda t: 2 * 6371.0088 * asin(least(1, sqrt(power(sin((radians(t.lat) - radians(p.lat)) / 2), 2) + cos(radians(t.lat)) * cos(radians(p.lat)) * power(sin((radians(t.lon) - radians(p.lon)) / 2), 2)))) < 10)) > 0
    THEN s.taken ELSE list_append(s.taken, {{'i': CAST(p.i AS BIGINT), 'lat': p.lat, 'lon': p.lon}}) END FROM steps s JOIN places p ON s.unit = p.unit AND p.k = s.k + 1),
last AS (SELECT unit, arg_max(taken, k) AS taken FROM steps GROUP BY unit)
SELECT unit, t.i AS "key", round(t.lat, 9) AS lat, round(t.lon, 9) AS lon, n - 1 AS "rank" FROM (SELECT unit, unnest(taken) AS t, generate_subscripts(taken, 1) AS n FROM last)"""
)
def spatial_thinning(spark, sf):
    r = inputs.records(spark, sf)
    found = panels.thinned(r.select("unit", F.col("i").alias("key"), (F.col("x") * 4).alias("lat"), (F.col("y") * 4).alias("lon")), "places", 10.0, 50)
    return rounded(found, "lat", "lon", digits=9)


# ---- inference ---------------------------------------------------------------------------------


@query()
def large_group_bootstrap(spark, sf):
    """Whether the mean discount of a return flag lies above 5 percent, by resamples that no task sees whole."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey").alias("row"), (F.col("l_discount") - 0.05).alias("x"))
    return rounded(inference.spread_bootstrap_test(rows, "x", ["l_returnflag"], "row"), "mean", "t", "p")



def _observed(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "events")
    observed = rows.groupBy(F.col("user_id").alias("unit")).agg(F.round(F.avg("value"), 6).alias("value"))
    return observed, rows.select(F.col("event_type").alias("label"), "value")


P_VALUES = """p_values AS (SELECT o.unit, r.event_type AS label, (1 + count(*) FILTER (r.value >= o.value)) / CAST(count(*) + 1 AS DOUBLE) AS p
  FROM (SELECT user_id AS unit, round(avg(value), 6) AS value FROM events GROUP BY 1) o CROSS JOIN events r GROUP BY 1, 2)"""


@query(f"WITH {P_VALUES} SELECT unit, label, round(p, 8) AS p FROM p_values")
def monte_carlo_p_values(spark, sf):
    return rounded(inference.exceedance(*_observed(spark, sf), ["unit"]), "p", digits=8)


@query(f"WITH {P_VALUES} SELECT unit, round(p, 8) AS p, label FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY p DESC, label) AS place FROM p_values) WHERE place = 1")
def envelope_p_values(spark, sf):
    return rounded(inference.envelope(inference.exceedance(*_observed(spark, sf), ["unit"]), ["unit"]), "p", digits=8)


REFERENCES = "refs AS (SELECT event_type AS config, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS replicate, value AS strength, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS statistic FROM events)"


@query(
    f"""WITH {REFERENCES}, med AS (SELECT config, median(strength) AS m FROM refs WHERE replicate < 100 GROUP BY 1),
dist AS (SELECT config, abs(CAST(50 AS DOUBLE) - m) / greatest(CAST(1.4826 AS DOUBLE) * median(abs(strength - m)), CAST(0.000001 AS DOUBLE)) AS distance FROM refs JOIN med USING (config) WHERE replicate < 100 GROUP BY config, m),
near AS (SELECT * FROM dist ORDER BY distance, config LIMIT 2),
p AS (SELECT config, distance, (1 + count(*) FILTER (statistic >= 90)) / CAST(count(*) + 1 AS DOUBLE) AS p FROM refs JOIN near USING (config) WHERE replicate >= 100 GROUP BY 1, 2)
SELECT config, round(distance, 6) AS distance, round(p, 8) AS p, round(max(p) OVER (), 8) AS chosen_p FROM p"""
)
def profiled_p_value(spark, sf):
    place = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    refs = table(spark, sf, "events").select(F.col("event_type").alias("config"), place.alias("replicate"), F.col("value").alias("strength"), F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("statistic"))
    found = inference.profiled_p(refs, 90.0, 50.0, 100)
    return rounded(rounded(found, "distance"), "p", "chosen_p", digits=8)


Z = "CAST(1.959963984540054 AS DOUBLE)"
BOUNDS = f"""((k / CAST(n AS DOUBLE)) + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) AS c,
  {Z} * sqrt((k / CAST(n AS DOUBLE)) * (1 - k / CAST(n AS DOUBLE)) / n + {Z} * {Z} / (4 * CAST(n AS DOUBLE) * n)) / (1 + {Z} * {Z} / n) AS h"""
CELLS = "cells AS (SELECT l_suppkey % 2 AS shared_fraction, l_linenumber % 3 AS amplitude, count(*) AS n, count(*) FILTER (l_tax >= 0.04) AS k FROM lineitem GROUP BY ALL)"


@query(f"WITH {CELLS} SELECT shared_fraction, amplitude, round(greatest(0, c - h), 8) AS low, round(least(1, c + h), 8) AS high FROM (SELECT *, {BOUNDS} FROM cells)")
def wilson_intervals(spark, sf):
    cells = _cells(spark, sf)
    low, high = scalars.wilson(F.col("rejections"), F.col("replicates"))
    return cells.select("shared_fraction", "amplitude", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


def _cells(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumns({"shared_fraction": F.col("l_suppkey") % 2, "amplitude": F.col("l_linenumber") % 3})
    return rows.groupBy("shared_fraction", "amplitude").agg(F.count(F.lit(1)).alias("replicates"), F.count_if(F.col("l_tax") >= 0.04).alias("rejections"))


@query(
    f"""WITH {CELLS}, b AS (SELECT *, {BOUNDS} FROM cells), q AS (SELECT max(least(1, c + h)) FILTER (shared_fraction = 0 AND amplitude > 0) AS a, min(greatest(0, c - h)) FILTER (shared_fraction = 1 AND amplitude = 2) AS b FROM b)
SELECT round(a, 8) AS max_null, round(b, 8) AS min_power, a <= 0.6 AND b >= 0.5 AS qualified FROM q"""
)
def precision_gate(spark, sf):
    return rounded(inference.qualification(_cells(spark, sf), 2, 0.6, 0.5), "max_null", "min_power", digits=8)


@query()
def bootstrap_intervals(spark, sf):
    scores = ranks.spearman(inputs.records(spark, sf), "y", "trait", ["unit"]).withColumn("grp", F.col("unit") % 4)
    return rounded(inference.percentile_interval(scores, "rho", ["grp"]), "mean", "low", "high")


@query()
def bootstrap_tests(spark, sf):
    scores = ranks.spearman(inputs.records(spark, sf), "y", "trait", ["unit"]).withColumn("grp", F.col("unit") % 4)
    return rounded(inference.bootstrap_test(scores, "rho", ["grp"]), "mean", "t", "p")


@query(
    f"""WITH {RECORDS}, w AS (SELECT replicate, unit, i, y, trait, row_number() OVER (PARTITION BY replicate, unit ORDER BY i) AS at_, row_number() OVER (PARTITION BY replicate, unit ORDER BY sha256('permute|0|' || replicate || '|' || i), i) AS from_ FROM records CROSS JOIN generate_series(0, 8) AS g(replicate)),
moved AS (SELECT p.replicate, p.unit, p.y, m.trait FROM w p JOIN w m ON p.replicate = m.replicate AND p.unit = m.unit AND p.at_ = m.from_)
SELECT replicate, round(avg(rho), 5) AS mean_rho FROM ({sql_spearman('moved', 'y', 'trait', by='replicate, unit')}) GROUP BY replicate"""
)
def permutation_null(spark, sf):
    rows = inputs.records(spark, sf).select("unit", "i", "y", "trait")
    shuffled = inference.permuted(rows, 9, ["unit"], "trait")
    found = rounded(ranks.spearman(shuffled, "y", "trait", ["replicate", "unit"]), "rho")
    return rounded(found.groupBy("replicate").agg(F.avg("rho").alias("mean_rho")), "mean_rho", digits=5)


@query()
def detectability_envelope(spark, sf):
    return rounded(inference.minimum_detectable(worlds.detectability(spark, [0.0, 0.1, 0.3], [0.0, 0.2], 40, 7), type1=0.2), "null_upper")


@query()
def synthetic_worlds(spark, sf):
    drawn = worlds.worlds(spark, [{"shared": 0.0, "amplitude": 2.0}, {"shared": 1.0, "amplitude": 2.0}], 3, 20260907)
    return drawn.groupBy("config", "world").agg(F.count(F.lit(1)).alias("records"), F.round(F.avg("trait"), 6).alias("mean_trait"))


# ---- dyads -------------------------------------------------------------------------------------

FE = "{c} - avg({c}) OVER (PARTITION BY source) - avg({c}) OVER (PARTITION BY target) + avg({c}) OVER ()"
ABSORBED = f"absorbed AS (SELECT source, target, {FE.format(c='q')} AS q, {FE.format(c='d')} AS d, {FE.format(c='p')} AS p FROM dyads)"


@query(f"WITH {DYADS}, {ABSORBED} SELECT source, target, round(q, 5) AS q, round(p, 5) AS p FROM absorbed")
def two_way_fixed_effects(spark, sf):
    return rounded(dyadic.absorbed(inputs.dyads(spark, sf), ["q", "p"]), "q", "p", digits=5).select("source", "target", "q", "p")


@query(
    f"""WITH {DYADS}, {ABSORBED}, fit AS (SELECT sum(q * p) / sum(q * q) AS beta, sum(q * q) AS qq FROM absorbed),
h AS (SELECT source, target, q / qq * (p - beta * q) AS h FROM absorbed, fit),
v AS (SELECT (SELECT count(*) / CAST(count(*) - 1 AS DOUBLE) * sum(s * s) FROM (SELECT sum(h) AS s FROM h GROUP BY source)) + (SELECT count(*) / CAST(count(*) - 1 AS DOUBLE) * sum(s * s) FROM (SELECT sum(h) AS s FROM h GROUP BY target))
  - (SELECT count(*) / CAST(count(*) - 1 AS DOUBLE) * sum(h * h) FROM h) AS v)
SELECT round(beta, 6) AS coefficient, round(sqrt(v), 6) AS standard_error, round(beta / sqrt(v), 5) AS z FROM fit, v"""
)
def clustered_dyad_test(spark, sf):
    found = dyadic.clustered_test(inputs.dyads(spark, sf), "p", ["q"])
    return found.select(F.round("coefficient", 6).alias("coefficient"), F.round("standard_error", 6).alias("standard_error"), F.round("z", 5).alias("z"))


@query(
    f"""WITH {DYADS}, {ABSORBED}, g AS (SELECT sum(q * q) AS qq, sum(q * d) AS qd, sum(d * d) AS dd, sum(q * p) AS qp, sum(d * p) AS dp FROM absorbed),
fit AS (SELECT dd / (qq * dd - qd * qd) AS b11, -qd / (qq * dd - qd * qd) AS b12, qq / (qq * dd - qd * qd) AS b22, qp, dp FROM g), beta AS (SELECT b11, b12, b11 * qp + b12 * dp AS b1, b12 * qp + b22 * dp AS b2 FROM fit),
h AS (SELECT source, target, (b11 * q + b12 * d) * (p - b1 * q - b2 * d) AS h FROM absorbed, beta), k AS (SELECT count(*) AS n FROM h),
v AS (SELECT (SELECT count(*) / CAST(count(*) - 1 AS DOUBLE) * sum(s * s) FROM (SELECT sum(h) AS s FROM h GROUP BY source)) * (n - 1) / (n - 2) + (SELECT count(*) / CAST(count(*) - 1 AS DOUBLE) * sum(s * s) FROM (SELECT sum(h) AS s FROM h GROUP BY target)) * (n - 1) / (n - 2)
  - (SELECT sum(h * h) FROM h) * n / (n - 2) AS v FROM k)
SELECT round(b1, 6) AS coefficient, round(sqrt(v), 6) AS standard_error, round(b1 / sqrt(v), 5) AS z FROM beta, v"""
)
def clustered_dyad_test_with_controls(spark, sf):
    found = dyadic.clustered_test(inputs.dyads(spark, sf), "p", ["q", "d"])
    return found.select(F.round("coefficient", 6).alias("coefficient"), F.round("standard_error", 6).alias("standard_error"), F.round("z", 5).alias("z"))


@query(
    f"""WITH {DYADS}, {ABSORBED}, fit AS (SELECT sum(q * d) / sum(d * d) AS beta, sum(q * q) AS fe FROM absorbed), raw AS (SELECT var_pop(q) * count(*) AS ss, count(*) AS n FROM dyads),
r AS (SELECT sum((q - beta * d) * (q - beta * d)) AS ss FROM absorbed, fit)
SELECT n AS dyads, round(fe / raw.ss, 6) AS fe_fraction, round(r.ss / fe, 6) AS conditional_fraction, round(r.ss / raw.ss, 6) AS total_fraction FROM fit, raw, r"""
)
def unique_information(spark, sf):
    return rounded(dyadic.unique_information(inputs.dyads(spark, sf), "q", ["d"])[1], "fe_fraction", "conditional_fraction", "total_fraction")


@query(
    f"""WITH {DYADS}, {ABSORBED}, s AS (SELECT source, target, q * q / sum(q * q) OVER () AS s FROM absorbed),
a AS (SELECT sum(s) AS s FROM s GROUP BY source), b AS (SELECT sum(s) AS s FROM s GROUP BY target)
SELECT round((SELECT 1 / sum(s * s) FROM s), 4) AS effective_dyads, round((SELECT 1 / sum(s * s) FROM a), 4) AS effective_sources, round((SELECT max(s) FROM a), 6) AS max_source_share,
       round((SELECT 1 / sum(s * s) FROM b), 4) AS effective_targets, round((SELECT max(s) FROM b), 6) AS max_target_share"""
)
def signal_support(spark, sf):
    rows = dyadic.absorbed(inputs.dyads(spark, sf), ["q"])
    found = dyadic.signal_support(rows, "q")
    return rounded(rounded(found, "effective_dyads", "effective_sources", "effective_targets", digits=4), "max_source_share", "max_target_share")


@query(
    """WITH r AS (SELECT s_nationkey AS dyad, l_linenumber % 3 AS k, avg(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
b AS (SELECT dyad, count(*) AS k, avg(v) AS m, var_pop(v) AS w, stddev_samp(v) AS sd FROM r GROUP BY 1),
f AS (SELECT max(k) AS k, count(*) AS n, max(k) * var_samp(m) AS msb, sum(w * k) / (count(*) * (max(k) - 1)) AS msw, median(sd) AS sd FROM b)
SELECT k AS replicates, n AS dyads, round(greatest(0, least(1, (msb - msw) / (msb + (k - 1) * msw))), 6) AS icc, round(greatest(0, (msb - msw) / k), 6) AS between_, round(msw, 6) AS within_, round(sd, 6) AS median_sd FROM f"""
)
def repeatability(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.groupBy(F.col("s_nationkey").alias("dyad"), (F.col("l_linenumber") % 3).alias("k")).agg(F.avg("l_quantity").alias("v"))
    found = dyadic.repeatability(rows, "dyad", "v").withColumnsRenamed({"between": "between_", "within": "within_"})
    return rounded(found, "icc", "between_", "within_", "median_sd")


@query(
    f"""WITH {EDGES}, {ROLES}, {TRAIN}, held AS (SELECT e.* FROM edge_table e JOIN roles r ON e.unit = r.unit AND role = 'held'),
m AS (SELECT sum(w) AS sw, sum(w * turnover) / sum(w) AS y0, sum(w * mx) / sum(w) AS x0, sum(w * my) / sum(w) AS z0, sum(w * length) / sum(w) AS l0, sqrt(sum(w * mx * mx) / sum(w) - power(sum(w * mx) / sum(w), 2)) AS sx,
  sqrt(sum(w * my * my) / sum(w) - power(sum(w * my) / sum(w), 2)) AS sz, sqrt(sum(w * length * length) / sum(w) - power(sum(w * length) / sum(w), 2)) AS sl FROM train),
c AS (SELECT w, turnover - y0 AS y, (mx - x0) / sx AS x, (my - z0) / sz AS z, (length - l0) / sl AS l FROM train, m),
g AS (SELECT sum(w * x * x) + 1 AS xx, sum(w * x * z) AS xz, sum(w * z * z) + 1 AS zz, sum(w * x * y) AS xy, sum(w * z * y) AS zy, sum(w * l * y) / (sum(w * l * l) + 1) AS bl FROM c),
b AS (SELECT (zz * xy - xz * zy) / (xx * zz - xz * xz) AS kx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS kz, bl FROM g),
f AS (SELECT unit, turnover, round(y0 + kx * (mx - x0) / sx + kz * (my - z0) / sz, 12) AS by_place, round(y0 + bl * (length - l0) / sl, 12) AS by_length FROM held, m, b),
one AS ({sql_spearman('f', 'by_place', 'turnover', out='place')}), two AS ({sql_spearman('f', 'by_length', 'turnover', out='length')})
SELECT unit, place, two.length, round(place - two.length, 6) AS increment FROM one JOIN two USING (unit)"""
)
def ridge_predictor_transfer(spark, sf):
    rows = inputs.records(spark, sf)
    edges = graph.neighbour_table(rows).select("unit", "a", "b", "length", F.col("mid")[0].alias("mx"), F.col("mid")[1].alias("my"), "turnover")
    roles = panels.half_split(rows.select("unit").distinct(), "split").select("unit", "role")
    edges = kept(edges.join(roles, "unit"), "edges")  # read for each space, twice
    out = rounded(dyadic.competing_spaces(*_roles(edges), "turnover", {"place": ["mx", "my"], "length": ["length"]}), "place", "length")
    return rounded(out.withColumn("increment", F.col("place") - F.col("length")), "increment")


# ---- niches ------------------------------------------------------------------------------------


def _axes(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("label").cast("long").alias("unit"), F.col("embedding")[0].cast("double").alias("w1"), F.col("embedding")[1].cast("double").alias("w2"))


DENSITY = """pts AS (SELECT CAST(label AS BIGINT) AS unit, CAST(embedding[1] AS DOUBLE) AS w1, CAST(embedding[2] AS DOUBLE) AS w2 FROM embeddings),
b AS (SELECT quantile_cont(w1, 0.005) AS a1, quantile_cont(w1, 0.995) AS z1, quantile_cont(w2, 0.005) AS a2, quantile_cont(w2, 0.995) AS z2 FROM pts),
e AS (SELECT a1 - CAST(0.1 AS DOUBLE) * (z1 - a1) AS l1, (z1 - a1) * CAST(1.2 AS DOUBLE) / 50 AS s1, a2 - CAST(0.1 AS DOUBLE) * (z2 - a2) AS l2, (z2 - a2) * CAST(1.2 AS DOUBLE) / 50 AS s2 FROM b),
cells AS (SELECT CAST(i * 50 + j AS INTEGER) AS cell, l1 + (i + CAST(0.5 AS DOUBLE)) * s1 AS x, l2 + (j + CAST(0.5 AS DOUBLE)) * s2 AS y FROM e, generate_series(0, 49) AS g(i), generate_series(0, 49) AS h(j)),
n AS (SELECT unit, power(count(*), CAST(-1 AS DOUBLE) / 6) AS h FROM pts GROUP BY 1),
k AS (SELECT unit, cell, sum(exp(-0.5 * ((x - w1) * (x - w1) + (y - w2) * (y - w2)) / (h * h))) AS s FROM pts JOIN n USING (unit) CROSS JOIN cells GROUP BY 1, 2),
density AS (SELECT unit, cell, s / sum(s) OVER (PARTITION BY unit) AS p FROM k)"""


@query(f"WITH {DENSITY} SELECT unit, cell, round(p, 10) AS p FROM density")
def kernel_densities(spark, sf):
    rows = _axes(spark, sf)
    return rounded(niche.densities(rows, ["w1", "w2"], niche.grid(rows, ["w1", "w2"])), "p", digits=10)


@query(f"WITH {DENSITY} SELECT a.unit AS source, b.unit AS target, round(1 - 0.5 * sum(abs(a.p - b.p)), 6) AS d FROM density a JOIN density b ON a.cell = b.cell AND a.unit <> b.unit GROUP BY 1, 2")
def niche_overlaps(spark, sf):
    rows = _axes(spark, sf)
    return rounded(niche.overlaps(niche.densities(rows, ["w1", "w2"], niche.grid(rows, ["w1", "w2"]))), "d")


def _environment(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("label").cast("long").alias("unit"), F.col("vec_id").alias("i"), *(F.col("embedding")[k].cast("double").alias(f"v{k}") for k in range(4)))


@query()
def whitened_components(spark, sf):
    rows = _environment(spark, sf)
    columns = ["v0", "v1", "v2", "v3"]
    return rounded(niche.whitened(rows, niche.components(rows, columns)), "w1", "w2").select("i", "w1", "w2")


@query("WITH b AS (SELECT min(l_quantity) AS a, max(l_quantity) AS z, min(l_extendedprice) AS c, max(l_extendedprice) AS y FROM lineitem WHERE l_returnflag = 'A') SELECT round(avg(CASE WHEN l_quantity < a OR l_quantity > z OR l_extendedprice < c OR l_extendedprice > y THEN 1 ELSE 0 END), 8) AS share FROM lineitem, b")
def extrapolation_share(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rounded(niche.extrapolation(rows, rows.where("l_returnflag = 'A'"), ["l_quantity", "l_extendedprice"]), "share", digits=8)


# ---- scalars, sequences, keys ------------------------------------------------------------------


@query(
    """WITH p AS (SELECT event_id, value / 500 * 180 - 90 AS lat, (event_id % 360) - CAST(180 AS DOUBLE) AS lon FROM events)
SELECT event_id, round(2 * 6371.0088 * asin(least(1, sqrt(power(sin((radians(10) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * power(sin(radians(20 - lon) / 2), 2)))), 4) AS km,
       round(6371.0088 * cos(radians(lat)) * cos(radians(lon)), 4) AS x, round(6371.0088 * sin(radians(lat)), 4) AS z FROM p"""
)
def geodesy(spark, sf):
    lat, lon = F.col("value") / 500 * 180 - 90, (F.col("event_id") % 360) - F.lit(180.0)
    x, _, z = scalars.ecef_km(lat, lon)
    km = scalars.haversine_km(lat, lon, F.lit(10.0), F.lit(20.0))
    return table(spark, sf, "events").select("event_id", F.round(km, 4).alias("km"), F.round(x, 4).alias("x"), F.round(z, 4).alias("z"))


@query(
    """WITH s AS (SELECT c_nationkey AS unit, o_orderstatus AS k, sum(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
f AS (SELECT unit, k, coalesce(s, 0) AS s FROM (SELECT DISTINCT unit FROM s) CROSS JOIN (SELECT DISTINCT k FROM s) LEFT JOIN s USING (unit, k)),
p AS (SELECT unit, k, s / sum(s) OVER (PARTITION BY unit) AS p FROM f), q AS (SELECT k, p AS q FROM p WHERE unit = 0)
SELECT unit, round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 10) AS jsd FROM p JOIN q USING (k) GROUP BY unit"""
)
def share_divergence(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = sequence.shares(rows.select(F.col("c_nationkey").alias("unit"), F.col("o_orderstatus").alias("k"), F.col("o_totalprice").alias("v")), ["unit"], "v", "k")
    first = found.where("unit = 0").select(F.col("shares").alias("q"))
    return found.crossJoin(F.broadcast(first)).select("unit", F.round(scalars.jensen_shannon(F.col("shares"), F.col("q")), 10).alias("jsd"))


@query(
    """SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS name, trim(regexp_replace(upper(p_type || '_' || p_name || '-x'), '[_\\-\\s]+', ' ', 'g')) AS token,
CASE WHEN starts_with(p_name, split_part(p_name, ' ', 1) || ' ') THEN substr(p_name, length(split_part(p_name, ' ', 1)) + 2) ELSE p_name END AS rest FROM part"""
)
def normalized_names(spark, sf):
    first = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    token = F.concat(F.col("p_type"), F.lit("_"), F.col("p_name"), F.lit("-x"))
    return table(spark, sf, "part").select("p_partkey", scalars.normalized_name(F.col("p_name")).alias("name"), scalars.normalized_token(token).alias("token"), scalars.without_prefix(F.col("p_name"), first).alias("rest"))


@query("SELECT c_custkey, sha256('seed|7|' || c_custkey) AS key, CAST(('0x' || substr(sha256('seed|7|' || c_custkey), 1, 15)) AS BIGINT) AS head FROM customer")
def hash_keys(spark, sf):
    key = scalars.hash_key("seed", F.lit(7), F.col("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", key.alias("key"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("head"))


def _sequences(spark, sf) -> DataFrame:
    letters = F.translate(F.sha2(F.col("c_name").cast("binary"), 256), "0123456789abcdef", "ACGTACGTACGTANNN")
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("unit"), F.col("c_custkey").alias("loc"), letters.alias("sequence"))


@query(
    """WITH s AS (SELECT c_nationkey AS unit, c_custkey AS loc, translate(sha256(c_name), '0123456789abcdef', 'ACGTACGTACGTANNN') AS q FROM customer),
e AS (SELECT unit, loc AS a, lead(loc) OVER (PARTITION BY unit ORDER BY loc) AS b FROM s),
c AS (SELECT e.unit, a, b, CAST(sum(CASE WHEN substr(l.q, k, 1) <> 'N' AND substr(r.q, k, 1) <> 'N' THEN 1 ELSE 0 END) AS BIGINT) AS n,
  CAST(sum(CASE WHEN substr(l.q, k, 1) <> 'N' AND substr(r.q, k, 1) <> 'N' AND substr(l.q, k, 1) <> substr(r.q, k, 1) THEN 1 ELSE 0 END) AS BIGINT) AS m
  FROM e JOIN s l ON e.a = l.loc JOIN s r ON e.b = r.loc CROSS JOIN generate_series(1, 64) AS g(k) GROUP BY 1, 2, 3)
SELECT unit, a, b, CAST(n >= 32 AS BIGINT) AS n_pairs, CASE WHEN n >= 32 THEN round(m / CAST(n AS DOUBLE), 8) END AS distance, CAST(n AS INTEGER) AS comparable FROM c"""
)
def masked_sequence_distances(spark, sf):
    rows = _sequences(spark, sf)
    following = F.lead("loc").over(Window.partitionBy("unit").orderBy("loc"))
    edges = rows.select("unit", F.col("loc").alias("a"), following.alias("b")).where("b is not null")
    return rounded(sequence.edge_sequence_distances(rows, edges, 32), "distance", digits=8)


@query(
    """WITH l AS (SELECT source, doc_id, floor(doc_id / CAST(1000 AS DOUBLE)) AS run, sha256(CAST(doc_id AS VARCHAR) || ':' || coalesce(text, '')) AS d FROM documents),
r AS (SELECT source, run, sha256(string_agg(d, chr(10) ORDER BY doc_id)) AS d FROM l GROUP BY 1, 2) SELECT source, sha256(string_agg(d, chr(10) ORDER BY run)) AS sha256 FROM r GROUP BY 1"""
)
def ordered_digests(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))).alias("line"))
    return sequence.ordered_digest(rows, ["source"], "doc_id", "line")


@query("SELECT 'N' || n_nationkey AS accession, n_name AS organism, [r_name, 'Second', 'Third'] AS taxonomy, n_nationkey || ' N 10 E' AS lat_lon FROM nation JOIN region ON n_regionkey = r_regionkey")
def flat_file_records(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(
        F.lit("LOCUS x\nACCESSION   N"), F.col("n_nationkey"), F.lit("\nSOURCE y\n  ORGANISM  "), F.col("n_name"), F.lit("\n            "), F.col("r_name"),
        F.lit("; Second;\n            Third.\nFEATURES\n     /lat_lon=\""), F.col("n_nationkey"), F.lit(" N 10 E\"\nORIGIN\n 1 acgt\nACCESSION   BAD"),
    )
    return genbank_records(rows.select(text.alias("record")))
