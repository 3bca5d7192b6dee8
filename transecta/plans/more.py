"""Queries of the operators for fronts, recurrence, calibration, ladders, places and checked sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import ranks, scalars
from ..operators import diagnostics, direction, dyadic, field, graph, inference, joins, niche, panels, sequence, spatial, worlds
from ..sources import strict
from ..sources.shared import kept
from . import calibration, inputs
from .inputs import DYADS, EDGES, FREE, HALF, KERNEL, RECORDS, ROLES, TRAIN, sql_fields, sql_near, sql_points, sql_projected, sql_rank, sql_spearman, table
from .queries import ABSORBED, _halves, query, rounded
from .transfer import TransferPlan

# ---- paired states and fronts ------------------------------------------------------------------

PAIRED = f"""{RECORDS}, {sql_near('records')},
raw_edges AS (SELECT e.unit, e.a, e.b, l.x AS ax, l.y AS ay, r.x AS bx, r.y AS by_, (l.x + r.x) / 2 AS mx, (l.y + r.y) / 2 AS my, (l.x + r.x) * {HALF} AS g,
  abs(abs(l.y - l.trait / 100) - abs(r.y - r.trait / 100)) AS dm, abs((l.y - l.trait / 100) - (r.y - r.trait / 100)) AS difference
  FROM edges e JOIN records l ON e.unit = l.unit AND e.a = l.i JOIN records r ON e.unit = r.unit AND e.b = r.i),
edge_table AS (SELECT *, ({sql_rank('dm', 'unit')} - {HALF}) / count(*) OVER (PARTITION BY unit) AS turnover, ({sql_rank('difference', 'unit')} - {HALF}) / count(*) OVER (PARTITION BY unit) AS coupling FROM raw_edges)"""


def _paired_edges(spark, sf):
    return tuple(direction.neighbour_pairs(rows) for rows in TransferPlan().record_halves(inputs.paired(spark, sf)))


@query(f"WITH {PAIRED} SELECT unit, a, b, round(turnover, 8) AS mismatch, round(coupling, 8) AS coupling FROM edge_table")
def paired_turnover(spark, sf):
    rows = inputs.paired(spark, sf)
    found = direction.paired_edges(rows, graph.knn_edges(rows))
    return found.select("unit", "a", "b", F.round(F.col("turnover")[0], 8).alias("mismatch"), F.round(F.col("turnover")[1], 8).alias("coupling"))


@query(
    f"""WITH {PAIRED}, {ROLES}, {TRAIN}, {sql_points()}, {sql_fields({'x0': ('turnover', 0.125), 'x1': ('coupling', 0.125)})},
long AS (SELECT 0 AS world, unit, x0 AS exposure, turnover FROM scored UNION ALL SELECT 1, s.unit, x1, e.coupling FROM scored s JOIN edge_table e ON s.unit = e.unit AND s.a = e.a AND s.b = e.b)
{sql_spearman('long', 'exposure', 'turnover', by='world, unit', out='score')}"""
)
def paired_transfer_scores(spark, sf):
    return rounded(diagnostics.world_scores(*_paired_edges(spark, sf), 0.25), "score")


CENTRE = f"""fr AS (SELECT e.*, row_number() OVER (PARTITION BY e.unit ORDER BY difference DESC, a DESC, b DESC) AS place, count(*) OVER (PARTITION BY e.unit) AS n FROM edge_table e JOIN roles r ON e.unit = r.unit AND role = 'train'),
top AS (SELECT * FROM fr WHERE place <= greatest(3, ceil(CAST(0.15 AS DOUBLE) * n))), tw AS (SELECT unit, g, sum(difference) AS w FROM top GROUP BY 1, 2),
cum AS (SELECT unit, g, sum(w) OVER (PARTITION BY unit ORDER BY g ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY unit) AS total FROM tw),
centres AS (SELECT unit, CASE WHEN max(total) > 2.2250738585072014e-308 THEN min(g) FILTER (run >= {HALF} * total) ELSE (SELECT median(t.g) FROM top t WHERE t.unit = cum.unit) END AS centre FROM cum GROUP BY unit),
centre AS (SELECT count(*) AS units, median(centre) AS centre FROM centres)"""


@query(f"WITH {PAIRED}, {ROLES}, {CENTRE} SELECT units, round(centre, 8) AS centre FROM centre")
def front_centre(spark, sf):
    return rounded(direction.front_centre(_paired_edges(spark, sf)[0]), "centre", digits=8)


@query(
    f"""WITH {PAIRED}, {ROLES}, {CENTRE}, m AS (SELECT r.unit, x, abs(y - trait / 100) AS m, c.centre AS c FROM records r JOIN roles o ON r.unit = o.unit AND role = 'held' CROSS JOIN centre c),
d AS (SELECT unit, count(*) FILTER (x >= c - 0.25 AND x < c) AS before, count(*) FILTER (x > c AND x <= c + 0.25) AS after, avg(m) FILTER (x > c AND x <= c + 0.25) - avg(m) FILTER (x >= c - 0.25 AND x < c) AS delta FROM m GROUP BY unit)
SELECT unit, before, after, round(delta, 8) AS delta FROM d WHERE before >= 4 AND after >= 4"""
)
def oriented_deltas(spark, sf):
    return rounded(direction.oriented_deltas(_held_mismatch(spark, sf), direction.front_centre(_paired_edges(spark, sf)[0]), 0.25), "delta", digits=8)


def _held_mismatch(spark, sf):
    rows = inputs.paired(spark, sf)
    held = panels.half_split(rows.select("unit").distinct(), "split").where("role = 'held'").select("unit")
    return rows.join(held, "unit", "left_semi").withColumn("mismatch", scalars.dissimilarity(F.col("state_a"), F.col("state_b"), True))


@query()
def directional_test(spark, sf):
    train, held = _paired_edges(spark, sf)
    return rounded(direction.directional_test(train, held, _held_mismatch(spark, sf), 0.25, 0.25), "centre", "coupling_p", "breakdown_p", "recoupling_p", "positive", "negative")


@query()
def paired_bootstrap_tests(spark, sf):
    return rounded(direction.paired_test(diagnostics.world_scores(*_paired_edges(spark, sf), 0.25)), "mean", "t", "p")


@query(
    """WITH s AS (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_suppkey, v, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY l_suppkey) AS total FROM s)
SELECT l_suppkey, min(v) FILTER (run >= CAST(0.5 AS DOUBLE) * total) AS median FROM c GROUP BY 1"""
)
def weighted_medians(spark, sf):
    return direction.weighted_median(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_suppkey"])


# ---- fields ------------------------------------------------------------------------------------


@query(
    f"""WITH {EDGES}, {ROLES}, {FREE}, {sql_points()}, {sql_fields({'x0': ('free', 0.0), 'x1': ('loose', 0.0)})},
one AS ({sql_spearman('scored', 'x0', 'turnover', out='score')}), other AS ({sql_spearman('scored', 'x1', 'turnover', out='score')})
SELECT unit, one.score AS normalized, other.score AS unscaled, round(one.score - other.score, 6) AS difference FROM one JOIN other USING (unit)"""
)
def normalization_bias(spark, sf):
    return rounded(TransferPlan().normalization_bias(_halves(spark, sf)), "difference")


@query(
    f"""WITH {EDGES}, {ROLES}, {TRAIN}, {sql_points()}, by_source AS (SELECT q.unit, q.a, q.b, q.p, t.unit AS source, sum(w * {KERNEL} * turnover) AS top, sum(w * {KERNEL}) AS low FROM points q CROSS JOIN train t GROUP BY ALL),
wo AS (SELECT unit, a, b, p, source, sum(top) OVER (PARTITION BY unit, a, b, p) - top AS top, sum(low) OVER (PARTITION BY unit, a, b, p) - low AS low FROM by_source),
exposed AS (SELECT source, unit, a, b, round(avg((top + CAST(0.125 AS DOUBLE)) / (low + CAST(0.25 AS DOUBLE))), 12) AS exposure FROM wo GROUP BY ALL),
scored AS (SELECT x.*, e.turnover FROM exposed x JOIN edge_table e ON x.unit = e.unit AND x.a = e.a AND x.b = e.b), s AS ({sql_spearman('scored', 'exposure', 'turnover', by='unit, source', out='score')})
SELECT CAST(source AS VARCHAR) AS source, count(*) AS units, round(avg(score), 5) AS statistic FROM s WHERE NOT isnan(score) GROUP BY 1"""
)
def leave_one_out_statistics(spark, sf):
    return rounded(field.leave_one_out(*_halves(spark, sf), 0.25), "statistic", digits=5)


@query(
    f"WITH {EDGES}, {ROLES}, {TRAIN}, {sql_points()}, {sql_fields({'exposure': ('turnover', 0.0)}, 'points q JOIN train t ON (q.unit + t.unit) % 7 = 0', ', t.unit AS source')}, "
    f"named AS (SELECT * REPLACE (CAST(source AS VARCHAR) AS source) FROM scored) {sql_spearman('named', 'exposure', 'turnover', by='unit, source', out='score')}"
)
def listed_pair_scores(spark, sf):
    train, held = _halves(spark, sf)
    sources = train.select(F.col("unit").alias("source")).distinct()
    pairs = held.select("unit").distinct().join(sources.withColumn("k", F.pmod(-F.col("source"), F.lit(7))), F.pmod("unit", F.lit(7)) == F.col("k")).select("unit", "source")
    return rounded(field.pair_scores(train, held, 0.25, pairs=pairs), "score")


_POOL = """{name} AS (SELECT target, source, (SELECT count(DISTINCT unit) FROM train) / CAST(count(*) OVER (PARTITION BY target) AS DOUBLE) AS scale FROM (
  SELECT h.unit AS target, t.unit AS source FROM (SELECT DISTINCT unit FROM roles WHERE role = 'held') h JOIN (SELECT DISTINCT unit FROM train) t ON {on}))"""


@query(
    f"""WITH {EDGES}, {ROLES}, {TRAIN}, {sql_points()}, {_POOL.format(name='pool', on='h.unit % 3 = t.unit % 3')}, {_POOL.format(name='wide', on='h.unit % 3 <= t.unit % 3')},
a AS (SELECT q.unit, q.a, q.b, q.p, sum(scale * w * {KERNEL} * turnover) AS top, sum(scale * w * {KERNEL}) AS low FROM points q JOIN pool o ON q.unit = o.target JOIN train t ON t.unit = o.source GROUP BY ALL),
b AS (SELECT q.unit, q.a, q.b, q.p, sum(scale * w * {KERNEL} * turnover) AS top, sum(scale * w * {KERNEL}) AS low FROM points q JOIN wide o ON q.unit = o.target JOIN train t ON t.unit = o.source GROUP BY ALL),
xa AS (SELECT unit, a, b, round(avg((top + 0.125) / (low + 0.25)), 12) AS exposure FROM a GROUP BY ALL), xb AS (SELECT unit, a, b, round(avg((top + 0.125) / (low + 0.25)), 12) AS exposure FROM b GROUP BY ALL),
sa AS (SELECT x.*, e.turnover FROM xa x JOIN edge_table e USING (unit, a, b)), sb AS (SELECT x.*, e.turnover FROM xb x JOIN edge_table e USING (unit, a, b)),
one AS ({sql_spearman('sa', 'exposure', 'turnover', out='score')}), other AS ({sql_spearman('sb', 'exposure', 'turnover', out='score')})
SELECT unit, round(one.score - other.score, 6) AS increment FROM one JOIN other USING (unit)"""
)
def pool_differences(spark, sf):
    train, held = (kept(x, "edges") for x in _halves(spark, sf))  # both pools read them
    targets, sources = held.select(F.col("unit").alias("target")).distinct(), train.select(F.col("unit").alias("source")).distinct()
    rest = [F.pmod(c, F.lit(3)) for c in ("target", "source")]
    scores = [rounded(field.pooled_transfer_scores(train, held, targets.join(sources, on), 0.25), "score") for on in (rest[0] == rest[1], rest[0] <= rest[1])]
    return rounded(diagnostics.increments(scores[1], scores[0], ["unit"]), "increment")


@query(
    f"""WITH {EDGES}, {ROLES}, shuffles AS (SELECT replicate, unit, i, trait, row_number() OVER (PARTITION BY replicate, unit ORDER BY i) AS at_, row_number() OVER (PARTITION BY replicate, unit ORDER BY sha256('permute|0|' || replicate || '|' || i), i) AS from_ FROM records CROSS JOIN generate_series(0, 1) AS g(replicate)),
traits AS (SELECT 0 AS world, unit, i, trait FROM records UNION ALL SELECT p.replicate + 1, p.unit, p.i, m.trait FROM shuffles p JOIN shuffles m ON p.replicate = m.replicate AND p.unit = m.unit AND p.at_ = m.from_),
d AS (SELECT l.world AS world, e.unit, e.a, e.b, abs(l.trait - r.trait) AS d FROM edges e JOIN traits l ON e.unit = l.unit AND e.a = l.i JOIN traits r ON e.unit = r.unit AND e.b = r.i AND l.world = r.world),
t AS (SELECT world, unit, a, b, ({sql_rank('d', 'world, unit')} - {HALF}) / count(*) OVER (PARTITION BY world, unit) AS t FROM d),
wide AS (SELECT unit, a, b, max(t) FILTER (world = 0) AS t0, max(t) FILTER (world = 1) AS t1, max(t) FILTER (world = 2) AS t2 FROM t GROUP BY 1, 2, 3),
train AS (SELECT e.mx, e.my, w.*, 1 / CAST(count(*) OVER (PARTITION BY e.unit) AS DOUBLE) AS w FROM edge_table e JOIN wide w USING (unit, a, b) JOIN roles r ON e.unit = r.unit AND role = 'train'),
{sql_points()}, {sql_fields({'x0': ('t0', 0.125), 'x1': ('t1', 0.125), 'x2': ('t2', 0.125)})},
long AS (SELECT world, x.unit, CASE world WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END AS exposure, t AS turnover FROM exposed x JOIN t ON x.unit = t.unit AND x.a = t.a AND x.b = t.b),
s AS ({sql_spearman('long', 'exposure', 'turnover', by='world, unit', out='score')})
SELECT CAST(world AS INTEGER) AS world, count(*) AS units, round(avg(score), 5) AS statistic FROM s WHERE NOT isnan(score) GROUP BY world"""
)
def permutation_statistics(spark, sf):
    return rounded(TransferPlan().permutation_statistics(inputs.records(spark, sf).drop("x", "y"), 2), "statistic", digits=5)


@query()
def full_refit_permutation_test(spark, sf):
    return rounded(TransferPlan().permutation_test(inputs.records(spark, sf).drop("x", "y"), 19), "statistic", "p")


@query()
def calibration_grid(spark, sf):
    found = calibration.grid(spark, [0.0, 1.0], [0.0, 2.0], 6, TransferPlan(bandwidth=0.2), units=16, records=30, resamples=199)
    return rounded(found, "statistic", "low", "high")


# ---- intervals ---------------------------------------------------------------------------------


@query()
def bootstrap_correlation_intervals(spark, sf):
    rows = table(spark, sf, "supplier").select((F.col("s_suppkey") % 5).alias("grp"), F.col("s_acctbal").cast("double").alias("x"), (F.col("s_suppkey") * 37 % 101).cast("double").alias("y"))
    return rounded(inference.correlation_interval(rows, "x", "y", ["grp"]), "rho", "low", "high")


@query()
def bootstrap_difference_intervals(spark, sf):
    rows = table(spark, sf, "supplier").select((F.col("s_nationkey") % 3).alias("grp"), F.col("s_acctbal").cast("double").alias("x"), (F.col("s_suppkey") % 2 == 0).alias("even"))
    return rounded(inference.difference_interval(rows, "x", "even", ["grp"]), "difference", "low", "high")


# ---- dyads -------------------------------------------------------------------------------------

# The additive fit of a square design without its diagonal, in closed form.
OWN_OUT = """rest AS (SELECT * FROM dyads WHERE source <> target AND target IN (SELECT source FROM dyads)), r AS (SELECT source AS k, avg(q) AS m FROM rest GROUP BY 1), c AS (SELECT target AS k, avg(q) AS m FROM rest GROUP BY 1),
g AS (SELECT avg(q) AS g, CAST(count(DISTINCT source) AS DOUBLE) AS n FROM rest), effects AS (SELECT k, (n - 1) * (n - 1) / (n * (n - 2)) AS u, (n - 1) / (n * (n - 2)) AS v, (n - 1) / (n - 2) AS w, r.m AS rm, c.m AS cm, g FROM r JOIN c USING (k), g)"""


@query(
    f"""WITH {DYADS}, {OWN_OUT} SELECT source, target, round(q - s.g - (s.u * s.rm + s.v * s.cm - s.w * s.g) - (t.u * t.cm + t.v * t.rm - t.w * t.g), 5) AS q
FROM rest JOIN effects s ON source = s.k JOIN effects t ON target = t.k"""
)
def incomplete_fixed_effects(spark, sf):
    rows = inputs.dyads(spark, sf)
    rows = rows.where("source <> target").join(rows.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target", "q")
    return rounded(dyadic.absorbed(rows, ["q"]), "q", digits=5)


SAME = "CASE WHEN source % 5 = target % 5 THEN CAST(1 AS DOUBLE) ELSE 0 END"
RATIO = "abs(ln((source + 1) / CAST(target + 2 AS DOUBLE)))"
_FE = "{c} - avg({c}) OVER (PARTITION BY source) - avg({c}) OVER (PARTITION BY target) + avg({c}) OVER () AS {c}"
LADDER = f"""{DYADS}, controlled AS (SELECT *, {SAME} AS same, {RATIO} AS ratio FROM dyads), free AS (SELECT source, target, {', '.join(_FE.format(c=c) for c in ('q', 'd', 'p', 'same', 'ratio'))} FROM controlled)"""


def _layer_sql(name: str, primary: str, controls: list[str], before: str) -> str:
    return f"""(WITH {sql_projected('free', primary, controls, 'source, target')}, s AS (SELECT source, target, v * v / sum(v * v) OVER () AS s FROM projected), a AS (SELECT sum(s) AS s FROM s GROUP BY source), b AS (SELECT sum(s) AS s FROM s GROUP BY target),
raw AS (SELECT var_pop({primary}) * count(*) AS ss, count(*) AS n FROM controlled), fe AS (SELECT sum({primary} * {primary}) AS ss FROM free), r AS (SELECT sum(v * v) AS ss FROM projected)
SELECT '{name}' AS layer, raw.n AS dyads, fe.ss / raw.ss AS fe_fraction, r.ss / fe.ss AS conditional_fraction, r.ss / raw.ss AS total_fraction, sqrt(r.ss / raw.ss) AS partial_sd, (SELECT 1 / sum(s * s) FROM s) AS effective_dyads,
  (SELECT 1 / sum(s * s) FROM a) AS effective_sources, (SELECT 1 / sum(s * s) FROM b) AS effective_targets, (SELECT max(s) FROM a) AS max_source_share, (SELECT max(s) FROM b) AS max_target_share, {before} AS survival FROM raw, fe, r)"""


_C1 = f"(WITH {sql_projected('free', 'q', ['d', 'same', 'ratio'], 'source, target')} SELECT sum(v * v) FROM projected)"


@query(
    f"""WITH {LADDER}, layers AS ({_layer_sql('current', 'd', ['same', 'ratio'], 'CAST(NULL AS DOUBLE)')} UNION ALL {_layer_sql('history', 'q', ['d', 'same', 'ratio'], 'CAST(NULL AS DOUBLE)')} UNION ALL {_layer_sql('history_and_place', 'q', ['d', 'same', 'ratio', 'p'], f'r.ss / {_C1}')})
SELECT layer, dyads, {', '.join(f'round({c}, 5) AS {c}' for c in ('fe_fraction', 'conditional_fraction', 'total_fraction', 'partial_sd', 'max_source_share', 'max_target_share', 'survival'))}, {', '.join(f'round({c}, 3) AS {c}' for c in ('effective_dyads', 'effective_sources', 'effective_targets'))} FROM layers"""
)
def information_ladder(spark, sf):
    found = dyadic.ladder(_controlled(spark, sf), [("current", "d", ["same", "ratio"]), ("history", "q", ["d", "same", "ratio"]), ("history_and_place", "q", ["d", "same", "ratio", "p"])])
    found = rounded(found, "fe_fraction", "conditional_fraction", "total_fraction", "partial_sd", "max_source_share", "max_target_share", "survival", digits=5)
    return rounded(found, "effective_dyads", "effective_sources", "effective_targets", digits=3)


def _controlled(spark, sf):
    same = F.when(F.col("source") % 5 == F.col("target") % 5, 1.0).otherwise(0.0)
    return inputs.dyads(spark, sf).withColumns({"same": same, "ratio": F.abs(F.log((F.col("source") + 1) / (F.col("target") + 2)))})


RULES = [("total_fraction", ">=", 0.05), ("max_source_share", "<=", 0.2), ("effective_targets", ">", 30.0)]


@query(
    f"""WITH {LADDER}, one AS {_layer_sql('current', 'd', ['same', 'ratio'], '0')}, g AS (SELECT unnest([{', '.join(f"{{'name': '{n}', 'observed': {n}, 'op': '{o}', 'threshold': CAST({t} AS DOUBLE), 'passed': {n} {o} {t}}}" for n, o, t in RULES)}]) AS g FROM one)
SELECT g.name AS name, round(g.observed, 3) AS observed, g.op AS op, g.threshold AS threshold, g.passed AS passed, CASE WHEN bool_and(g.passed) OVER () THEN 'EVALUABLE' ELSE 'NOT_EVALUABLE' END AS status FROM g"""
)
def evaluability_gates(spark, sf):
    return rounded(schema.gates(dyadic.ladder(_controlled(spark, sf), [("current", "d", ["same", "ratio"])]), RULES), "observed", digits=3)


# ---- places ------------------------------------------------------------------------------------

#: Label and corners of four shapes, the last with a hole.
SHAPES = [
    ("north", [[(0.05, 0.55), (0.45, 0.6), (0.4, 0.95), (0.1, 0.9)]]), ("south", [[(0.1, 0.05), (0.9, 0.1), (0.5, 0.4)]]), ("west", [[(0.0, 0.2), (0.3, 0.3), (0.25, 0.8), (0.02, 0.7)]]),
    ("east", [[(0.6, 0.3), (0.98, 0.35), (0.95, 0.9), (0.55, 0.85)], [(0.7, 0.5), (0.85, 0.5), (0.8, 0.7)]]),
]
_SEGMENTS = ", ".join(f"('{label}', {p[0]}, {p[1]}, {q[0]}, {q[1]})" for label, rings in SHAPES for ring in rings for p, q in zip(ring, ring[1:] + ring[:1]))
INSIDE = f"""segments AS (SELECT label, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM (VALUES {_SEGMENTS}) AS v(label, x1, y1, x2, y2)),
hits AS (SELECT i, label FROM records CROSS JOIN segments WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY i, label HAVING count(*) % 2 = 1)"""


def _shapes(spark):
    rows = [(label, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for label, rings in SHAPES]
    return spark.createDataFrame(rows, "label string, rings array<array<struct<x:double,y:double>>>")


@query(f"WITH {RECORDS}, {INSIDE} SELECT i, label FROM hits")
def points_in_polygons(spark, sf):
    return spatial.in_polygons(inputs.records(spark, sf).select("i", "x", "y"), _shapes(spark), "x", "y", 0.1).select("i", "label")


@query(f"WITH {RECORDS}, {INSIDE} SELECT r.i, coalesce(min(label) FILTER (label = 'west'), min(label)) AS label FROM records r LEFT JOIN hits h ON r.i = h.i GROUP BY r.i")
def spatial_labels(spark, sf):
    return spatial.spatial_labels(inputs.records(spark, sf).select("i", "x", "y"), _shapes(spark), "i", "x", "y", "West", 0.1).select("i", "label")


@query(
    f"""WITH {RECORDS}, {ROLES}, d AS (SELECT h.unit, h.i, min(sqrt((h.x - t.x) * (h.x - t.x) + (h.y - t.y) * (h.y - t.y))) AS d FROM records h JOIN roles o ON h.unit = o.unit AND o.role = 'held' CROSS JOIN (SELECT x, y FROM records JOIN roles USING (unit) WHERE role = 'train') t GROUP BY 1, 2)
SELECT unit, count(*) AS n, round(median(d), 8) AS median, round(quantile_cont(d, 0.9), 8) AS p90, round(max(d), 8) AS farthest FROM d GROUP BY unit"""
)
def nearest_support(spark, sf):
    rows = inputs.records(spark, sf)
    both = rows.join(panels.half_split(rows.select("unit").distinct(), "split").select("unit", "role"), "unit").withColumn("row", F.col("i").cast("string"))
    near = spatial.nearest_distances(both.where("role = 'held'"), both.where("role = 'train'"))
    return rounded(spatial.support_summary(both.select("row", "unit").join(near, "row"), ["unit"]), "median", "p90", "farthest", digits=8)


@query("SELECT l_returnflag, count(*) AS n, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 8) AS slope FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1")
def log_log_slopes(spark, sf):
    return rounded(spatial.log_log_slope(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), "slope", digits=8)


@query(
    f"""WITH {RECORDS}, p AS (SELECT unit, i, x * 60 AS lat, y * 120 AS lon FROM records)
SELECT a.unit, round(max(6371.0088 * acos(greatest(-1, least(1, sin(radians(a.lat)) * sin(radians(b.lat)) + cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(a.lon - b.lon)))))), 3) AS km FROM p a JOIN p b ON a.unit = b.unit GROUP BY 1"""
)
def pairwise_spans(spark, sf):
    rows = inputs.records(spark, sf).select("unit", "i", (F.col("x") * 60).alias("lat"), (F.col("y") * 120).alias("lon"))
    return rounded(spatial.spans(rows), "km", digits=3)


@query(
    """WITH f AS (SELECT l_suppkey AS realization, l_partkey % 40 AS cell, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2), t AS (SELECT realization, quantile_cont(value, 0.9) AS t FROM f GROUP BY 1)
SELECT cell, count(*) AS valid, round(avg(CASE WHEN value >= t THEN 1 ELSE 0 END), 8) AS probability FROM f JOIN t USING (realization) GROUP BY cell"""
)
def recurrence_map(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("realization"), (F.col("l_partkey") % 40).alias("cell")).agg(F.avg("l_extendedprice").alias("value"))
    return rounded(spatial.recurrence(rows), "probability", digits=8)


@query(
    f"""WITH {RECORDS}, l AS (SELECT unit, i, floor(i / CAST(1000 AS DOUBLE)) AS run, sha256(i || '|' || CAST(round(x * 1000000) AS BIGINT) || ',' || CAST(round(y * 1000000) AS BIGINT)) AS d FROM records),
r AS (SELECT unit, run, sha256(string_agg(d, chr(10) ORDER BY i)) AS d FROM l GROUP BY 1, 2), u AS (SELECT unit, sha256(string_agg(d, chr(10) ORDER BY run)) AS d FROM r GROUP BY 1)
SELECT count(*) AS units, (SELECT count(*) FROM records) AS records, sha256(string_agg(unit || '|' || d, chr(10) ORDER BY unit || '|' || d)) AS sha256 FROM u"""
)
def geometry_fingerprint(spark, sf):
    return sequence.fingerprint(inputs.records(spark, sf), decimals=6)


DENSITY_AT = """pts AS (SELECT CAST(label AS BIGINT) AS unit, CAST(embedding[1] AS DOUBLE) AS w1, CAST(embedding[2] AS DOUBLE) AS w2, CAST(embedding[3] AS DOUBLE) AS w3 FROM embeddings),
asked AS (SELECT CAST(vec_id AS VARCHAR) AS query, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings WHERE vec_id < 40),
n AS (SELECT unit, count(*) AS n, power(count(*), CAST(-1 AS DOUBLE) / 7) AS h FROM pts GROUP BY 1),
density AS (SELECT unit, query, sum(exp(-0.5 * ((x - w1) * (x - w1) + (y - w2) * (y - w2) + (z - w3) * (z - w3)) / (h * h))) / (max(n) * power(2 * pi(), CAST(1.5 AS DOUBLE)) * power(max(h), 3)) AS density FROM pts JOIN n USING (unit) CROSS JOIN asked GROUP BY 1, 2)"""


def _axes3(spark, sf):
    e = table(spark, sf, "embeddings")
    axes = [F.col("embedding")[k].cast("double").alias(f"w{k + 1}") for k in range(3)]
    return e.select(F.col("label").cast("long").alias("unit"), *axes), e.where("vec_id < 40").select(F.col("vec_id").alias("query"), *axes)


@query(f"WITH {DENSITY_AT} SELECT unit, query, round(density, 10) AS density FROM density")
def densities_at_points(spark, sf):
    return rounded(niche.density_at(*_axes3(spark, sf), ["w1", "w2", "w3"]), "density", digits=10)


@query(f"WITH {DENSITY_AT}, s AS (SELECT unit, query, density / sum(density) OVER (PARTITION BY unit) AS p FROM density) SELECT a.unit AS source, b.unit AS target, round(1 - 0.5 * sum(abs(a.p - b.p)), 8) AS d FROM s a JOIN s b ON a.query = b.query AND a.unit <> b.unit GROUP BY 1, 2")
def suitability_relations(spark, sf):
    found = niche.suitability(*_axes3(spark, sf), ["w1", "w2", "w3"]).withColumnRenamed("query", "cell")
    return rounded(niche.overlaps(found), "d", digits=8)


# ---- scalars, splits, checked sources ----------------------------------------------------------


@query("SELECT event_id, round(value + 200 - 273.15, 8) AS celsius, round(CASE event_id % 3 WHEN 0 THEN value - 273.15 WHEN 1 THEN value ELSE (value - 32) / 1.8 END, 8) AS harmonized, round(value - event_id, 8) AS moved FROM events")
def harmonized_measures(spark, sf):
    unit = F.element_at(F.array(F.lit("K"), F.lit(" c "), F.lit("F")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf, "events").select(
        "event_id", F.round(scalars.celsius(F.col("value") + 200), 8).alias("celsius"), F.round(scalars.harmonized(F.col("value"), unit), 8).alias("harmonized"),
        F.round(scalars.displacement(F.col("value"), F.col("event_id")), 8).alias("moved"),
    )


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'missing_usage_key' WHEN p_partkey % 5 < 3 AND p_partkey % 2 = 0 THEN 'exact_canonical_species' ELSE 'rejected_nonexact_species_match' END AS reason, p_partkey % 7 <> 0 AND p_partkey % 5 < 3 AND p_partkey % 2 = 0 AS accepted FROM part"""
)
def name_matches(spark, sf):
    kind = F.when(F.col("p_partkey") % 5 < 3, F.when(F.col("p_partkey") % 3 == 0, "exact").otherwise("CONFIDENCE")).otherwise("FUZZY")
    rank = F.when(F.col("p_partkey") % 2 == 0, "species").otherwise("GENUS")
    found = scalars.name_match(F.upper("p_name"), F.col("p_partkey") % 7, kind, rank, F.concat(F.lit("  "), F.col("p_name")))
    return table(spark, sf, "part").select("p_partkey", found["accepted"].alias("accepted"), found["reason"].alias("reason"))


@query("SELECT s_suppkey, '{\"balance\":' || CAST(CAST(s_acctbal * 100 AS BIGINT) AS VARCHAR) || ',\"name\":\"' || s_name || '\",\"none\":null}' AS json, sha256('{\"balance\":' || CAST(CAST(s_acctbal * 100 AS BIGINT) AS VARCHAR) || ',\"name\":\"' || s_name || '\",\"none\":null}') AS sha256 FROM supplier")
def canonical_rows(spark, sf):
    text = strict.canonical_json({"name": F.col("s_name"), "balance": F.round(F.col("s_acctbal") * 100).cast("long"), "none": F.lit(None).cast("string")})
    return table(spark, sf, "supplier").select("s_suppkey", text.alias("json"), F.sha2(text.cast("binary"), 256).alias("sha256"))


@query("SELECT event_id, event_id % 4 <> 0 AND event_id % 4 <> 1 AS ok, CASE WHEN event_id % 4 >= 2 THEN '{\"a\":' || event_id || ',\"b\":[1,null]}' END AS canonical FROM events")
def strict_receipts(spark, sf):
    k = F.col("event_id")
    text = F.when(k % 4 == 0, F.concat(F.lit('{"a": 1, "a": '), k, F.lit("}"))).when(k % 4 == 1, F.concat(F.lit('{"a": NaN, "b": '), k, F.lit("}"))).otherwise(F.concat(F.lit('{"b" : [1, null], "a" : '), k, F.lit(" }")))
    return strict.strict_json(table(spark, sf, "events").select("event_id", text.alias("text"))).select("event_id", "ok", "canonical")


@query("SELECT c_custkey || chr(9) || c_mktsegment || chr(9) || c_name AS value FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def raw_row_projection(spark, sf):
    lines = table(spark, sf, "customer").select(F.concat_ws("\t", "c_custkey", "c_mktsegment", "c_name").alias("value"))
    return strict.raw_rows(lines, 1, ["BUILDING", "MACHINERY"])


@query("SELECT o_orderkey, o_orderkey % 5 AS shard FROM orders WHERE o_orderkey % 5 IN (1, 3)")
def modulo_shards(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey")
    return strict.sharded(rows, "o_orderkey", 1, 5).withColumn("shard", F.lit(1)).unionByName(strict.sharded(rows, "o_orderkey", 3, 5).withColumn("shard", F.lit(3))).withColumn("shard", F.col("shard").cast("long"))


@query("SELECT l_suppkey, mode, n FROM (SELECT l_suppkey, l_linenumber AS mode, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS p FROM lineitem GROUP BY 1, 2) WHERE p = 1")
def most_frequent_values(spark, sf):
    return ranks.most_frequent(table(spark, sf, "lineitem"), "l_linenumber", ["l_suppkey"])


@query("SELECT user_id, event_type FROM events WHERE value > 150 INTERSECT SELECT user_id, event_type FROM events WHERE value < 100 EXCEPT SELECT user_id, event_type FROM events WHERE value BETWEEN 200 AND 202")
def jointly_supported(spark, sf):
    rows = table(spark, sf, "events")
    named = lambda d: d.select("user_id", "event_type")
    return named(rows.where("value > 150")).intersect(named(rows.where("value < 100"))).subtract(named(rows.where("value between 200 and 202")))


@query(f"WITH {RECORDS}, r AS (SELECT CASE WHEN i % 97 = 0 THEN NULL ELSE unit END AS unit, i % 2000 AS i, CASE WHEN i % 31 = 0 THEN 'NaN' ELSE x END AS x FROM records) SELECT 'unnamed' AS fault, count(*) AS n FROM r WHERE unit IS NULL HAVING count(*) > 0 UNION ALL SELECT 'not_finite', count(*) FROM r WHERE isnan(CAST(x AS DOUBLE)) HAVING count(*) > 0 UNION ALL SELECT 'repeated', count(*) FROM (SELECT unit, i FROM r GROUP BY 1, 2 HAVING count(*) > 1) HAVING count(*) > 0")
def record_faults(spark, sf):
    i = F.col("i")
    rows = inputs.records(spark, sf).select(F.when(i % 97 != 0, F.col("unit")).alias("unit"), (i % 2000).alias("i"), F.array(F.when(i % 31 == 0, F.lit(float("nan"))).otherwise(F.col("x")), F.col("y")).alias("coords"))
    return schema.faults(rows)


@query()
def generated_worlds(spark, sf):
    drawn = worlds.generated(spark, [(name, 3) for name in sorted(worlds.GENERATORS)], 20260907, units=6, records=24)
    return drawn.groupBy("generator", "world").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("unit").alias("units"), F.round(F.avg("trait"), 6).alias("mean_trait"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000 AND o_totalprice = (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c_custkey) AND o_orderkey = (SELECT min(o_orderkey) FROM orders o WHERE o.o_custkey = c_custkey AND o.o_totalprice = (SELECT max(o_totalprice) FROM orders o2 WHERE o2.o_custkey = c_custkey))")
def best_partner(spark, sf):
    rich = table(spark, sf, "customer").where("c_acctbal > 9000").select("c_custkey")
    best = panels.one_per_group(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.checked_merge(rich, best, ["c_custkey"])


@query(f"WITH {DYADS}, {ABSORBED} SELECT source, round(sum(q * d), 5) AS product FROM absorbed GROUP BY source")
def endpoint_free_products(spark, sf):
    rows = dyadic.absorbed(inputs.dyads(spark, sf).select("source", "target", "q", "d"), ["q", "d"])
    return rows.groupBy("source").agg(F.round(F.sum(F.col("q") * F.col("d")), 5).alias("product"))
