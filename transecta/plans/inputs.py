"""The driver's tables as the inputs of the operators, in Spark and, as SQL fragments, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = 2_592_000_000_000.0  # thirty days in microseconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as units, events as records: time and value as place, the number in props as trait."""
    since = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("unit"), F.col("event_id").alias("i"), (since / F.lit(SPAN)).alias("x"), (F.col("value") / F.lit(500.0)).alias("y"),
        F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("trait"),
    )
    return rows.withColumn("coords", F.array("x", "y"))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records() with two states, the value and the number in props over 100, and the time as orientation."""
    rows = records(spark, sf_dir)
    return rows.withColumns({"state_a": F.array("y"), "state_b": F.array(F.col("trait") / F.lit(100.0)), "orientation": F.col("x")})


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as units, embeddings as records: two dimensions as place, the next eight as trait."""
    e = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("unit"), F.col("vec_id").alias("i"), F.slice(e, 1, 2).alias("coords"), F.slice(e, 3, 8).alias("trait"))


def dyads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier nation and customer nation of line items: mean quantity, discount, tax and price in thousands."""
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "supplier", "orders", "customer")}
    bought = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))  # before they meet the items, which are more
    rows = t["lineitem"].join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("s_nationkey").cast("long").alias("source"), F.col("c_nationkey").cast("long").alias("target")).agg(
        F.round(F.avg("l_quantity"), 6).alias("q"), F.round(F.avg(F.col("l_discount") * 100), 6).alias("d"), F.round(F.avg(F.col("l_extendedprice") / 1000), 6).alias("p")
    )


RECORDS = """records AS (
  SELECT user_id AS unit, event_id AS i, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / CAST(2592000000000 AS DOUBLE) AS x,
         value / CAST(500 AS DOUBLE) AS y, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS trait
  FROM events)"""

VECTORS = """vectors AS (
  SELECT CAST(label AS BIGINT) AS unit, vec_id AS i, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
         list_transform(embedding[3:10], lambda v: CAST(v AS DOUBLE)) AS trait
  FROM embeddings)"""

DYADS = """dyads AS (
  SELECT CAST(s_nationkey AS BIGINT) AS source, CAST(c_nationkey AS BIGINT) AS target, round(avg(l_quantity), 6) AS q,
         round(avg(l_discount * 100), 6) AS d, round(avg(l_extendedprice / 1000), 6) AS p
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2)"""


def sql_rank(value: str, by: str) -> str:
    """Average rank as SQL."""
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / CAST(2 AS DOUBLE))"


def sql_near(source: str, k: str = "4") -> str:
    return f"""near AS (
  SELECT unit, i, j FROM (
    SELECT l.unit, l.i, r.i AS j, count(*) OVER (PARTITION BY l.unit, l.i) + 1 AS n,
           row_number() OVER (PARTITION BY l.unit, l.i ORDER BY sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)), r.i) AS place
    FROM {source} l JOIN {source} r ON l.unit = r.unit AND l.i <> r.i)
  WHERE place <= {k}),
edges AS (SELECT DISTINCT unit, least(i, j) AS a, greatest(i, j) AS b FROM near)"""


def sql_edge_table(source: str = "records", difference: str = "abs(l.trait - r.trait)") -> str:
    return f"""raw_edges AS (
  SELECT e.unit, e.a, e.b, l.x AS ax, l.y AS ay, r.x AS bx, r.y AS by_, (l.x + r.x) / 2 AS mx, (l.y + r.y) / 2 AS my,
         sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) AS length, {difference} AS difference
  FROM edges e JOIN {source} l ON e.unit = l.unit AND e.a = l.i JOIN {source} r ON e.unit = r.unit AND e.b = r.i),
edge_table AS (
  SELECT *, ({sql_rank("difference", "unit")} - CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY unit) AS turnover FROM raw_edges)"""


EDGES = f"{RECORDS},\n{sql_near('records')},\n{sql_edge_table()}"


def sql_spearman(source: str, x: str, y: str, by: str = "unit", out: str = "rho") -> str:
    """Guarded rank correlation by unit as a SELECT."""
    return f"""SELECT {by}, n, CASE WHEN n < 3 THEN CAST('NaN' AS DOUBLE) WHEN sqrt(xx * yy) <= 2.220446049250313e-16 THEN CAST(0 AS DOUBLE) ELSE round(xy / sqrt(xx * yy), 6) END AS {out}
FROM (SELECT {by}, count(*) AS n, sum(u * u) AS xx, sum(v * v) AS yy, sum(u * v) AS xy FROM (
  SELECT {by}, {sql_rank(x, by)} - (count(*) OVER (PARTITION BY {by}) + 1) / CAST(2 AS DOUBLE) AS u,
         {sql_rank(y, by)} - (count(*) OVER (PARTITION BY {by}) + 1) / CAST(2 AS DOUBLE) AS v FROM {source}) GROUP BY {by})"""


HALF = "CAST(0.5 AS DOUBLE)"
KERNEL = "exp(-0.5 * ((px - mx) * (px - mx) + (py - my) * (py - my)) / CAST(0.0625 AS DOUBLE))"
ROLES = """roles AS (
  SELECT unit, CASE WHEN row_number() OVER (ORDER BY sha256('split|' || unit), unit) <= floor(count(*) OVER () * 0.5) THEN 'train' ELSE 'held' END AS role
  FROM (SELECT DISTINCT unit FROM records))"""


def sql_points(source: str = "edge_table e JOIN roles r ON e.unit = r.unit AND role = 'held'", more: str = "") -> str:
    """points(unit, a, b, p, px, py): five on each edge."""
    return f"""points AS (SELECT e.unit, a, b, p{more}, ax + (p + {HALF}) / 5 * (bx - ax) AS px, ay + (p + {HALF}) / 5 * (by_ - ay) AS py
  FROM {source} CROSS JOIN generate_series(0, 4) AS g(p))"""


#: train(unit, mx, my, turnover, ..., w) of the training units' edges.
TRAIN = "train AS (SELECT e.*, 1 / CAST(count(*) OVER (PARTITION BY e.unit) AS DOUBLE) AS w FROM edge_table e JOIN roles r ON e.unit = r.unit AND role = 'train')"
#: The same with turnover made orthogonal to length: free with the spread of untied ranks, loose as it is.
FREE = f"""tr AS (SELECT e.*, count(*) OVER (PARTITION BY e.unit) AS n FROM edge_table e JOIN roles r ON e.unit = r.unit AND role = 'train'),
tc AS (SELECT *, ({sql_rank('turnover', 'unit')} - (n + 1) / CAST(2 AS DOUBLE)) AS ct, ({sql_rank('length', 'unit')} - (n + 1) / CAST(2 AS DOUBLE)) AS cz FROM tr),
tl AS (SELECT *, (ct - coalesce(sum(ct * cz) OVER (PARTITION BY unit) / nullif(sum(cz * cz) OVER (PARTITION BY unit), 0), 0) * cz) / n AS loose FROM tc),
train AS (SELECT unit, a, b, mx, my, turnover, 1 / CAST(n AS DOUBLE) AS w, loose,
  CASE WHEN stddev_pop(loose) OVER (PARTITION BY unit) > 1e-12 THEN loose * sqrt((n * n - 1) / (CAST(12 AS DOUBLE) * n * n)) / stddev_pop(loose) OVER (PARTITION BY unit) ELSE 0 END AS free FROM tl)"""


def sql_fields(values: dict[str, tuple[str, float]], pairs: str = "points q CROSS JOIN train t", keys: str = "", weight: str = "w") -> str:
    """sums, exposed(unit, a, b, one column for each value) and scored with turnover: fields of (column, prior mass) at the points.

    keys: further columns of the pairs that sums are kept apart by.
    """
    tops = ", ".join(f"sum({weight} * {KERNEL} * t.{column}) AS top_{name}" for name, (column, _) in values.items())
    means = ", ".join(f"round(avg((top_{name} + CAST({prior} AS DOUBLE)) / (low + CAST(0.25 AS DOUBLE))), 12) AS {name}" for name, (_, prior) in values.items())
    return f"""sums AS (SELECT q.unit, q.a, q.b, q.p{keys}, {tops}, sum({weight} * {KERNEL}) AS low FROM {pairs} GROUP BY ALL),
exposed AS (SELECT unit, a, b{keys.replace('t.', '').replace('unit AS ', '')}, {means} FROM sums GROUP BY ALL),
scored AS (SELECT x.*, e.turnover FROM exposed x JOIN edge_table e ON x.unit = e.unit AND x.a = e.a AND x.b = e.b)"""


def sql_projected(source: str, value: str, controls: list[str], keys: str) -> str:
    """CTEs after which projected(keys, v) is value less its projection on the controls, one after another made orthogonal; all are centred columns of source."""
    names = [f"c{i}" for i in range(len(controls))]
    out = [f"g0 AS (SELECT {keys}, {value} AS v{''.join(f', {c} AS {n}' for c, n in zip(controls, names))} FROM {source})"]
    for i, n in enumerate(names):
        less = lambda c, n=n: f"{c} - sum({c} * {n}) OVER () / sum({n} * {n}) OVER () * {n} AS {c}"
        out.append(f"g{i + 1} AS (SELECT {keys}, {', '.join(map(less, ['v', *names[i + 1 :]]))} FROM g{i})")
    return ",\n".join([*out, f"projected AS (SELECT {keys}, v FROM g{len(names)})"])
