"""Schemas of the model's tables, and checks that a table keeps what its operators take for granted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORDS = "unit string, i bigint, coords array<double>, trait double"
PAIRED = "unit string, i bigint, coords array<double>, state_a array<double>, state_b array<double>"
EDGES = "unit string, a bigint, b bigint, start array<double>, end array<double>, mid array<double>, length double, turnover double"
DYADS = "source string, target string, value double"
GATE = "name string, observed double, op string, threshold double, passed boolean"


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def lacking(df: DataFrame, schema: str) -> list[str]:
    """Columns of the schema that df lacks."""
    return [c.split()[0] for c in schema.split(", ") if c.split()[0] not in df.columns]


def faults(records: DataFrame, units: int = 4) -> DataFrame:
    """(fault, n) of records(unit, i, coords): repeated places in a unit's numbering, missing names, coordinates that are no numbers or of another number of axes, and too few units; faults that don't occur are left out."""
    rows = records.select("unit", "i", "coords")
    several = rows.groupBy("unit", "i").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated").alias("fault"), "n")
    bad = F.coalesce(~F.forall("coords", finite), F.lit(True))
    axes = F.max(F.size("coords")) - F.min(F.size("coords"))
    sums = rows.agg(F.count_if(F.col("unit").isNull() | (F.col("unit").cast("string") == "")).alias("unnamed"), F.count_if(bad).alias("not_finite"), axes.cast("long").alias("axes"), F.greatest(F.lit(units) - F.count_distinct("unit"), F.lit(0)).alias("units_lacking"))
    long = sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("fault"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n")) for c in ("unnamed", "not_finite", "axes", "units_lacking")))).alias("x")).select("x.*")
    return long.unionByName(several).where("n > 0")


def checked(records: DataFrame, units: int = 4) -> DataFrame:
    """records, or an error that names their faults."""
    if missing := lacking(records, "unit string, i bigint, coords array<double>"):
        raise ValueError(f"no column {missing}")
    if found := faults(records, units).collect():  # five rows at most
        raise ValueError("; ".join(f"{r['fault']}: {r['n']}" for r in found))
    return records


def disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    """An error where two tables share a key."""
    if not left.select(key).intersect(right.select(key)).isEmpty():
        raise ValueError(f"{key} is in both tables")


def subset(left: DataFrame, right: DataFrame, key: str) -> None:
    """An error where a key of left is not in right."""
    if not left.select(key).subtract(right.select(key)).isEmpty():
        raise ValueError(f"{key} is not always in the other table")


def gates(row: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """(name, observed, op, threshold, passed, status) of a table of one row: each rule(column, op, threshold), and EVALUABLE where all pass, else NOT_EVALUABLE.

    Ops are >=, <=, > and <; a null or NaN passes none.
    """
    ops = {">=": lambda x, t: x >= t, "<=": lambda x, t: x <= t, ">": lambda x, t: x > t, "<": lambda x, t: x < t}
    structs = []
    for name, op, threshold in rules:
        x = F.col(name).cast("double")
        ok = F.coalesce(~F.isnan(x) & ops[op](x, F.lit(float(threshold))), F.lit(False))
        structs.append(F.struct(F.lit(name).alias("name"), x.alias("observed"), F.lit(op).alias("op"), F.lit(float(threshold)).alias("threshold"), ok.alias("passed")))
    found = row.select(F.array(*structs).alias("g"))
    status = F.when(F.forall("g", lambda g: g["passed"]), "EVALUABLE").otherwise("NOT_EVALUABLE")
    return found.select(F.explode("g").alias("x"), status.alias("status")).select("x.*", "status")
