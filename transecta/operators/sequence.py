"""Aligned sequences: masks, localities, and distances between the localities of an edge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def mask(sequence: Column) -> Column:
    """The sequence with 1 where there is one of A, C, G and T and 0 elsewhere."""
    return F.regexp_replace(F.regexp_replace(F.upper(sequence), "[^ACGT]", "0"), "[ACGT]", "1")


def ordered_digest(rows: DataFrame, by: list[str], order: str, value: str, each: int = 1000) -> DataFrame:
    """(by, sha256): digest of a group's values in their order by a whole number.

    The values' own digests are joined by line feeds for every run of `each` numbers, and the digests of those runs
    again, so that a group of any size comes to short texts: 64 characters for each run.
    """
    lines = rows.select(*by, F.floor(F.col(order) / each).alias("run_"), order, F.sha2(F.col(value).cast("binary"), 256).alias("digest_"))
    joined = lambda at: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "digest_"))), lambda x: x["digest_"]), "\n").cast("binary"), 256)
    runs = lines.groupBy(*by, "run_").agg(joined(order).alias("digest_"))
    return runs.groupBy(*by).agg(joined("run_").alias("sha256"))


def fingerprint(records: DataFrame, unit: str = "unit", order: str = "i", places: str = "coords", decimals: int = 9) -> DataFrame:
    """(units, records, sha256): digest of a sampling frame, of every unit's name, record numbers and places to so many decimals, whatever their order."""
    scaled = F.transform(places, lambda x: F.round(x * 10**decimals).cast("long").cast("string"))
    lines = records.select(unit, order, F.concat_ws("|", F.col(order).cast("string"), F.array_join(scaled, ",")).alias("line"))
    units = ordered_digest(lines, [unit], order, "line").join(records.groupBy(unit).agg(F.count(F.lit(1)).alias("n")), unit)
    line = F.concat_ws("|", F.col(unit).cast("string"), "sha256")
    whole = F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256)  # a short line for each unit
    return units.agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("records"), whole.alias("sha256"))


LETTERS = "ACGT"
#: Columns of a sequence that one word of each plane holds.
WORD = 64


def planes(sequence: Column) -> Column:
    """array<struct<A, C, G, T>>: for every 64 columns of a sequence four words, whose bits say where that letter is; small letters count as capitals."""
    words = F.when(F.length(sequence) > 0, F.sequence(F.lit(0), ((F.length(sequence) - 1) / WORD).cast("int"))).otherwise(F.array().cast("array<int>"))

    def word(k: Column) -> Column:
        part = F.rpad(F.upper(F.substr(sequence, k * WORD + 1, F.lit(WORD))), WORD, "-")
        bits = lambda letter: F.conv(F.replace(F.regexp_replace(part, f"[^{letter}]", "0"), F.lit(letter), F.lit("1")), 2, -10).cast("long")
        return F.struct(*(bits(x).alias(x) for x in LETTERS))

    return F.transform(words, word)


def compared(left: Column, right: Column) -> Column:
    """struct<comparable, equal>: columns where both planes have a letter, and where it is the same; what one sequence lacks is not comparable."""

    def word(x: Column, y: Column) -> Column:
        anyone = lambda w: reduce(lambda a, b: a.bitwiseOR(b), (w[c] for c in LETTERS))
        equal = sum((F.bit_count(x[c].bitwiseAND(y[c])) for c in LETTERS[1:]), F.bit_count(x[LETTERS[0]].bitwiseAND(y[LETTERS[0]])))
        return F.struct(F.coalesce(F.bit_count(anyone(x).bitwiseAND(anyone(y))), F.lit(0)).alias("comparable"), F.coalesce(equal, F.lit(0)).alias("equal"))

    start = F.struct(F.lit(0).alias("comparable"), F.lit(0).alias("equal"))
    add = lambda s, w: F.struct((s["comparable"] + w["comparable"]).alias("comparable"), (s["equal"] + w["equal"]).alias("equal"))
    return F.aggregate(F.zip_with(left, right, word), start, add)


def edge_sequence_distances(sequences: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """(unit, a, b, n_pairs, distance, comparable): mean masked distance of the sequences of an edge's two localities.

    sequences(unit, loc, sequence). Pairs with fewer than `least` comparable columns do not count;
    an edge without any pair has a null distance. A sequence is packed once, and pairs of them meet as words.
    """
    packed = sequences.select("unit", "loc", planes(F.col("sequence")).alias("planes"))
    left, right = (packed.select("unit", F.col("loc").alias(end), F.col("planes").alias(name)) for end, name in (("a", "l"), ("b", "r")))
    pairs = edges.select("unit", "a", "b").join(left, ["unit", "a"]).join(right, ["unit", "b"])
    rows = pairs.select("unit", "a", "b", compared(F.col("l"), F.col("r")).alias("x")).select("unit", "a", "b", "x.*")
    n = F.col("comparable")
    distance = F.when((n >= least) & (n > 0), (n - F.col("equal")) / F.when(n > 0, n))
    return rows.groupBy("unit", "a", "b").agg(F.count(distance).alias("n_pairs"), F.avg(distance).alias("distance"), F.max("comparable").alias("comparable"))


def locality_of(records: DataFrame, localities: DataFrame) -> DataFrame:
    """records with loc by exact place; check joins.missing() for records without one."""
    return records.join(localities.select("unit", "coords", "loc"), ["unit", "coords"])


def shares(rows: DataFrame, by: list[str], value: str, kind: str) -> DataFrame:
    """(by, kinds array<double>): shares of a group's total by kind, in order of kind, zeros for absent kinds."""
    kinds = rows.select(kind).distinct()
    keys = rows.select(*by).distinct().crossJoin(kinds)  # the result's size: each group has a number for each kind
    sums = rows.groupBy(*by, kind).agg(F.sum(value).alias("s"))
    full = keys.join(sums, [*by, kind], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    part = full.withColumn("p", F.col("s") / F.sum("s").over(Window.partitionBy(*by)))
    return part.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(kind).alias("k"), "p"))), lambda x: x["p"]).alias("shares"))
