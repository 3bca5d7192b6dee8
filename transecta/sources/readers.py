"""Readers of the tables and text records that analyses start from, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import SPLIT_BYTES, numbered

# Column names of the two archive tables.
GENES = "gene dir proportion_retained num_seqs_unaligned num_seqs_aligned kingdom phylum class order family genus species subspecies different_genbank_species".split()
OCCURRENCES = "phylogatr_id accession source_id latitude longitude basis_of_record coordinate_uncertainty_in_meters issue flag".split()


def exact_table(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """A table of strings whose header must be exactly these columns in this order."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    header = spark.read.text(path).where(F.col("value").startswith(columns[0] + sep)).limit(1).collect()
    if not header or header[0]["value"].split(sep) != columns:
        raise ValueError(f"{path}: the header is not {columns}")
    return spark.read.schema(schema).option("sep", sep).option("header", True).option("enforceSchema", False).option("quote", "").csv(path)


def required_columns(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with at least the columns of schema; values that do not parse are an error."""
    found = spark.read.option("header", True).csv(path)
    want = [x.split()[0] for x in schema.split(",")]
    if lacking := set(want) - set(found.columns):
        raise ValueError(f"{path}: no column {sorted(lacking)}")
    kinds = dict(x.split() for x in schema.split(","))
    return found.select(*(F.col(c).cast(kinds[c]).alias(c) for c in want))


def at_least(rows: DataFrame, unit: str, least: int) -> DataFrame:
    """Rows of units with `least` rows or more."""
    return rows.join(rows.groupBy(unit).count().where(F.col("count") >= least).select(unit), unit, "left_semi")


def fasta(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """(path, number, header, sequence): records of aligned FASTA files, numbered in file order, sequences in upper case. Files are read in byte ranges."""
    return numbered(spark, path, True, split)


def fasta_headers(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """(path, number, header) without keeping any sequence line."""
    return numbered(spark, path, False, split)


def genbank(spark: SparkSession, path: str) -> DataFrame:
    """(accession, organism, taxonomy array, lat_lon) of flat-file records; what follows ORIGIN is never looked at."""
    rows = spark.read.option("lineSep", "\n//").text(path)
    return genbank_records(rows.select(F.col("value").alias("record")))


def genbank_records(rows: DataFrame, record: str = "record") -> DataFrame:
    head = F.regexp_replace(F.col(record), r"(?s)\nORIGIN.*$", "")
    lineage = F.regexp_extract(head, r"(?m)^  ORGANISM  [^\n]*\n((?:            [^\n]*\n?)*)", 1)
    out = rows.select(
        F.regexp_extract(head, r"(?m)^ACCESSION\s+(\S+)", 1).alias("accession"),
        F.trim(F.regexp_extract(head, r"(?m)^  ORGANISM  ([^\n]*)", 1)).alias("organism"),
        F.filter(F.transform(F.split(F.regexp_replace(lineage, r"[\s.]+", " "), ";"), lambda x: F.trim(x)), lambda x: F.length(x) > 0).alias("taxonomy"),
        F.regexp_extract(head, r'/lat_lon="([^"]*)"', 1).alias("lat_lon"),
    )
    return out.where(F.length("accession") > 0)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def changed_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, expected, sha256) of manifest(path, expected) entries that found lacks or has with another digest."""
    return manifest.join(found, "path", "left").where(F.col("sha256").isNull() | (F.col("sha256") != F.col("expected")))


def bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet below path; nothing that exists is overwritten."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}.parquet")
