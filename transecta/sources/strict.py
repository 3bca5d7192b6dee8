"""Sources that are checked or opened before they are tables: strict JSON, archives, raw lines, polygons, and sinks."""

from __future__ import annotations

import io
import json
import math
import re
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType


def strict_object(text: str) -> object:
    """The value of a JSON text; a repeated key, or a number that is not finite, is a ValueError."""

    def pairs(found):
        keys = [k for k, _ in found]
        if len(set(keys)) != len(keys):
            raise ValueError(f"repeated key {next(k for k in keys if keys.count(k) > 1)!r}")
        return dict(found)

    def number(x):
        value = float(x)
        if not math.isfinite(value):
            raise ValueError(f"not finite: {x}")
        return value

    def constant(x):
        raise ValueError(f"not finite: {x}")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant, parse_float=number)


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def strict_json(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with ok, error and canonical: whether each text is strict JSON, why not, and its canonical form. A null text is no JSON."""

    def run(frames):
        for pdf in frames:
            out = []
            for x in pdf[text]:
                try:
                    out.append((True, None, canonical(strict_object(x))))
                except (ValueError, TypeError, RecursionError) as e:
                    out.append((False, str(e)[:200], None))
            yield pdf.assign(ok=[o[0] for o in out], error=[o[1] for o in out], canonical=[o[2] for o in out])

    schema = StructType([*rows.schema.fields, StructField("ok", BooleanType()), StructField("error", StringType()), StructField("canonical", StringType())])
    return rows.mapInPandas(run, schema)


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, ok, error, canonical) of whole JSON files."""
    return strict_json(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def canonical_json(columns: dict[str, Column]) -> Column:
    """A row's values as JSON with sorted keys, no spaces, and nulls."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def archive_members(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """(path, member, size, content) of the members of ZIP and TAR archives, plain or compressed, whose name matches; an archive is one task."""

    def members(name, content):
        if name.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                yield from ((x.filename, x.file_size, z.read(x)) for x in z.infolist() if not x.is_dir() and re.search(pattern, x.filename))
        else:
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                yield from ((x.name, x.size, t.extractfile(x).read()) for x in t if x.isfile() and re.search(pattern, x.name))

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                for member, size, data in members(name, content):  # one at a time, as members can be large
                    yield pd.DataFrame([(name, member, size, data)], columns=["path", "member", "size", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, member string, size long, content binary")


def raw_rows(lines: DataFrame, position: int, values: list[str], sep: str = "\t") -> DataFrame:
    """The lines, value as it came, whose field at a position from 0 is one of values."""
    return lines.where(F.get(F.split("value", re.escape(sep), -1), F.lit(position)).isin(*values))


def geojson(texts: DataFrame, label: str, text: str = "text") -> DataFrame:
    """(label, rings array<array<struct<x, y>>>) of the polygons in GeoJSON feature collections; each part of a multiple polygon is a row."""
    feature = "array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    rows = texts.select(F.explode(F.from_json(text, f"struct<features:{feature}>")["features"]).alias("f"))
    numbers = "array<array<array<double>>>"
    kind, found = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(found, numbers))).when(kind == "MultiPolygon", F.from_json(found, f"array<{numbers}>"))
    rings = F.transform("part", lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return rows.select(F.col("f.properties")[label].alias("label"), F.explode(parts).alias("part")).select("label", rings.alias("rings"))


def sink(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """df as parquet, csv (with a header), json or orc; what exists is never overwritten."""
    if kind not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"no sink {kind}")
    df.write.mode("errorifexists").format(kind).options(**({"header": True} if kind == "csv" else {})).save(path)


def sharded(rows: DataFrame, key: str, shard: int, shards: int) -> DataFrame:
    """The rows whose whole number leaves `shard` over `shards`: by absolute numbers, so that shards don't depend on each other."""
    if shards < 1 or not 0 <= shard < shards:
        raise ValueError("no such shard")
    return rows.where(F.pmod(F.col(key), F.lit(shards)) == shard)


def ranges(total: int, shards: int) -> list[tuple[int, int]]:
    """Contiguous ranges [start, end) of 0 to total, in order, whose sizes differ by one at most."""
    if shards < 1 or total < 0:
        raise ValueError("no such shards")
    each, over = divmod(total, shards)
    starts = [i * each + min(i, over) for i in range(shards + 1)]
    return list(zip(starts, starts[1:]))
