"""All-against-all work in blocks of bounded size, for sums and searches that no key can prune.

Rows of a unit are dealt to blocks by a hash, so a unit of any size is many blocks and never one
task. Blocks, not rows, are joined; a task sees two blocks at a time and returns sums or the best
few, never the pairs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import folder

BLOCK = 2048


def blocked(df: DataFrame, unit: list[str], row: str, fields: list[str], size: int = BLOCK, name: str = "block") -> DataFrame:
    """One row for each block: the unit's columns, name (its number), of_name (how many the unit has) and rows array<struct<row, fields>>."""
    key = ["all_"] if not unit else unit
    rows = df.withColumn("all_", F.lit(0)) if not unit else df
    counts = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(size))).cast("int").alias(f"of_{name}"))
    dealt = rows.join(counts, key).withColumn(name, F.pmod(F.xxhash64(row), F.col(f"of_{name}")).cast("int"))
    return dealt.groupBy(*key, f"of_{name}", name).agg(F.collect_list(F.struct(row, *fields)).alias("rows"))


def arrays(column: pa.Array, i: int) -> dict[str, np.ndarray]:
    """The fields of the i-th block as arrays; an array field becomes a matrix."""
    found = column[i].values
    out = {}
    for f in found.type:
        x = found.field(f.name)
        if pa.types.is_list(f.type) and not x.null_count:
            sizes = pc.list_value_length(x).to_numpy(zero_copy_only=False)
            if len(sizes) and (sizes == sizes[0]).all():
                out[f.name] = x.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), sizes[0])
                continue
        out[f.name] = x.to_numpy(zero_copy_only=False)
    return out


def paired(left: DataFrame, right: DataFrame, unit: list[str]) -> DataFrame:
    """(unit, l_, r_, left_, right_): every two blocks of the same unit, each pair a key of its own, so that a unit's pairs spread over all tasks.

    left's blocks are named block, right's block_.
    """
    key = ["all_"] if not unit else unit
    n_left = left.select(*key, F.col("of_block").alias("n_")).distinct()
    n_right = right.select(*key, F.col("of_block_").alias("n_")).distinct()
    others = F.explode(F.sequence(F.lit(0), F.col("n_") - 1))
    a = left.join(n_right, key).select(*key, F.col("block").alias("l_"), others.alias("r_"), F.col("rows").alias("left_"))
    b = right.join(n_left, key).select(*key, others.alias("l_"), F.col("block_").alias("r_"), F.col("rows").alias("right_"))
    return a.join(b.hint("merge"), [*key, "l_", "r_"])  # a broadcast would leave pairs where their blocks were made


def each_pair(left: DataFrame, right: DataFrame, unit: list[str], fn: Callable, schema: str) -> DataFrame:
    """fn(left arrays, right arrays, unit values) -> record batch, for every two blocks of the same unit."""
    key = ["all_"] if not unit else unit
    pairs = paired(left, right, unit).select(*key, "left_", "right_")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (arrays(batch.column(batch.schema.get_field_index(c)), i) for c in ("left_", "right_"))
                yield fn(a, b, {k: batch.column(batch.schema.get_field_index(k))[i].as_py() for k in key})

    return pairs.mapInArrow(run, schema)


class Stored:
    """Rows dealt to blocks by a key's hash, each block a folder that the tasks read by its number: however many blocks it meets, it is written once."""

    def __init__(self, path: str, count: int):
        self.path, self.count = path, count

    def read(self, k: int) -> pa.Table | None:
        """The rows of block k, None if it has none."""
        return _block(self.path, k)


@lru_cache(2)
def _block(path: str, k: int) -> pa.Table:
    store, root = fs.FileSystem.from_uri(path)
    at = f"{root}/block_={k}"
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return None
    return pa.concat_tables(pq.ParquetFile(store.open_input_file(x.path)).read() for x in store.get_file_info(fs.FileSelector(at)) if x.path.endswith(".parquet"))


def stored(df: DataFrame, key: str, size: int, least: int = 1, units: int | None = None) -> Stored:
    """df in blocks of about `size` rows and `units` keys at most, `least` blocks or more; the rows of a key are in one block."""
    found = df.agg(F.count(F.lit(1)).alias("n"), (F.approx_count_distinct(key) if units else F.lit(0)).alias("m")).first()
    count = max(1, least, math.ceil(found["n"] / size), math.ceil(found["m"] / units) if units else 1)
    path = f"{folder(df.sparkSession)}/blocks-{uuid.uuid4().hex}"
    dealt = df.withColumn("block_", F.pmod(F.xxhash64(key), F.lit(count)).cast("int"))
    dealt.repartition("block_").write.partitionBy("block_").option("compression", "zstd").parquet(path)
    return Stored(path, count)


def columns(table: pa.Table) -> dict[str, np.ndarray]:
    """A block's columns as arrays; lists of equal length become a matrix."""
    return arrays(pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.combine_chunks().to_struct_array().combine_chunks()), 0)


def every_two(left: Stored, right: Stored, spark: SparkSession) -> DataFrame:
    """(l_, r_): the numbers of every two blocks, in tasks of few pairs each."""
    pairs = left.count * right.count
    rows = spark.range(0, pairs, 1, max(1, min(pairs, 16 * spark.sparkContext.defaultParallelism, 4096)))
    return rows.select((F.col("id") / right.count).cast("int").alias("l_"), (F.col("id") % right.count).cast("int").alias("r_"))
