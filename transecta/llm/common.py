"""Shared plumbing: table access, Arrow batch helpers and intermediate tables.

Conventions that hold for every operator of this package unless its docstring says otherwise:

* a null text is an empty text, a null id counts as the empty string where the id is hashed;
* repeated rows are kept and each gets its own result row;
* only the columns an operator needs are read, so further columns with any name do no harm;
* an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import sys
import uuid
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: Text bytes that Python code handles at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_last_module = ""


def entered(module: str) -> None:
    """Let go of what the operator that ran before in this worker remembers, by its module's forget()."""
    global _last_module
    if _last_module not in ("", module):
        getattr(sys.modules[_last_module], "forget", lambda: None)()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries
            ctypes.CDLL(None).malloc_trim(0)
    _last_module = module


def on_workers(fn: Callable, *args) -> Callable:
    """fn(batches, *args) as a function that executors can run even where this package is not on their path.

    fn must be a module-level function; it is looked up by name on the executor, so that a
    worker's module-level caches live as long as the worker.
    """
    module, name, root, packed = fn.__module__, fn.__qualname__, ROOT, pickle.dumps(args)

    def run(batches):
        import importlib
        import pickle
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        found = importlib.import_module(module)
        importlib.import_module("transecta.llm.common").entered(module)
        yield from getattr(found, name)(batches, *pickle.loads(packed))

    return run


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts come to about `most` bytes; a longer text is a run of its own."""
    sizes = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(sizes), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def fold(doc_id, parts: int) -> int:
    """crc32 of the id as text, modulo parts; a null id is the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def fold_column(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local default only where that is unset and all run on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "file:///tmp/checkpoints/transecta").rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder, which purge() deletes."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: computed once, and lost executors don't repeat it."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that written() returned; to be called when nothing reads it any more."""
    spark = df.sparkSession
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if folder.split("://")[-1].lstrip("/").startswith(run_dir(spark).split("://")[-1].lstrip("/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def purge(spark: SparkSession) -> None:
    """Delete the tables and shards that this application has left in the shared folder; to be called when its results have been read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: int) -> DataFrame:
    """At most `most` rows (doc_id, text, label) of docs to learn from, chosen by a hash of the id.

    Rows whose fold is `held` are never among them. The chosen labels are at most `most`
    small rows, which is the proven bound of the broadcast; a second copy of a doc_id in
    labels, or a null label, is ignored. Of several rows of docs with one doc_id the least text is taken.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("k"), F.col(label).cast("int").alias("label"))
        .where(F.col("k").isNotNull() & F.col("label").isNotNull() & (fold_column(F.col("k"), parts) != held))
        .groupBy("k").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("k"), "k").limit(most)
    )
    rows = docs.select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return found.select(F.col("k").alias("doc_id"), "text", "label")
