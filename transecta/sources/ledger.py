"""Runs in shards that can be stopped and started again: what is committed is not computed anew, and a retry replaces."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import latest, shard_audit


class Run:
    """A plan of shards (label, replicate) whose results and ledger lie below a path that driver and executors share.

    Each batch of shards is written to a folder of its own first; its shards count once their rows are in the
    ledger, a small table to which every commit adds a file at once. What a run that was killed left without
    a row there is never read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def ledger(self) -> DataFrame:
        """(label, replicate, attempt, folder): the last commit of each shard."""
        kind = "label string, replicate long, attempt long, folder string"
        rows = self.spark.read.schema(kind).parquet(f"{self.path}/ledger") if self._there("ledger") else self.spark.createDataFrame([], kind)
        return latest(rows, ["label", "replicate"], "attempt")

    def lacking(self, plan: DataFrame) -> DataFrame:
        """The shards of plan(label, replicate) that no commit has."""
        return plan.select("label", "replicate").distinct().join(self.ledger(), ["label", "replicate"], "left_anti")

    def commit(self, shards: DataFrame, results: DataFrame) -> None:
        """Write results(label, replicate, more) of the shards and then their rows in the ledger, which replace earlier ones."""
        attempt = (self.ledger().agg(F.max("attempt")).first()[0] or 0) + 1
        folder = f"{attempt:06d}-{uuid.uuid4().hex}"
        results.write.mode("errorifexists").parquet(f"{self.path}/results/{folder}")
        rows = shards.select(F.col("label").cast("string").alias("label"), F.col("replicate").cast("long").alias("replicate"), F.lit(attempt).cast("long").alias("attempt"), F.lit(folder).alias("folder"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")  # one file: all rows or none

    def results(self) -> DataFrame:
        """The committed results: of each shard those of its last commit."""
        if not self._there("results"):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(f"{self.path}/results")
        names = [c for c in rows.columns]
        rows = rows.withColumn("folder", F.element_at(F.split("_metadata.file_path", "/"), -2))
        return rows.join(self.ledger().select("label", "replicate", "folder"), ["label", "replicate", "folder"]).select(names)

    def resume(self, plan: DataFrame, compute: Callable[[DataFrame], DataFrame], batch: int) -> int:
        """Commit what plan lacks, `batch` shards about at a time, by compute(shards) -> results; how many batches that took.

        compute must give each shard the same results whatever shards come with it.
        """
        done, last = 0, None
        while True:
            left = self.lacking(plan)
            n = left.count()
            if not n:
                return done
            if n == last:
                raise RuntimeError("a batch committed nothing")
            last, shards = n, left.orderBy("label", "replicate").limit(batch).cache()
            self.commit(shards, compute(shards))
            shards.unpersist()
            done += 1

    def audit(self, expected: int) -> DataFrame:
        """(label, found, duplicates, complete) of the committed shards."""
        return shard_audit(self.ledger(), "label", "replicate", expected)
