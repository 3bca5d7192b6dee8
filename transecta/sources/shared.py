"""Tables in the folder that driver and executors share: results that are computed once and read often, whatever executors are lost."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's own part of the folder that spark.checkpoint.dir names; a local default only where that is unset and all run on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(found or 'file:///tmp/checkpoints/transecta').rstrip('/')}/{spark.sparkContext.applicationId}/analysis"


def kept(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_by(df: DataFrame, name: str, key: str, buckets: int, compression: str = "zstd") -> DataFrame:
    """df as a table bucketed by key in the shared folder: a join on the key with rows dealt to as many partitions doesn't move it."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("compression", compression).option("path", f"{folder(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def drop(spark: SparkSession) -> None:
    """Delete what this application has kept; to be called when its results have been read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
