"""Records that arrive as a stream: units of each batch are scored again with all their records.

Nothing here keeps state of its own. A batch is appended to a table, and the units it touches are
read back whole, so a batch that is replayed after a failure gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rescore(stream: DataFrame, store: str, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Start a query that appends each batch to store and writes score(all records of the touched units) to sink/batch=n."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")
        spark = rows.sparkSession
        touched = rows.select("unit").distinct()
        whole = spark.read.option("basePath", store).parquet(f"{store}/batch=*").where(F.col("batch") <= number).drop("batch")
        score(whole.join(touched, "unit", "left_semi")).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
