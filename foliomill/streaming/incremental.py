"""Resumable processing: a stream of chapters into a keyed sink, each key once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_available(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str, step: Callable[[DataFrame], DataFrame]) -> None:
    """Process what is new under source; rows whose key the sink holds are skipped, and keys without output leave a mark.

    A batch that failed, or whose commit was lost, is run again and replaces its own rows and marks.
    """

    def batch(rows: DataFrame, number: int) -> None:
        s = rows.sparkSession
        marks = f"{sink}/marks"
        try:
            done = s.read.parquet(marks)
        except Exception as e:  # no mark yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = rows.select(key).limit(0).withColumn("batch", F.lit(-1))
        earlier = done.filter(F.col("batch") != number).select(key)  # a batch that is run again must find its own keys new
        new = rows.join(earlier, key, "left_anti")
        step(new).write.mode("overwrite").parquet(f"{sink}/rows/batch={number}")
        new.select(key).distinct().write.mode("overwrite").parquet(f"{marks}/batch={number}")  # last: marks say that the rows are there

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def coverage(done: DataFrame, all_keys: DataFrame, key: str) -> DataFrame:
    """Keys in all, keys done."""
    d = done.select(key).distinct().withColumn("d", F.lit(1))
    return all_keys.select(key).distinct().join(d, key, "left").agg(F.count("*").alias("total"), F.count("d").alias("done"))
