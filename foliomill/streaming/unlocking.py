"""Stateful unlocking: a parent's target is emitted when the last of its children has arrived.

Children come as a stream (parent, child, expected), in any order, in any batches, perhaps twice. The state of a parent holds the children that it
has; when there are as many as expected, the parent is emitted, once, and its children are forgotten. State lives in RocksDB under the
checkpoint, so that a query that is started again goes on where it stopped. Parents are independent keys: a book's arcs are spread over all
partitions, and a state is as large as one parent's children.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UNLOCKED = StructType([StructField("parent", StringType()), StructField("children", LongType())])


class Unlock(StatefulProcessor):
    """Of one parent: the children that are there, their number, and whether it was emitted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.there = handle.getMapState("there", StructType([StructField("child", StringType())]), StructType([StructField("is", BooleanType())]))
        self.sums = handle.getValueState("sums", StructType([StructField("n", LongType()), StructField("done", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, done = self.sums.get() if self.sums.exists() else (0, False)
        if done:
            return
        for part in rows:
            for child, expected in zip(part["child"].tolist(), part["expected"].tolist(), strict=True):
                if done or self.there.containsKey((child,)):
                    continue
                self.there.updateValue((child,), (True,))
                n += 1
                if n >= expected:
                    done = True
                    yield pd.DataFrame({"parent": [key[0]], "children": [n]})
        if done:
            self.there.clear()
        self.sums.update((n, done))

    def close(self) -> None:
        pass


def unlock(children: DataFrame) -> DataFrame:
    """(parent, children) of each parent of a stream (parent string, child string, expected long) as it becomes whole; rows with a null are left out."""
    if children.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {PROVIDER}")
    rows = children.selectExpr("cast(parent as string) parent", "cast(child as string) child", "cast(expected as bigint) expected").dropna()
    return rows.groupBy("parent").transformWithStateInPandas(statefulProcessor=Unlock(), outputStructType=UNLOCKED, outputMode="append", timeMode="none")


def unlock_available(spark: SparkSession, source: str, targets: DataFrame, sink: str, checkpoint: str) -> None:
    """Process what is new under source, Parquet of (child); targets are (child, parent, expected). Unlocked parents are appended to sink."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    children = spark.readStream.schema("child string").parquet(source).join(targets, "child")
    out = unlock(children).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    out.trigger(availableNow=True).start().awaitTermination()
