"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset a local session gets a temporary folder, and a cluster an error."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    _own = _own or tempfile.mkdtemp(prefix="foliomill-")
    return _own


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: what reads it twice computes it once, and a lost executor costs no more than its tasks."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
