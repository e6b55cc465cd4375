"""Sinks: appends, refreshes by key, versions that are swapped, JSON lines with a backup, small documents."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MOST = 10_000


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def paths(spark: SparkSession, path: str) -> list[str]:
    """Names of what is at path; none if there is nothing."""
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def append(df: DataFrame, path: str) -> None:
    """Add rows; one write is committed as a whole or not at all."""
    df.write.mode("append").parquet(path)


def _part(key: str) -> Column:
    """The name of a key's folder: never empty, never taken for a number or a date; null has a folder of its own."""
    return F.concat(F.lit("is "), F.col(key).cast("string")).alias(f"{key}_part")


def refresh(df: DataFrame, path: str, key: str) -> int:
    """Replace all rows of each value of key that df has, leave the others; returns the number of rows.

    df, which may read the table itself, is evaluated once, into a folder beside the table, and its counts are checked against what the table
    holds afterwards. Keys may be of any type, "" and null are keys like others. Each key's rows go into few files: a large key is split by
    size (rebalance), not into a file for each task. ``refreshed`` reads the table.
    """
    spark = df.sparkSession
    stage = f"{path}.stage-{uuid.uuid4().hex}"
    part = f"{key}_part"
    try:
        df.select("*", _part(key)).hint("rebalance", part).write.partitionBy(part).parquet(stage)
        kind = df.schema.add(part, "string")
        staged = spark.read.schema(kind).parquet(stage)
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
        wanted = staged.groupBy(part).agg(F.count("*").alias("wanted"))
        found = spark.read.schema(kind).parquet(path).groupBy(part).agg(F.count("*").alias("found")).withColumnRenamed(part, "there")
        both = wanted.join(found, F.col(part).eqNullSafe(F.col("there")), "left")
        if bad := both.filter("found is null or found <> wanted").limit(1).collect():
            raise ValueError(f"{bad[0]['found']} of {bad[0]['wanted']} rows of {bad[0][part]} are there")
        return wanted.agg(F.coalesce(F.sum("wanted"), F.lit(0))).first()[0]
    finally:
        fs, p = _path(spark, stage)
        fs.delete(p, True)
        spark.catalog.refreshByPath(path)


def refreshed(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The table that refresh writes."""
    return spark.read.parquet(path).drop(f"{key}_part")


def write_batch(df: DataFrame, path: str, batch: str) -> None:
    """Write one batch (a chapter) whole; written again it replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def swap(df: DataFrame, path: str) -> int:
    """Write df, which may read the table at path, as its next version; readers see the old one until the new one is whole."""
    number = max(versions(df.sparkSession, path), default=-1) + 1
    df.write.mode("overwrite").parquet(f"{path}/version-{number}")
    return number


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a table that are whole."""
    return sorted(int(n[8:]) for n in paths(spark, path) if n.startswith("version-") and "_SUCCESS" in paths(spark, f"{path}/{n}"))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a table."""
    return spark.read.parquet(f"{path}/version-{versions(spark, path)[-1]}")


def restore(spark: SparkSession, path: str) -> bool:
    """Bring back what was at path if a swap was cut off between its two renames; true if there was something to bring back."""
    fs, p = _path(spark, path)
    old = _path(spark, f"{path}.bak")[1]
    return bool(not fs.exists(p) and fs.exists(old) and fs.rename(old, p))


def _renamed(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"{a} can't be renamed to {b}")


def write_jsonl(df: DataFrame, path: str, backup: bool = True) -> int:
    """JSON lines; what was at path is kept at path.bak. Returns the number of rows.

    df, which may read path, is written to a fresh folder first, and the lines there are counted against its rows. Only then
    the old data is renamed to path.bak and the new to path, so that a failed write, or one that is tried again, changes neither.
    The backup before goes last. If the driver is lost between the renames, the old data is at path.bak, and the next call (or restore) brings it back.
    """
    spark = df.sparkSession
    fs, p = _path(spark, path)
    restore(spark, path)
    mark = uuid.uuid4().hex
    fresh, old, older = (_path(spark, f"{path}{x}")[1] for x in (f".new-{mark}", ".bak", f".bak-{mark}"))
    seen = Observation()
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("ignoreNullFields", "false").json(str(fresh))
        n = spark.read.text(str(fresh)).count()
        if n != seen.get["n"]:
            raise ValueError(f"{n} of {seen.get['n']} rows were written")
        if fs.exists(p):
            if backup and fs.exists(old):
                _renamed(fs, old, older)
            _renamed(fs, p, old if backup else older)
        _renamed(fs, fresh, p)
        fs.delete(older, True)
    finally:
        fs.delete(fresh, True)
        spark.catalog.refreshByPath(path)
    return n


def pretty_json(df: DataFrame, most: int = MOST) -> str:
    """A small table as one indented document; more than most rows raise."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no document")
    return json.dumps([json.loads(r) for r in rows], indent=2, ensure_ascii=False) + "\n"


def cards(rows: DataFrame, title: Column, content: Column, gold: Column, predicted: Column) -> DataFrame:
    """A Markdown card for each row whose labels differ; gold and predicted are arrays of labels."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(F.array_sort(c), lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("_(none)_")
    named = lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(c), ", ")).otherwise("none")
    missing, extra = F.array_except(gold, predicted), F.array_except(predicted, gold)
    card = F.concat_ws("\n", F.concat(F.lit("## "), title), F.lit(""), F.lit("```"), F.trim(content), F.lit("```"), F.lit(""), F.lit("**Gold:**"), listed(gold), F.lit("**Predicted:**"), listed(predicted), F.concat(F.lit("Missing: "), named(missing)), F.concat(F.lit("Extra: "), named(extra)), F.lit(""), F.lit("---"))
    return rows.filter((F.size(missing) > 0) | (F.size(extra) > 0)).withColumn("card", card)
