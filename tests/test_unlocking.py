"""Children in any order unlock the parents that the planner would name next."""

import random

import pytest
from pyspark.sql import functions as F

from foliomill.operators import rollup
from foliomill.streaming import unlocking


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order(spark, tmp_path, seed):
    """Batches in any order, repeats, and a query that is started anew for each: a parent comes once, with the batch that brings its last child."""
    rng = random.Random(seed)
    parents = {f"arc {i}": [f"chapter {i}.{j}" for j in range(rng.randrange(1, 6))] for i in range(8)}
    targets = spark.createDataFrame([(c, p, len(cs)) for p, cs in parents.items() for c in cs], "child string, parent string, expected long")
    waiting = [c for cs in parents.values() for c in cs]
    rng.shuffle(waiting)
    source, sink, there, seen = tmp_path / "in", str(tmp_path / "out"), set(), set()
    source.mkdir()
    for number in range(3):
        batch = waiting[number * 7 : (number + 1) * 7 if number < 2 else None] + rng.sample(sorted(there), min(3, len(there)))
        spark.createDataFrame([(c,) for c in [*batch, *batch[:2]]], "child string").coalesce(2).write.mode("append").parquet(str(source))
        unlocking.unlock_available(spark, str(source), targets, sink, str(tmp_path / "checkpoint"))
        there |= set(batch)
        rows = [(r["parent"], r["children"]) for r in spark.read.parquet(sink).collect()]
        whole = {p for p, cs in parents.items() if set(cs) <= there}
        assert sorted(rows) == sorted((p, len(parents[p])) for p in whole)
        # the planner, asked about arcs whose chapters are all there, names the same as are new
        done = spark.createDataFrame([(p,) for p in seen], "key string")
        level = spark.createDataFrame([("arc", p) for p in whole], "level string, key string")
        assert {r["key"] for r in rollup.plan_next(level, done).collect()} == whole - seen
        seen = whole
    assert seen == set(parents)


def test_needs_its_store(spark):
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError, match="RocksDB"):
        unlocking.unlock(spark.readStream.format("rate").load().select(F.lit("p").alias("parent"), F.lit("c").alias("child"), F.lit(1).alias("expected")))
