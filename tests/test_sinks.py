"""Sinks on keys of all kinds, in place, tried again and cut off."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from foliomill.sources import readers, sinks


def files(path):
    return [p for p in path.rglob("part-*")]


def test_refresh_keys(spark, tmp_path):
    """"007", "", null and dates stay what they are, and are replaced one by one."""
    at = str(tmp_path / "t")
    rows = spark.createDataFrame([("007", 1), ("7", 2), ("", 3), (None, 4), ("2020-01-01", 5), ("a/b=c %", 6)], "k string, n long")
    assert sinks.refresh(rows, at, "k") == 6
    assert sinks.refresh(spark.createDataFrame([("", 30), (None, 40), (None, 41)], "k string, n long"), at, "k") == 3
    got = sinks.refreshed(spark, at, "k")
    assert got.schema["k"].dataType.simpleString() == "string"
    assert {(r["k"], r["n"]) for r in got.collect()} == {("007", 1), ("7", 2), ("", 30), (None, 40), (None, 41), ("2020-01-01", 5), ("a/b=c %", 6)}
    days = spark.createDataFrame([(datetime.date(2020, 1, d), d) for d in (1, 2)], "day date, n int")
    assert sinks.refresh(days, str(tmp_path / "d"), "day") == 2
    assert sinks.refreshed(spark, str(tmp_path / "d"), "day").filter("day = date'2020-01-02'").first()["n"] == 2
    assert sinks.refresh(rows.limit(0), at, "k") == 0 and sinks.refreshed(spark, at, "k").count() == 7


def test_refresh_reads_itself(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.refresh(spark.range(100).selectExpr("id % 50 k", "id n").repartition(8), at, "k")
    assert len(files(tmp_path / "t")) <= 60  # few files a key, not one for each task
    own = sinks.refreshed(spark, at, "k").filter("k < 5").withColumn("n", F.col("n") + 1000)
    assert sinks.refresh(own, at, "k") == 10
    assert sinks.refreshed(spark, at, "k").agg(F.sum("n")).first()[0] == sum(range(100)) + 10 * 1000
    assert [p.name for p in tmp_path.iterdir()] == ["t"]  # no stage is left


def test_refresh_failing(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.refresh(spark.range(10).selectExpr("id % 2 k", "id n"), at, "k")
    bad = spark.range(10).selectExpr("id % 2 k", "if(id = 7, raise_error('no'), id) n")
    with pytest.raises(Exception, match="no"):
        sinks.refresh(bad, at, "k")
    assert sinks.refreshed(spark, at, "k").count() == 10 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_jsonl_in_place(spark, tmp_path):
    """A patch of a file into itself, twice; the backup is what was there before."""
    at = str(tmp_path / "j")
    assert sinks.write_jsonl(spark.range(5).selectExpr("id", "cast(null as string) note"), at) == 5
    for step in (1, 2):
        own = spark.read.schema("id long, note string").json(at)
        assert sinks.write_jsonl(own.withColumn("note", F.lit(f"step {step}")), at) == 5
        assert {r["note"] for r in spark.read.json(at).collect()} == {f"step {step}"}
    assert {r["note"] for r in spark.read.json(f"{at}.bak").collect()} == {"step 1"}
    assert sinks.write_jsonl(spark.read.json(at).limit(2), at, backup=False) == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["j", "j.bak"] and spark.read.json(f"{at}.bak").count() == 5


def test_jsonl_failing(spark, tmp_path):
    """A write that fails, and fails again, changes neither the data nor its backup."""
    at = str(tmp_path / "j")
    sinks.write_jsonl(spark.range(3), at)
    sinks.write_jsonl(spark.range(5), at)
    bad = spark.read.json(at).selectExpr("if(id = 3, raise_error('no'), id) id")
    for _ in range(2):
        with pytest.raises(Exception, match="no"):
            sinks.write_jsonl(bad, at)
        assert spark.read.json(at).count() == 5 and spark.read.json(f"{at}.bak").count() == 3
    assert sorted(p.name for p in tmp_path.iterdir()) == ["j", "j.bak"]


def test_jsonl_cut_off(spark, tmp_path):
    """The driver is lost between the renames: the next reader or writer has the old data back."""
    at = tmp_path / "j"
    sinks.write_jsonl(spark.range(5), str(at))
    at.rename(tmp_path / "j.bak")
    assert sinks.restore(spark, str(at)) and not sinks.restore(spark, str(at))
    assert spark.read.json(str(at)).count() == 5
    at.rename(tmp_path / "j.bak")
    assert sinks.write_jsonl(spark.range(2), str(at)) == 2 and spark.read.json(f"{at}.bak").count() == 5


def test_document_changes(spark, tmp_path):
    at = tmp_path / "d.json"
    at.write_text('[{"a": 1}]')
    assert readers.read_document(spark, str(at), "a int").first()["a"] == 1
    at.write_text('[{"a": 2}]')
    os.utime(at, (2_000_000_000, 2_000_000_000))
    assert readers.read_document(spark, str(at), "a int").first()["a"] == 2
    readers._documents[("another session", str(at), "a int")] = readers._documents.popitem()[1]
    assert readers.read_document(spark, str(at), "a int").first()["a"] == 2 and len(readers._documents) == 1
    readers.reset_documents()
