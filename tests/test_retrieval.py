"""Vectors without a direction, of other sizes, and queries that repeat."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliomill.functions import models
from foliomill.operators import retrieval

VECTORS = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [-1.0, 0.0]), (9, [])]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, v, "b", i, "a word") for i, v in VECTORS], "chunk_id long, embedding array<double>, book_id string, chapter_num long, content string")


WANT = [(1, 0.0, 1), (3, round(1 - 1 / math.sqrt(2), 6), 2), (8, 2.0, 3)]


def test_dense(rows):
    assert [tuple(r) for r in retrieval.dense(rows, [1.0, 0.0]).collect()] == WANT
    assert retrieval.dense(rows, [0.0, 0.0]).count() == retrieval.dense(rows, []).count() == retrieval.dense(rows, [1.0, 2.0, 3.0]).count() == 0


@pytest.mark.parametrize("block", [1, None])
def test_batched(spark, rows, block):
    """The same rows as one by one, for every size of blocks."""
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "query_id long, query array<double>")
    got = {}
    for r in retrieval.batched_dense(rows, q, block=block).collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["distance"], r["rank"]))
    assert {k: sorted(v, key=lambda x: x[2]) for k, v in got.items()} == {1: WANT, 3: [tuple(r) for r in retrieval.dense(rows, [0.0, 1.0]).collect()]}
    assert retrieval.batched_dense(rows, q.limit(0)).count() == 0


def test_tiles(spark, monkeypatch):
    """More rows and queries than a tile, with ties, give what one at a time gives."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(retrieval, "TILE", 7)
    v = rng.integers(-2, 3, (200, 3)).astype(float)
    at, unit = retrieval.units(pa.array(v.tolist()), 3)
    found = [b.to_pylist() for b in retrieval.nearest(at, unit, at[:30], unit[:30], 4)]
    got = {}
    for r in sum(found, []):
        got.setdefault(r["query_id"], []).append((r["distance"], r["chunk_id"]))
    for q in range(30):
        far = np.round(1 - unit @ unit[q], 6) + 0.0
        assert sorted(got[at[q]])[:4] == sorted(zip(far.tolist(), at.tolist(), strict=True))[:4]


def test_bad_queries(spark, rows):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id long, query array<double>")
    with pytest.raises(ValueError, match="id of its own"):
        retrieval.batched_dense(rows, q)
    with pytest.raises(ValueError, match="dimensions"):
        retrieval.batched_dense(rows, spark.createDataFrame([(1, [1.0]), (2, [0.0, 1.0])], "query_id long, query array<double>"))


def test_search_book_with_empty_texts(spark):
    """An empty text has a zero vector, which is found by words only."""
    c = spark.createDataFrame([(1, "b", 1, "the fool met a king"), (2, "b", 2, ""), (3, "b", 3, None)], "chunk_id long, book_id string, chapter_num long, content string")
    c = c.withColumn("embedding", models.embed(F.col("content")))
    assert [r["chunk_id"] for r in retrieval.search_book(c, "fool and king", ["b"], {"b": 9}).collect()] == [1]
