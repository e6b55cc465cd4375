"""The full-text and the vector index: pruned reads, batches, and the scan or the exact search as the measure."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill.operators import fulltext, retrieval, vectors

CHUNKS = [(1, "The nations nation; a NATIONAL anthem", 1), (2, "licensed tokens", 2), (3, None, 3), (4, "", 4), (5, "license licenses a license", 5), (6, "nothing here", 6), (7, "tokens, tokens and a nation", 7)]


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id long, content string, chapter_num long")


def test_batches(spark, chunks, tmp_path):
    """Batches give what one gives; one that is written again replaces itself; an index that is there is opened."""
    one = fulltext.FullTextIndex(spark, str(tmp_path / "one"), buckets=4, keep=("chapter_num",))
    one.add(chunks, "all")
    two = fulltext.FullTextIndex(spark, str(tmp_path / "two"), buckets=4, keep=("chapter_num",))
    for _ in range(2):
        for b in (0, 1):
            two.add(chunks.filter(f"chunk_id % 2 = {b}"), str(b))
    two = fulltext.FullTextIndex(spark, str(tmp_path / "two"), buckets=99, keep=("chapter_num",))
    assert two.buckets == 4
    words = fulltext.lexemes(spark, "Which nation has the licenses of a token?")
    assert words == ["licens", "nation", "token"]
    rows = one.search(words).collect()
    assert rows == two.search(words).collect() and [r["chunk_id"] for r in rows] == [7, 2, 1, 5]
    assert [r["chunk_id"] for r in two.search(words, n=1, where="chapter_num < 6").collect()] == [2]
    assert two.search([]).count() == two.search(["absent"]).count() == 0
    assert [r["chunk_id"] for r in two.hybrid(one.search(["nation"]).select("chunk_id", "rank"), "tokens", 2).collect()] == [7, 1]


def test_reads_only_its_postings(spark, chunks, tmp_path):
    index = fulltext.FullTextIndex(spark, str(tmp_path / "i"), buckets=16)
    index.add(chunks, "0")
    p = plan(index.search(["nation"]))
    assert "EqualTo(lexeme,nation)" in p and "PartitionFilters: [isnotnull(bucket" in p
    files = {r[0] for r in index.read(["nation"]).select(F.input_file_name()).collect()}
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1 < len(spark.read.parquet(index.path).inputFiles())


def test_equals_the_scan(spark, tmp_path):
    """For words that are their own only forms the index ranks as the scan does."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    index = fulltext.FullTextIndex(spark, str(tmp_path / "i"))
    index.add(d, "0")
    own = fulltext.postings(d).groupBy("lexeme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lexeme").limit(40).select("lexeme")
    forms = d.select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word")).distinct()
    alone = fulltext.with_stem(forms).groupBy("lexeme").agg(F.count("*").alias("forms"), F.min("word").alias("word")).filter("forms = 1 and word = lexeme")
    words = [r["lexeme"] for r in own.join(alone, "lexeme").orderBy("lexeme").limit(3).collect()]
    assert len(words) == 3 and index.search(words).collect() == retrieval.sparse(d, words).collect()


def vector_rows(spark, n, clusters):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(clusters, 16)) * 4
    v = middle[rng.integers(0, clusters, n)] + rng.normal(size=(n, 16))
    odd = [(n, [0.0] * 16), (n + 1, [1.0]), (n + 2, None), (n + 3, [float("nan")] * 16)]
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + odd, "chunk_id long, embedding array<double>")


def test_vector_index(spark, tmp_path):
    """Every row is in it; with clusters a few cells find nine of ten, and all cells find what the exact search finds."""
    rows = vector_rows(spark, 3000, 40)
    index = vectors.VectorIndex.build(rows, str(tmp_path / "v"), sample=1000)
    stored = spark.read.parquet(str(tmp_path / "v" / "rows"))
    assert stored.count() == 3003 and stored.filter("cell = -1").count() == 3
    assert 1 <= index.probes < len(index.middle) / 4
    queries = rows.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    found = index.recall(rows, queries).agg(F.sum("found"), F.sum("wanted")).first()
    assert found[0] >= 0.9 * found[1] and found[1] == 60 * 20
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(index.batched(queries, probes=vectors.ALL)) == key(retrieval.batched_dense(rows, queries))
    q = rows.filter("chunk_id = 7").first()["embedding"]
    again = vectors.VectorIndex(spark, str(tmp_path / "v"))
    assert key(again.search(q, probes=vectors.ALL)) == key(retrieval.dense(rows, q))
    assert "PartitionFilters: [isnotnull(cell" in plan(again.search(q)) or "PartitionFilters: [cell" in plan(again.search(q))
    assert again.search([0.0] * 16).count() == again.search([1.0]).count() == 0
    assert again.batched(queries.limit(0)).count() == 0


def test_vector_index_of_nothing(spark, tmp_path):
    rows = vector_rows(spark, 0, 1)
    for name, d in (("none", rows.limit(0)), ("odd", rows)):
        index = vectors.VectorIndex.build(d, str(tmp_path / name))
        assert index.search([1.0] * len(index.middle[0])).count() == 0


def test_postings_by_size(spark, monkeypatch):
    """More words mean more partitions, not larger ones; a chunk that is there twice is one."""
    rows = [(i % 40, f"Reading reads w{i} w{i} the x") for i in range(60)] + [(90, None), (91, "")]
    c = spark.createDataFrame(rows, "chunk_id long, content string")
    monkeypatch.setattr(fulltext, "ROWS", 2)
    got = fulltext.postings(c)
    assert got.rdd.getNumPartitions() == 60 * 4 // 2 + 1
    found = {(r["lexeme"], r["chunk_id"]): r["n"] for r in got.collect()}
    assert len(found) == got.count() == 60 + 2 * 40 and found["read", 3] == 4 and found["read", 30] == 2 and found["w7", 7] == 2 and found["x", 3] == 2
