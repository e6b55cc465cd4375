"""Full-text index: postings of English stems, in folders by a hash of the stem, appended batch by batch.

A posting is (lexeme, chunk_id, n) with the columns of a chunk that searches filter by. Postings of a batch lie in ``buckets`` folders by
crc32 of their lexeme, sorted by lexeme in each file: a search reads the folders of its lexemes (partition pruning) and the row
groups that may hold them (pushed filters), not the texts. Stopwords have no postings, as no question asks for them.

Scale: words are counted within a chunk's row, without a shuffle, and written once; a build shuffles each distinct word of a chunk to meet its stem,
which is made once for a word of the batch, and its postings twice. There are as many partitions as ``ROWS`` of them need, so that a task's memory
does not grow with the batch. A frequent lexeme is split over files by size (rebalance), and a search
sums map-side before it shuffles. A search for k lexemes reads k of ``buckets`` folders of each batch.

Defined cases: a batch that is written again replaces itself; null and empty texts have no postings; a chunk_id that is there
twice is one chunk; a question without lexemes finds nothing.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import with_stem
from ..functions.text import STOPWORDS, query_tokens
from ..sources.shared import stored
from ..sources.sinks import paths
from .retrieval import CANDIDATES, PI2_6, fuse, ranked

BUCKETS, ROWS = 64, 1 << 20


def postings(chunks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(lexeme, chunk_id, n, kept columns): how often a chunk (chunk_id, content) has words of a stem."""
    spark = chunks.sparkSession
    words = F.sort_array(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]+"), F.lit(0)))
    rows = chunks.select("chunk_id", *keep, words.alias("words"))
    starts = F.array_compact(F.transform("words", lambda w, i: F.when((i == 0) | (w != F.get("words", i - 1)), i)))  # where another word begins
    one = lambda s, k: F.struct(F.get("words", s).alias("word"), (F.coalesce(F.get("starts", k + 1), F.size("words")) - s).cast("long").alias("n"))
    each = rows.withColumn("starts", starts).select("chunk_id", *keep, F.explode(F.transform("starts", one)).alias("x"))
    counted = stored(each.select("chunk_id", *keep, "x.word", "x.n").filter(~F.col("word").isin(STOPWORDS)), "words")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, counted.count() // ROWS + 1)
    stems = with_stem(counted.select("word").distinct().repartition(parts, "word"))  # by number: a stem costs far more than a row of a join
    met = counted.repartition(parts, "word").join(stems, "word").select("lexeme", "chunk_id", *keep, "n")
    return met.repartition(parts, "lexeme", "chunk_id").groupBy("lexeme", "chunk_id", *keep).agg(F.sum("n").alias("n"))


def lexemes(spark: SparkSession, question: str) -> list[str]:
    """Stems of a question's content words, each once."""
    words = spark.range(1).select(F.explode(query_tokens(F.lit(question))).alias("word"))
    return sorted({r["lexeme"] for r in with_stem(words).collect()})


class FullTextIndex:
    """An index at a path; one that is there is opened with its number of buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, keep: tuple[str, ...] = ()):
        self.spark, self.keep = spark, keep
        found = [int(n[3:]) for n in paths(spark, path) if n.startswith("of=")]
        self.buckets = found[0] if found else buckets
        self.path = f"{path}/of={self.buckets}"

    def add(self, chunks: DataFrame, batch: str) -> None:
        """Append the postings of a batch of chunks (chunk_id, content, kept columns)."""
        rows = postings(chunks, self.keep).withColumn("bucket", (F.crc32(F.encode("lexeme", "UTF-8")) % self.buckets).cast("int"))
        rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "lexeme", "chunk_id")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch}")
        self.spark.catalog.refreshByPath(self.path)

    def read(self, words: list[str]) -> DataFrame:
        """The postings of these lexemes."""
        own = sorted({zlib.crc32(w.encode()) % self.buckets for w in words})
        return self.spark.read.parquet(self.path).filter(F.col("bucket").isin(own) & F.col("lexeme").isin(words))

    def search(self, words: list[str], n: int = CANDIDATES, where: str = "true") -> DataFrame:
        """(chunk_id, score, rank): the n chunks that rank highest for these lexemes; where is a condition on the kept columns.

        A chunk's score is the sum over lexemes of 0.1 * sum(1 / j^2), j up to its count, scaled as ``text_rank``.
        """
        if not words:
            return self.spark.read.parquet(self.path).select("chunk_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
        one = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("n")), F.lit(0.0), lambda s, j: s + F.lit(0.1) / (j * j))
        score = F.round(F.sum(one) / F.lit(PI2_6) / F.lit(float(len(words))), 9).alias("score")
        return ranked(self.read(words).filter(where).groupBy("chunk_id").agg(score), [F.desc("score"), F.col("chunk_id")], n)

    def hybrid(self, nearest: DataFrame, question: str, k: int, where: str = "true") -> DataFrame:
        """(chunk_id, score): the words of a question fused with a ranked list of nearest chunks."""
        return fuse([nearest, self.search(lexemes(self.spark, question), where=where)], k)
