"""Benchmark decontamination: MinHash containment search in DataFrame functions only.

Words are runs of letters and digits, lower-cased; an item and a document are sets of 5-word shingles, and
an item is found in a document that holds at least 80 % of its shingles. Items are partitioned by size
(powers of two of their shingle count). Each partition samples from its items the bottom-k shingle hashes (their
MinHash sketch): k is one more than the shingles that a match may lack in the partition's largest item, which
makes the search exact, up to ``SAMPLES``, where a match is missed with probability 0.2 ** SAMPLES.
A document that holds a sampled hash is a candidate, if it has as many shingles as a match of that item needs; candidates
are verified on the shingles themselves. Items with fewer than 5 words are searched with shingles of all their words.

The documents' hashes are joined with the sampled ones: by a broadcast of these for up to ``FEW`` items (``FEW * SAMPLES``
hashes), by a shuffle for more. Items are broadcast only if they are few and their shingles take ``FEW_BYTES`` at most. Pairs are a written table of ids, joined with the texts of candidates only.

Defined cases: null counts as empty text; texts without a word match nothing, as do items without one; rows
with equal doc_id are one document if any of them matches; equal item_ids likewise; rows with a null id are
ignored; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

SHINGLE = 5
PERCENT = 80
SAMPLES = 16
FEW = 2000
FEW_BYTES = 16 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _places(w: Column, k: int) -> Column:
    return F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))


def hashes(w: Column, k: int) -> Column:
    return F.transform(_places(w, k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def shingles(w: Column, k: int) -> Column:
    return F.array_distinct(F.transform(_places(w, k), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)])))


def _candidates(docs: DataFrame, items: DataFrame, k: int, percent: int, few: int, samples: int) -> DataFrame:
    """(doc_id, item_id) of documents that hold a sampled hash of an item."""
    lack = lambda n: F.floor((100 - percent) * n / 100)
    size = F.floor(F.log2(F.col("n")))
    need = (F.col("n") - lack(F.col("n"))).alias("need")
    sampled = items.select("item_id", need, F.least(F.lit(samples), lack(F.pow(F.lit(2), size + 1) - 1) + 1).cast("int").alias("k"), F.sort_array(F.array_distinct("hashes")).alias("hashes"))
    sampled = sampled.select("item_id", "need", F.explode(F.slice("hashes", F.lit(1), F.col("k"))).alias("hash"))
    wide = docs.withColumn("places", F.size("words") - (k - 1)).filter("places > 0")
    side = F.arrays_zip(*[F.slice("words", F.lit(j + 1), F.col("places")).alias(f"w{j}") for j in range(k)])
    met = wide.select("doc_id", "places", F.explode(side).alias("s")).select("doc_id", "places", F.xxhash64(*[f"s.w{j}" for j in range(k)]).alias("hash"))
    if items.limit(few + 1).count() <= few:  # at most few * samples hashes
        sampled = F.broadcast(sampled)
    return met.join(sampled, "hash").filter("places >= need").select("doc_id", "item_id").distinct()


def _small(items: DataFrame, few: int) -> bool:
    """Whether the items and their shingles are few enough to broadcast."""
    size = F.aggregate("own", F.lit(0).cast("long"), lambda total, s: total + F.octet_length(s) + 16)
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return total["n"] <= few and total["bytes"] <= FEW_BYTES


def find_items(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, percent: int = PERCENT, few: int = FEW, samples: int = SAMPLES) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_found and containment of every match; with samples of a fifth of the largest item's shingles the search is exact for all."""
    ws = Workspace(spark, "decontaminate")
    texts = docs.filter("doc_id is not null").select("doc_id", words(F.col("text")).alias("words"))
    items = benchmark.filter("item_id is not null").select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = ws.write(items.withColumn("k", F.least(F.lit(k), F.size("words"))), "items")
    found = []
    for n in sorted(r["k"] for r in items.select("k").distinct().collect()):  # 1 to k
        own = items.filter(F.col("k") == n).select("item_id", shingles(F.col("words"), n).alias("own"), hashes(F.col("words"), n).alias("hashes")).withColumn("n", F.size("own"))
        pairs = ws.write(_candidates(texts, own, n, percent, few, samples), f"pairs{n}")
        few_items = own.select("item_id", "own", "n")
        both = texts.join(pairs, "doc_id").join(F.broadcast(few_items) if _small(few_items, few) else few_items, "item_id")
        common = F.size(F.array_intersect(shingles(F.col("words"), n), F.col("own")))
        found.append(both.select("doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), common.cast("long").alias("n_found")))
    if not found:
        return docs.select("doc_id").limit(0).selectExpr("doc_id", "cast(null as bigint) item_id", "0L n_shingles", "0L n_found", "0D containment")
    rows = functools.reduce(DataFrame.unionAll, found).filter(F.col("n_found") * 100 >= F.col("n_shingles") * percent)
    rows = rows.withColumn("containment", F.col("n_found") / F.col("n_shingles"))
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_found", "n_shingles")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shingles", "best.n_found", "best.containment")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql() -> str:
    split = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    grams = lambda t, k, when: f"SELECT DISTINCT id, {k} AS k, array_to_string(w[p : p + {k - 1}], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - {k - 2})) AS p FROM {t} WHERE {when})"
    ds = " UNION ALL ".join(grams("d", k, f"len(w) >= {k} AND {k} IN (SELECT least({SHINGLE}, len(w)) FROM i)") for k in range(1, SHINGLE + 1))
    si = " UNION ALL ".join(grams("i", k, f"least({SHINGLE}, len(w)) = {k}") for k in range(1, SHINGLE + 1))
    return f"""
WITH d AS (SELECT doc_id AS id, {split} AS w FROM documents), i AS (SELECT item_id AS id, {split} AS w FROM benchmark),
ds AS ({ds}), si AS ({si}), n AS (SELECT id, count(*) AS n_shingles FROM si GROUP BY 1),
m AS (SELECT ds.id AS doc_id, si.id AS item_id, count(*) AS n_found FROM ds JOIN si USING (k, s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_found, n_found::DOUBLE / n_shingles AS containment
FROM m JOIN n ON n.id = item_id WHERE n_found * 100 >= n_shingles * {PERCENT}
"""


OP9_SQL = _sql()
