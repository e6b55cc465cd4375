"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, each run of characters that aren't letters becomes one space, and n-grams of 1
to ``ORDERS`` characters are hashed to ``FEATURES`` counters. Counters of the training rows are summed
in Arrow functions and by Spark; the driver gets a matrix of languages by FEATURES, whose logarithms
are broadcast. Batches are scored in numpy: each n-gram fetches its row, and rows are summed by text.

Training takes at most about ``MAX_TRAIN`` labelled rows, chosen by a hash of doc_id, and of a rare language as many as there are up to ``LEAST``
besides; prediction takes every row, and priors are counted over all labelled ones. Languages are the distinct labels; the driver and
the executors hold FEATURES numbers for each, and more than ``LANGUAGES`` raise.

Defined cases: null text, empty text and text without a letter get ``und`` and score 0, as does every
text if there is nothing to learn from; ties go to the alphabetically first language; equal rows each
get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import release
from .workspace import carried, small_batches, struct

FEATURES = 1 << 15
ORDERS = 3
MAX_TRAIN = 40_000
LEAST = 500
LANGUAGES = 1000
BLOCK = 1 << 12
CHARS = 1 << 20
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, the text of each, and whether a text has a letter."""
    joined = np.frombuffer(("\n".join(texts) + "\n").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(joined) != sum(map(len, texts)) + len(texts):  # lower() can lengthen a text
        texts = [t.lower() for t in texts]
        joined = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    letter = _letters()[joined]
    has = np.bincount(doc, letter, len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run that aren't letters stands for it
    c, doc, letter = joined[keep], doc[keep], letter[keep]
    c = np.where(letter, c, 32).astype(np.uint32)
    grams, owners = [], []
    h = c * np.uint32(0x9E3779B1)
    for n in range(1, ORDERS + 1):
        if n > 1:
            if len(c) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n - 1 :] * np.uint32(0x9E3779B1)
        use = doc[: len(h)] == doc[n - 1 :]
        use[letter[: len(h)] == False] &= n > 1  # noqa: E712  a lone space says nothing
        x = h[use]
        grams.append(((x ^ (x >> np.uint32(16))) * np.uint32(0xC2B2AE35) >> np.uint32(17)).astype(np.int32))
        owners.append(doc[: len(h)][use])
    if not grams:
        return np.empty(0, np.int32), np.empty(0, np.int32), has
    return np.concatenate(grams), np.concatenate(owners), has


def _slices(texts: list[str]):
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _tally(batches):
    """Counters of each language in a task, as blocks of BLOCK."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lo, hi in _slices(texts):
            grams, owners, _ = features(texts[lo:hi])
            names = sorted(set(langs[lo:hi]))
            code = np.array([names.index(x) for x in langs[lo:hi]])[owners] if len(owners) else owners
            counts = np.bincount(code * FEATURES + grams, minlength=len(names) * FEATURES).reshape(len(names), FEATURES)
            for k, name in enumerate(names):
                total[name] = total.get(name, 0) + counts[k]
    rows = [(name, i, c[i * BLOCK : (i + 1) * BLOCK].tolist()) for name, c in total.items() for i in range(FEATURES // BLOCK)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["lang", "block", "counts"])


def fit(spark: SparkSession, labelled: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log probabilities (FEATURES + 1 rows; the last holds the priors)."""
    small_batches(spark)
    rows = labelled.filter("text is not null and lang is not null").select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("size"))
    found = sizes.limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages are labelled")
    priors = {r["lang"]: r["size"] for r in found}
    n = sum(priors.values())
    if n > max_train:
        share = F.greatest(F.lit(max_train / n), F.lit(float(LEAST)) / F.col("size"))
        few = spark.createDataFrame(list(priors.items()), "lang string, size long")  # LANGUAGES at most
        rows = rows.join(F.broadcast(few), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (share * (1 << 30)).cast("long"))
    sums = rows.select("lang", "text").mapInArrow(_tally, "lang string, block int, counts array<long>")
    sums = sums.select("lang", "block", F.posexplode("counts").alias("at", "n")).filter("n > 0").groupBy("lang", "block", "at").agg(F.sum("n").alias("n"))
    found = sums.groupBy("lang").agg(F.collect_list(F.struct((F.col("block") * BLOCK + F.col("at")).alias("f"), "n")).alias("counts")).orderBy("lang").collect()
    langs = [r["lang"] for r in found]
    logs = np.zeros((FEATURES + 1, len(langs)))
    for k, r in enumerate(found):
        counts = np.ones(FEATURES)
        f, m = zip(*[(x["f"], x["n"]) for x in r["counts"]], strict=True)
        counts[list(f)] += m
        logs[:-1, k] = np.log(counts / counts.sum())
        logs[-1, k] = np.log(priors[r["lang"]] / sum(priors.values()))
    return langs, logs


def _score(langs: list[str], logs):
    def run(batches):
        table = logs.value
        for b in batches:
            texts, best, score = [x or "" for x in b.column(1).to_pylist()], [], []
            for lo, hi in _slices(texts):
                grams, owners, has = features(texts[lo:hi])
                sums = np.stack([np.bincount(owners, table[:-1, k][grams], hi - lo) for k in range(len(langs))], 1) if langs else np.zeros((hi - lo, 1))
                sums += table[-1] if langs else 0
                top = sums.argmax(1)
                p = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                best += [langs[t] if h and langs else UNKNOWN for t, h in zip(top, has, strict=True)]
                score += np.where(has & bool(langs), p, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64()), *b.columns[2:]], ["doc_id", "text", "lang_pred", "score", *b.schema.names[2:]])
        release()

    return run


def predict(spark: SparkSession, docs: DataFrame, model: tuple[list[str], np.ndarray], carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, lang_pred and score of every row, and a struct ``carried`` of the columns named in carry, whatever their names."""
    small_batches(spark)
    langs, logs = model
    shared = spark.sparkContext.broadcast(logs)
    rows = docs.select("doc_id", F.col("text").cast("string"), *carried(carry))
    kinds = [("doc_id", rows.schema["doc_id"].dataType), ("text", "string"), ("lang_pred", "string"), ("score", "double"), *[("carried", rows.schema["carried"].dataType) for _ in carry[:1]]]
    return rows.mapInArrow(_score(langs, shared), struct(kinds))


def fold() -> F.col:
    """crc32(doc_id as text) mod 4."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(spark, docs.filter(fold() != 2))
    return predict(spark, docs, model).select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
