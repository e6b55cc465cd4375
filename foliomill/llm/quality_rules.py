"""Quality rules with risk-controlled thresholds.

Each document gets a whole number for each of ``RULES`` (a share in thousandths, or a word length on a scale of
logarithms); a rule rejects it from a cutoff on. Cutoffs are chosen by labelled holdouts: documents with a label that the base
rules leave. In each stratum (language) a cutoff counts as certified if the exact binomial test rejects the
hypothesis that it turns away more than ``risk`` / rules of the good documents: with k of n good ones turned away,
P(Binomial(n, risk / rules) <= k) <= (1 - confidence) / (strata * rules). The bound is corrected for all strata and rules
by Bonferroni, and for the cutoffs of one rule by testing them in a fixed order, strictest last: k grows along it, so that the
cutoffs that pass are those before the first that fails. Hence, with the stated confidence, all certified cutoffs of all strata together
turn away at most ``risk`` of the good documents of their stratum, whichever of them are used. Used is the one that
turns away most more of the bad documents than of the good ones, by share; a rule that never turns away ``risk`` more of the bad has no cutoff.

Scale: documents are measured in Arrow batches, and only their numbers are written and joined with the labels. Counts for each stratum, rule
and value are summed by Spark over all labels; windows go over the values of one rule in a stratum, a few thousand at most. The cutoffs
are one row for a stratum, joined by Spark's choice. There is neither a sample nor a list of strata on the driver.

Defined cases: null text has no words and fails the base rules, as does empty text; a null stratum is one of its own. Rows of one
doc_id share its labels, the best of them counts; null labels and labels without a document count for nothing. A
stratum with too few good labels to certify anything rejects by the base rules only. Repeated windows are confirmed on
the words themselves. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .words import Hasher, Words, as_bytes, chunks, mix, release
from .workspace import Workspace, small_batches, struct

RISK = 0.02
CONFIDENCE = 0.9
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
RULES = ["symbols", "repeats", "lines", "capitals", "marks", "long_words", "short_words"]
#: Symbols of the base rules; marks of one method rule.
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@functools.cache
def _hasher() -> Hasher:
    return Hasher(303)


@functools.cache
def _kinds() -> np.ndarray:
    """For each byte: whether it begins a character of a word, is a symbol, a capital, a mark."""
    b = np.arange(256)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    return np.stack([~space & ((b & 0xC0) != 0x80), np.isin(b, list(SYMBOLS)), (b >= 65) & (b <= 90), np.isin(b, list(MARKS))])


def repeated(texts: list[bytes], words: Words, window: int = WINDOW) -> np.ndarray:
    """How many words of each text stand in windows that are found twice or more in it."""
    out = np.zeros(len(texts), np.int64)
    at = np.flatnonzero(words.whole(window))
    if not len(at):
        return out
    doc = words.doc[at]
    keys = _hasher().sequences(_hasher().words(words.buf, words.starts, words.ends), window)[at] ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order] = same[1:] | same[:-1]
    at, doc = at[twice], doc[twice]
    for d in np.unique(doc).tolist():
        own = texts[d].split()
        places = (at[slice(*np.searchsorted(doc, [d, d + 1]))] - words.bounds[d]).tolist()
        seen = Counter(tuple(own[i : i + window]) for i in places)
        cover = np.zeros(len(own) + 1, np.int64)
        hits = np.array([i for i in places if seen[tuple(own[i : i + window])] > 1], np.int64)
        np.add.at(cover, hits, 1)
        np.add.at(cover, hits + window, -1)
        out[d] = np.count_nonzero(np.cumsum(cover)[:-1])
    return out


def measures(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts of each text, by name."""
    words = Words(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(size)
    chars = [np.concatenate([[0], np.cumsum(kind[words.buf])])[[ends - size, ends]] for kind in _kinds()]
    counts = {k: b - a for k, (a, b) in zip(("word_chars", "n_symbols", "n_capitals", "n_marks"), chars, strict=True)}
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n_lines = np.fromiter(map(len, lines), np.int64, len(texts))
    dup = n_lines - np.fromiter((len(set(x)) for x in lines), np.int64, len(texts))
    return {"n_words": np.diff(words.bounds), **counts, "n_lines": n_lines, "n_dup_lines": dup, "n_repeat_words": repeated(texts, words)}


def values(m: dict[str, np.ndarray]) -> np.ndarray:
    """A whole number for each text and rule; the larger, the worse."""
    share = lambda a, b: 1000 * m[a] // np.maximum(m[b], 1)
    length = np.floor(100 * np.log2(1 + m["word_chars"] / np.maximum(m["n_words"], 1))).astype(np.int64)
    return np.stack([share("n_symbols", "word_chars"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines"), share("n_capitals", "word_chars"), share("n_marks", "word_chars"), length, -length], 1)


def _measure(batches):
    for b in batches:
        texts = as_bytes(b.column(2))
        for lo, hi in chunks(texts):
            m = measures(texts[lo:hi])
            own = values(m)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * len(RULES), pa.int32()), pa.array(own.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], *[pa.array(m[c]) for c in BASE], lists], ["doc_id", "stratum", *BASE, "measured"])
    release()


def below(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k): the regularised incomplete beta function I(1 - p; n - k, k + 1), by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = float(n - k), float(k + 1), 1 - p
    if flip := x > (a + 1) / (a + b + 2):
        a, b, x = b, a, p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out, m = d, 0
    while True:  # needs about sqrt(n) terms
        m += 1
        step = 1.0
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + t * d or tiny)
            c = 1 + t / c or tiny
            step = c * d
            out *= step
        if abs(step - 1) < 1e-14:
            break
    return 1 - front * out if flip else front * out


def _tail(risk: float):
    @F.pandas_udf("double")
    def run(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([below(int(a), int(b), risk) for a, b in zip(k, n, strict=True)], dtype=float)

    return run


def measure(spark: SparkSession, docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the five base counts, base_failed and the rules' values (an array in the order of RULES) of every document."""
    small_batches(spark)
    rows = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), F.col("text").cast("string").alias("text"))
    kinds = [("doc_id", rows.schema["doc_id"].dataType), ("stratum", "string"), *[(c, "long") for c in BASE]]
    rows = rows.mapInArrow(_measure, struct(kinds).add("measured", ArrayType(LongType())))
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def certify(measured: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """stratum, rule, cutoff, n_good, k_good, n_bad, k_bad, p_value: the cutoff in use of each rule that has one. labels: (doc_id, good)."""
    labels = labels.filter("doc_id is not null and good is not null").groupBy("doc_id").agg(F.max("good").alias("good"))
    held = measured.filter("not base_failed").select("doc_id", "stratum", "measured").join(labels, "doc_id")
    kinds = F.array(*map(F.lit, RULES))
    counts = held.select("stratum", "good", F.explode(F.arrays_zip(kinds.alias("rule"), F.col("measured").alias("value"))).alias("x"))
    counts = counts.groupBy("stratum", "x.rule", "x.value").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    rule = Window.partitionBy("stratum", "rule")
    so_far = rule.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(c).over(w).alias(f"{k}_{c}") for c in ("good", "bad") for k, w in (("k", so_far), ("n", rule))]
    counts = counts.select("stratum", "rule", F.col("value").alias("cutoff"), *sums).filter("n_good > 0")
    strata = counts.agg(F.count_distinct(F.coalesce("stratum", F.lit("")), F.col("stratum").isNull()).alias("strata"))  # one row
    gain = F.coalesce(F.col("k_bad") / F.expr("nullif(n_bad, 0)"), F.lit(0.0)) - F.col("k_good") / F.col("n_good")
    tested = counts.withColumn("p_value", _tail(risk / len(RULES))("k_good", "n_good")).withColumn("gain", gain)
    passed = tested.join(F.broadcast(strata), (F.col("p_value") <= F.lit(1 - confidence) / (F.col("strata") * len(RULES))) & (F.col("gain") >= risk))
    own = ["cutoff", "n_good", "k_good", "n_bad", "k_bad", "p_value"]
    best = passed.groupBy("stratum", "rule").agg(F.max_by(F.struct(*own), F.struct("gain", "cutoff")).alias("best"))
    return best.select("stratum", "rule", "best.*")


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add failed_rules (of the method) and kept."""
    by = cutoffs.select(F.struct(F.col("stratum")).alias("of"), "rule", "cutoff").groupBy("of").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))  # RULES at most
    rows = measured.withColumn("of", F.struct("stratum")).join(by, "of", "left")
    over = [F.when(F.col("measured")[i] >= F.try_element_at("cutoffs", F.lit(r)), F.lit(r)) for i, r in enumerate(RULES)]
    rows = rows.withColumn("failed_rules", F.array_compact(F.array(*over)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("of", "cutoffs")


def apply_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE, stratum: str = "lang") -> DataFrame:
    """Measure, certify and judge: one row per document. labels: (doc_id, good boolean)."""
    ws = Workspace(spark, "quality")
    measured = ws.write(measure(spark, docs, stratum), "measured")
    return judge(measured, ws.write(certify(measured, labels, risk, confidence), "cutoffs"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("good"))
    rows = apply_rules(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    return rows.select("doc_id", *BASE, "base_failed", "kept", "stratum", "failed_rules")
