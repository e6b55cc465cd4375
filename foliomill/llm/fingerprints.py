"""Document fingerprints: improbable-feature digests.

Every ``WINDOW`` bytes of a text are ranked by how rare their entropy is for text; a window that is the
leftmost rarest of at least ``POPULAR`` of its neighbourhoods is a feature. Features are hashed to five
bits of a 2048-bit Bloom filter; after ``CAPACITY`` features the next filter of the chain begins. Likeness is the
overlap of two filters beyond that expected by chance, over the largest possible one; each filter of the
smaller chain counts with its best partner, weighted by its features.

Texts under ``SHORT`` bytes have one or few such features. They get one more filter, of all their windows of
``NARROW`` bytes, and two texts that have it are compared by it alone.

Entropies are exact integer sums, so that a window's rank doesn't depend on what surrounds it.

The neighbour of a document is the next in descending doc_id. Documents are dealt out by ranges of
doc_id, with the first row of the following range copied into each as a look-ahead, and each range is
read in order as a stream: texts are shuffled once and no task holds more than a batch.

Defined cases: null counts as empty text, whose fingerprint has no filter; two empty fingerprints have
likeness 1, an empty and another 0; texts under WINDOW bytes are one feature, those under NARROW one narrow one; equal doc_ids are ordered by
a hash of their texts, null doc_ids come last; a single document is its own neighbour; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import Hasher, chunks, sliding_min

WINDOW = 64
SHORT = 256
NARROW = 8
POPULAR = 16
CAPACITY = 160
BITS = 2048
HASHES = 5
TYPICAL, SPREAD, LEAST = 4.15, 0.25, 2.0
BUFFER = 256 << 10
ROWS_A_RANGE = 500
MOST_RANGES = 10_000
SCALE = 1024
STEP = 512


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, Hasher]:
    """Growth of c log c with c, rank of each entropy level (low: rare), hash of a window."""
    c = np.arange(WINDOW + 1)
    f = np.round(SCALE * c * np.log2(np.maximum(c, 1))).astype(np.int64)
    level = np.arange(int(f[WINDOW]) // STEP + 1)
    entropy = math.log2(WINDOW) - level * STEP / SCALE / WINDOW
    rank = np.argsort(np.argsort(-np.abs(entropy - TYPICAL) / SPREAD, kind="stable"), kind="stable")
    rank[entropy < LEAST] = len(level)
    return np.diff(f), rank, Hasher(303)


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each feature, in order."""
    gain, rank, hasher = _tables()
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    n = len(buf)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    whole = [(i, int(first[i]), int(first[i] + lengths[i])) for i in np.flatnonzero((lengths > 0) & (lengths < WINDOW))]
    at, doc = np.empty(0, np.int64), np.empty(0, np.int64)
    if n > WINDOW and (lengths >= WINDOW).any():
        before, after, same = np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.empty(n, bool)
        for d in range(1, WINDOW):
            np.equal(buf[d:], buf[:-d], out=same[:-d])
            eq = same[:-d].view(np.uint8)
            before[d:] += eq
            after[:-d] += eq
        total = np.concatenate([[0], np.cumsum(gain[before])])
        gone = np.concatenate([[0], np.cumsum(gain[after])])
        sums = total[WINDOW:] - gone[: n - WINDOW + 1]
        owner = np.repeat(np.arange(len(texts)), lengths + 1)
        pos = np.arange(n - WINDOW + 1)
        ok = pos + WINDOW <= (first + lengths)[owner[: len(pos)]]
        r = rank[sums // STEP]
        key = (np.where(ok, r, len(rank) + 1) << 32) | pos
        best = sliding_min(key, WINDOW)
        inside = ok[: len(best)] & ok[WINDOW - 1 :][: len(best)] & (owner[: len(best)] == owner[WINDOW - 1 :][: len(best)])
        best = best[inside & (best >> 32 < len(rank))]
        votes = np.bincount(best & 0xFFFFFFFF, minlength=1)
        at = np.flatnonzero(votes >= POPULAR)
        doc = owner[at]
        for i in np.setdiff1d(np.flatnonzero(lengths >= WINDOW), doc):  # too short or too even for a vote
            span = key[first[i] : first[i] + lengths[i] - WINDOW + 1]
            s = first[i] + int(np.argmin(span))
            whole.append((i, s, s + WINDOW) if span.min() >> 32 < len(rank) else (i, int(first[i]), int(first[i] + lengths[i])))
    starts = np.concatenate([at, np.array([w[1] for w in whole], np.int64)])
    ends = np.concatenate([at + WINDOW, np.array([w[2] for w in whole], np.int64)])
    docs = np.concatenate([doc, np.array([w[0] for w in whole], np.int64)])
    hashes = hasher.words(buf, starts, ends)
    order = np.lexsort((starts, docs))
    return hashes[order], docs[order]


class Chain:
    """Bloom filters (rows of bytes) and the number of features in each; a short text's narrow filter."""

    __slots__ = ("counts", "filters", "narrow", "ones")

    def __init__(self, filters: np.ndarray, counts: np.ndarray, narrow: "Chain | None" = None):
        self.filters, self.counts, self.narrow = filters, counts, narrow
        self.ones = np.bitwise_count(filters.view(np.uint64)).sum(1).astype(float)

    def text(self) -> str:
        head = f"{len(self.counts)}:{int(self.counts[-1]) if len(self.counts) else 0}:"
        return head + base64.b64encode(self.filters.tobytes()).decode() + (f"+{self.narrow.text()}" if self.narrow else "")


def _filters(where: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    bits = np.zeros((n, BITS), bool)
    for k in range(HASHES):
        bits[where, (hashes >> np.uint64(11 * k)).astype(np.int64) % BITS] = True
    return np.packbits(bits, axis=1)


def _narrow(texts: list[bytes]) -> list[Chain | None]:
    """The filter of all narrow windows of each short text."""
    out: list[Chain | None] = [None] * len(texts)
    short = [i for i, t in enumerate(texts) if 0 < len(t) < SHORT]
    if not short:
        return out
    lengths = np.array([len(texts[i]) for i in short])
    n = np.maximum(lengths - NARROW + 1, 1)
    owner = np.repeat(np.arange(len(short)), n)
    first = np.cumsum(lengths) - lengths
    starts = first[owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    ends = np.minimum(starts + NARROW, (first + lengths)[owner])
    hashes = _tables()[2].words(np.frombuffer(b"".join(texts[i] for i in short), np.uint8), starts, ends)
    packed = _filters(owner, hashes, len(short))
    for j, i in enumerate(short):
        out[i] = Chain(packed[j : j + 1], n[j : j + 1])
    return out


def fingerprints(texts: list[bytes]) -> list[Chain]:
    """The chain of each text."""
    out: list[Chain] = []
    for lo, hi in chunks(texts, BUFFER):
        hashes, docs = _features(texts[lo:hi])
        edge = np.searchsorted(docs, np.arange(hi - lo + 1))
        n = np.diff(edge)
        chain = -(-n // CAPACITY)
        base = np.concatenate([[0], np.cumsum(chain)])
        where = base[docs] + (np.arange(len(docs)) - edge[docs]) // CAPACITY
        packed, counts = _filters(where, hashes, base[-1]), np.bincount(where, minlength=base[-1])
        narrow = _narrow(texts[lo:hi])
        out += [Chain(packed[base[i] : base[i + 1]], counts[base[i] : base[i + 1]], narrow[i]) for i in range(hi - lo)]
    return out


def _toward(a: Chain, b: Chain) -> float:
    best = np.zeros(len(a.counts))
    wide = b.filters.view(np.uint64)
    for i, f in enumerate(a.filters.view(np.uint64)):
        overlap = np.bitwise_count(wide & f).sum(1)
        chance = a.ones[i] * b.ones / BITS
        most = np.minimum(a.ones[i], b.ones)
        best[i] = np.max((overlap - chance) / np.maximum(most - chance, 1e-9))
    return float(np.clip((best * a.counts).sum() / a.counts.sum(), 0, 1))


def likeness(a: Chain, b: Chain) -> float:
    """0 (nothing in common but chance) to 1."""
    if a.narrow and b.narrow:
        return likeness(a.narrow, b.narrow)
    n, m = int(a.counts.sum()), int(b.counts.sum())
    if not n or not m:
        return float(n == m)
    if n == m:
        return (_toward(a, b) + _toward(b, a)) / 2
    return _toward(a, b) if n < m else _toward(b, a)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _walk(batches):
    """Rows (look, doc_id, text) in order: each with look = 0 is followed by its neighbour."""
    carry: list[tuple] = []
    for b in batches:
        for lo in range(0, len(b), 512):
            part = b.slice(lo, 512)
            rows = carry + list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), [t or "" for t in part.column(2).to_pylist()], strict=True))
            carry = [rows[-1]]
            chains = fingerprints([r[2].encode() for r in rows])
            own = [i for i in range(len(rows) - 1) if rows[i][0] == 0]
            changed = [edited(rows[i][2], rows[i + 1][2]).encode() for i in own]
            others = fingerprints(changed)
            columns = [
                pa.array([rows[i][1] for i in own], pa.int64()),
                pa.array([len(rows[i][2]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
                pa.array([chains[i].text() for i in own], pa.string()),
                pa.array([c.text() for c in others], pa.string()),
                pa.array([likeness(chains[i], c) for i, c in zip(own, others, strict=True)], pa.float64()),
                pa.array([likeness(chains[i], chains[i + 1]) for i in own], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, NAMES)


def compare_neighbours(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text, and its likeness to that and to its neighbour's."""
    low = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("key"))
    n = rows.count()
    ranges = max(1, min(-(-n // ROWS_A_RANGE), max(MOST_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    cuts = np.unique(np.array(rows.filter("doc_id is not null").select(F.col("key").cast("double").alias("k")).approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else [], float)).astype(np.int64)

    @F.pandas_udf("long")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, key.to_numpy()), dtype="int64")

    first = {r["range"]: r["key"] for r in rows.groupBy(place("key").alias("range")).agg(F.max("key").alias("key")).collect()}  # at most ranges rows
    order = sorted(first)
    ahead = spark.createDataFrame([(first[order[(i + 1) % len(order)]], r) for i, r in enumerate(order)], "key long, range long")
    looked = rows.join(F.broadcast(ahead), "key").select("doc_id", "text", "key", "range", F.lit(1).alias("look"))
    dealt = rows.select("doc_id", "text", "key", place("key").alias("range"), F.lit(0).alias("look")).unionByName(looked)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "range").sortWithinPartitions("range", "look", F.desc("key"), F.xxhash64("text"))
    return ordered.select("look", "doc_id", "text").mapInArrow(_walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
