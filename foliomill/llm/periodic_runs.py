"""Periodic run detection: stretches of a text in which the same words come round again and again.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
``max(LEAST, 2 * q)`` that neither neighbouring word extends. A word is dropped if a run holds it after the run's first q words.

Harmonic grid probing: a run of period p holds two consecutive multiples of p, so that only words at jp and (j + 1)p are tested for
equality, n / p tests for a period and n ln n for all. Words are numbered first, so that equality is exact. A place that
passes is extended by comparing growing chunks of the text with the text p words later, after a test of its three neighbours on either side, one of
which must be equal in a stretch of six. Grid points inside runs already found whose period divides p are skipped: there
the stretch of period p is that run itself. Short texts take their grid from a table, longer ones in 2 * sqrt(n) passes: by
period up to sqrt(n), by j beyond.

Scale: documents are independent, so that the job has neither shuffle nor broadcast. A task holds an Arrow batch of a few MB;
a longer document stands alone and takes memory in proportion to its words.

Defined cases: null and empty texts have no words and no run; equal rows each get a row; an empty table gives
an empty result; other columns are carried in a struct where asked for, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .words import as_bytes, release
from .workspace import carried, small_batches, struct

LEAST = 12
TABLE = 4096
CHUNK = 64
NEAR = 3
RUNS = ArrayType(struct([(k, "long") for k in ("start", "length", "period")]))


@functools.cache
def _table() -> tuple[np.ndarray, np.ndarray]:
    """Upper grid point and period of each test for texts of up to TABLE words, by upper point: a shorter text takes the front."""
    upper = [np.arange(p, TABLE, p, dtype=np.int32) for p in range(1, TABLE // 2 + 1)]
    period = np.repeat(np.arange(1, TABLE // 2 + 1, dtype=np.int32), list(map(len, upper)))
    upper = np.concatenate(upper)
    order = np.argsort(upper, kind="stable")
    return upper[order], period[order]


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray | int]]:
    """Lower grid points and periods to test in a text of n words, in passes; those of one period come first, in ascending order."""
    if n <= TABLE:
        upper, period = _table()
        cut = np.searchsorted(upper, n)
        upper, period = upper[:cut], period[:cut]
        fits = period <= n // 2
        yield (upper - period)[fits], period[fits]
        return
    root = int(n**0.5)
    for p in range(1, root + 1):
        yield np.arange(0, n - p, p), p
    for j in range(n // (root + 1)):
        p = np.arange(root + 1, min(n // 2, (n - 1) // (j + 1)) + 1)
        yield j * p, p


class _Text:
    """Numbers of a text's words and the runs found so far, by period."""

    def __init__(self, ids: np.ndarray, least: int):
        self.n, self.least, self.ids = len(ids), least, ids
        self.padded = np.concatenate([np.arange(-NEAR, 0), ids, np.arange(-2 * NEAR, -NEAR)])  # no two of the edges are equal
        self.found: dict[int, tuple[list[int], list[int]]] = {}
        self.seen: set[tuple[int, int]] = set()
        self.runs: list[tuple[int, int, int]] = []

    def passing(self, at: np.ndarray, period: np.ndarray | int) -> np.ndarray:
        """Whether the words at grid points are equal, with equal neighbours."""
        out = self.ids[at] == self.ids[at + period]
        at, period = at[out], period if isinstance(period, int) else period[out]
        x, left, right = at + NEAR, np.ones(len(at), bool), np.ones(len(at), bool)
        for k in range(1, NEAR + 1):
            right &= self.padded[x + k] == self.padded[x + k + period]
            left &= self.padded[x - k] == self.padded[x - k + period]
        out[out] = left | right
        return out

    def outside(self, at: np.ndarray, period: np.ndarray | int) -> np.ndarray:
        """Whether grid points are in no run found whose period divides theirs. Runs of one period overlap by less than it."""
        out = np.ones(len(at), bool)
        for q, (starts, ends) in self.found.items():
            if isinstance(period, int) and period % q:
                continue
            k = np.searchsorted(starts, at, "right") - 1
            inside = (k >= 0) & (at + period < np.asarray(ends)[k])
            out &= ~(inside & (period % q == 0))
        return out

    def _equal(self, at: int, p: int, step: int) -> int:
        """How many words from at on (step 1) or before at (step -1) equal the words p later."""
        done, size = 0, CHUNK
        while True:
            if step > 0:
                lo, hi = at + done, min(at + done + size, self.n - p)
                same = self.ids[lo:hi] == self.ids[lo + p : hi + p]
            else:
                lo, hi = max(at - done - size, 0), at - done
                same = (self.ids[lo:hi] == self.ids[lo + p : hi + p])[::-1]
            if lo >= hi:
                return done
            if not same.all():
                return done + int(same.argmin())
            done, size = done + hi - lo, size * 2

    def extend(self, at: np.ndarray, p: int) -> None:
        """Runs of period p at grid points in ascending order."""
        at = at[self.outside(at, p)]
        k = 0
        while k < len(at):
            i = int(at[k])
            start, stop = i - self._equal(i, p, -1), i + self._equal(i, p, 1)
            end = stop + p
            if end - start >= max(self.least, 2 * p) and (start, end) not in self.seen:  # a stretch that has a smaller period is seen
                self.seen.add((start, end))
                self.runs.append((start, end - start, p))
                starts, ends = self.found.setdefault(p, ([], []))
                starts.append(start)
                ends.append(end)
            k = int(np.searchsorted(at, stop))


def find(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text of numbered words, by start and period."""
    text, later = _Text(ids, least), []
    if len(ids) < max(least, 2):
        return []
    for at, period in _grid(len(ids)):
        hit = text.passing(at, period)
        if isinstance(period, int):
            text.extend(at[hit], period)
        else:
            at, period = at[hit], period[hit]
            keep = text.outside(at, period)
            later.append((at[keep], period[keep]))
    if later:
        at, period = (np.concatenate(x) for x in zip(*later, strict=True))
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
        edges = np.append(np.flatnonzero(np.diff(period, prepend=-1)), len(at))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            text.extend(at[lo:hi], int(period[lo]))
    return sorted(text.runs, key=lambda r: (r[0], r[2]))


def _runs(least: int):
    def run(batches):
        for b in batches:
            sizes, found, kept = [], [], []
            for text in as_bytes(b.column(1)):
                words, number = text.split(), {}
                runs = find(np.array([number.setdefault(w, len(number)) for w in words], np.int64), least)
                sizes.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                if runs:
                    cover = np.zeros(len(words) + 1, np.int64)
                    for s, n, p in runs:
                        cover[s + p] += 1
                        cover[s + n] -= 1
                    gone = np.cumsum(cover) > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=False) if not g]
                kept.append(b" ".join(words))
            kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary()).cast(pa.string()), *b.columns[2:]], ["doc_id", "n_words", "runs", "collapsed", *b.schema.names[2:]])
        release()

    return run


def collapse_runs(spark: SparkSession, docs: DataFrame, least: int = LEAST, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the words that
    aren't dropped, joined by one space), and a struct ``carried`` of the columns named in carry."""
    small_batches(spark)
    rows = docs.select("doc_id", F.col("text").cast("string"), *carried(carry))
    kinds = [("doc_id", rows.schema["doc_id"].dataType), ("n_words", "long"), ("runs", RUNS), ("collapsed", "string"), *[("carried", rows.schema["carried"].dataType) for _ in carry[:1]]]
    return rows.mapInArrow(_runs(least), struct(kinds))


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which the end of every tenth document, by crc32 of its doc_id, repeats one stretch of it."""
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")

    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    again = F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a))
    return F.when((h % 10 == 0) & (F.size(words) > 0), F.array_join(again, " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = collapse_runs(spark, docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = rows.withColumn("best", best).select("*", (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.shorter")).alias("period"))
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    milli = F.expr("(1000 * length) div period").alias("exponent_milli")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", milli, F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
