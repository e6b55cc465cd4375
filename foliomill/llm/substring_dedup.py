"""Substring dedup with a log-structured index of window hashes.

A window is ``window`` consecutive words of one document. Its hash in the index is the smallest
hash among the word shingles inside it: equal windows have equal hashes, and neighbours mostly share
theirs, so that a run holds about one entry for five windows. The index is a list of immutable runs,
Parquet tables of (fp, doc_id) sorted by fp. Each new batch becomes a run, which is merge-joined with
the runs before it; hashes met in two documents are kept as candidates. Runs are compacted by tiers: a batch is a run of tier 0, and ``fanout``
runs of one tier are merged into one of the next, so that n batches leave about log n runs, and a posting is rewritten
about log n times. An index at a path of its own stays and can be opened again: later calls
join their documents with its runs, given the earlier documents to verify against. Documents come in ascending doc_id: the index knows its
largest one, and documents that don't come after it raise, as their smaller doc_id would be found by nobody. Candidates are then verified: the windows under a candidate
hash get 128-bit digests, and a window is removed if its digest starts in a smaller doc_id. A whole text
that a smaller doc_id has too needs no digests: all its windows start there.

Skew: hashes are joined, never gathered. A run has one key row for a hash, pre-aggregated before the shuffle, and
the postings of a hot hash lie in ``PARTS`` buckets. The number of buckets is the session's number of shuffle
partitions when the index is made.

Defined cases: null text has no words. Rows with a null doc_id neither match nor are matched. Rows
with equal doc_id are one document when windows are compared, and each gets its own result row.
Texts shorter than a window keep every word. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import Hasher, Words, as_bytes, chunks, release, signed, sliding_min
from .workspace import Workspace, carried, small_batches, struct

WINDOW = 13
SHINGLE = 5
BATCHES = 2
FANOUT = 2
NONE = -(1 << 63)
PARTS = 16
POSTING = "fp long, doc_id long"
KEYS = ("fp long, mask int, twice boolean", ["fp"])
POSTINGS = ("fp long, doc_id long, part int", ["fp", "part"])


@functools.cache
def _hashers() -> tuple[Hasher, Hasher]:
    return Hasher(101), Hasher(202)


def _windows(words: Words, hasher: Hasher, window: int, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window, its hash in the index, and the hashes of all words."""
    hashes = hasher.words(words.buf, words.starts, words.ends)
    at = np.flatnonzero(words.whole(window))
    fps = sliding_min(hasher.sequences(hashes, shingle), window - shingle + 1)
    return at, fps[at] if len(at) else fps[:0], hashes


def _postings(window: int, shingle: int):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), as_bytes(b.column(1))
            for lo, hi in chunks(texts):
                words = Words(texts[lo:hi])
                at, fps, _ = _windows(words, _hashers()[0], window, shingle)
                if not len(at):
                    continue
                doc = words.doc[at]
                new = np.ones(len(at), bool)
                new[1:] = (fps[1:] != fps[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(signed(fps[new])), pa.array(ids[lo:hi][doc[new]].astype(np.int64))], ["fp", "doc_id"])
        release()

    return run


def postings(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(fp, doc_id) for each run of windows of a document that share a hash."""
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_postings(window, min(shingle, window)), POSTING)


class FingerprintIndex:
    """Runs of sorted buckets under a path; a path that has runs is opened with them. Runs that a lost driver left unfinished go.

    The name of a run's tables says its number, its buckets, its tier, the numbers of the first run merged into it, and the largest doc_id so far.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("a fanout is 2 or more")
        self.ws, self.fanout = Workspace(spark, "index", path), fanout
        found = self.ws.tables()
        whole = sorted(tuple(map(int, n.split("_")[1:])) for n, done in found.items() if done and n.startswith("keys_"))
        merged = {i for run, _, _, first, _ in whole for i in range(first, run)}  # what a later run has taken in
        whole = [r for r in whole if r[0] not in merged]
        self.buckets = whole[0][1] if whole else int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.made = whole[-1][0] + 1 if whole else 0
        self.last = max([r[4] + NONE for r in whole], default=NONE)
        self.names = {r[0]: "_".join(map(str, r)) for r in whole}
        self.tiers = {r[0]: r[2] for r in whole}
        self.runs = {i: (self.ws.open_buckets(f"keys_{n}", KEYS[0], self.buckets, KEYS[1]), self.ws.open_buckets(f"postings_{n}", POSTINGS[0], self.buckets, POSTINGS[1])) for i, n in self.names.items()}
        self.ws.drop(*{n for n in found if n.startswith(("keys_", "postings_"))} - {f"{k}_{n}" for n in self.names.values() for k in ("keys", "postings")})

    def _write(self, postings: DataFrame, keys: Callable[[DataFrame], DataFrame], tier: int, first: int | None = None) -> None:
        """Postings first: a run whose keys are whole is whole."""
        run, self.made = self.made, self.made + 1
        name = "_".join(map(str, (run, self.buckets, tier, run if first is None else first, self.last - NONE)))
        rows = self.ws.write_buckets(postings, f"postings_{name}", self.buckets, POSTINGS[1])
        self.runs[run] = self.ws.write_buckets(keys(rows), f"keys_{name}", self.buckets, KEYS[1]), rows
        self.names[run], self.tiers[run] = name, tier

    def drop(self, *runs: int) -> None:
        self.ws.drop(*[f"{kind}_{self.names[i]}" for i in runs for kind in ("keys", "postings")])

    def add(self, batch: DataFrame, last: int) -> DataFrame:
        """Append a batch of postings, of documents up to last, as a run; return (fp, mask) of the hashes it shares with another document, mask over all runs."""
        self.last = max(self.last, last)
        history = [keys.select("fp", F.col("mask").alias(f"mask{i}")) for i, (keys, _) in self.runs.items()]
        batch = batch.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
        stats = (F.expr("bit_or(shiftleft(1, part))").alias("mask"), (F.min("doc_id") < F.max("doc_id")).alias("twice"))
        self._write(batch.repartition(self.buckets, "fp", "part"), lambda rows: rows.groupBy("fp").agg(*stats), 0)
        own = self.runs[self.made - 1][0]
        masks = [f"mask{i}" for i in list(self.runs)[:-1]]
        for old in history:
            own = own.join(old, "fp", "left")
        shared = own.filter(" or ".join(["twice", *[f"{m} is not null" for m in masks]]))
        return shared.select("fp", F.expr(" | ".join(["mask", *[f"coalesce({m}, 0)" for m in masks]])).alias("mask"))

    def holders(self, shared: DataFrame) -> DataFrame:
        """(doc_id, fp) of all documents that hold the hashes of (fp, mask)."""
        at = shared.select("fp", F.explode(F.expr(f"filter(sequence(0, {PARTS - 1}), p -> (mask & shiftleft(1, p)) <> 0)")).alias("part"))
        return functools.reduce(DataFrame.unionAll, [rows.join(at, ["fp", "part"]).select("doc_id", "fp") for _, rows in self.runs.values()])

    def compact(self) -> None:
        """Merge runs while fanout of them are of one tier. Old runs go when the new one is whole; postings met twice change nothing."""
        while same := [i for i in self.runs if self.tiers[i] == min(self.tiers[j] for j in self.runs)][-self.fanout :]:
            if len(same) < self.fanout:
                return
            keys, rows = (functools.reduce(DataFrame.unionAll, tables) for tables in zip(*(self.runs[i] for i in same), strict=True))
            first = min(int(self.names[i].split("_")[3]) for i in same)
            merged = keys.groupBy("fp").agg(F.expr("bit_or(mask)").alias("mask"), F.expr("bool_or(twice)").alias("twice"))
            self._write(rows.distinct(), lambda _: merged, self.tiers[same[0]] + 1, first)  # noqa: B023
            self.drop(*same)
            for i in same:
                del self.runs[i], self.names[i], self.tiers[i]


def _digests(window: int, shingle: int):
    def run(batches):
        a, b = _hashers()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), as_bytes(batch.column(1))
            wanted = batch.column(2)
            for lo, hi in chunks(texts):
                words = Words(texts[lo:hi])
                at, fps, h1 = _windows(words, a, window, shingle)
                h2 = b.words(words.buf, words.starts, words.ends)
                doc, keep = words.doc[at], np.zeros(len(at), bool)
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    s = slice(edge[i], edge[i + 1])
                    keep[s] = np.isin(signed(fps[s]), wanted[lo + i].values.to_numpy(zero_copy_only=False))
                at, doc = at[keep], doc[keep]
                w1, w2 = a.sequences(h1, window)[at], b.sequences(h2, window)[at]
                yield pa.RecordBatch.from_arrays([pa.array(signed(w1)), pa.array(signed(w2)), pa.array(ids[lo:hi][doc].astype(np.int64))], ["h1", "h2", "doc_id"])
        release()

    return run


def _cut(window: int):
    def run(batches):
        a, b = _hashers()
        for batch in batches:
            raw, texts = batch.column(1), as_bytes(batch.column(1))
            flagged, copy = batch.column(2), batch.column(3).to_pylist()
            n_words, n_removed, kept = [], [], []
            for lo, hi in chunks(texts):
                words = Words(texts[lo:hi])
                h1 = h2 = None
                for i in range(hi - lo):
                    f, t = words.bounds[i], words.bounds[i + 1]
                    n_words.append(int(t - f))
                    if copy[lo + i] and t - f >= window:
                        n_removed.append(int(t - f))
                        kept.append(b"")
                        continue
                    if not flagged[lo + i].is_valid or t - f < window:
                        n_removed.append(0)
                        kept.append(b" ".join(texts[lo + i].split()))
                        continue
                    if h1 is None:
                        h1, h2 = (x.words(words.buf, words.starts, words.ends) for x in (a, b))
                    bad = flagged[lo + i].values
                    b1, b2 = (bad.field(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
                    order = np.argsort(b1)
                    b1, b2 = b1[order], b2[order]
                    w1, w2 = a.sequences(h1[f:t], window), b.sequences(h2[f:t], window)
                    left, right = np.searchsorted(b1, w1, "left"), np.searchsorted(b1, w1, "right")
                    hit = np.zeros(len(w1), bool)
                    for j in range(int((right - left).max())):
                        at = np.minimum(left + j, len(b1) - 1)
                        hit |= (left + j < right) & (b2[at] == w2)
                    cover = np.zeros(t - f + 1, np.int64)
                    np.add.at(cover, np.flatnonzero(hit), 1)
                    np.add.at(cover, np.flatnonzero(hit) + window, -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join([w for w, g in zip(texts[lo + i].split(), gone, strict=True) if not g]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), raw, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *batch.columns[4:]],
                ["doc_id", "text", "n_words", "n_removed", "kept_text", *batch.schema.names[4:]],
            )
        release()

    return run


def later_copies(ws: Workspace, docs: DataFrame) -> DataFrame:
    """doc_id of documents (of one row) whose whole text a smaller doc_id has too."""
    keys = ws.write(docs.filter("doc_id is not null and text is not null").select("doc_id", F.sha2(F.col("text").cast("string"), 256).alias("digest")), "keys")
    first = ws.write(keys.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "copied")
    alone = keys.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("digest").alias("digest")).filter("n = 1")
    return ws.write(alone.join(first, "digest").filter("doc_id > first").select("doc_id"), "copies")


def dedup_substrings(spark: SparkSession, docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, fanout: int = FANOUT, carry: tuple[str, ...] = (), index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, text, n_words, n_removed, kept_text (kept words joined by one space), and a struct ``carried`` of the columns named in carry.

    With an index of its own, calls build on each other: docs are then the next documents in ascending doc_id (others raise), and history
    holds (doc_id, text) of all that the index has. Calls one after the other give the rows of one call for all.
    """
    small_batches(spark)
    ws = Workspace(spark, "substrings")
    shingle = min(SHINGLE, window)
    cuts = sorted(set(docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / batches for i in range(1, batches)], 0.02))) if batches > 1 else []
    own = FingerprintIndex(spark, f"{ws.path}/index", fanout) if index is None else index
    span = docs.agg(F.min(F.col("doc_id").cast("long")).alias("least"), F.max(F.col("doc_id").cast("long")).alias("most")).first()
    if span["least"] is not None and span["least"] <= own.last:
        raise ValueError(f"doc_id {span['least']} doesn't come after {own.last}, the largest in the index: documents go in ascending doc_id, once")
    shared = []
    for i in range(len(cuts) + 1):  # ascending doc_id: history holds only smaller ones
        part = docs
        if i:
            part = part.filter(F.col("doc_id") > int(cuts[i - 1]))
        if i < len(cuts):
            part = part.filter(F.col("doc_id") <= int(cuts[i]))
        shared.append(ws.write(own.add(postings(part, window, shingle), int(cuts[i]) if i < len(cuts) else own.last if span["most"] is None else span["most"]), f"shared{i}"))
        own.compact()
    both = functools.reduce(DataFrame.unionAll, shared).groupBy("fp").agg(F.expr("bit_or(mask)").alias("mask"))
    wanted = ws.write(own.holders(both).groupBy("doc_id").agg(F.collect_set("fp").alias("fps")), "wanted")
    if index is None:
        own.drop(*own.runs)
    narrow = docs.select("doc_id", F.col("text").cast("string"))
    if history is not None:
        narrow = narrow.unionByName(history.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), F.col("text").cast("string")))
    copies = later_copies(ws, narrow)
    found = narrow.join(wanted.join(copies, "doc_id", "left_anti"), "doc_id").select(F.col("doc_id").cast("long"), "text", "fps").mapInArrow(_digests(window, shingle), "h1 long, h2 long, doc_id long")
    found = ws.write(found, "digests")
    first = ws.write(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("h1", "h2", "first"), "first")
    flagged = ws.write(found.join(first, ["h1", "h2"]).filter("doc_id > first").groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("windows")), "flagged")
    flagged = flagged.withColumn("copy", F.lit(False)).unionAll(copies.select(F.col("doc_id").cast("long"), F.lit(None).cast(flagged.schema["windows"].dataType), F.lit(True)))
    ws.drop("digests", "first", "wanted")
    rows = docs.select("doc_id", F.col("text").cast("string"), *carried(carry)).join(flagged, "doc_id", "left")
    rows = rows.select("doc_id", "text", "windows", F.coalesce("copy", F.lit(False)).alias("copy"), *(["carried"] if carry else []))
    kinds = [("doc_id", rows.schema["doc_id"].dataType), ("text", "string"), ("n_words", "long"), ("n_removed", "long"), ("kept_text", "string"), *[("carried", rows.schema["carried"].dataType) for _ in carry[:1]]]
    return rows.mapInArrow(_cut(window), struct(kinds))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(spark, docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
