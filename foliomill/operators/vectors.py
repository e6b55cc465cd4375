"""Vector index: coarse cells, probed in part and ranked exactly.

Cells are the nearest of some centroids, which k-means finds on a sample of at most ``SAMPLE`` rows, chosen by a hash of their id. Every row
is in the index, in the folder of its cell; rows without a direction are in cell -1, which no search reads. A search ranks the
rows of the cells that are nearest to its query by their exact distance. With all cells it is the exact search. How many cells a
search takes is fitted when the index is built: as few as find ``RECALL`` of the nearest of some of the sample within the sample, so that vectors
without clusters, whose neighbours are everywhere, get most cells, and others few.

Scale: building is one pass over the rows and one shuffle by cell; a large cell is split by size (rebalance). The driver and each task hold the
centroids, at most ``CELLS`` of them. A batch of queries is broadcast in blocks of a bounded size, and reads the cells that its queries probe once a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import CANDIDATES, batched_dense, dense, first_n, nearest, query_blocks, units

SAMPLE = 20_000
CELLS = 4096
ROUNDS = 8
RECALL = 0.93
ALL = CELLS


def centroids(vectors: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit vectors in the middle of at most cells groups of unit vectors."""
    rng = np.random.default_rng(seed)
    out = np.unique(vectors, axis=0)
    out = out[rng.permutation(len(out))[:cells]]
    for _ in range(rounds):
        own = (vectors @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), out)  # an empty cell stays where it is
    return out


def fitted_probes(vectors: np.ndarray, middle: np.ndarray, n: int = CANDIDATES, recall: float = RECALL) -> int:
    """The least number of cells that hold this share of the n nearest of every 50th of these vectors."""
    queries = vectors[::50]
    own, missed = (vectors @ middle.T).argmax(1), []
    for lo in range(0, len(queries), 256):
        q = queries[lo : lo + 256]
        near = np.argsort(-(q @ middle.T), axis=1, kind="stable")
        place = np.empty_like(near)
        np.put_along_axis(place, near, np.arange(near.shape[1])[None, :], axis=1)
        first = np.argpartition(-(q @ vectors.T), min(n, len(vectors)) - 1, axis=1)[:, :n]
        missed.append(np.take_along_axis(place, own[first], axis=1).ravel())
    return int(np.quantile(np.concatenate(missed), recall, method="higher")) + 1


def _assign(shared):
    def run(batches):
        middle = shared.value
        for b in batches:
            cell = np.full(len(b), -1)
            at, rows = units(b.column(1), middle.shape[1])
            for lo in range(0, len(at), 1024):
                cell[at[lo : lo + 1024]] = (rows[lo : lo + 1024] @ middle.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], ["chunk_id", "embedding", "cell"])

    return run


def _probe(shared, n: int):
    def run(batches):
        ids, queries, by_cell = shared.value
        for b in batches:
            keys, cells = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            at, rows = units(b.column(1), queries.shape[1])
            for c in np.unique(cells[at]):
                if c in by_cell:
                    own = cells[at] == c
                    yield from nearest(keys[at[own]], rows[own], ids[by_cell[c]], queries[by_cell[c]], n)

    return run


class VectorIndex:
    """The index at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        found = spark.read.parquet(f"{path}/middle").orderBy("cell").collect()  # CELLS at most
        self.middle, self.probes = np.array([r["middle"] for r in found], np.float64), found[0]["probes"]

    @classmethod
    def build(cls, rows: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Index the vectors of rows (chunk_id, embedding); cells is about the root of their number if it isn't given. Vectors of a size other than the first of the sample are near to nothing."""
        spark = rows.sparkSession
        rows = rows.filter("embedding is not null").select(F.col("chunk_id").cast("long"), F.col("embedding").cast("array<double>"))
        some = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
        sizes = some.value_lengths().to_numpy(zero_copy_only=False)
        size = int(np.bincount(sizes).argmax()) if len(sizes) else 1
        vectors = units(some, size)[1]
        if not len(vectors):
            vectors = np.eye(1, size)
        middle = centroids(vectors, min(CELLS, cells or max(1, round(rows.count() ** 0.5))))
        probes = fitted_probes(vectors, middle)
        table = spark.createDataFrame([(i, m.tolist(), probes) for i, m in enumerate(middle)], "cell int, middle array<double>, probes int")
        placed = rows.mapInArrow(_assign(spark.sparkContext.broadcast(middle)), "chunk_id long, embedding array<double>, cell int")
        placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        table.write.mode("overwrite").parquet(f"{path}/middle")  # last: an index with centroids is whole
        return cls(spark, path)

    def rows(self, cells: list[int]) -> DataFrame:
        return self.spark.read.schema("chunk_id long, embedding array<double>, cell int").parquet(f"{self.path}/rows").filter(F.col("cell").isin(cells))

    def _near(self, queries: np.ndarray, probes: int | None) -> np.ndarray:
        return np.argsort(-(queries @ self.middle.T), axis=1, kind="stable")[:, : probes or self.probes]

    def search(self, query: list[float], n: int = CANDIDATES, probes: int | None = None) -> DataFrame:
        """(chunk_id, distance, rank) as ``dense``, from the nearest cells: as many as were fitted, or probes."""
        q = np.array([query], np.float64)
        cells = self._near(q, probes)[0].tolist() if q.shape[1] == self.middle.shape[1] else []
        return dense(self.rows(cells), query, n)

    def batched(self, queries: DataFrame, n: int = CANDIDATES, probes: int | None = None) -> DataFrame:
        """(query_id, chunk_id, distance, rank) as ``batched_dense``, from the cells nearest to each query: as many as were fitted, or probes (ALL takes all)."""
        sc, found = self.spark.sparkContext, []
        for ids, vectors in query_blocks(queries):
            if vectors.shape[1] != self.middle.shape[1]:
                continue
            cells = self._near(vectors, probes)
            order = np.argsort(cells.ravel(), kind="stable")
            names, first = np.unique(cells.ravel()[order], return_index=True)
            by_cell = dict(zip(names.tolist(), np.split(order // cells.shape[1], first[1:]), strict=True))
            found.append(self.rows(names.tolist()).mapInArrow(_probe(sc.broadcast((ids, vectors, by_cell)), n), "query_id long, chunk_id long, distance double"))
        return first_n(found, n, queries)

    def recall(self, rows: DataFrame, queries: DataFrame, n: int = CANDIDATES, probes: int | None = None) -> DataFrame:
        """(query_id, wanted, found): how many of the exact search's n nearest of each query the index finds."""
        exact, own = batched_dense(rows, queries, n), self.batched(queries, n, probes).select("query_id", "chunk_id", F.lit(1).alias("hit"))
        return exact.join(own, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
