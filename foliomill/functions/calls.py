"""Calls of an outside model: a bounded pool in each task, shared prompts first, blanks asked again, usage beside the answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

CONCURRENCY, BATCH_BYTES = 4, 4 << 20
COUNTERS = ["no_cache", "cache_read", "cache_write", "output", "calls"]
ADDED = ["answer", "usage"]


class Reply(NamedTuple):
    """A model's text and its tokens: input by what became of it, and output."""

    text: str
    no_cache: int = 0
    cache_read: int = 0
    cache_write: int = 0
    output: int = 0


#: The prompt that many rows share, and a row's own; for an answer.
Model = Callable[[str, str], Reply]


def _answered(model: Model, shared: str, own: str, tries: int) -> tuple[str, dict[str, int]]:
    used, text = dict.fromkeys(COUNTERS, 0), ""
    for _ in range(tries):
        reply = model(shared, own)
        for k in COUNTERS[:4]:
            used[k] += getattr(reply, k)
        used["calls"] += 1
        if text := reply.text.strip():
            break
    return text, used


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose prompts take about ``BATCH_BYTES``, of one row at least."""
    size = sum(np.asarray(pc.fill_null(pc.binary_length(b.column(i)), 0), np.int64) for i in range(2))
    part = np.cumsum(size) // BATCH_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for start, stop in pairwise(edges):
        yield b.slice(start, stop - start)


def _asking(model: Model, concurrency: int, tries: int):
    usage = pa.struct([(k, pa.int64()) for k in COUNTERS])

    def run(batches):
        warm = None
        with ThreadPoolExecutor(concurrency) as pool:
            for b in (part for whole in batches for part in _parts(whole)):
                prompts = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
                first: dict[str, int] = {}
                for i, (shared, _) in enumerate(prompts):
                    if shared != warm:
                        first.setdefault(shared, i)
                warm = prompts[-1][0] if prompts else warm  # rows are sorted: what comes next may go on with it
                one = lambda i: _answered(model, prompts[i][0] or "", prompts[i][1] or "", tries)  # noqa: B023, E731
                lead = list(first.values())
                rest = sorted(set(range(len(prompts))) - set(lead))
                out = dict(zip(lead, pool.map(one, lead), strict=True)) | dict(zip(rest, pool.map(one, rest), strict=True))
                texts, used = zip(*(out[i] for i in range(len(prompts))), strict=True) if prompts else ((), ())
                yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(texts, pa.string()), pa.array(used, usage)], [*b.schema.names[2:], *ADDED])

    return run


def ask(rows: DataFrame, shared: Column, own: Column, model: Model, concurrency: int = CONCURRENCY, tries: int = 1, batch: int | None = None) -> DataFrame:
    """Rows with ``answer`` (trimmed; empty after ``tries`` blanks) and ``usage`` (the four counters of tokens and the calls).

    Rows that share a prompt lie together, so that a provider's cache of it is used: in a task the first of them is asked before the others, which
    then go ``concurrency`` at a time. A prompt that very many rows share is split over tasks by size, each with a first call of its own. An error of the
    model is the task's. Write the result before it is used twice: each evaluation makes the calls again.
    """
    if clash := {c.lower() for c in rows.columns} & set(ADDED):
        raise ValueError(f"rows must not have {sorted(clash)}")
    kind = StructType([*rows.schema.fields]).add("answer", "string").add("usage", StructType().add("no_cache", LongType()).add("cache_read", LongType()).add("cache_write", LongType()).add("output", LongType()).add("calls", LongType()))
    asked = rows.select(shared.cast("string").alias("_shared"), own.cast("string").alias("_own"), "*").withColumn("_key", F.xxhash64("_shared"))
    asked = (asked.hint("rebalance", "_key") if batch is None else asked.repartition(batch, "_key")).sortWithinPartitions("_key", "_shared").drop("_key")
    return asked.mapInArrow(_asking(model, concurrency, tries), kind)


def used(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums of usage by some columns; rows without a call count as zeros."""
    return rows.groupBy(*by).agg(*[F.coalesce(F.sum(f"usage.{k}"), F.lit(0)).alias(k) for k in COUNTERS])
