"""Token counts with a public tokenizer file.

Arrow functions encode batches of a bounded number of bytes and return lengths only. Texts are split
at safe boundaries: before a single space between two characters that aren't white space. A byte-level
pre-token holds a space only as its first character or within white space, so that the counts of the
parts add up to the count of the whole; special strings hold no space. Equal parts are encoded once
while they stay in a bounded cache, and very long parts without a boundary are encoded whole.

Defined cases: null counts as empty text, which has 0 tokens; rows with equal ids or texts each get a
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 1 << 20
CACHE_PARTS = 200_000
LIMIT = 512
BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
UNEVEN = re.compile(r"^ | $|\s | \s")


@functools.cache
def _tokenizer(path: str):
    os.environ["RAYON_NUM_THREADS"] = "1"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _cache(path: str) -> dict[str, int]:
    return {}


def parts(text: str) -> list[str]:
    """The text cut at its safe boundaries."""
    if UNEVEN.search(text):
        return BOUNDARY.split(text)
    head, *rest = text.split(" ")
    return [head, *[" " + x for x in rest]]


def count_batch(texts: list[str], path: str) -> list[int]:
    """Tokens of each text."""
    known, cut = _cache(path), [parts(t) if t else [] for t in texts]
    if len(known) > CACHE_PARTS:
        known.clear()
    new = list(dict.fromkeys(p for c in cut for p in c if p not in known))
    start = 0
    while start < len(new):
        end, size = start, 0
        while end < len(new) and (size == 0 or size + 4 * len(new[end]) <= BATCH_BYTES):
            size += len(new[end].encode("utf-8", "surrogatepass"))
            end += 1
        encoded = _tokenizer(path).encode_batch_fast(new[start:end], add_special_tokens=False)
        known.update(zip(new[start:end], map(len, encoded), strict=True))
        start = end
    return [sum(map(known.__getitem__, c)) for c in cut]


def _count(path: str):
    def run(batches):
        for b in batches:
            raw = b.column(1)
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(raw), 0)).astype(np.int64)
            texts, counts, start = [x or "" for x in raw.to_pylist()], [], 0
            while start < len(texts):
                end = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:]), 4 * BATCH_BYTES, "right")) + start)
                counts += count_batch(texts[start:end], path)
                start = end
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every text under the tokenizer file at path."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(_count(path), f"doc_id {kind}, n_bytes long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).selectExpr("*", f"n_tokens > {LIMIT} as over_limit")
