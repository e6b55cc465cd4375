"""Seams for outside models: callables over batches, with deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[list[float]]]
Generate = Callable[[list[str]], list[str]]


def hash_embedding(texts: list[str], size: int = 64) -> list[list[float]]:
    """Unit vectors of hashed words."""
    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            out[i, h[0] % size] += 1 if h[1] & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).tolist()


def extractive(texts: list[str], words: int = 40) -> list[str]:
    """The first words."""
    return [" ".join(t.split()[:words]) for t in texts]


def embed(text: Column, model: Embed = hash_embedding, batch: int = 100) -> Column:
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        texts, out = s.fillna("").tolist(), []
        for i in range(0, len(texts), batch):
            got = model(texts[i : i + batch])
            if len(got) != len(texts[i : i + batch]):
                raise ValueError("the model must return one vector for each text")
            out += got
        return pd.Series(out)

    return run(text)


def generate(text: Column, model: Generate = extractive, tries: int = 2, fallback: str = "(none)") -> Column:
    """The model's text; blank answers are asked again, then replaced."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        texts = s.fillna("").tolist()
        out = [""] * len(texts)
        for _ in range(tries):
            todo = [i for i, x in enumerate(out) if not x.strip()]
            for i, x in zip(todo, model([texts[i] for i in todo]), strict=True):
                out[i] = x
        return pd.Series([x if x.strip() else fallback for x in out])

    return run(text)
