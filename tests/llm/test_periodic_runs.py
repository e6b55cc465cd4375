"""Periodic runs against all periods of all stretches, and the query against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill.llm import periodic_runs, queries

SF = "/root/testdata/sf0.01"


def brute(w, least=12):
    """Every maximal stretch of each period, with the smallest period of those that are equal."""
    out, n = {}, len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i < n - p and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, 2 * p):
                out.setdefault((s, i + p), p)
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def word(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(120))]
    if kind == 1:
        return [rng.randrange(50) for _ in range(rng.randrange(200))]
    if kind == 2:
        a, b = [0], [1]
        while len(a) < 150:
            a, b = a + b, a
        return a[: rng.randrange(150)]
    if kind == 3:
        return [0] * rng.randrange(60) + [1] + [0] * rng.randrange(60)
    out = [rng.randrange(30) for _ in range(rng.randrange(40))]
    for _ in range(rng.randrange(4)):
        unit = [rng.randrange(3 if kind == 4 else 30) for _ in range(rng.randrange(1, 25))]
        out += (unit * 9)[: rng.randrange(9 * len(unit))] + [rng.randrange(30) for _ in range(rng.randrange(20))]
    return out


@pytest.mark.parametrize("table", [4096, 8])
def test_against_all_periods(monkeypatch, table):
    monkeypatch.setattr(periodic_runs, "TABLE", table)  # 8: every text takes the passes of longer ones
    monkeypatch.setattr(periodic_runs, "CHUNK", 4 if table == 8 else 64)
    periodic_runs._table.cache_clear()
    rng = random.Random(table)
    for _ in range(1500):
        w = word(rng)
        assert periodic_runs.find(np.array(w, np.int64)) == brute(w), w
    periodic_runs._table.cache_clear()


def test_long_texts():
    assert periodic_runs.find(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    w = np.concatenate([np.arange(70_000), np.arange(70_000), np.arange(100), np.tile(np.arange(100_000, 100_900), 40)])
    assert periodic_runs.find(w) == [(0, 140_100, 70_000), (140_100, 36_000, 900)]


def digest(text):
    return hashlib.sha256(text).hexdigest()


def expected(d, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(d).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs, gone = brute(w), set()
    for s, length, q in runs:
        gone |= set(range(s + q, s + length))
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (d, len(runs), *top, digest(lines), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)), n)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    short = [r for r in docs if r["n_chars"] < 6000]
    assert len(short) > 900
    for r in short:
        assert got[r["doc_id"]] == expected(r["doc_id"], r["text"])


def test_cases(spark):
    text = "a b " * 8 + "end"
    rows = [(1, None, "x"), (2, "", "x"), (3, text, "y"), (3, text, "y"), (None, "\x0b\x0c z", "z"), (4, "é " * 12, "w"), (5, "w " * 11, "v")]
    d = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("n_words", F.lit("other"))
    got = {(r["doc_id"], r["carried"]["runs"]): r for r in periodic_runs.collapse_runs(spark, d, carry=("runs", "n_words")).collect()}
    assert [tuple(x) for x in got[3, "y"]["runs"]] == [(0, 16, 2)] and got[3, "y"]["collapsed"] == "a b end"
    assert got[1, "x"]["n_words"] == 0 and got[1, "x"]["runs"] == [] and got[2, "x"]["collapsed"] == ""
    assert got[None, "z"]["collapsed"] == "z" and got[4, "w"]["collapsed"] == "é" and got[5, "v"]["runs"] == []
    assert periodic_runs.collapse_runs(spark, d).count() == len(rows) and periodic_runs.collapse_runs(spark, d.limit(0)).count() == 0
