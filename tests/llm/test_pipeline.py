"""The registered pipeline against its stages in plain Python, over the whole small tables."""

import re
from collections import defaultdict

import public_tokenizers
import pytest
import regex
import sentencepiece

SF = "/root/testdata/sf0.001"
entry = pytest.importorskip("__spark_entry__")


def shingles(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def near_copies(docs):
    """doc_ids that aren't the smallest of their component at five words and 0.8."""
    low = {d: re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split() for d, t in docs.items()}
    sets, up = {d: shingles(w, 5) for d, w in low.items()}, {d: d for d in docs}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d for d in docs if find(d) != d}


def cut(docs, window):
    first = {}
    words = {d: t.encode().split() for d, t in docs.items()}
    for d in sorted(docs):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        if not gone or kept:
            out[d] = kept if gone else docs[d]
    return out


def leaks(docs, items):
    plain = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w]
    by = defaultdict(set)
    for d, t in docs.items():
        by[d] = plain(t)
    out = set()
    for t in items:
        own = plain(t)
        k = min(5, len(own))
        want = shingles(own, k) if own else set()
        for d, w in by.items():
            if want and 100 * len(want & {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) >= 80 * len(want):
                out.add(d)
    return out


def test_pipeline(spark):
    import corpus_pipeline

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r["text"] or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {d: t for d, t in docs.items() if any(c.isalpha() for c in t)}
    copies = near_copies(docs)
    docs = cut({d: t for d, t in docs.items() if d not in copies}, corpus_pipeline.WINDOW)
    found = leaks(docs, items)
    docs = {d: t for d, t in docs.items() if d not in found}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in entry.queries()["pipeline"](spark, SF).collect()}
    assert copies and found and set(got) == set(docs)
    assert all(r["ids"] == sp.encode(docs[d]) and r["round_trip"] for d, r in got.items())
