"""The registered queries on whole tables against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from foliomill.llm import fingerprints, language_id, license_scan, queries, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    return {r[0]: r for r in rows}, rows


def words(text):
    return (text or "").encode().split()


def test_op1(spark, docs):
    got, rows = run(spark, "op1_substring_dedup")
    first = {}
    for d in sorted(docs):
        w = words(docs[d]["text"])
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    assert len(rows) == len(docs)
    for d, r in got.items():
        w, gone = words(docs[d]["text"]), set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


def test_op2(spark, docs):
    got, rows = run(spark, "op2_fingerprints")
    order, by = sorted(docs, reverse=True), defaultdict(set)
    assert len(rows) == len(docs)
    for d, follow in zip(order, order[1:] + order[:1], strict=True):  # after the last comes the first
        text, r = docs[d]["text"] or "", got[d]
        cut = len(text) // 3
        changed = text[: len(text) - cut] + (docs[follow]["text"] or "")[:cut]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        a, b, c = fingerprints.fingerprints([text.encode(), changed.encode(), (docs[follow]["text"] or "").encode()])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a.text(), b.text())
        assert abs(r["near_edited"] - fingerprints.likeness(a, b)) < 1e-12 and abs(r["near_next"] - fingerprints.likeness(a, c)) < 1e-12
        by[text].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by.values())
    assert np.mean([r["near_edited"] for r in rows]) > 0.4 > 0.2 > np.mean([r["near_next"] for r in rows])


def features_of(text):
    """Hash of each feature window, by comparing all windows of all neighbourhoods."""
    gain, rank, hasher = fingerprints._tables()
    size, f = fingerprints.WINDOW, np.concatenate([[0], np.cumsum(gain)])
    key = []
    for i in range(len(text) - size + 1):
        total = sum(int(f[n]) for n in Counter(text[i : i + size]).values())
        key.append((int(rank[total // fingerprints.STEP]), i))
    votes = Counter(min(key[i : i + size]) for i in range(len(key) - size + 1))
    at = sorted(i for (r, i), n in votes.items() if n >= fingerprints.POPULAR and r < len(rank))
    buf = np.frombuffer(text, np.uint8)
    return hasher.words(buf, np.array(at, np.int64), np.array(at, np.int64) + size) if at else None


def test_op2_features(docs):
    seen = 0
    for d in sorted(docs)[:60]:
        text = (docs[d]["text"] or "").encode()[:3000]
        want = features_of(text) if len(text) >= 2 * fingerprints.WINDOW else None
        if want is not None:
            seen += 1
            got, owner = fingerprints._features([b"x" * 70, text, b"other text"])
            assert got[owner == 1].tolist() == want.tolist()
    assert seen > 20


def test_op5(spark, docs):
    got, rows = run(spark, "op5_sharding")
    sums, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "bytes", None)
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[text].add(r["shard"])
    assert len(got) == len(rows) == len(docs) and sorted(sums) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values())
    assert max(sums.values()) - min(sums.values()) < 0.05 * sum(sums.values()) / 8


def test_op5_packing():
    """Each item, largest share first, goes where its weighted dot product with the residual capacity is highest."""
    rng = np.random.default_rng(1)
    items = rng.integers(1, 1000, (300, 3)).astype(float)
    got = sharding.pack(items, 8)
    share, left = items / items.sum(0), [[1 / 8] * 3 for _ in range(8)]
    for i in sorted(range(300), key=lambda i: -max(share[i])):
        dots = [sum(w * s * c for w, s, c in zip(sharding.WEIGHTS, share[i], shard, strict=True)) for shard in left]
        assert dots[got[i]] >= max(dots) - 1e-12
        left[got[i]] = [c - s for c, s in zip(left[got[i]], share[i], strict=True)]


def test_op6(spark, docs):
    got, rows = run(spark, "op6_license_scan")
    assert len(rows) == len(docs)
    for d, r in got.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), docs[d]["text"] or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at, base = [i for i, _ in places], {label for _, label in places}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)))
        assert base <= set(r["labels"].split(",")) | {""} and r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(","))))) and 0 <= r["score"] <= 1


def test_op3_and_op7(spark, docs):
    import sentencepiece
    from tokenizers import Tokenizer

    sp, t = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, counts = run(spark, "op3_piece_encoding")[0], run(spark, "op7_token_counts")[0]
    for d, r in docs.items():
        text = r["text"] or ""
        n = len(t.encode(text, add_special_tokens=False))
        assert pieces[d]["ids"] == sp.encode(text) and pieces[d]["round_trip"]
        assert tuple(counts[d]) == (d, len(text.encode()), n, n > 512)
    assert len(pieces) == len(counts) == len(docs)


def test_op4(spark, docs):
    got, rows = run(spark, "op4_minhash_dedup")
    sets, up = {}, {}
    for d, r in docs.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[d] = {tuple(w[i : i + 2]) for i in range(len(w) - 1)} or ({tuple(w)} if w else set())
        up[d] = d

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    assert len(rows) == len(docs)
    assert all(tuple(r) == (d, len(sets[d]), find(d), find(d) == d) for d, r in got.items())


def test_op8(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got, rows = run(spark, "op8_warc")
    first = {}
    for p in sorted(pages):
        first.setdefault(pages[p], p)
    assert len(rows) == len(pages)
    for p, r in got.items():
        again = len(pages[p]) >= 100 and first[pages[p]] != p
        want = (p, len(pages[p]), hashlib.sha256(pages[p]).hexdigest(), "revisit" if again else "response", first[pages[p]] if again else None)
        assert tuple(r) == want


def test_op10(spark, docs):
    got, rows = run(spark, "op10_language_id")
    assert len(rows) == len(docs)
    held = {d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert {d for d, r in got.items() if r["held_out"]} == held
    known = {docs[d]["lang"] for d in docs if d not in held}
    for d, r in got.items():
        letters = any(c.isalpha() for c in docs[d]["text"] or "")
        assert r["lang_pred"] in known if letters else (r["lang_pred"], r["score"]) == ("und", 0)


def test_op10_scores(spark, docs):
    """Counters, probabilities and scores of the model against sums over one n-gram at a time."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    langs, logs = language_id.fit(spark, table)
    counts = {x: np.ones(language_id.FEATURES) for x in langs}
    for r in docs.values():
        if r["text"] is not None and r["lang"] is not None:
            np.add.at(counts[r["lang"]], language_id.features([r["text"]])[0], 1)
    n = Counter(r["lang"] for r in docs.values() if r["text"] is not None and r["lang"] is not None)
    for k, x in enumerate(langs):
        assert np.allclose(logs[:-1, k], np.log(counts[x] / counts[x].sum())) and np.isclose(logs[-1, k], np.log(n[x] / n.total()))
    got = {r["doc_id"]: r for r in language_id.predict(spark, table.limit(30), (langs, logs)).collect()}
    for d, r in got.items():
        grams, _, has = language_id.features([docs[d]["text"] or ""])
        sums = np.array([logs[grams, k].sum() + logs[-1, k] for k in range(len(langs))])
        if has[0]:
            assert r["lang_pred"] == langs[int(sums.argmax())] and np.isclose(r["score"], 1 / np.exp(sums - sums.max()).sum())


def test_inner_limits(spark):
    """One text beyond every inner limit of size gives what its words alone give."""
    long = " ".join(f"w{i % 70000}" for i in range(400_000))
    d = spark.createDataFrame([(1, long), (2, "w1 w2 " + long[: 1 << 20]), (3, "short")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    from foliomill.llm import substring_dedup, token_counts

    out = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(spark, d).collect()}
    assert out[1]["n_removed"] == 0 and out[1]["n_words"] == 400_000 and out[3]["kept_text"] == "short"
    w2 = out[2]["n_words"]
    assert out[2]["n_removed"] >= w2 - 4
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert token_counts.count_batch([long], path) == [len(t.encode(long, add_special_tokens=False))]


def test_op10_grams(docs):
    """Hashed n-grams of a text against one n-gram at a time: runs of other characters are one space, but none at the beginning, and a space alone is no n-gram."""
    mask = 0xFFFFFFFF

    def slow(text):
        chars = []
        for c in (text + "\n").lower():
            if c.isalpha():
                chars.append(c)
            elif chars and chars[-1] != " ":
                chars.append(" ")
        out = []
        for i in range(len(chars)):
            h = ord(chars[i]) * 0x9E3779B1 & mask
            for n in range(1, language_id.ORDERS + 1):
                if i + n > len(chars):
                    break
                if n > 1:
                    h = ((h ^ (h >> 15)) * 0x85EBCA6B + ord(chars[i + n - 1]) * 0x9E3779B1) & mask
                if n > 1 or chars[i] != " ":
                    out.append(((h ^ (h >> 16)) * 0xC2B2AE35 & mask) >> 17)
        return sorted(out)

    texts = ["", " -- ", "a", "ab, cd!", "Été 12 à la", "x\n\ny", *[docs[d]["text"] or "" for d in sorted(docs)[:40]]]
    grams, owners, has = language_id.features(texts)
    for i, t in enumerate(texts):
        assert sorted(grams[owners == i].tolist()) == slow(t) and has[i] == any(c.isalpha() for c in t)
