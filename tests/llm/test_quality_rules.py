"""Quality rules: counts, binomial bounds and cutoffs against plain Python."""

import random
from collections import Counter, defaultdict
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from foliomill.llm import quality_rules as rules
from foliomill.llm import queries

SF = "/root/testdata/sf0.01"


def plain(text):
    """The five base counts, and lines, capitals and marks."""
    t = text or ""
    w = t.encode().split()
    lines = [x for x in t.split("\n") if x.encode().split()]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, hit = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            hit |= set(range(i, i + 5))
    chars = sum(len(x.decode()) for x in w)
    base = (len(w), chars, sum(t.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))
    return base, len(lines), sum("A" <= c <= "Z" for c in t), sum(c in "!?" for c in t)


def expected_values(text):
    (n, chars, symbols, dup, rep), lines, capitals, marks = plain(text)
    share = lambda a, b: 1000 * a // max(b, 1)
    return [share(symbols, chars), share(rep, n), share(dup, lines), share(capitals, chars), share(marks, chars)]


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_quality_rules"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, (base, *_) = got[d["doc_id"]], plain(d["text"])
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        assert tuple(r[1:6]) == base and r["base_failed"] == failed
        assert r["kept"] == (not failed and not r["failed_rules"])


def test_values(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    got = {r["doc_id"]: r["measured"] for r in rules.measure(spark, docs).collect()}
    for d in docs.collect():
        assert got[d["doc_id"]][:5] == expected_values(d["text"]) and got[d["doc_id"]][5] == -got[d["doc_id"]][6]


def test_binomial():
    """Against sums of exact fractions."""
    for n, p in [(1, Fraction(1, 2)), (7, Fraction(3, 10)), (60, Fraction(1, 100)), (400, Fraction(1, 50)), (900, Fraction(9, 10))]:
        total = Fraction(0)
        for k in range(n + 1):
            total += comb(n, k) * p**k * (1 - p) ** (n - k)
            assert rules.below(k, n, float(p)) == pytest.approx(float(total), rel=1e-9, abs=1e-13)
    assert rules.below(2_800_000, 10**9, 0.003) < 1e-300 and 0.49 < rules.below(3_000_000, 10**9, 0.003) < 0.51


def sample(seed, n=9000):
    """(doc_id, stratum, measured, base_failed, good): the first rule tells bad from good, the others don't."""
    rng, out = random.Random(seed), []
    for i in range(n):
        good = rng.random() < 0.8
        first = int(rng.expovariate(1 / 20)) + (0 if good else rng.randrange(200))
        out.append((i, None if i % 5 == 0 else "x", [first, *[rng.randrange(50) for _ in range(6)]], rng.random() < 0.05, good))
    return out


def test_cutoffs(spark):
    """The chosen cutoffs are those of a search over all values, and their risk on new documents stays within the bound."""
    data, risk, confidence = sample(1), 0.1, 0.9
    table = spark.createDataFrame([r[:4] for r in data], "doc_id long, stratum string, measured array<bigint>, base_failed boolean")
    labels = spark.createDataFrame([(r[0], r[4]) for r in data] + [(0, None), (None, True), (10**9, True)], "doc_id long, good boolean")
    got = {(r["stratum"], r["rule"]): r for r in rules.certify(table, labels, risk, confidence).collect()}
    want, k = {}, len(rules.RULES)
    for s in (None, "x"):
        held = [r for r in data if r[1] == s and not r[3]]
        n_good = sum(r[4] for r in held)
        for j, rule in enumerate(rules.RULES):
            options = []
            for cut in {r[2][j] for r in held}:
                good, bad = (sum(r[2][j] >= cut for r in held if r[4] == g) for g in (True, False))
                gain = bad / (len(held) - n_good) - good / n_good
                if gain >= risk and rules.below(good, n_good, risk / k) <= (1 - confidence) / (2 * k):
                    options.append((gain, cut, good, bad))
            if options:
                want[s, rule] = max(options)[1:]
    assert {x: (r["cutoff"], r["k_good"], r["k_bad"]) for x, r in got.items()} == want and set(want) == {(None, "symbols"), ("x", "symbols")}
    judged = rules.judge(table, rules.certify(table, labels, risk, confidence)).collect()
    assert all(r["kept"] == (not r["base_failed"] and r["measured"][0] < want[r["stratum"], "symbols"][0]) for r in judged)
    new = [r for r in sample(2, 40_000) if r[4] and not r[3]]
    assert sum(r[2][0] >= want[r[1], "symbols"][0] for r in new) < risk * len(new)


def test_few_labels_certify_nothing(spark):
    table = spark.createDataFrame([(i, "x", [900 if i < 5 else 0] + [0] * 6, False) for i in range(30)], "doc_id long, stratum string, measured array<bigint>, base_failed boolean")
    labels = spark.createDataFrame([(i, i >= 5) for i in range(30)], "doc_id long, good boolean")
    assert rules.certify(table, labels).count() == 0 and rules.judge(table, rules.certify(table, labels)).filter("kept").count() == 30
    assert rules.certify(table, labels.limit(0)).count() == 0


def test_cases(spark):
    line = "the same line of seven words here\n"
    rows = [(1, None, None), (2, "", "a"), (3, line * 2, "a"), (3, line * 2, "a"), (None, "one two " * 6, None), (4, "é#  \n \n" * 20, "b"), (5, " ".join(f"w{i}" for i in range(400_000)) + " w1 w2 w3 w4 w5", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit(1)).withColumn("good", F.lit("x"))
    labels = spark.createDataFrame([(3, True), (3, False), (None, True)], "doc_id long, good boolean")
    got = defaultdict(list)
    for r in rules.apply_rules(spark, d, labels).collect():
        got[r["doc_id"]].append((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["kept"]))
    assert got[1] == got[2] == [(0, 0, 0, 0, 0, False)] and got[3] == [(14, 54, 0, 1, 14, False)] * 2
    assert got[None] == [(12, 36, 0, 0, 12, False)] and got[4] == [(20, 40, 20, 19, 20, False)]
    assert got[5][0][0] == 400_005 and got[5][0][4] == 10 and got[5][0][5]
    assert rules.apply_rules(spark, d.limit(0), labels).count() == 0
