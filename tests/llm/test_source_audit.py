"""The audit's odd inputs; the query itself is checked against SQL."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliomill.llm import source_audit as audit


def brute(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        w = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        docs[lang].update(set(w))
        counts[lang, source].update(w)
    f, out = lambda p, q: (p - q) ** 2 // (p + q), set()
    for lang in docs.keys() | {r[1] for r in rows}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        sources = sorted({s for _, x, s in rows if x == lang})

        def p(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = p(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            own = p(counts[lang, s])
            pairs = [(-sum(f(own[t], other[t]) for t in kept), o) for o in sources if o != s for other in [p(counts[lang, o])]]
            terms = [(-f(own[t], q[t]), t) for t in kept if counts[lang, s][t] and own[t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(items)}
    return out


@pytest.mark.parametrize("held", [400_000, 3])
def test_cases(spark, held):
    """Nulls, ties, equal columns, groups and languages without terms, clashing columns; 3: a task flushes again and again."""
    base = [("Aé b-c b C", "x", f"s{i % 4}") for i in range(40)] + [(" ".join(f"t{chr(97 + i % 7)} u{chr(97 + i % 5)}z" for _ in range(i % 4)), "x", f"s{i % 3}") for i in range(60)]
    rows = base + [(None, None, None), ("", "x", "empty"), ("12 %", "y", "s1"), ("word", "y", "s2"), ("b", None, "s1"), *[("only Straße", "z", "one")] * 12, *[("tie tied", "z", "two")] * 12]
    d = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("n", F.lit("x"))
    for min_docs, top in ((10, 10), (2, 3)):
        assert {tuple(r) for r in audit.audit(spark, d, min_docs, top, held).collect()} == brute(rows, min_docs, top)
    got = audit.audit(spark, d)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and got.schema["rank"].dataType.simpleString() == "int"
    assert audit.audit(spark, d.limit(0)).count() == 0


def test_wide_counts(spark):
    """Counts beyond 64 bits go by decimals, with the same floor."""
    n, total = 9_100_000_001, 123_456_789_012
    row = spark.createDataFrame([(n, total), (5, total), (5, 0)], "n long, total long").selectExpr(f"{audit.share('n', 'total')} p").collect()
    assert [r["p"] for r in row] == [1 + 10**9 * (n + 2) // total, 1 + 10**9 * 7 // total, None]


def broadcasts(df):
    """The columns of each broadcast of a plan."""
    found, open_ = [], [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        if node.nodeName() == "BroadcastExchange":
            found.append({node.output().apply(i).name() for i in range(node.output().size())})
        open_ += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("sent", [4 << 20, 0])
def test_broadcasts(spark, monkeypatch, sent):
    """Tables of terms and columns, small as their files may be, are never broadcast, and groups only if they are few."""
    plans, write = [], audit.Workspace.write

    def watched(self, df, name):
        plans.append(df)
        return write(self, df, name)

    monkeypatch.setattr(audit, "SENT", sent, raising=False)
    monkeypatch.setattr(audit.Workspace, "write", watched)
    rows = [(f"a{chr(97 + i % 5)} b c{chr(97 + i % 3)}", "xy"[i % 7 == 0], f"s{i % 4}") for i in range(60)] + [("", "z", "t")]
    got = audit.audit(spark, spark.createDataFrame(rows, "text string, lang string, source string"), 3, 2)
    found = [names for df in [*plans, got] for names in broadcasts(df)]
    assert len(plans) == 5 and bool(found) == bool(sent) and not any(names & {"cid", "vec", "term", "m", "n"} for names in found)
    assert {tuple(r) for r in got.collect()} == brute(rows, 3, 2)
