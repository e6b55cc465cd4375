"""The automaton scan, the containment join and the trigram join against slower, plainer versions."""

import random
import re

import pytest

from foliomill.functions import aliases
from foliomill.operators import extraction, trigram


def one_by_one(text, names, longest_first=True):
    """A pass over the text for each name."""
    names = sorted(names, key=lambda x: -len(x[0])) if longest_first else names
    taken, out = set(), []
    for name, key in names:
        if name:
            for m in re.finditer(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])", text):
                if not taken & set(range(*m.span())):
                    taken |= set(range(*m.span()))
                    out.append((*m.span(), key))
    return out


def invented(rng, n, most):
    return "".join(rng.choice("aab_ .é") for _ in range(rng.randrange(most))) if n is None else [(invented(rng, None, most), i) for i in range(n)]


@pytest.mark.parametrize("longest_first", [True, False])
def test_automaton(longest_first):
    rng = random.Random(4)
    for _ in range(800):
        names, text = invented(rng, rng.randrange(12), 6), invented(rng, None, 40)
        assert sorted(aliases.Dictionary(names, longest_first).spans(text)) == sorted(one_by_one(text, names, longest_first)), (names, text)


def test_many_names_in_slices(spark):
    """A large dictionary; slices of it give what the whole gives."""
    names = [(f"name {i}", i % 977) for i in range(100_000)] + [("name", -1), ("name 7", -2)]
    texts = [(i, f"name {i} name {i * 7 % 100_000}x name {i * 31 % 100_000} name") for i in range(300)] + [(300, None), (301, "")]
    c = spark.createDataFrame(texts, "chunk_id long, content string")
    whole = {tuple(r) for r in aliases.scan_aliases(c, names).collect()}
    assert whole == {tuple(r) for r in aliases.scan_aliases(c, names, most=300_000).collect()} and len(aliases.slices(names, 300_000)) > 2
    assert (7, 7, 1) in whole and (7, -1, 2) in whole and not any(k == -2 for _, k, _ in whole)
    assert aliases.scan_aliases(c, []).count() == 0


def test_containment(spark):
    rng = random.Random(8)
    words = ["ab", "Ba", "c", "Dé", "x1"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "-", ""]) for _ in range(rng.randrange(n)))
    chunks = [(rng.choice(["p", "q"]), i % 9, i, i, rng.choice([text(25), None, ""])) for i in range(150)]
    anchors = [(i, rng.choice(["p", "q", "z"]), rng.randrange(5), rng.randrange(4, 10), rng.choice([text(8), None, "", "B", "é", "AB BA"])) for i in range(120)]
    c = spark.createDataFrame(chunks, "book_id string, chapter_num long, chunk_index long, chunk_id long, content string")
    a = spark.createDataFrame(anchors, "anchor_id long, book_id string, lo long, hi long, needle string")
    want = {(i, x[3]) for i, b, lo, hi, n in anchors if n for x in chunks if x[0] == b and lo <= x[1] <= hi and n.lower() in (x[4] or "").lower()}
    got = extraction.containment(c, a)
    assert {(r["anchor_id"], r["chunk_id"]) for r in got.collect()} == want and len(want) > 300
    first = {r["anchor_id"]: r["chunk_id"] for r in extraction.first_match(c, a).collect()}
    order = {x[3]: (x[1], x[2]) for x in chunks}
    assert first == {i: min((c for j, c in want if j == i), key=order.get) for i in {j for j, _ in want}}
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert extraction.containment(c, a.filter("needle is null")).count() == 0


def grams(text):
    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) + 1)}


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.75, 1.0])
def test_trigrams(spark, threshold):
    """Ties at the threshold, equal texts, texts without words."""
    rng = random.Random(2)
    words = ["Klein", "klien", "Kleine", "Moretti", "Moreti", "x", "of", "é"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(4)))) for i in range(150)] + [(150, None), (151, "--"), (152, "Klein!")]
    d = spark.createDataFrame(rows, "id long, name string")
    first = {}
    for i, t in rows:
        if t is not None:
            first.setdefault(t, i)
    texts = [(i, grams(t)) for t, i in first.items() if grams(t)]
    want = {(i, j): len(a & b) / len(a | b) for i, a in texts for j, b in texts if i < j and len(a & b) / len(a | b) >= threshold}
    got = {(r["a"], r["b"]): r["similarity"] for r in trigram.similar_pairs(d, "id", "name", threshold).collect()}
    assert got == want and want
    near = trigram.similar_to(d, "name", "klein moretti", threshold).collect()
    q = grams("klein moretti")
    assert {r["id"] for r in near} == {i for i, t in rows if t and grams(t) and len(grams(t) & q) / len(grams(t) | q) >= threshold}
    who = {(r["text_id"], r["id"]) for r in trigram.members(d, "id", "name").collect()}
    assert who == {(first[t], i) for i, t in rows if t is not None}


def test_trigrams_of_one_host(spark, monkeypatch):
    """A trigram that all texts have is dealt into cells of bounded size, which find each pair once."""
    rows = [(i, f"http://host.example.net/en/{i * 37 % 1000}{'#top' * (i % 3 == 0)}") for i in range(300)]
    sizes, cell = spark.sparkContext.accumulator(0), trigram._cell

    def watched(threshold):
        run = cell(threshold)

        def bounded(t):
            assert t.num_rows < 100
            sizes.add(1)
            return run(t)

        return bounded

    monkeypatch.setattr(trigram, "BLOCK", 32)
    monkeypatch.setattr(trigram, "COLUMNS", 7)
    monkeypatch.setattr(trigram, "_cell", watched)
    got = [(r["a"], r["b"], r["similarity"]) for r in trigram.similar_pairs(spark.createDataFrame(rows, "id long, url string"), "id", "url").collect()]
    sets = [(i, grams(t)) for i, t in rows]
    want = [(i, j, len(a & b) / len(a | b)) for i, a in sets for j, b in sets if i < j and len(a & b) / len(a | b) >= 0.6]
    assert sorted(got) == sorted(want) and len(want) > 10_000 and sizes.value > 100


def test_trigrams_of_one_host_are_shuffled_once(spark, monkeypatch):
    """Twice the texts are twice the shuffle, though each meets twice as many; pairs come from both sides of the cut."""
    monkeypatch.setattr(trigram, "BLOCK", 8)
    bus, status = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def written():
        bus.waitUntilEmpty(30_000)
        return status.executorSummary("driver").totalShuffleWrite()

    def shuffled(n):
        rows = [(i, f"http://host.example.net/en/{i * 7919 % 100_003}") for i in range(n)]
        before = written()
        got = [(r["a"], r["b"], r["similarity"]) for r in trigram.similar_pairs(spark.createDataFrame(rows, "id long, url string"), "id", "url", 0.7).collect()]
        took, sets = written() - before, [(i, grams(t)) for i, t in rows]
        want = [(i, j, len(a & b) / len(a | b)) for i, a in sets for j, b in sets if i < j and len(a & b) / len(a | b) >= 0.7]
        assert sorted(got) == sorted(want) and len(want) > n / 2
        return took

    assert shuffled(600) < 2.4 * shuffled(300)


def test_few_needles_in_one_pass(spark, monkeypatch):
    """A word or two are looked for as they are: no runs of characters are made; many are found by runs, alike."""
    c = spark.createDataFrame([(b, i, 0, i, t) for b in ("p", "q") for i, t in enumerate(["a LICENSE", "sublicensed", None, "", "licens e", "mit license."])], "book_id string, chapter_num long, chunk_index long, chunk_id long, content string")
    a = spark.createDataFrame([(1, "p", 0, 9, "License"), (2, "q", 1, 4, "LICENSE"), (3, "p", 0, 9, "t l"), (4, "q", 0, 9, "none"), (5, "z", 0, 9, "a"), (6, "q", 0, 9, None)], "anchor_id long, book_id string, lo long, hi long, needle string")
    rows = lambda: sorted((r["anchor_id"], r["chunk_id"]) for r in extraction.containment(c, a).collect())
    want = [(1, 0), (1, 1), (1, 5), (2, 1), (3, 5)]
    with monkeypatch.context() as m:
        m.setattr(extraction, "FEW", 0)
        assert rows() == want
    monkeypatch.setattr(extraction, "_keyed", None)
    assert rows() == want
    assert sorted((r["anchor_id"], r["chunk_id"]) for r in extraction.first_match(c, a).collect()) == [(1, 0), (2, 1), (3, 5)]
