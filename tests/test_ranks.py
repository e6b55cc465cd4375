"""Distributed ranks and the binned interval join against plain Python, and their plans."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliomill.operators import ranks, rollup
from foliomill.plans import queries


def test_row_numbers(spark):
    """Nulls, one group with most rows, many ranges."""
    rng = random.Random(1)
    data = [(rng.choice([None, "hot", "hot", "hot", "a", "b"]), rng.choice([None, *range(500)]), i) for i in range(3000)]
    d = spark.createDataFrame(data, "book string, n long, id long").repartition(7)
    want = defaultdict(int)
    key = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])
    expected = {}
    for r in sorted(data, key=key):
        want[r[0]] += 1
        expected[r[2]] = want[r[0]]
    assert {r["id"]: r["rank"] for r in ranks.row_numbers(d, ["book"], ["n", "id"]).collect()} == expected
    assert ranks.row_numbers(d.limit(0), ["book"], ["n"]).count() == 0
    first = [r[2] for r in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]
    for cap in (0, 1, 777, 5000):
        assert {r["id"] for r in ranks.first_rows(d, cap, ["n", "id"]).collect()} == set(first[:cap])


def test_running_totals(spark):
    """Nulls and negative values, one group with most rows."""
    rng = random.Random(5)
    data = [(rng.choice([None, "hot", "hot", "a"]), i, rng.choice([None, -3, 0, 5, 9])) for i in range(2000)]
    d = spark.createDataFrame(data, "book string, id long, v long").repartition(5)
    want, sums = {}, defaultdict(int)
    for b, i, v in sorted(data, key=lambda r: r[1]):
        sums[b] += v or 0
        want[i] = sums[b]
    assert {r["id"]: r["total"] for r in ranks.running_totals(d, ["book"], ["id"], "v").collect()} == want
    assert {r["id"] for r in ranks.within_budget(d, ["book"], ["id"], "v", 100).collect()} == {i for i, t in want.items() if t <= 100}
    assert ranks.running_totals(d.limit(0), [], ["id"], "v").count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_window_over_a_book(spark):
    sf = "/root/testdata/sf0.001"
    windows = re.findall(r"windowspecdefinition\((.*?)\)", plan(queries.chapters(spark, sf)))
    assert windows and all("_range" in w and "doc_id" not in w for w in windows)  # over ranges of a book only
    assert plan(queries.QUERIES["plan_next_level"](spark, sf)).count("Scan parquet") < 10


@pytest.mark.parametrize("width", [1, 7, 512])
def test_interval_join(spark, monkeypatch, width):
    """Ranges within a bin, over many bins, empty ones and books without any; and each bin is a key of its own."""
    monkeypatch.setattr(rollup, "BIN", width)
    rng = random.Random(width)
    c = [(b, n) for b in ("x", None, "y") for n in range(1, 200)]
    r, at = [], {}
    for b in ("x", None):
        lo = 1
        while lo < 200:
            hi = lo + rng.choice([0, 3, 60])
            r.append((b, lo, hi, len(r)))
            at |= {(b, n): len(r) - 1 for n in range(lo, hi + 1)}
            lo = hi + 1
    chapters = spark.createDataFrame(c, "book_id string, chapter_num long")
    ranges = spark.createDataFrame([*r, ("x", 50, 40, 999)], "book_id string, range_start long, range_end long, arc long")
    got = rollup.assign_ranges(chapters, ranges)
    assert {(x["book_id"], x["chapter_num"]): x["arc"] for x in got.collect()} == {k: v for k, v in at.items() if k in set(c)}
    s = chapters.withColumns({"volume": F.lit(1), "volume_name": F.lit("v"), "arc": F.col("chapter_num") % 5, "arc_name": F.lit("n"), "content_kind": F.lit("main")})
    sums = ranges.select(F.lit("series").alias("level"), "book_id", "range_start", "range_end", F.col("arc").cast("string").alias("label"))
    meta = {x["label"]: x["arc_count"] for x in rollup.summary_metadata(sums, s).collect()}
    assert meta == {str(i): len({n % 5 for n in range(lo, min(hi, 199) + 1)}) for _, lo, hi, i in [*r, ("x", 50, 40, 999)]}
