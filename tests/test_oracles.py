"""Every query against its DuckDB SQL on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from foliomill.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def same(spark, f, sql):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = c.sql(sql)
    names = sorted(want.columns)
    df = f(spark, SF)
    assert sorted(df.columns) == names
    got = sorted((tuple(norm(r[n]) for n in names) for r in df.collect()), key=repr)
    at = [want.columns.index(n) for n in names]
    exp = sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert len(got) == len(exp)
    assert got == exp


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.fixture(scope="module")
def odd_talks(tmp_path_factory):
    """A talk of over 1000 turns, whose numbers reach into the next one's, and trigger words in texts of odd length."""
    at = tmp_path_factory.mktemp("talks")
    texts = ["A duel", "A duels", "killed.", "the Justice, The Fool and the Moon", "The Justice; The Fool; The Sun", "above the grey fog", "Tarot Club.", "plain"]
    rows = [(7, i, ("user", "assistant", "system")[i % 3], texts[i % len(texts)]) for i in range(1100)] + [(8, i, ("system", "user")[i % 2], texts[-i % len(texts)]) for i in range(90)]
    c = duckdb.connect()
    c.execute("CREATE TABLE t (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    c.sql(f"COPY t TO '{at}/conversations.parquet'")
    return str(at)


def test_event_extraction_of_odd_talks(spark, odd_talks, monkeypatch):
    monkeypatch.setitem(globals(), "SF", odd_talks)
    same(spark, QUERIES["event_extraction"], ORACLES["event_extraction"])


def test_event_usage_of_odd_talks(spark, odd_talks, monkeypatch):
    monkeypatch.setitem(globals(), "SF", odd_talks)
    same(spark, QUERIES["event_usage"], ORACLES["event_usage"])


def test_lexeme_counts_beside_stopwords(spark, tmp_path, monkeypatch):
    """A stem that is a stopword itself goes; the stem of a stopword that no text has stays."""
    c = duckdb.connect()
    c.sql("CREATE TABLE d AS SELECT * FROM (VALUES (1::BIGINT, 'doesed summarising having', 'en', 'src0', 25::BIGINT), (2, 'haves have DOESED the list lists', 'en', 'src0', 33), (3, NULL, 'en', 'src0', 0), (4, '', 'en', 'src0', 0)) t(doc_id, text, lang, source, n_chars)")
    c.sql(f"COPY d TO '{tmp_path}/documents.parquet'")
    monkeypatch.setitem(globals(), "SF", str(tmp_path))
    same(spark, QUERIES["lexeme_counts"], ORACLES["lexeme_counts"])
    assert [r["lexeme"] for r in QUERIES["lexeme_counts"](spark, str(tmp_path)).collect()] == ["summaris"]
