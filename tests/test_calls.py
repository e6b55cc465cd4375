"""Model calls: how many run at once, what goes first, what is asked again, and what is refused."""

import json
import os
import time
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliomill.functions import calls, chunking
from foliomill.operators import generation


def recorder(folder, blank=lambda own, n: False):
    """A model that writes down when each call began and ended."""

    def model(shared, own):
        earlier = [json.loads(open(f"{folder}/{f}").read()) for f in os.listdir(folder) if f[0] != "."]
        began, seen = time.time(), sum(x["own"] == own for x in earlier)
        time.sleep(0.03)
        with open(f"{folder}/.{uuid.uuid4().hex}", "w") as f:
            json.dump({"shared": shared, "own": own, "began": began, "ended": time.time(), "pid": os.getpid()}, f)
        os.rename(f.name, f.name.replace("/.", "/"))
        return calls.Reply("" if blank(own, seen) else f" {own} ", no_cache=len(own), cache_read=2, cache_write=3, output=4)

    return model


def written(folder):
    return [json.loads(open(f"{folder}/{f}").read()) for f in os.listdir(folder) if f[0] != "."]


def test_pool(spark, tmp_path):
    """At most so many at once in a task; the first call of a prompt is over before the others of that prompt begin; each row once."""
    rows = spark.range(60).selectExpr("id", "concat('p', id % 3) p", "concat('row ', id) q")
    got = calls.ask(rows, F.col("p"), F.col("q"), recorder(tmp_path), concurrency=5, batch=1).collect()
    assert sorted((r["id"], r["answer"]) for r in got) == [(i, f"row {i}") for i in range(60)]
    assert all(tuple(r["usage"]) == (len(r["q"]), 2, 3, 4, 1) for r in got)
    log = written(tmp_path)
    assert len(log) == 60 and len({x["pid"] for x in log}) == 1
    at_once = max(sum(y["began"] <= x["began"] < y["ended"] for y in log) for x in log)
    assert 2 <= at_once <= 5
    for p in ("p0", "p1", "p2"):
        own = sorted((x for x in log if x["shared"] == p), key=lambda x: x["began"])
        assert own[0]["ended"] <= own[1]["began"]


def test_blanks(spark, tmp_path):
    """A blank is asked again, as often as stated; its calls are counted."""
    rows = spark.createDataFrame([(1, "once"), (2, "never"), (3, None)], "id long, q string")
    model = recorder(tmp_path, blank=lambda own, n: own == "never" or own == "once" and n == 0)
    got = {r["id"]: r for r in calls.ask(rows, F.lit("p"), F.col("q"), model, tries=2).collect()}
    assert [(got[i]["answer"], got[i]["usage"]["calls"]) for i in (1, 2, 3)] == [("once", 2), ("", 2), ("", 2)]
    assert calls.ask(rows.limit(0), F.lit("p"), F.col("q"), model).count() == 0
    with pytest.raises(ValueError, match="answer"):
        calls.ask(rows.withColumn("Answer", F.lit(1)), F.lit("p"), F.col("q"), model)


def test_calls_are_made_once(spark, tmp_path):
    """Rows and usage come from one evaluation; stopped chunks cost none; a session's cues go with its chunk."""
    chunks = spark.createDataFrame([(1, 7, 0, "he was killed"), (2, 7, 1, "calm"), (3, 7, 2, "above the grey fog"), (4, 8, 0, "he died")], "chunk_id long, chapter_id long, chunk_index long, content string").withColumns({"book_id": F.lit("b"), "chapter_num": F.lit(1)})
    types = spark.createDataFrame([(1, ["character"]), (2, ["character"]), (3, ["organization"]), (4, ["location"])], "chunk_id long, types array<string>")
    entities = spark.createDataFrame([(5, "he", [], "character")], "entity_id long, canonical_name string, aliases array<string>, entity_type string")
    chapters = spark.createDataFrame([(7, 'T "x"', "body"), (8, "U", None)], "chapter_id long, header string, raw_text string")
    made = generation.extract_events(chunks, types, entities, chapters, recorder(tmp_path), "catalog")
    made.rows.count(), made.usage.count(), made.rows.count()
    log = written(tmp_path)
    assert len(log) == 2 and {x["shared"] for x in log} == {'catalog\n\n<document title="T \\"x\\"">\nbody\n</document>'}
    assert sum(x["own"].startswith("In session: above-the-Grey-Fog\n\n<chunk>\nabove") for x in log) == 1
    assert {r["chapter_id"]: (r["chunks"], r["gated"], r["calls"], r["output"]) for r in made.usage.collect()} == {7: (3, 1, 2, 8), 8: (1, 1, 0, 0)}


def test_gate_runs_once(spark, tmp_path, monkeypatch):
    """Session cues and prompts read the chunks that one run of the gates let through."""
    seen, gate = spark.sparkContext.accumulator(0), generation.event_gate

    def counted(own, types):
        @F.udf("boolean")
        def count(_):
            seen.add(1)
            return True

        return gate(own, types).filter(count.asNondeterministic()("chunk_id"))

    monkeypatch.setattr(generation, "event_gate", counted)
    chunks = spark.range(20).selectExpr("id chunk_id", "id % 3 chapter_id", "'b' book_id", "1 chapter_num", "if(id % 2 = 0, 'he died', 'calm') content")
    types = chunks.select("chunk_id", F.array(F.lit("character")).alias("types"))
    entities = spark.createDataFrame([(5, "he", [], "character")], "entity_id long, canonical_name string, aliases array<string>, entity_type string")
    chapters = spark.range(3).selectExpr("id chapter_id", "'T' header", "'body' raw_text")
    made = generation.extract_events(chunks, types, entities, chapters, recorder(tmp_path), "catalog")
    assert made.usage.agg(F.sum("calls"), F.sum("gated")).first()[:] == (10, 10) and made.rows.count() == 0
    assert len(written(tmp_path)) == 10 and seen.value == 10


def test_alignment(spark, tmp_path):
    chapters = spark.createDataFrame([(7, "T", "body")], "chapter_id long, header string, raw_text string")
    for bad in ([(7, 0, "a"), (7, 0, "b")], [(7, 0, "a"), (9, 0, "b")]):
        chunks = spark.createDataFrame(bad, "chapter_id long, chunk_index long, content string")
        with pytest.raises(ValueError, match="prefixes"):
            generation.contextual_prefixes(chunks, chapters, recorder(tmp_path))


def test_summary_vectors(spark, tmp_path):
    """Exactly one vector for a content."""
    t = spark.createDataFrame([("arc", "b", 1, 2, "L", "s", "u")], "level string, book_id string, range_start long, range_end long, label string, system string, user string")
    good = generation.summarise(t, recorder(tmp_path))
    assert [(r["content"], len(r["embedding"])) for r in good.rows.collect()] == [("u", 64)]
    assert [tuple(r) for r in good.usage.collect()] == [("arc", 1, 2, 3, 4, 1)]
    with pytest.raises(Exception, match="one vector"):
        generation.summarise(t, recorder(tmp_path), lambda texts: [[1.0]] * (len(texts) + 1)).rows.collect()


def test_chapters_in_bounded_batches(monkeypatch):
    """A large batch of chapters leaves in small ones; nothing is lost."""
    monkeypatch.setattr(chunking, "BATCH_CHARS", 1000, raising=False)
    texts = [None, "", *("\n\n".join(f"word {i} {j}." * 5 for j in range(20)) for i in range(40))]
    out = list(chunking._chunks([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["chapter_id", "raw_text"])]))
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows == [(i, j, c, n) for i, t in enumerate(texts) for j, (c, n) in enumerate(chunking.chunk_chapter(t or ""))]
    assert len(out) > 30 and all(sum(map(len, b.column("content").to_pylist())) < 5000 for b in out)


def test_prompts_in_bounded_batches(monkeypatch):
    """A large batch is asked in parts by its prompts' bytes, in order; a shared prompt that goes on is still asked first once."""
    monkeypatch.setattr(calls, "BATCH_BYTES", 1000, raising=False)
    shared, own = [*("s" * 300 for _ in range(20)), None, "t"], [*(str(i) for i in range(20)), None, "o" * 3000]
    b = pa.RecordBatch.from_arrays([pa.array(shared), pa.array(own), pa.array(range(22))], ["_shared", "_own", "n"])
    out = list(calls._asking(lambda s, o: calls.Reply(f"{len(s)} {o}", output=1), 4, 1)([b, b.slice(0, 0)]))
    rows = [r for x in out for r in x.to_pylist()]
    assert [(r["n"], r["answer"]) for r in rows] == [(i, f"{len(s or '')} {o or ''}".strip()) for i, (s, o) in enumerate(zip(shared, own, strict=True))]
    assert len(out) > 6 and all(x.num_rows <= 5 for x in out) and {r["usage"]["calls"] for r in rows} == {1}
