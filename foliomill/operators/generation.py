"""What a model writes: contextual prefixes, events, summaries. Each operator makes its calls once, into a written table, and returns rows and usage."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aliases, calls, llm_json, models, text
from ..sources.shared import stored
from .extraction import event_gate, resolve_events


class Made(NamedTuple):
    """Rows, and the tokens and calls by chapter or level."""

    rows: DataFrame
    usage: DataFrame


def _chunk(content: Column, task: str) -> Column:
    return F.concat(F.lit("<chunk>\n"), F.coalesce(content, F.lit("")), F.lit(f"\n</chunk>\n\n{task}"))


SITUATE = "Say in a few words where this chunk stands in the document."
EXTRACT = "List the events of this chunk as a JSON array."


def _with_chapters(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chunks with the block of their chapter (chapter_id, header, raw_text)."""
    title = F.to_json(F.struct(F.col("header").alias("t")))  # {"t":"..."}: its value is the title as JSON
    block = F.concat(F.lit("<document title="), F.substr(title, F.lit(6), F.length(title) - 6), F.lit(">\n"), F.coalesce("raw_text", F.lit("")), F.lit("\n</document>"))
    return chunks.join(chapters.select("chapter_id", block.alias("block")), "chapter_id")


def contextual_prefixes(chunks: DataFrame, chapters: DataFrame, model: calls.Model, primer: str = "", concurrency: int = calls.CONCURRENCY) -> Made:
    """(chapter_id, chunk_index, contextual_prefix) of every chunk (chapter_id, chunk_index, content), and usage by chapter.

    Chunks of a chapter share the primer and the chapter's block. Each chunk must have exactly one prefix: a repeated chunk_index, or a
    chunk whose chapter isn't there, raises.
    """
    rows = _with_chapters(chunks.select("chapter_id", "chunk_index", "content"), chapters)
    asked = calls.ask(rows, F.concat(F.lit(primer), F.col("block")), _chunk(F.col("content"), SITUATE), model, concurrency)
    made = stored(asked.select("chapter_id", "chunk_index", F.col("answer").alias("contextual_prefix"), "usage"), "prefixes")
    check_aligned(made, chunks)
    return Made(made.drop("usage"), calls.used(made, ["chapter_id"]))


def check_aligned(prefixes: DataFrame, chunks: DataFrame) -> None:
    """Raises unless prefixes and chunks have the same (chapter_id, chunk_index), each once."""
    n = lambda d, name: d.groupBy("chapter_id", "chunk_index").agg(F.count("*").alias(name))
    both = n(chunks, "wanted").join(n(prefixes, "got"), ["chapter_id", "chunk_index"], "full")
    if bad := both.filter("coalesce(wanted, 0) <> 1 or coalesce(got, 0) <> 1").limit(1).collect():
        raise ValueError(f"chunk {bad[0]['chunk_index']} of chapter {bad[0]['chapter_id']} is there {bad[0]['wanted'] or 0} times and has {bad[0]['got'] or 0} prefixes")


def extract_events(chunks: DataFrame, types: DataFrame, entities: DataFrame, chapters: DataFrame, model: calls.Model, catalog: str, concurrency: int = calls.CONCURRENCY) -> Made:
    """Events of chunks (chunk_id, chapter_id, book_id, chapter_num, content): gates, model, parser, names, in this order.

    types are (chunk_id, types). Chunks that the gates stop cost no call. The catalog and the chapter's block are shared by a chapter's
    chunks, and a session's cues go with the chunk. Rows are (entity_id, event_type, chapter_id, book_id, chapter_num, evidence_chunk_id, snippet, extra);
    usage has a row for each chapter: chunks, gated and the counters.
    """
    own = chunks.select("chunk_id", "chapter_id", "book_id", "chapter_num", "content")
    gated = stored(event_gate(own, types), "gated")
    cues = aliases.detect_sessions(gated).filter("in_session").select("chunk_id", "cues")
    rows = _with_chapters(gated, chapters).join(cues, "chunk_id", "left")
    hint = F.when(F.col("cues").isNotNull(), F.concat(F.lit("In session: "), F.array_join("cues", ", "), F.lit("\n\n"))).otherwise("")
    prompt = F.concat(hint, _chunk(F.col("content"), EXTRACT))
    asked = calls.ask(rows, F.concat(F.lit(f"{catalog}\n\n"), F.col("block")), prompt, model, concurrency)
    answers = stored(asked.drop("block", "cues"), "answers")
    found = answers.select("chapter_id", "book_id", "chapter_num", F.col("chunk_id").alias("evidence_chunk_id"), F.explode(llm_json.parse_events(F.col("answer"), F.col("content"))).alias("e"))
    events = resolve_events(found.select("*", "e.*").drop("e"), entities)
    fields = ["entity_id", "event_type", "chapter_id", "book_id", "chapter_num", "evidence_chunk_id", "snippet", "extra"]
    all_ = own.groupBy("chapter_id").agg(F.count("*").alias("chunks"))
    told = answers.groupBy("chapter_id").agg(F.count("*").alias("asked")).join(calls.used(answers, ["chapter_id"]), "chapter_id")
    usage = all_.join(told, "chapter_id", "left").fillna(0).withColumn("gated", F.col("chunks") - F.col("asked"))
    return Made(events.select(*fields), usage.select("chapter_id", "chunks", "gated", *calls.COUNTERS))


def summarise(targets: DataFrame, model: calls.Model, embed: models.Embed = models.hash_embedding, concurrency: int = calls.CONCURRENCY) -> Made:
    """A row for each target with its prompt (level, book_id, range_start, range_end, label, system, user): content and embedding; and usage by level.

    A blank answer is asked for once more and then replaced by a sentence that says so. Each content has exactly one vector, or it raises.
    """
    keys = ["level", "book_id", "range_start", "range_end", "label"]
    asked = calls.ask(targets.select(*keys, "system", "user"), F.col("system"), F.col("user"), model, concurrency, tries=2)
    missing = F.concat(F.lit("Summary unavailable for "), "label", F.lit(" ("), "range_start", F.lit("-"), "range_end", F.lit(")."))
    made = stored(asked.select(*keys, F.when(F.col("answer") != "", F.col("answer")).otherwise(missing).alias("content"), "usage"), "summaries")
    rows = made.select(*keys, "content", models.embed(F.col("content"), embed).alias("embedding"))
    return Made(rows, calls.used(made, ["level"]))


def prefixed(chunks: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Chunks with their prefix and the text they are embedded as."""
    rows = chunks.join(prefixes, ["chapter_id", "chunk_index"], "left")
    return rows.withColumn("embed_text", text.embed_text(F.col("contextual_prefix"), F.col("content")))
