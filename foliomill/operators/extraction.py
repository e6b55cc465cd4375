"""From chunks to mentions and events: gates in order, resolvers, merge of a model's mentions with alias hits."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aliases, llm_json, models, text
from ..sources.shared import stored
from .accounting import ROLE_RANKS
from .quality import drawn


def entity_types(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_id, types): the distinct types of the entities that a chunk mentions; there are five types."""
    rows = mentions.select("entity_id", "chunk_id").join(entities.select("entity_id", "entity_type"), "entity_id")
    return rows.groupBy("chunk_id").agg(F.array_sort(F.collect_set("entity_type")).alias("types"))


def event_gate(chunks: DataFrame, types: DataFrame) -> DataFrame:
    """Chunks (chunk_id, content) that a model is asked about events: the entity types first, then a keyword or a session."""
    typed = chunks.join(types.filter(text.entity_type_gate(F.col("types"))).select("chunk_id"), "chunk_id", "left_semi")
    session = aliases.detect_sessions(typed).select("chunk_id", "in_session").filter("in_session")
    by_word = typed.withColumn("keyword", text.keyword_gate(F.col("content")))
    return by_word.join(session, "chunk_id", "left").filter(F.col("keyword") | F.col("in_session").isNotNull()).select(*chunks.columns)


def names_of(entities: DataFrame, last: bool = False) -> DataFrame:
    """(key, entity_id, entity_type): who a name or alias without case means. The entity loaded first (or last) wins; entity_id is the load order."""
    forms = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = entities.select("entity_id", "entity_type", F.explode(forms).alias("name")).select("entity_id", "entity_type", F.lower(text.trim(F.col("name"))).alias("key")).filter("key <> ''")
    pick = (F.max_by if last else F.min_by)(F.struct("entity_id", "entity_type"), "entity_id")
    return rows.groupBy("key").agg(pick.alias("x")).select("key", "x.entity_id", "x.entity_type")


def resolve_events(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Events (entity_canonical_name, event_type, ...) with their entity_id; unknown names and types that can't have the event are left out."""
    names = names_of(entities)
    rows = events.withColumn("key", F.lower(text.trim(F.col("entity_canonical_name")))).join(names, "key")
    return rows.filter(llm_json.allowed(F.col("event_type"), F.col("entity_type"))).select(*events.columns, "entity_id")


def merge_mentions(answered: DataFrame, hits: DataFrame) -> DataFrame:
    """(chunk_id, entity_id, role): of a model's mentions (chunk_id, entity_id, role) the role of highest rank; entities that only an alias found are "mentioned"."""
    rank = F.create_map(*[x for k, v in ROLE_RANKS.items() for x in (F.lit(k), F.lit(v))])
    said = answered.select("chunk_id", "entity_id", F.lit(1).alias("said"), F.coalesce(F.try_element_at(rank, F.col("role")), F.lit(0)).alias("rank"), "role")
    found = hits.select("chunk_id", "entity_id", F.lit(0).alias("said"), F.lit(0).alias("rank"), F.lit("mentioned").alias("role"))
    best = said.unionByName(found).groupBy("chunk_id", "entity_id").agg(F.max(F.struct("said", "rank", "role")).alias("best"))
    return best.select("chunk_id", "entity_id", "best.role")


def answered_mentions(chunks: DataFrame, hits: DataFrame, entities: DataFrame, model: models.Generate) -> DataFrame:
    """(chunk_id, name, type, role, entity_id or null) that a model finds in chunks with dialogue or without an alias hit."""
    counts = hits.groupBy("chunk_id").agg(F.count("*").alias("hits"))
    asked = chunks.join(counts, "chunk_id", "left").filter(text.model_gate(F.col("content"), F.col("hits")))
    rows = asked.select("chunk_id", F.explode(llm_json.parse_mentions(models.generate(F.col("content"), model, fallback="[]"))).alias("m")).select("chunk_id", "m.*")
    return rows.withColumn("key", F.lower("name")).join(names_of(entities, last=True).select("key", "entity_id"), "key", "left").drop("key")


GRAM, FEW = 4, 32
APART = r"[^\p{L}\p{N}]+"


def _keyed(rows: DataFrame, text: str, kind: int) -> DataFrame:
    """Rows with key, once for each thing that a text can be found by: its words (kind 0) or its runs of kind characters; it may repeat."""
    low = F.lower(text)
    if kind == 0:
        return rows.withColumn("key", F.explode(F.split(low, APART))).drop(text)
    chars, n = F.split(low, ""), F.length(low) - kind + 1
    runs = F.arrays_zip(*[F.slice(chars, F.lit(j + 1), F.greatest(n, F.lit(0))).alias(f"c{j}") for j in range(kind)])
    return rows.withColumn("run", F.explode(runs)).withColumn("key", F.concat(*[F.col(f"run.c{j}") for j in range(kind)])).drop(text, "run")


def containment(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor_id, chunk_id, chapter_num, chunk_index): chunks of an anchor's book and chapters (lo to hi) that hold its needle without case.

    Up to ``FEW`` different needles of fewer than three words are looked for as they are, in one pass over the texts. Of the others,
    a needle's words but the first and last are words of every text that holds it; a needle of fewer has its runs of ``GRAM``
    characters, or is one. The one that the fewest chunks of its book have is its key: chunks and needles are joined on (book, key),
    and only these pairs are looked into. A needle that is null or empty is in no chunk.
    """
    low = F.lower("needle")
    inner = F.filter(F.slice(F.split(low, APART), F.lit(2), F.greatest(F.size(F.split(low, APART)) - 2, F.lit(0))), lambda w: w != "")
    needles = anchors.filter("length(needle) > 0").select("anchor_id", "book_id", "lo", "hi", low.alias("low"), inner.alias("inner"))
    needles = needles.withColumn("kind", F.when(F.size("inner") > 0, 0).otherwise(F.least(F.length("low"), F.lit(GRAM))))
    found, few = [], [r["low"] for r in needles.filter("kind > 0").select("low").distinct().limit(FEW + 1).collect()]
    if 0 < len(few) <= FEW:
        low = F.lower("content")
        held = chunks.select("book_id", "chapter_num", "chunk_index", "chunk_id", F.explode(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in few]))).alias("low"))
        met = held.join(needles.filter("kind > 0").drop("inner", "kind"), ["book_id", "low"]).filter("chapter_num between lo and hi")
        found.append(met.select("anchor_id", "chunk_id", "chapter_num", "chunk_index"))
        needles = needles.filter("kind = 0")
    for kind in sorted(r["kind"] for r in needles.select("kind").distinct().collect()):  # 0 to GRAM
        own = needles.filter(F.col("kind") == kind)
        own = own.withColumn("key", F.explode("inner")) if kind == 0 else _keyed(own.withColumn("text", F.col("low")), "text", kind)
        wanted = own.select("book_id", "key").distinct()
        held = _keyed(chunks.select("book_id", "chapter_num", "chunk_index", "chunk_id", "content"), "content", kind)
        held = stored(held.join(wanted, ["book_id", "key"], "left_semi").distinct(), "keys")
        own = own.join(held.groupBy("book_id", "key").agg(F.count("*").alias("n")), ["book_id", "key"], "left").fillna(0, ["n"])
        rarest = own.groupBy("anchor_id", "book_id", "lo", "hi", "low").agg(F.min_by("key", F.struct("n", "key")).alias("key"))
        pairs = held.join(rarest, ["book_id", "key"]).filter("chapter_num between lo and hi").select("anchor_id", "low", "chunk_id", "chapter_num", "chunk_index")
        met = pairs.join(chunks.select("chunk_id", "content"), "chunk_id").filter(F.contains(F.lower("content"), F.col("low")))
        found.append(met.select("anchor_id", "chunk_id", "chapter_num", "chunk_index"))
    if not found:
        return anchors.select("anchor_id").limit(0).crossJoin(chunks.select("chunk_id", "chapter_num", "chunk_index").limit(0))
    return functools.reduce(DataFrame.unionAll, found).distinct()


def first_match(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """The first chunk, by chapter and place, of each anchor (anchor_id, book_id, lo, hi, needle) that holds its needle without case."""
    first = containment(chunks, anchors).groupBy("anchor_id").agg(F.min(F.struct("chapter_num", "chunk_index", "chunk_id")).alias("x"))
    return first.select("anchor_id", "x.chunk_id", "x.chapter_num", "x.chunk_index")


def gated_pool(chunks: DataFrame, types: DataFrame, seed: int, pool: int = 500, quota: int = 15) -> DataFrame:
    """quota chunks with a keyword out of a seeded pool of those that mention a character or an organization."""
    typed = chunks.join(types.filter(text.entity_type_gate(F.col("types"))).select("chunk_id"), "chunk_id", "left_semi").withColumn("draw", drawn(seed, "chunk_id"))
    candidates = typed.orderBy("draw", "chunk_id").limit(pool)
    return candidates.filter(text.keyword_gate(F.col("content"))).orderBy("draw", "chunk_id").limit(quota)
