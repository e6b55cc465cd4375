"""Parsers of a model's JSON answers, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim, verbatim

#: Event types and the entity types that may have them.
EVENT_SUBJECTS = {
    "sequence_advance": ["character"],
    "digestion": ["character"],
    "meeting": ["organization", "character"],
    "organization_join": ["character"],
    "battle": ["character"],
    "death": ["character"],
    "identity_assume": ["character"],
    "identity_reveal": ["character"],
}
ROLES = ["speaker", "addressee", "mentioned"]
ENTITY_TYPES = ["character", "organization", "pathway", "artifact", "location"]


def json_array(answer: Column, scratchpad: bool = True) -> Column:
    """The text from the first [ to the last ], after the scratchpad; null if there is none."""
    plain = F.regexp_replace(answer, r"(?is)<thinking>.*?</thinking>", "") if scratchpad else answer
    return F.nullif(F.regexp_extract(plain, r"(?s)\[.*\]", 0), F.lit(""))


def _items(array: Column) -> Column:
    """Elements of a JSON array, one by one; of anything else none."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(array), "$", "array<variant>"), F.array().cast("array<variant>"))


def _kind(item: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(item, f"$.{field}", "variant"))


def _string(item: Column, field: str) -> Column:
    """A field that is a string, trimmed; null for other kinds."""
    return F.when(_kind(item, field) == "STRING", trim(F.try_variant_get(item, f"$.{field}", "string")))


def parse_events(answer: Column, content: Column) -> Column:
    """Events with a known type whose snippet stands in the content; extra is JSON text, {} if it isn't an object.

    Strings are trimmed. An element that isn't such an event is left out; the others stay.
    """
    known = F.array(*[F.lit(t) for t in EVENT_SUBJECTS])
    extra = lambda x: F.when(F.startswith(_kind(x, "extra"), F.lit("OBJECT")), F.to_json(F.try_variant_get(x, "$.extra", "variant"))).otherwise("{}")
    rows = F.transform(_items(json_array(answer)), lambda x: F.struct(*[_string(x, k).alias(k) for k in ("entity_canonical_name", "event_type", "snippet")], extra(x).alias("extra")))
    return F.filter(rows, lambda e: F.coalesce((e["entity_canonical_name"] != "") & F.array_contains(known, e["event_type"]) & (e["snippet"] != "") & verbatim(e["snippet"], content), F.lit(False)))


def parse_mentions(answer: Column) -> Column:
    """(name, type, role) of named mentions, from entity_name, entity_type and role; the type defaults to character, an unknown role is null."""
    kinds, roles = F.array(*map(F.lit, ENTITY_TYPES)), F.array(*map(F.lit, ROLES))
    low = lambda x, k, known, other: F.when(F.array_contains(known, F.lower(_string(x, k))), F.lower(_string(x, k))).otherwise(other)
    rows = F.transform(_items(json_array(answer, scratchpad=False)), lambda x: F.struct(_string(x, "entity_name").alias("name"), low(x, "entity_type", kinds, F.lit("character")).alias("type"), low(x, "role", roles, F.lit(None).cast("string")).alias("role")))
    return F.filter(rows, lambda m: F.coalesce(m["name"] != "", F.lit(False)))


def allowed(event_type: Column, entity_type: Column) -> Column:
    """Whether an entity of this type may have this event."""
    table = F.create_map(*[x for k, v in EVENT_SUBJECTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(F.try_element_at(table, event_type), entity_type), F.lit(False))
