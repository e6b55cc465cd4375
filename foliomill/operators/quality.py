"""Samples, gold data and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import longest_span


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def compare(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn of each key in either side."""
    g, p = gold.select(*keys).distinct().withColumn("g", F.lit(True)), predicted.select(*keys).distinct().withColumn("p", F.lit(True))
    return g.join(p, keys, "full_outer").select(*keys, (F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.col("g").isNull().alias("fp"), F.col("p").isNull().alias("fn"))


def score(compared: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall and F1; 0 where a denominator is 0."""
    rows = compared.groupBy(*(by or [])).agg(*[F.count_if(k).alias(k) for k in ("tp", "fp", "fn")])
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * precision * recall, precision + recall)
    return rows.withColumns({"precision": F.round(precision, 6), "recall": F.round(recall, 6), "f1": F.round(f1, 6)})


def by_role(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(role, tp, fp, fn) of rows compared by key and role: a key with another role misses its gold role and is wrong for the predicted one."""
    named = lambda d, c: d.select(*keys, F.coalesce("role", F.lit("null")).alias(c))
    met = named(gold, "g").join(named(predicted, "p"), keys, "full_outer")
    one = lambda role, tp, fp, fn: F.struct(role.alias("role"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn"))
    g, p = F.col("g"), F.col("p")
    hit, miss, wrong = one(g, True, False, False), one(g, False, False, True), one(p, False, True, False)
    out = F.when(g == p, F.array(hit)).when(p.isNull(), F.array(miss)).when(g.isNull(), F.array(wrong)).otherwise(F.array(miss, wrong))
    return met.select(F.explode(out).alias("x")).select("x.*")


def role_accuracy(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(found, correct, accuracy): of the keys that both sides have, those whose role is the same; no role is a role. 0 where none is found."""
    named = lambda d, c: d.select(*keys, F.coalesce("role", F.lit("null")).alias(c)).distinct()
    met = named(gold, "g").join(named(predicted, "p"), keys)
    counts = met.agg(F.count("*").alias("found"), F.count_if(F.col("g") == F.col("p")).alias("correct"))
    return counts.withColumn("accuracy", F.round(ratio(F.col("correct"), F.col("found")), 6))


def quotas(takes: list[int], total: int) -> list[int]:
    """Takes in proportion to a new total, at least one each, repaired one by one."""
    if not takes or sum(takes) == total:
        return takes
    out = [max(1, int(t * total / sum(takes) + 0.5)) for t in takes]
    for i in range(1001):
        if sum(out) == total:
            break
        k = i % len(out)
        out[k] = max(1, out[k] + (1 if sum(out) < total else -1))
    return out


#: Label, place of the book (first or second), first and last chapter, kind and take of each stratum.
STRATA = [("early", 0, 1, 100, "main", 8), ("mid", 0, 101, 800, "main", 8), ("late", 0, 1000, None, "main", 4), ("second", 1, None, None, "main", 4), ("side", 0, None, None, "side_story", 2)]


def stratum(books: list[str], book: str = "book_id", chapter: str = "chapter_num", kind: str = "content_kind") -> Column:
    """The label of a chunk's stratum; chapters 801 to 999 of the first book are in none."""
    out = F.lit(None).cast("string")
    for label, place, lo, hi, of_kind, _ in reversed(STRATA):
        inside = (F.col(book) == books[place]) & (F.col(kind) == of_kind)
        for bound, holds in ((lo, F.col(chapter) >= lo if lo else None), (hi, F.col(chapter) <= hi if hi else None)):
            inside = inside & holds if bound else inside
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def drawn(seed: int, id_: str) -> Column:
    """A seeded number for each id, the same on every run and cluster."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string"))), 1, 8), 16, 10).cast("long")


def sample_strata(rows: DataFrame, stratum: str, id_: str, take: int, seed: int) -> DataFrame:
    """take rows of each stratum, drawn by a seeded hash."""
    w = Window.partitionBy(stratum).orderBy(drawn(seed, id_), id_)
    return rows.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= take).withColumn("draw", F.col("draw").cast("long"))


def _forms(aliases: DataFrame) -> DataFrame:
    """(known, forms): a name or alias without case, and all forms of its entity; the last entity wins."""
    forms = F.concat(F.array("canonical_name"), "aliases")
    rows = aliases.select("entity_id", forms.alias("forms"), F.explode(forms).alias("known"))
    return rows.groupBy(F.lower("known").alias("known")).agg(F.max_by("forms", "entity_id").alias("forms"))


def _first_in(chapter: Column, forms: Column) -> Column:
    return F.get(F.filter(forms, lambda f: F.contains(chapter, f)), F.lit(0))


def normalise_gold(gold: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_id, name, role, action) of gold rows (chunk_id, place, name, role, content, chapter_text).

    A name that stands in the chunk or the chapter is kept, as is one whose entity (entity_id, canonical_name, aliases)
    has a form in the chapter; else it is replaced by its longest span in the chunk, else dropped. Of names that are
    then equal without case, with one role, the first by place stays.
    """
    rows = gold.join(_forms(entities), F.lower("name") == F.col("known"), "left")
    span = longest_span(F.col("name"), F.col("content"))
    stands = F.contains("content", F.col("name")) | F.coalesce(F.contains("chapter_text", F.col("name")), F.lit(False))
    action = F.when(stands, "keep").when(_first_in(F.col("chapter_text"), F.col("forms")).isNotNull(), "alias").when(span.isNotNull(), "replace").otherwise("drop")
    done = rows.select("chunk_id", "place", "name", "role", span.alias("span"), action.alias("action")).filter("action <> 'drop'")
    done = done.withColumn("name", F.when(F.col("action") == "replace", F.col("span")).otherwise(F.col("name")))
    first = done.groupBy("chunk_id", F.lower("name").alias("low"), F.coalesce("role", F.lit("")).alias("as")).agg(F.min(F.struct("place", "name", "role", "action")).alias("x"))
    return first.select("chunk_id", "x.name", "x.role", "x.action")


def audit_gold(gold: DataFrame, entities: DataFrame) -> DataFrame:
    """Gold names that stand neither in their chunk nor in the chapter: which form of their entity does (alias), and whether their first word is in the chunk."""
    rows = gold.filter(~F.contains("content", F.col("name")) & ~F.coalesce(F.contains("chapter_text", F.col("name")), F.lit(False)))
    rows = rows.join(_forms(entities), F.lower("name") == F.col("known"), "left")
    first = F.get(F.split("name", " "), F.lit(0))
    suggested = F.when((first != F.col("name")) & F.contains("content", first), first)
    rows = rows.withColumn("alias", _first_in(F.col("chapter_text"), F.col("forms"))).withColumn("suggested", suggested)
    kind = F.when(F.col("alias").isNotNull(), "alias").when(F.col("suggested").isNotNull(), "first-word").otherwise("absent")
    return rows.withColumn("audit", kind).drop("known", "forms")


def canonical_key(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add key: entity:<id>, or raw:<name without case>."""
    low = F.lower(F.trim("name"))
    known = aliases.groupBy(F.lower(F.trim("alias")).alias("known")).agg(F.min("entity_id").alias("entity_id"))
    return names.join(known, low == F.col("known"), "left").withColumn("key", F.coalesce(F.concat(F.lit("entity:"), F.col("entity_id").cast("string")), F.concat(F.lit("raw:"), low))).drop("known", "entity_id")
