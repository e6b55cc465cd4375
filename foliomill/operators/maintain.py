"""Changes to tables as DataFrame to DataFrame functions; write the result to a new path and swap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim

PARTS = 1024


def once(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row of each key: the last by a column, or, without one, the only row; a key that repeats then raises when it is read.

    Grouped by the keys that the rows are joined on next, so that this takes no shuffle of its own.
    """
    values = [c for c in rows.columns if c not in keys]
    if not values:
        return rows.distinct()
    pick = F.max_by(F.struct(*values), order) if order else F.any_value(F.struct(*values))
    one = rows.groupBy(*keys).agg(pick.alias("_row"), F.count("*").alias("_n"))
    if order is None:
        again = F.raise_error(F.concat(F.lit("new rows repeat the key "), F.to_json(F.struct(*keys))))
        one = one.withColumn("_row", F.when(F.col("_n") == 1, F.col("_row")).otherwise(again))
    return one.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New rows replace old ones of the same key; inserted tells which keys weren't there. Of new rows of one key the last by order counts; without an order they raise."""
    values = [c for c in old.columns if c not in keys]
    o = old.withColumnsRenamed({c: f"old_{c}" for c in values}).withColumn("had", F.lit(True))
    n = once(new, keys, order).select(*keys, *values).withColumn("has", F.lit(True))
    met = o.join(n, keys, "full_outer")
    return met.select(*keys, *[F.when(F.col("has"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in values], F.col("had").isNull().alias("inserted"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose key isn't there; new rows of one key all go in, as in one INSERT ... SELECT."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def get_or_create(entities: DataFrame, names: DataFrame, dry_run: bool = False) -> DataFrame:
    """(canonical_name, entity_id) of every name. Names are compared without case; new ids go on from the largest, or from -1 down in a dry run.

    New names are numbered inside ``PARTS`` parts by their hash and the parts one after the other: the numbers depend
    on the names alone, so that a plan that is evaluated again gives the same ids.
    """
    key = F.lower("canonical_name")
    wanted = names.select(trim(F.col("name")).alias("canonical_name")).filter("canonical_name <> ''")
    wanted = wanted.groupBy(key.alias("key")).agg(F.min("canonical_name").alias("canonical_name"))
    have = entities.groupBy(key.alias("key")).agg(F.min("entity_id").alias("entity_id"))
    known = wanted.join(have, "key").select("canonical_name", "entity_id")
    new = wanted.join(have, "key", "left_anti").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = new.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # PARTS rows at most
    number = F.row_number().over(Window.partitionBy("part").orderBy("key")) + F.col("before")
    made = new.join(F.broadcast(sizes), "part").select("canonical_name", number.cast("long").alias("number"))
    if dry_run:
        return known.unionByName(made.select("canonical_name", (-F.col("number")).alias("entity_id")))
    top = entities.agg(F.coalesce(F.max("entity_id"), F.lit(0)).cast("long").alias("top"))  # one row
    return known.unionByName(made.join(F.broadcast(top), F.lit(True)).select("canonical_name", (F.col("top") + F.col("number")).alias("entity_id")))


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true; unknown isn't true."""
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def delete_orphans(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Without entities that were made automatically (no alias, empty meta, no spoiler) and have no mention; meta is JSON text."""
    auto = (F.size("aliases") == 0) & (F.col("meta") == "{}") & (F.col("is_spoiler") == 0)
    lonely = entities.filter(auto).join(mentions.select("entity_id").distinct(), "entity_id", "left_anti").select("entity_id")
    return entities.join(lonely, "entity_id", "left_anti")


def update_from(rows: DataFrame, values: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Columns of values overwrite those of the row with the same key. Of values of one key the last by order counts; without an order they raise."""
    columns = [c for c in values.columns if c not in (key, order)]
    v = once(values, [key], order).select(key, *columns).withColumnsRenamed({c: f"new_{c}" for c in columns}).withColumn("hit", F.lit(True))
    met = rows.join(v, key, "left")
    return met.select(*[F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def needs_update(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of which any column differs, null-safe."""
    n = new.withColumnsRenamed({c: f"new_{c}" for c in columns})
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
    return old.join(n, key).filter(differs).select(key)


def reattribute(mentions: DataFrame, entities: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions moved from entity_id to target_id, and the entities without those merged away. Spark chooses the joins by the size of moves."""
    m = mentions.join(moves, "entity_id", "left").withColumn("entity_id", F.coalesce("target_id", "entity_id")).drop("target_id")
    return m.select(*mentions.columns), entities.join(moves, "entity_id", "left_anti")


def delete_returning(rows: DataFrame, guard: Column, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) for a guarded list of keys."""
    gone = rows.filter(F.coalesce(guard, F.lit(False))).join(ids, key, "left_semi")
    return rows.join(gone.select(key), key, "left_anti"), gone


def guarded_insert(rows: DataFrame, new: DataFrame, field: str, pattern: str, guard: Column | None = None) -> DataFrame:
    """Insert unless one of the rows (that the guard takes) has a JSON field like the pattern."""
    like = F.get_json_object("extra", f"$.{field}").ilike(pattern)
    there = rows.filter(like if guard is None else like & guard).limit(1).select(F.lit(1).alias("there"))
    return rows.unionByName(new.join(F.broadcast(there), F.lit(True), "left_anti"))


def patch_lists(rows: DataFrame, key: str, column: str, patches: dict[int, Callable[[Column], Column]]) -> DataFrame:
    """Apply a function to a row's array by its key; patched tells whether the array changed."""
    out = F.col(column)
    for k, change in patches.items():
        out = F.when(F.col(key) == k, change(F.col(column))).otherwise(out)
    return rows.withColumn("patched", ~out.eqNullSafe(F.col(column))).withColumn(column, out)


def labelled(rows: DataFrame) -> DataFrame:
    """Gold rows that someone has labelled: with mentions, or marked as empty."""
    return rows.filter((F.size("gold_mentions") > 0) | F.coalesce(F.col("notes") == "EMPTY_OK", F.lit(False)))
