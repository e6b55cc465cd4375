"""Counts, usage and cost, and small set operations over keyed rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import ratio

#: Dollars for a million tokens, and ranks of roles.
CONTEXT_PRICES = {"no_cache": 0.14, "cache_read": 0.028, "cache_write": 0.14, "output": 0.28}
SUMMARY_PRICES = {"no_cache": 1.74, "cache_read": 0.145, "cache_write": 1.74, "output": 3.48}
EMBED_PRICE = 0.02
ROLE_RANKS = {"speaker": 3, "addressee": 2, "mentioned": 1}
COUNTERS = ["no_cache", "cache_read", "cache_write", "output", "calls"]


def no_cache_tokens(detail: Column, total: Column, read: Column, write: Column) -> Column:
    """Input tokens that no cache served: the detail if there is one, else what the total leaves."""
    return F.coalesce(detail, F.greatest(total - F.coalesce(read, F.lit(0)) - F.coalesce(write, F.lit(0)), F.lit(0)), F.lit(0))


def usage(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the five counters."""
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def cost(prices: dict[str, float], embed: Column | None = None) -> Column:
    """Dollars for the counters of a row, and for embedded tokens."""
    parts = [F.col(c) * F.lit(p) for c, p in prices.items()] + ([embed * F.lit(EMBED_PRICE)] if embed is not None else [])
    return functools.reduce(lambda a, b: a + b, parts) / F.lit(1e6)


def project(sampled: Column, n_sampled: Column, population: Column) -> Column:
    """A sample's cost carried on to the population; 0 without a sample."""
    return ratio(sampled, n_sampled) * population


def max_by_rank(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, int]) -> DataFrame:
    """The value of highest rank of each key; values without a rank have 0."""
    table = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])
    return rows.groupBy(*keys).agg(F.max_by(value, F.coalesce(F.try_element_at(table, F.col(value)), F.lit(0))).alias(value))


def first_wins(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def last_wins(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def union_first(parts: list[DataFrame], key: str) -> DataFrame:
    """Each key of the parts once, with the number (from 1) of the first part that has it."""
    rows = [p.select(key, F.lit(i).cast("long").alias("part")) for i, p in enumerate(parts, 1)]
    return functools.reduce(DataFrame.unionByName, rows).groupBy(key).agg(F.min("part").alias("part"))


def set_sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of a, with side both or first."""
    a, b = a.select(key), b.select(key)
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("first")))


def child_counts(parents: DataFrame, children: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Children of every parent, 0 included. Children are counted before they are joined."""
    counts = children.groupBy(key).agg(F.count("*").alias(n))
    return parents.join(counts, key, "left").withColumn(n, F.coalesce(n, F.lit(0)))


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return rows.join(others.select(key), key, "left_anti")


def having(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return rows.join(others.select(key), key, "left_semi")


def exists(rows: DataFrame) -> bool:
    """Whether there is a row; reads no more than one."""
    return not rows.isEmpty()


def counts_by(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(column, n) for each of the values, 0 where there is no row."""
    dimension = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return child_counts(dimension, rows, column)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table."""
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, d in tables.items()]
    rows = functools.reduce(DataFrame.unionByName, parts)
    return rows.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables])


def false_positives(rows: DataFrame, empty: Column, predicted: Column) -> DataFrame:
    """Rows that should be empty, those with a prediction, and their share."""
    n, fp = F.count_if(empty), F.count_if(empty & predicted)
    return rows.agg(n.alias("empty"), fp.alias("false_positives"), F.round(ratio(fp, n), 6).alias("rate"))


def agreement(rows: DataFrame, same: Column) -> DataFrame:
    same = F.coalesce(same, F.lit(False))
    return rows.agg(F.count_if(same).alias("agree"), F.count_if(~same).alias("disagree"))


def top_mentioned(entities: DataFrame, mentions: DataFrame, n: int = 30) -> DataFrame:
    """The n entities with most mentions, ties by id."""
    return child_counts(entities, mentions, "entity_id", "mentions").orderBy(F.desc("mentions"), "entity_id").limit(n)


def catalog(entities: DataFrame) -> DataFrame:
    """One block of lines "- name (type)", with aliases after a dash; entities (canonical_name, entity_type, aliases) are a bounded dimension."""
    more = F.when(F.size("aliases") > 0, F.concat(F.lit(" — aliases: "), F.array_join("aliases", ", "))).otherwise("")
    line = F.concat(F.lit("- "), F.col("canonical_name"), F.lit(" ("), F.col("entity_type"), F.lit(")"), more)
    items = F.array_sort(F.collect_list(F.struct("canonical_name", line.alias("line"))))
    return entities.agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias("block"))
