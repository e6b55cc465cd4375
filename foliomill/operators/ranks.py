"""Ranks, running sums and caps by two passes, without a window over a group.

Rows are dealt out by ranges of (group, order) and sorted in each range; what a group has in a range is summed, a small table
whose running sums say where each range of a group begins; a row's rank is that plus its place in its range. A group that holds a third of all rows
is spread over a third of the ranges. The sorted rows are written once, as both passes must see the same ranges.

Defined cases: null is a group, and comes first in an order; rows that tie in the whole order get consecutive ranks in no stated order, so
that order should end with a key; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def _placed(rows: DataFrame, group: list[str], order: list[str], value: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with their place _at, and (group, _range, _first, _before): a group's first place in a range, and its rows (or the sum of a value) in earlier ranges."""
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    at = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())  # range number and place in it
    at = stored(at, "ranks").withColumn("_range", F.shiftright("_at", 33))
    ranges = at.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n") if value is None else F.coalesce(F.sum(value), F.lit(0)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    return at, ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def _joined(at: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    own = ranges.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_range").alias("_of"), "_first", "_before")
    same = F.col("_range") == F.col("_of")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return at.join(own, same)


def row_numbers(rows: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Rows with their number from 1 in their group, in that order."""
    at, ranges = _placed(rows, group, order)
    return _joined(at, ranges, group).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))


def running_totals(rows: DataFrame, group: list[str], order: list[str], value: str, name: str = "total") -> DataFrame:
    """Rows with the sum of a value up to and with each, in its group and that order; null adds nothing. The windows go over what a group has in one range."""
    at, ranges = _placed(rows, group, order, value)
    here = Window.partitionBy(*group, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("_here", F.coalesce(F.sum(value).over(here), F.lit(0)))
    return _joined(at, ranges, group).select(*rows.columns, (F.col("_before") + F.col("_here")).alias(name))


def within_budget(rows: DataFrame, group: list[str], order: list[str], value: str, budget: float) -> DataFrame:
    """The first rows of each group whose values together stay within a budget."""
    return running_totals(rows, group, order, value, "_total").filter(F.col("_total") <= budget).drop("_total")


def first_rows(rows: DataFrame, cap: int, order: list[str]) -> DataFrame:
    """The first cap rows in an order: whole ranges before the one that the cap cuts, and that one in part."""
    return row_numbers(rows, [], order, "_rank").filter(F.col("_rank") <= cap).drop("_rank")
