"""The place of every row in one order over a whole table, without one task that
sees all rows.

Rows are dealt to ranges of the order and sorted within them; each row's number is
that of the rows in the ranges before, plus its place in its own. What meets in one
task is one row for each range (for groups: and one more for each group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.llm import common

#: `monotonically_increasing_id` keeps the partition above this many bits.
_PLACE_BITS = 33


def _placed(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """Written, with part (the range) and place (in it, from 0)."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    rows = common.cut(rows, label)
    return rows.select(*df.columns, F.shiftright("__m", _PLACE_BITS).alias("part"), F.col("__m").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("place"))


def ranked(df: DataFrame, order: list[Column], label: str = "ranked") -> DataFrame:
    """Adds rank, from 0. Rows that are equal in `order` come in any order."""
    rows = _placed(df, order, label)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    # One row for each partition of the session's shuffles at most.
    return rows.join(F.broadcast(before), "part").select(*df.columns, (F.col("before") + F.col("place")).alias("rank"))


def ranked_in_groups(df: DataFrame, group: str, order: list[Column], label: str = "ranked") -> DataFrame:
    """Adds rank (from 0, within its group), group_rows, and group_rank: the group's
    place among the groups (nulls first). A group of any size spans ranges."""
    rows = _placed(df, [F.col(group).asc_nulls_first(), *order], label)
    runs = rows.groupBy("part", group).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    runs = runs.withColumn("before", F.sum("n").over(Window.partitionBy(group).orderBy("part")) - F.col("n"))
    groups = ranked(runs.groupBy(group).agg(F.sum("n").alias("group_rows")), [F.col(group).asc_nulls_first()], f"{label}-groups")
    named = groups.select(F.col(group).alias("__g"), "group_rows", F.col("rank").alias("group_rank"))
    runs = runs.join(named, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
    own = runs.select(F.col("part").alias("__p"), F.col(group).alias("__g"), "first", "before", "group_rows", "group_rank")
    joined = rows.join(own, (F.col("part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    return joined.select(*df.columns, (F.col("place") - F.col("first") + F.col("before")).alias("rank"), "group_rows", "group_rank")


def quantile(ranked: DataFrame, part: float, group: str = "key", value: str = "value") -> DataFrame:
    """group, value: each group's exact quantile, between two rows as numpy has it.
    ranked: rows with rank and group_rows, in the order of the value."""
    at = F.lit(part) * (F.col("group_rows") - 1)
    low, high = F.min(value), F.max(value)
    near = ranked.filter((F.col("rank") == F.floor(at)) | (F.col("rank") == F.ceil(at)))
    return near.groupBy(group, "group_rows").agg((low + (high - low) * (at - F.floor(at))).alias(value)).drop("group_rows")
