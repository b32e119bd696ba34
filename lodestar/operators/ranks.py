"""Row numbers within groups of any size: no group is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled


def row_numbers(rows: DataFrame, by: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... within ``by`` (nulls are one group) in the given order.

    Rows are dealt out by ranges of (by, order) and settled there. What stands before a
    group's rows of one range is a sum over the ranges before, of which there is one row
    for each group and range. Rows and those sums meet on (group, range), so that a group
    with a third of all rows is spread over a third of the ranges.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in [*by, *order]]
    placed = settled(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id()))
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    pieces = placed.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    group = F.struct(*by).alias("_group")  # in which nulls are equal
    offsets = pieces.select(group, "_range", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return placed.select("*", group).join(offsets, ["_group", "_range"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_group", "_range", "_at", "_shift")
