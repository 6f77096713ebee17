"""Order-dependent columns over a whole table without moving it to one partition.

Rows are range-partitioned by the order key, written once, and numbered,
summed or shifted within partitions; what crosses a partition's edge is one
row for a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _totals(parts: DataFrame, value: Column) -> DataFrame:
    """Of each partition the sum over all before it; as many rows as partitions."""
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(sums.select("_part", F.coalesce(before, F.lit(0)).cast("long").alias("_before")))


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Rows numbered by a unique order key."""
    parts = _ranged(df, order)
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(_totals(parts, F.lit(1)), "_part").withColumn(name, (F.col("_before") + within + (start - 1)).cast("long")).drop("_part", "_before")


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of a unique order key."""
    parts = _ranged(df, order)
    earlier = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return parts.join(_totals(parts, F.col(value)), "_part").withColumn(name, (F.col("_before") + F.coalesce(earlier, F.lit(0))).cast("long")).drop("_part", "_before")


def following(df: DataFrame, key: str, name: str) -> DataFrame:
    """The next greater value of a unique key, null in the last row."""
    parts = _ranged(df, [key])
    firsts = parts.groupBy("_part").agg(F.min(key).alias("_first"))
    nexts = F.broadcast(firsts.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_first_after")))
    inside = F.lead(key).over(Window.partitionBy("_part").orderBy(key))
    return parts.join(nexts, "_part").withColumn(name, F.coalesce(inside, F.col("_first_after"))).drop("_part", "_first_after")
