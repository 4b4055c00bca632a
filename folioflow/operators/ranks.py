"""Places and running sums over a whole table in order, without one task for all rows.

Rows are cut into ranges of the order and written with the number of their range; each range is summed alone and shifted by
the sums of those before it, of which there are as many as partitions. The written table fixes which rows a range holds:
a range exchange that is planned twice may cut differently each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stored import stored


def running(df: DataFrame, order: list[str], value: str, name: str, total: str | None = None) -> DataFrame:
    """df with the sum of `value` over all rows before each in `order`, and, if named, over all rows. Equal keys are summed in
    any order among themselves; nulls sort first."""
    parts = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = sums.select("_part", (F.sum("_sum").over(W.orderBy("_part")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(every).alias("_total"))
    inside = F.sum(value).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col(value)
    out = parts.withColumn("_inside", inside).join(F.broadcast(before), "_part")  # one row a partition
    out = out.withColumn(name, F.col("_before") + F.col("_inside"))
    return (out.withColumn(total, F.col("_total")) if total else out).drop("_part", "_inside", "_before", "_total")


def group_starts(df: DataFrame, group: str, first: Column, value: str) -> DataFrame:
    """group, start, end: the sum of `value` over all groups before each in the order of `first`, and with its own. Written."""
    sums = running(df.groupBy(group).agg(F.sum(value).alias("_sum")).withColumn("_first", first), ["_first"], "_sum", "start")
    return stored(sums.select(group, "start", (F.col("start") + F.col("_sum")).alias("end")))


def running_in_groups(df: DataFrame, starts: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of `value` over all rows before each, where groups follow each other as in `starts` and `order` is inside
    them: rows are summed only in their group, so that rows dealt by group don't move."""
    inside = F.sum(value).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col(value)
    out = df.withColumn("_inside", inside).join(starts.select(group, "start"), group)
    return out.withColumn(name, F.col("start") + F.col("_inside")).drop("start", "_inside")


def numbered(df: DataFrame, order: list[str], name: str = "ord", total: str | None = None) -> DataFrame:
    """df with each row's place in `order`, from 0."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name, total).drop("_one")


def quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """AGG-12: group and, by name, linearly interpolated quantiles of value: exact, by the places of a sorted table, so that a
    group with most rows is neither one task nor held in memory. Null values don't count."""
    rows = numbered(df.select(group, F.col(value).cast("double").alias("v")).where("v is not null"), [group, "v"], "place")
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    placed = rows.join(sizes, group).withColumn("at", (F.col("place") - F.col("first")).cast("double"))

    def at(share: float) -> Column:
        where = F.lit(share) * (F.col("n") - 1)
        low = F.max(F.when(F.col("at") == F.floor(where), F.col("v")))
        high = F.max(F.when(F.col("at") == F.ceil(where), F.col("v")))
        part = F.max(where - F.floor(where))
        return low + (high - low) * part

    return placed.groupBy(group).agg(*(at(p).alias(name) for name, p in shares.items()))
