"""Rows dealt to tasks by what they cost, not by how many they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Slices of the digests for each task, and slices that are summed up together.
SLICES, GROUPED = 64, 1024


def slice_of(digest: str, slices: int) -> Column:
    """The slice of a hex digest: its first 32 bits, scaled to the number of slices."""
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.shiftright(number * slices, 32)


def task_of_slice(rows: DataFrame, digest: str, cost: Column, tasks: int, slices: int) -> DataFrame:
    """(slice, task): each task gets a run of slices of about the same summed cost.

    Prefix sums in two levels: inside groups of slices, and over the groups' few totals.
    A task is over its share by the cost of one slice at most.
    """
    totals = rows.groupBy(slice_of(digest, slices).alias("_slice")).agg(F.sum(cost).alias("_cost"))
    group = F.floor(F.col("_slice") / GROUPED)
    inside = W.partitionBy("_group").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    grouped = totals.withColumn("_group", group)
    groups = grouped.groupBy("_group").agg(F.sum("_cost").alias("_sum"))
    groups = groups.select(
        "_group",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_sum").over(W.partitionBy()).alias("_whole"),
    )
    placed = grouped.withColumn("_start", F.coalesce(F.sum("_cost").over(inside), F.lit(0))).join(groups, "_group")
    middle = F.col("_before") + F.col("_start") + F.col("_cost") / 2
    task = F.least(F.lit(tasks - 1), F.floor(middle * tasks / F.col("_whole")))
    return placed.select("_slice", task.cast("int").alias("_task"))


def dealt_by_cost(rows: DataFrame, digest: str, cost: Column, tasks: int, slices: int | None = None) -> DataFrame:
    """Rows in ``tasks`` partitions of about equal summed cost; rows of one digest stay together.

    A single row of more than a task's share cannot be split, and its task is over by it.
    """
    slices = slices or SLICES * tasks
    found = task_of_slice(rows, digest, cost, tasks, slices)
    numbered = rows.withColumn("_slice", slice_of(digest, slices)).join(found, "_slice")
    return numbered.repartitionById(tasks, "_task").drop("_slice", "_task")
