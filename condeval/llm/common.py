"""What several of these operators need: shared checkpoints, free names, ordered prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A local session without it, as in tests, gets a folder of its own; a cluster
    without it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="llm-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(table: DataFrame) -> DataFrame:
    """Compute a table once, in the shared folder, and cut its lineage there."""
    checkpoint_folder(table.sparkSession)
    return table.checkpoint()


# Bytes of texts that go to Python at a time.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at ``BATCH_BYTES``, where else they hold 10,000 texts of any length.

    A task has several copies of a batch, in the executor and in Python. Results don't
    depend on where batches end.
    """
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


@contextmanager
def in_small_batches(spark: SparkSession) -> Iterator[None]:
    """``small_batches`` for the jobs that run inside."""
    before = spark.conf.get(BATCH_SETTING)
    small_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def documents_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores before it as make it new."""
    seen, names = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in seen:
            name = "_" + name
        seen.add(name.lower())
        names.append(name)
    return names


def running_totals(
    rows: DataFrame,
    groups: Sequence[str],
    slice_of: Column,
    order: Sequence[Column],
    sums: dict[str, str],
    slices: str = "_slice",
) -> DataFrame:
    """Sum of what stands before each row of its group, in a given order.

    ``slice_of`` cuts a group into slices that follow the order: a row of a
    smaller slice stands before one of a larger. Slices are summed first, their
    few totals are added up per group, and the order inside a slice is all that a
    single task sorts, so a group with most of the rows is no bottleneck as long
    as its slices are many. ``sums`` maps a new column to the column it sums.
    NULL groups are groups of their own.
    """
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("")).alias(f"_k{i}") for i, g in enumerate(groups)]
    nulls = [F.col(g).isNull().alias(f"_n{i}") for i, g in enumerate(groups)]
    names = [f"_{c}{i}" for i in range(len(groups)) for c in "kn"]
    # Dealt by slice, or a shuffle by group alone, made for a join before, would be kept.
    sliced = rows.select("*", slice_of.alias(slices), *keys, *nulls)
    totals = sliced.groupBy(*names, slices).agg(
        *(F.sum(c).alias(f"_before_{out}") for out, c in sums.items())
    )
    earlier = Window.partitionBy(*names).orderBy(slices).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *names,
        slices,
        *(F.coalesce(F.sum(f"_before_{out}").over(earlier), F.lit(0)).alias(f"_before_{out}") for out in sums),
    )
    inside = (
        Window.partitionBy(*names, slices).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sliced.repartition(*names, slices).withColumns(
        {out: F.coalesce(F.sum(c).over(inside), F.lit(0)) for out, c in sums.items()}
    )
    found = placed.join(offsets, [*names, slices], "left")
    return found.withColumns({out: F.col(out) + F.col(f"_before_{out}") for out in sums}).drop(
        *names, slices, *(f"_before_{out}" for out in sums)
    )


def scratch_table(table: DataFrame) -> DataFrame:
    """Write a table as Parquet in a new folder beside the checkpoints, and read it."""
    spark = table.sparkSession
    folder = f"{checkpoint_folder(spark)}/tables/{uuid.uuid4()}"
    table.write.parquet(folder)
    return spark.read.parquet(folder)
