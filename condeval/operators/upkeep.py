"""Label counters of a table that grows in steps, kept up to date step by step."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from condeval.functions.columns import as_list
from condeval.operators.counts import count_labels
from condeval.sources.tables import STEP, WRITING, _children, _files, committed_steps

# Counters of a step, in the folder of the results.
COUNTS = "_counts"


def uncounted_steps(spark: SparkSession, path: str, name: str) -> list[str]:
    counted = {child.getPath().getName() for child in _children(spark, f"{path}/{COUNTS}/{name}")}
    return [step for step in committed_steps(spark, path) if step not in counted]


def count_steps(
    spark: SparkSession, path: str, schema: T.StructType, keys: str | Sequence[str], label: str = "label", name: str = "labels"
) -> list[str]:
    """Count the labels of each committed step that is not counted yet; returns their names.

    A step's counters are written aside and enter by one rename, so a run that is lost
    leaves a step counted or not. ``name`` tells sets of keys apart: one name, one set.
    """
    new = uncounted_steps(spark, path, name)
    for step in new:
        rows = spark.read.schema(schema).parquet(f"{path}/{STEP}{step}")
        hidden = f"{path}/{WRITING}/{uuid4().hex}"
        count_labels(rows, as_list(keys), label).write.parquet(hidden)
        files, place = _files(spark, hidden)
        shown = _files(spark, f"{path}/{COUNTS}/{name}/{step}")[1]
        files.mkdirs(shown.getParent())
        if not files.rename(place, shown):
            raise OSError(f"{hidden} could not be renamed to {shown}")
    return new


def kept_counts(
    spark: SparkSession, path: str, schema: T.StructType, keys: str | Sequence[str], label: str = "label", name: str = "labels"
) -> DataFrame:
    """Counters of all committed steps, a row a key and step, counting new steps alone.

    Rates, votes and flips take the result in place of labelled rows, and sum it.
    """
    keys = as_list(keys)
    count_steps(spark, path, schema, keys, label, name)
    folders = [f"{path}/{COUNTS}/{name}/{step}" for step in committed_steps(spark, path)]
    nothing = count_labels(spark.createDataFrame([], schema), keys, label)
    return spark.read.schema(nothing.schema).parquet(*folders) if folders else nothing
