"""An index of finished keys, bucketed by key, so that a resume moves only the new items.

Results are appended in steps; the index holds the distinct keys of the steps it covers, as
a bucketed Parquet table beside them. Bringing it up to date reads the new steps' key
columns alone. Anti-joining items with it shuffles the items to its buckets, and nothing
of what is finished.

A step is marked as covered after its keys are in. A run that is lost in between leaves keys
without the mark; they are those of finished rows, and are added again by the next run, which
changes nothing, since the index is read as a set.

Spark never co-locates rows by floating keys, so these are held as text in the index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condeval.functions.columns import all_present, free_names
from condeval.sources.tables import STEP, _children, _files, committed_steps

# Folders of the index in the folder of the results: keys, and marks of the steps they cover.
INDEX, COVERED = "_finished/keys", "_finished/covered"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _held(rows: DataFrame | T.StructType, key: str) -> Column:
    """A key as the index holds it."""
    schema = rows if isinstance(rows, T.StructType) else rows.schema
    if isinstance(schema[key].dataType, T.FractionalType):
        return (F.col(key).cast("double") + 0.0).cast("string")  # -0.0 is 0.0
    return F.col(key)


def open_index(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    keys: Sequence[str],
    values: Sequence[str],
    buckets: int,
    name: str,
) -> DataFrame:
    """The index of a results folder as the catalogue's table ``name``, registered if it is not.

    Buckets are in the names of its files, so another session that names the same keys and
    number of buckets reads the same index.
    """
    floating = {k for k in keys if isinstance(schema[k].dataType, T.FractionalType)}
    kinds = [(k, "string" if k in floating else schema[k].dataType.simpleString()) for k in (*keys, *values)]
    columns = ", ".join(f"{_quoted(k)} {kind}" for k, kind in kinds)
    by = ", ".join(map(_quoted, keys))
    location = f"{path}/{INDEX}".replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({columns}) USING parquet "
        f"CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    spark.catalog.refreshTable(_quoted(name))
    return spark.table(_quoted(name))


def finished_keys(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    keys: Sequence[str],
    name: str,
    values: Sequence[str] = (),
    buckets: int = 64,
) -> DataFrame:
    """The distinct keys, with ``values`` if asked, of all committed steps of a results folder.

    They come from the index, to which steps it does not cover are added first, together,
    one file a bucket. A row with a NULL among them is never finished.
    """
    keys, values = list(keys), list(values)
    open_index(spark, path, schema, keys, values, buckets, name)
    covered = {child.getPath().getName() for child in _children(spark, f"{path}/{COVERED}")}
    new = [step for step in committed_steps(spark, path) if step not in covered]
    if new:
        rows = spark.read.schema(schema).parquet(*(f"{path}/{STEP}{step}" for step in new))
        held = [_held(schema, k).alias(k) for k in keys]
        found = rows.filter(all_present([*keys, *values])).select(*held, *values).distinct()
        writer = found.repartition(buckets, *keys).write.mode("append").format("parquet")
        writer.option("path", f"{path}/{INDEX}").bucketBy(buckets, *keys).saveAsTable(_quoted(name))
        _mark_covered(spark, path, new)
        spark.catalog.refreshTable(_quoted(name))
    return spark.table(_quoted(name))


def _mark_covered(spark: SparkSession, path: str, steps: Sequence[str]) -> None:
    for step in steps:
        files, place = _files(spark, f"{path}/{COVERED}/{step}")
        files.create(place, True).close()


def rows_not_in(rows: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in an index; repeated and NULL-keyed rows are kept."""
    names = free_names(rows.columns, *(f"_{k}" for k in keys))
    finished = index.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)))
    same = [_held(rows, k) == F.col(n) for k, n in zip(keys, names, strict=True)]
    return rows.join(finished, same, "left_anti")
