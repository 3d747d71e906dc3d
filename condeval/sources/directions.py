"""Stored directions: write, read with a check, build or reuse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condeval.sources.tables import DIRECTION, read_parquet_table


def rows_digest(table: DataFrame) -> str:
    """A digest of a table's rows in any order: how many there are, and the sums of two hashes of each.

    A row that is changed, left out or repeated gives another digest; the order and the
    partitioning don't count.
    """
    columns = sorted(table.columns)
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")) for seed in (1, 2)]
    return "|".join(str(value or 0) for value in table.agg(F.count("*"), *sums).first())


def save_direction(found: DataFrame, path: str, source_layer: int, model: str, source: str | None = None) -> None:
    """Write the one-row direction with what it was built from."""
    tagged = found.select(
        "v",
        "s",
        "midpoint",
        F.lit(source_layer).cast("int").alias("source_layer"),
        F.lit(model).alias("model"),
        F.lit(source).cast("string").alias("source"),
    )
    tagged.write.mode("overwrite").parquet(path)


def load_direction(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """Read a direction; reading its row fails if it was built on another model."""
    stored = read_parquet_table(spark, path, DIRECTION, "Build the direction first.")
    if model is None:
        return stored
    message = F.concat(F.lit("direction was built on "), F.col("model"), F.lit(f", not on {model}"))
    return stored.filter(F.assert_true(F.col("model") == model, message).isNull())


def build_or_reuse_direction(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    source_layer: int,
    model: str,
    rebuild: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Load the stored direction, building and storing it when absent or asked to.

    With ``source``, the rows it is built from, it is also built anew when the stored one
    was built from others. That is told by ``rows_digest``, one pass over them.
    """
    digest = None if source is None else rows_digest(source)
    if not rebuild:
        try:
            stored = load_direction(spark, path, model)
            if digest is None or stored.select("source").first()[0] == digest:
                return stored
        except FileNotFoundError:
            pass
    save_direction(build(), path, source_layer, model, digest)
    return load_direction(spark, path, model)
