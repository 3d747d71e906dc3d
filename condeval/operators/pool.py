"""The labelled contrast pool and simple table profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from condeval.functions.columns import as_list, value_map
from condeval.functions.text import same_surface

# Usages kept in the pool and the class each one stands for.
USAGE_CLASSES = {"idiomatic": "figurative", "literal": "literal"}


def contrast_pool(
    sources: Sequence[DataFrame],
    usage: str = "usage",
    span: str = "span",
    expression: str = "idiom",
    classes: dict[str, str] = USAGE_CLASSES,
) -> DataFrame:
    """Stack the sources and keep rows of a known usage in exact surface form.

    Duplicates are kept. ``label`` is the class of the usage. Both filters sit
    directly on each scan.
    """
    stacked = reduce(DataFrame.unionByName, sources)
    kept = stacked.filter(F.col(usage).isin(*classes) & same_surface(span, expression))
    return kept.withColumn("label", value_map(usage, classes))


def value_counts(table: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Counts of each value of the named columns as (column, value, n), from one scan."""
    pairs = F.array(
        *(
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            for c in as_list(columns)
        )
    )
    melted = table.select(F.inline(pairs))
    counts = melted.filter(F.col("value").isNotNull()).groupBy("column", "value")
    return counts.agg(F.count("*").alias("n")).orderBy("column", F.desc("n"), "value")


def distinct_values(table: DataFrame, column: str) -> DataFrame:
    """Distinct values in sorted order, NULL included."""
    return table.select(column).distinct().orderBy(column)


def shape(table: DataFrame, distinct: Sequence[str] = (), true: Sequence[str] = ()) -> DataFrame:
    """One row: row count, distinct non-NULL counts, and counts of true flags."""
    return table.agg(
        F.count("*").alias("n_rows"),
        *(F.count_distinct(c).alias(f"n_{c}") for c in distinct),
        *(F.count_if(c).alias(f"n_true_{c}") for c in true),
    )


def class_balance(table: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share per class. The window runs over one row per class."""
    counts = table.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return counts.withColumn("share", F.col("n") / total)


def first_rows(table: DataFrame, order: Sequence[Column | str], n: int = 5) -> DataFrame:
    return table.orderBy(*order).limit(n)


def first_per_group(table: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order.

    Spark keeps one row per group and task before it shuffles (window group
    limit), so a hot group does not travel.
    """
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return table.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def suite_invariants(
    suite: DataFrame,
    expression: str = "expression",
    variant: str = "variant_id",
    prefix: str = "prefix",
    trusted: str = "gold",
    variants: int = 5,
) -> DataFrame:
    """Per expression: variants, trusted rows, repeated keys, prefixes that end elsewhere.

    Keys collapse first, so the second aggregation sees one row per key.
    """
    per_key = suite.groupBy(expression, variant).agg(
        F.count("*").alias("rows"),
        F.count_if(trusted).alias("trusted"),
        F.count_if(~F.endswith(F.col(prefix), F.col(expression))).alias("loose"),
    )
    found = per_key.groupBy(expression).agg(
        F.count("*").alias("n_variants"),
        F.sum("trusted").alias("n_gold"),
        F.count_if(F.col("rows") > 1).alias("n_repeated_keys"),
        F.sum("loose").alias("n_loose_prefixes"),
    )
    holds = (
        (F.col("n_variants") == variants)
        & (F.col("n_gold") == 1)
        & (F.col("n_repeated_keys") == 0)
        & (F.col("n_loose_prefixes") == 0)
    )
    return found.withColumn("holds", holds)
