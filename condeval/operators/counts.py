"""Label counters, from labelled rows or from a table that was counted before.

Wherever an operator takes labelled rows it also takes the output of
``count_labels``, and sums instead of counting. So rows can be counted by a fine
key first, and be joined with what belongs to that key afterwards: a key that
holds a large part of all rows shrinks inside each task and never meets a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condeval.functions.columns import as_list
from condeval.functions.text import LABELS, UNPARSEABLE

DOMAIN = (*LABELS, UNPARSEABLE)
COUNTERS = ("n_rows", "n_labelled", *DOMAIN)


def total(
    table: DataFrame, counter: str, label: str = "label", within: Column | None = None
) -> Column:
    """Aggregate expression of one counter, optionally only of the rows within a condition."""
    if set(COUNTERS) <= set(table.columns):
        amount = F.col(counter) if within is None else F.when(within, F.col(counter))
        return F.coalesce(F.sum(amount), F.lit(0))
    if counter == "n_rows":
        counted = F.lit(True)
    elif counter == "n_labelled":
        counted = F.col(label).isNotNull()
    else:
        counted = F.col(label) == counter
    return F.count_if(counted if within is None else within & counted)


def count_labels(table: DataFrame, keys: str | Sequence[str], label: str = "label") -> DataFrame:
    """One row per key with its rows, its labelled rows, and the rows of each label."""
    counters = [total(table, c, label).alias(c) for c in COUNTERS]
    return table.groupBy(*as_list(keys)).agg(*counters)


def unknown_labels(table: DataFrame, label: str = "label") -> DataFrame:
    """Labels outside the domain and their rows; they count as labelled rows only."""
    return (
        table.filter(~F.col(label).isin(*DOMAIN)).groupBy(label).agg(F.count("*").alias("n_rows"))
    )


def with_item_columns(
    labelled: DataFrame, items: DataFrame, item: str, condition: str, label: str = "label"
) -> DataFrame:
    """Counters per item and condition, with the columns of the item.

    Rows are counted before the join, so an item with a third of all rows arrives
    as a few, and the result has the same columns whatever the size of the items.
    """
    return count_labels(labelled, [item, condition], label).join(items, item)
