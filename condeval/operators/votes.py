"""Majority labels over samples and label flips between two conditions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condeval.functions.columns import all_present, as_list, free_names
from condeval.operators.counts import DOMAIN, total


def _tally(labelled: DataFrame, label: str, within: Column | None, tag: str) -> list[Column]:
    named = [total(labelled, v, label, within).alias(f"{tag}_{v}") for v in DOMAIN]
    return [total(labelled, "n_labelled", label, within).alias(f"{tag}_n"), *named]


def _strict_majority(tag: str) -> Column:
    vote = F.lit(None).cast("string")
    for value in DOMAIN:
        vote = F.when(F.col(f"{tag}_{value}") * 2 > F.col(f"{tag}_n"), value).otherwise(vote)
    return vote


def majority_labels(labelled: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """The label held by more than half of a group's labelled samples, else NULL.

    The label domain is known, so one map-side combined aggregation counts all
    labels at once. Labels outside the domain can't win; ``n_unknown`` counts them.
    """
    keys = as_list(keys)
    groups = labelled.filter(all_present(keys)).groupBy(*keys)
    tally = groups.agg(*_tally(labelled, label, None, "v"))
    known = reduce(add, (F.col(f"v_{value}") for value in DOMAIN))
    return tally.select(
        *keys,
        F.col("v_n").alias("n_labelled"),
        (F.col("v_n") - known).alias("n_unknown"),
        _strict_majority("v").alias("majority"),
    )


def open_majority(labelled: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """The value held by more than half of a group's values, else NULL, over any values.

    Columns: the keys, ``n_labelled`` and ``majority``. Values are counted first, by group and
    value together, so that no task holds a group's values; a group's counts then leave each
    task as their sum and the most frequent value, which decide. Rows are narrow in both steps.
    Groups with a NULL key are left out, and a group without values has no majority.
    """
    keys = as_list(keys)
    times, most, value = free_names([*labelled.columns, "n_labelled", "majority"], "_times", "_most", "_value")
    counts = labelled.filter(all_present(keys)).groupBy(*keys, label).agg(F.count(label).alias(times))
    tally = counts.groupBy(*keys).agg(
        F.sum(times).alias("n_labelled"), F.max(times).alias(most), F.max_by(label, times).alias(value)
    )
    held = F.when(F.col(most) * 2 > F.col("n_labelled"), F.col(value))
    return tally.select(*keys, "n_labelled", held.alias("majority"))


def label_flips(
    labelled: DataFrame,
    item: Sequence[str],
    condition: str,
    push: Column | float,
    baseline: float = 0.0,
    label: str = "label",
    before: str = "FIGURATIVE",
    after: str = "LITERAL",
) -> DataFrame:
    """Majority label of each item at two conditions, and whether it flipped.

    Both conditions are counted in the same aggregation, in place of a
    self-join. ``comparable`` marks items that have a majority at both.
    """
    item = as_list(item)
    at = F.col(condition)
    rows = labelled.filter(all_present(item) & ((at == baseline) | (at == push)))
    tally = rows.groupBy(*item).agg(
        *_tally(labelled, label, at == baseline, "base"),
        *_tally(labelled, label, at == push, "push"),
    )
    votes = tally.select(
        *item,
        _strict_majority("base").alias("majority_base"),
        _strict_majority("push").alias("majority_push"),
    )
    flipped = (F.col("majority_base") == before) & (F.col("majority_push") == after)
    return votes.withColumns(
        {
            "comparable": F.col("majority_base").isNotNull() & F.col("majority_push").isNotNull(),
            "flipped": F.coalesce(flipped, F.lit(False)),
        }
    )


def flip_summary(
    flips: DataFrame, expression: str, by: str | Sequence[str] = ()
) -> DataFrame:
    """Items, comparable items, flips, and distinct expressions among the flips.

    One row for each value of ``by`` and one, with ``pooled`` true and NULLs, overall.
    """
    by = as_list(by)
    measures = [
        F.count("*").alias("n_items"),
        F.count_if("comparable").alias("n_comparable"),
        F.count_if("flipped").alias("n_flips"),
        F.count_distinct(F.when(F.col("flipped"), F.col(expression))).alias("n_expressions"),
    ]
    if not by:
        return flips.groupBy().agg(*measures)
    levels = flips.groupingSets([[], [F.col(c) for c in by]], *by)
    found = levels.agg((F.grouping(by[0]) == 1).alias("pooled"), *measures)
    return found.select("pooled", *by, "n_items", "n_comparable", "n_flips", "n_expressions")
