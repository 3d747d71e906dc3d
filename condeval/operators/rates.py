"""Label rates per condition, and what is derived from them.

Every function reduces the labelled rows to counts in one partial aggregation
(map-side combined, so a hot group costs a few counters per task and no skewed
shuffle); everything after that works on the small counts. Counted tables are
taken as well as labelled rows, see ``counts``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from condeval.functions.columns import all_present, as_list
from condeval.functions.text import LABELS
from condeval.operators.counts import count_labels, total


def _label_counts(table: DataFrame, label: str) -> list[Column]:
    return [total(table, name, label).alias(name) for name in ("n_labelled", *LABELS)]


def _rates(counts: DataFrame, keys: Sequence[str], places: int | None = 3) -> DataFrame:
    share = {name: F.col(name) / F.col("n_labelled") for name in LABELS}
    share["coherence_rate"] = share["FIGURATIVE"] + share["LITERAL"]
    if places is not None:
        share = {name: F.bround(rate, places) for name, rate in share.items()}
    return counts.select(*keys, *(rate.alias(name) for name, rate in share.items()))


def label_rates(
    labelled: DataFrame, keys: str | Sequence[str], label: str = "label", places: int | None = 3
) -> DataFrame:
    """Share of each label per group, plus the coherence rate.

    Rows with a NULL label or a NULL key are left out; a parse failure stays in
    the denominator but gets no column. The coherence rate is summed first and
    rounded afterwards.
    """
    keys = as_list(keys)
    groups = labelled.filter(all_present(keys)).groupBy(*keys)
    counts = groups.agg(*_label_counts(labelled, label))
    return _rates(counts.filter(F.col("n_labelled") > 0), keys, places)


def pooled_and_grouped_rates(
    labelled: DataFrame, group: str, condition: str, label: str = "label"
) -> DataFrame:
    """``label_rates`` by condition and by (group, condition) from one scan.

    Grouping sets run on the counts, not on the rows, so no row is expanded.
    ``pooled`` tells the two levels apart; pooled rows have a NULL group.
    """
    groups = labelled.filter(F.col(condition).isNotNull()).groupBy(group, condition)
    counts = groups.agg(*_label_counts(labelled, label)).filter(F.col("n_labelled") > 0)
    sums = [F.sum(name).alias(name) for name in ("n_labelled", *LABELS)]
    both = counts.groupingSets(
        [[F.col(condition)], [F.col(group), F.col(condition)]], group, condition
    ).agg((F.grouping(group) == 1).alias("pooled"), *sums)
    kept = both.filter(F.col("pooled") | F.col(group).isNotNull())
    return _rates(kept, ["pooled", group, condition])


def trusted_rates(
    labelled: DataFrame, condition: str, trusted: str = "gold", label: str = "label"
) -> DataFrame | None:
    """Rates over trusted rows only; None when the table has no such column."""
    if trusted not in labelled.columns:
        return None
    return label_rates(labelled.filter(F.col(trusted)), condition, label)


def combine_rates(
    first: DataFrame, second: DataFrame, condition: str, names: tuple[str, str]
) -> DataFrame:
    """Two rate tables side by side; a condition of either one is kept, sorted."""

    def side(rates: DataFrame, name: str) -> DataFrame:
        return rates.select(
            condition,
            F.col("LITERAL").alias(f"{name}_literal_rate"),
            F.col("coherence_rate").alias(f"{name}_coherence_rate"),
        )

    joined = side(first, names[0]).join(side(second, names[1]), condition, "full")
    columns = [f"{n}_{kind}_rate" for kind in ("literal", "coherence") for n in names]
    return joined.select(condition, *columns).orderBy(condition)


def lowest_condition(table: DataFrame, condition: str) -> Column:
    """The smallest coefficient as a scalar subquery, usable in any expression.

    It scans the table of its own; it is meant for a condition of another experiment.
    """
    return table.agg(F.min(condition)).scalar()


def _with_lowest(counted: DataFrame, condition: str) -> tuple[DataFrame, Column]:
    """A table of one row per series and condition, with its lowest condition beside each."""
    lowest = F.min(condition).over(W.partitionBy())
    return counted.withColumn("_lowest", lowest), F.col("_lowest")


def rate_deltas(
    rates: DataFrame,
    condition: str,
    push: Column | float | None = None,
    baseline: float = 0.0,
    series: str | Sequence[str] = (),
) -> DataFrame:
    """Literal rate at ``push`` minus at ``baseline``, of the (rounded) rates.

    Without ``push`` it is the lowest condition of the rates themselves. A series
    that lacks either condition gets a NULL delta.
    """
    if push is None:
        rates, push = _with_lowest(rates, condition)
    at = lambda value: F.max(F.when(F.col(condition) == value, F.col("LITERAL")))
    found = rates.groupBy(*as_list(series)).agg(
        at(baseline).alias("baseline_rate"), at(push).alias("pushed_rate")
    )
    return found.withColumn("delta", F.col("pushed_rate") - F.col("baseline_rate"))


def effect_ratio(delta: Column, reference_delta: Column) -> Column:
    """Size of one delta relative to another; NULL when the other is zero."""
    return F.try_divide(delta, reference_delta)


def literal_rate(
    labelled: DataFrame, keys: str | Sequence[str] = (), label: str = "label"
) -> DataFrame:
    """Literal share over all rows, missing labels included; NULL if there are none."""
    rate = F.try_divide(total(labelled, "LITERAL", label), total(labelled, "n_rows", label))
    return labelled.groupBy(*as_list(keys)).agg(rate.alias("literal_rate"))


def condition_counts(
    labelled: DataFrame, condition: str, value: Column | float, label: str, tag: str
) -> list[Column]:
    """Literal rows ``k<tag>`` and all rows ``n<tag>`` of one condition."""
    here = F.col(condition) == value
    return [
        total(labelled, "LITERAL", label, here).alias(f"k{tag}"),
        total(labelled, "n_rows", label, here).alias(f"n{tag}"),
    ]


def point_delta() -> Column:
    """Unrounded delta from the four counts of ``condition_counts``; NULL if one side is empty."""
    return F.try_divide(F.col("k1"), F.col("n1")) - F.try_divide(F.col("k0"), F.col("n0"))


def literal_deltas(
    labelled: DataFrame,
    condition: str,
    push: Column | float | None = None,
    baseline: float = 0.0,
    series: str | Sequence[str] = (),
    label: str = "label",
) -> DataFrame:
    """Unrounded literal-rate delta per series, both conditions in one pass.

    Without ``push`` it is the lowest condition of the rows themselves, which are
    then counted by series and condition first and read once.
    """
    series = as_list(series)
    if push is None:
        labelled, push = _with_lowest(count_labels(labelled, [*series, condition], label), condition)
    counts = labelled.filter(all_present(series)).groupBy(*series).agg(
        *condition_counts(labelled, condition, baseline, label, "0"),
        *condition_counts(labelled, condition, push, label, "1"),
    )
    return counts.select(
        *series,
        F.try_divide("k0", "n0").alias("baseline_rate"),
        F.try_divide("k1", "n1").alias("pushed_rate"),
        point_delta().alias("delta"),
    )


def dose_response(
    rates: DataFrame, condition: str, baseline: float = 0.0, series: str | Sequence[str] = ()
) -> DataFrame:
    """Is every negative condition above the baseline and every positive one at or below?

    All cells lie above a value exactly when their minimum does, so one
    aggregation answers it without joining the baseline back. ``peak`` is the
    condition with the highest literal rate, the smaller one on a tie.
    """
    at, literal = F.col(condition), F.col("LITERAL")
    base = F.max(F.when(at == baseline, literal))
    return rates.groupBy(*as_list(series)).agg(
        base.alias("baseline_rate"),
        (F.min(F.when(at < baseline, literal)) > base).alias("negatives_above"),
        (F.max(F.when(at > baseline, literal)) <= base).alias("positives_not_above"),
        F.min(F.struct((-literal).alias("order"), at.alias("at")))["at"].alias("peak"),
        F.max(literal).alias("peak_rate"),
        F.min("coherence_rate").alias("min_coherence_rate"),
    )
