"""The two offline reports over labelled experiments, as tables and as CSV folders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condeval.functions.numeric import signed3
from condeval.operators import bootstrap as B
from condeval.operators import rates as R
from condeval.operators.counts import count_labels
from condeval.operators.storing import stored
from condeval.sources.tables import write_report_csv

Keep = Callable[[DataFrame], DataFrame]


def comparison_report(
    first: DataFrame,
    second: DataFrame,
    names: tuple[str, str] = ("idiom", "figurative"),
    condition: str = "alpha_factor",
    category: str = "category",
    trusted: str = "gold",
    baseline: float = 0.0,
    keep: Keep = stored,
) -> dict[str, DataFrame]:
    """Rates of two experiments side by side, by category and on trusted rows, with deltas.

    The deltas are those of the rounded rates. The pushed condition is the lowest
    one of the first experiment and is used for every series. Each experiment is
    read once, into counts that all tables are made from: ``keep`` stores them, as
    each table is an action of its own. A caller who reads a single table passes
    ``lambda counts: counts`` and gets one plan.
    """
    fine = [category, condition, *([trusted] if trusted in second.columns else [])]
    first = keep(count_labels(first, condition))
    second = keep(count_labels(second, fine))
    first_rates = R.label_rates(first, condition)
    both = R.pooled_and_grouped_rates(second, category, condition)
    second_rates = both.filter("pooled").drop("pooled", category)
    by_category = both.filter(~F.col("pooled")).drop("pooled").orderBy(category, condition)
    push = R.lowest_condition(first, condition)

    def deltas(rates: DataFrame, series: str | None = None) -> DataFrame:
        found = R.rate_deltas(rates, condition, push, baseline, [category] if series is None else [])
        named = found.withColumn("series", F.col(category) if series is None else F.lit(series))
        return named.select(
            "series", "baseline_rate", "pushed_rate", "delta", signed3("delta").alias("shown")
        )

    series = deltas(first_rates, names[0]).unionByName(deltas(by_category))
    series = series.unionByName(deltas(second_rates, names[1]))
    tables = {
        "summary_by_condition": R.combine_rates(first_rates, second_rates, condition, names),
        "summary_by_category": by_category,
    }
    trusted_rates = R.trusted_rates(second, condition, trusted)
    if trusted_rates is not None:
        tables["summary_trusted"] = trusted_rates.orderBy(condition)
        series = series.unionByName(deltas(trusted_rates, trusted))
    tables["deltas"] = series
    return tables


def bootstrap_report(
    first: DataFrame,
    second: DataFrame,
    first_name: str,
    first_cluster: str,
    push: float,
    pairs: Sequence[tuple[str, str]],
    category: str = "category",
    second_cluster: str = "expression",
    condition: str = "alpha_factor",
    baseline: float = 0.0,
    replicates: int = 5000,
    seed: int = 0,
    keep: Keep = stored,
) -> dict[str, DataFrame]:
    """Intervals per series and tests per pair, from one aggregation of each experiment."""
    one = B.cluster_counts(
        first.withColumn("_series", F.lit(first_name)), "_series", first_cluster, condition, push, baseline
    )
    many = B.cluster_counts(second, category, second_cluster, condition, push, baseline)
    counts = keep(one.unionByName(many))
    deltas = keep(B.bootstrap_deltas(counts, replicates, seed))
    return {
        "intervals": B.confidence_intervals(counts, deltas),
        "pairs": B.pairwise_differences(deltas, pairs),
    }


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder per table; report tables hold one row per condition or series."""
    for name, table in tables.items():
        write_report_csv(table, f"{folder.rstrip('/')}/{name}")
