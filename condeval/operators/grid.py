"""Condition grids, their samples, and the work still to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condeval.functions.columns import all_present

# The coefficients and the number of samples of a full sweep.
COEFFICIENTS = (-4.78, -3.59, -2.39, -1.20, 0.0, 1.20, 2.39, 3.59, 4.78)
SAMPLES = 5


def _grid(coefficients: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(c)) for c in coefficients))


def condition_grid(
    items: DataFrame,
    coefficients: Sequence[float] = COEFFICIENTS,
    condition: str = "coefficient",
) -> DataFrame:
    """One row per item and coefficient: an explode of a literal array, no join."""
    return items.withColumn(condition, F.explode(_grid(coefficients)))


def sample_rows(
    table: DataFrame, texts: str = "continuations", text: str = "continuation"
) -> DataFrame:
    """One row per generated text, with its 0-based ``sample_i``."""
    kept = [c for c in table.columns if c != texts]
    return table.select(*kept, F.posexplode(texts).alias("sample_i", text))


def repeat_samples(table: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per sample index, before any text exists."""
    return table.withColumn("sample_i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def pending_conditions(
    items: DataFrame,
    done: DataFrame,
    keys: Sequence[str],
    coefficients: Sequence[float] = COEFFICIENTS,
    condition: str = "coefficient",
) -> DataFrame:
    """Item x coefficient cells that have no finished row at all.

    Equivalent to anti-joining the whole grid, but the items are joined once and
    not once per coefficient: finished rows shrink to the set of an item's finished
    points, which the grid bounds, and what the set lacks is exploded after the
    join. A NULL key never matches, so it stays pending. A coefficient that is
    listed again counts once.
    """
    keys = list(keys)
    points = list(dict.fromkeys(float(c) for c in coefficients))
    value = F.col(condition).cast("double") + 0.0  # -0.0 is 0.0
    finished = (
        done.filter(all_present(keys) & F.col(condition).cast("double").isin(points))
        .groupBy(*keys)
        .agg(F.collect_set(value).alias("_finished"))
    )
    nothing = F.array().cast("array<double>")
    open_points = F.array_except(_grid(points), F.coalesce("_finished", nothing))
    joined = items.join(finished, keys, "left")
    return joined.select(*items.columns, F.explode(open_points).alias(condition))


def pending_rows(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not finished yet; repeated and NULL-keyed rows are kept.

    The finished keys are made distinct first, which combines map-side and takes
    the weight out of a key that finished many times.
    """
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti").select(*rows.columns)
