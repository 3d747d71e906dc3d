import math
import operator
import random
from fractions import Fraction
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from condeval.operators import exact as E
from condeval.operators import vectors as V

DDL = "embedding array<double>, label int"


def _summed(rows, pieces):
    """Sums of rows that are added in pieces, and merged in a random order."""
    pick = random.Random(pieces)
    parts = [E.ExactSums(rows.shape[1]) for _ in range(pieces)]
    for row in rows:
        pick.choice(parts).add(row[None], np.ones((1, rows.shape[1]), bool))
    pick.shuffle(parts)
    whole = E.ExactSums(rows.shape[1])
    for part in parts:
        whole.merge(*part.row())
    return whole.sums()


def test_sums_are_rounded_once():
    pick = np.random.default_rng(1)
    rows = pick.normal(0, 1, (300, 4)) * 10.0 ** pick.integers(-300, 300, (300, 4))
    rows[:, 3] = pick.normal(0, 1, 300)
    rows = np.concatenate([rows, -rows[:150], [[5e-324, 1.0, 2.0**60, -0.0]]])
    want = [math.fsum(column) for column in rows.T]
    exact = [float(sum(map(Fraction, column))) for column in rows.T]
    assert want == exact
    for pieces in (1, 2, 7, 211):
        assert _summed(rows, pieces) == exact


def test_cancelling_and_extreme_sums():
    top = np.finfo(float).max
    rows = np.array([[1e308, 1.0, top, -top], [1e-308, 1e100, top, -top], [-1e308, -1e100, -top, 1.0]])
    assert _summed(rows, 2) == [1e-308, 1.0, top, -math.inf]
    assert E.ExactSums(2).sums() == [0.0, 0.0]


def test_numbers_that_are_none():
    rows = np.array([[math.inf, math.inf, math.nan], [1.0, -math.inf, 1.0]])
    found = _summed(rows, 2)
    assert found[0] == math.inf and math.isnan(found[1]) and math.isnan(found[2])


def test_many_rows_carry():
    sums = E.ExactSums(1)
    for _ in range(40):
        sums.add(np.full((50_000, 1), 0.1), np.ones((50_000, 1), bool))
    assert sums.sums() == [float(Fraction(0.1) * 2_000_000)] and abs(sums.limbs).max() <= 1 << 31


@pytest.mark.parametrize("tasks", [1, 7, 211])
def test_directions_are_equal_to_the_bit(spark, tasks):
    pick = np.random.default_rng(4)
    vectors = pick.normal(0, 1, (900, 5)) * 10.0 ** pick.integers(-9, 9, (900, 5))
    table = spark.createDataFrame([(v.tolist(), i % 3) for i, v in enumerate(vectors)], DDL)
    means = [[math.fsum(c) / len(c) for c in vectors[np.arange(900) % 3 == 0].T], [math.fsum(c) / len(c) for c in vectors[np.arange(900) % 3 != 0].T]]
    gap = [a - b for a, b in zip(*means)]
    added = lambda numbers: reduce(operator.add, numbers, 0.0)  # noqa: E731, as sum() compensates
    size = math.sqrt(added(g * g for g in gap))
    row = V.direction(table.repartition(tasks, F.rand(tasks)), F.col("label") == 0).first()
    assert row["v"] == [g / size for g in gap] and row["s"] == size
    assert row["midpoint"] == added(g * (a + b) for g, a, b in zip(gap, *means)) / 2 / size


def test_tasks_send_one_row_a_class(spark):
    table = spark.range(4000).select(
        F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i * F.col("id").cast("double")).alias("embedding"),
        (F.col("id") % 2).alias("label"),
    ).repartition(9)
    rows = table.select((F.col("label") == 0).alias("positive"), F.col("embedding").alias("vector"))
    assert rows.mapInArrow(E._sum_rows, E._PARTIAL).count() == 9 * 2
    plan = V.direction(table, F.col("label") == 0)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_missing_elements_and_vectors(spark):
    rows = [([1.0, None], 0), ([3.0, 4.0], 0), ([0.0, 1.0], 1), (None, 0), ([], 1)]
    found = {r["positive"]: r for r in E.class_means(spark.createDataFrame(rows, DDL), F.col("label") == 0, "embedding").collect()}
    assert found[True]["means"] == [2.0, 4.0] and found[True]["n"] == 2
    assert found[False]["means"] == [0.0, 1.0] and found[False]["n"] == 1 and found[False]["even"]
