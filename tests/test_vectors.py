import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from condeval.operators import vectors as V

RNG = np.random.default_rng(7)
ROWS = [(i, RNG.normal(i % 2, 1, 6).tolist(), "figurative" if i % 2 else "literal") for i in range(60)]
DDL = "id int, embedding array<float>, label string"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([*ROWS, (99, None, "figurative")], DDL)


def _direction(vectors):
    return V.direction(vectors, F.col("label") == "figurative")


def _expected():
    x = np.array([r[1] for r in ROWS], dtype=np.float32).astype(float)
    mark = np.array([r[2] == "figurative" for r in ROWS])
    m1, m0 = x[mark].mean(0), x[~mark].mean(0)
    s = np.linalg.norm(m1 - m0)
    v = (m1 - m0) / s
    return x, mark, v, s, (m1 + m0) @ v / 2


def test_direction(vectors):
    row = _direction(vectors).first()
    _, mark, v, s, midpoint = _expected()
    assert np.allclose(row["v"], v) and row["s"] == pytest.approx(s)
    assert row["midpoint"] == pytest.approx(midpoint)
    assert (row["n_positive"], row["n_other"]) == (mark.sum(), (~mark).sum())
    assert np.linalg.norm(row["v"]) == pytest.approx(1)


def test_everything_else_is_the_other_class(frame):
    rows = frame([([2.0, 0.0], "figurative"), ([0.0, 0.0], "other"), ([0.0, 0.0], None)], "embedding array<float>, label string")
    row = _direction(rows).first()
    assert (row["n_other"], row["s"], row["v"]) == (2, 2.0, [1.0, 0.0])


def test_equal_means_give_no_direction(frame):
    rows = frame([([1.0, 2.0], "figurative"), ([1.0, 2.0], "literal")], "embedding array<float>, label string")
    row = _direction(rows).first()
    assert row["s"] == 0 and row["v"] is None and row["midpoint"] is None


@pytest.mark.parametrize(
    "rows, message",
    [
        ([([1.0], "figurative")], "no vectors"),
        ([([1.0], "figurative"), (None, "literal")], "no vectors"),
        ([], "no vectors"),
        ([([1.0], "figurative"), ([1.0, 2.0], "figurative"), ([1.0, 2.0], "literal")], "differ in length"),
    ],
)
def test_unusable_classes_fail(frame, rows, message):
    with pytest.raises(PySparkException, match=message):
        _direction(frame(rows, "embedding array<float>, label string")).collect()


def test_shift_moves_the_projection(vectors):
    found = _direction(vectors)
    x, _, v, s, _ = _expected()
    moved = V.shift_vectors(vectors.filter("embedding is not null"), found, -2.39).orderBy("id").collect()
    got = np.array([r["shifted"] for r in moved])
    assert np.allclose(got, x - 2.39 * s * v)
    assert np.allclose(got @ v, x @ v - 2.39 * s)
    same = V.shift_vectors(vectors, found, 0).filter("id = 3").first()
    assert same["shifted"] == pytest.approx(x[3].tolist())


def test_sweep_matches_explicit_shifts(vectors):
    x, mark, v, s, midpoint = _expected()
    rows = V.shift_sweep(vectors, _direction(vectors), "label").collect()
    assert len(rows) == 18
    for r in rows:
        part = x[mark] if r["label"] == "figurative" else x[~mark]
        literal = np.mean((part + r["coefficient"] * s * v) @ v <= midpoint)
        assert r["LITERAL"] == pytest.approx(literal, abs=6e-4)


def test_sweep_is_monotone(vectors):
    rows = V.shift_sweep(vectors, _direction(vectors)).orderBy("coefficient").collect()
    literal = [r["LITERAL"] for r in rows]
    assert literal == sorted(literal, reverse=True) and literal[0] == 1.0 and literal[-1] == 0.0


def test_direction_plan_aggregates_before_it_shuffles(vectors):
    """The vectors are under no shuffle but that of one row a task and class, and no element is a row."""
    plan = _direction(vectors)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("MapInArrow _sum_rows") :]
    assert "Exchange" not in below and "Generate" not in plan and "Exchange hashpartitioning(_group" in plan
