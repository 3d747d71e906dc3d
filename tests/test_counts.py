import pytest

from condeval.operators import bootstrap as B
from condeval.operators import rates as R
from condeval.operators import votes as M
from condeval.operators.counts import COUNTERS, count_labels, unknown_labels, with_item_columns

LABELS = ["LITERAL", "FIGURATIVE", "INCOHERENT", "UNPARSEABLE", None]
# One item holds a third of all rows.
ROWS = [(i % 7 if i % 3 else 0, (i % 5) - 2, LABELS[(i * i + i // 4) % 5]) for i in range(600)]
ITEMS = [(i, "ab"[i % 2] if i < 6 else None, f"e{i % 4}", i % 3 == 0) for i in range(7)]


@pytest.fixture(scope="module")
def both(spark):
    lines = spark.createDataFrame([*ROWS, (None, 0, "LITERAL"), (99, 0, "LITERAL")], "item int, step int, label string")
    items = spark.createDataFrame(ITEMS, "item int, category string, expression string, gold boolean")
    return (
        lines.join(items, "item"),
        with_item_columns(lines, items, "item", "step"),
    )


OPERATORS = {
    "rates": lambda t: R.label_rates(t, ["category", "step"]),
    "pooled": lambda t: R.pooled_and_grouped_rates(t, "category", "step"),
    "trusted": lambda t: R.trusted_rates(t, "step"),
    "literal": lambda t: R.literal_rate(t, "category"),
    "deltas": lambda t: R.literal_deltas(t, "step", -2, 0, "category"),
    "majority": lambda t: M.majority_labels(t, ["expression", "step"]),
    "flips": lambda t: M.label_flips(t, ["item"], "step", -2),
    "clusters": lambda t: B.cluster_counts(t, "category", "expression", "step", -2),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_counted_tables_give_the_same_as_rows(both, name):
    rows, counted = (sorted(map(str, OPERATORS[name](t).collect())) for t in both)
    assert rows == counted and rows


def test_items_are_joined_after_counting(both):
    rows, counted = both
    assert set(COUNTERS) <= set(counted.columns) and "label" in rows.columns
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "partial_count_if" in plan or "partial_count(" in plan
    assert counted.filter("item = 0").count() == 5


def test_counters(frame):
    table = frame([("k", "LITERAL"), ("k", None), ("k", "UNPARSEABLE"), ("k", "odd")], "k string, label string")
    assert tuple(count_labels(table, "k").first()) == ("k", 4, 3, 0, 1, 0, 1)
    again = count_labels(count_labels(table, "k"), [])
    assert tuple(again.first()) == (4, 3, 0, 1, 0, 1)


def test_unknown_labels(frame):
    table = frame([("odd",), ("odd",), ("LITERAL",), (None,), ("literal",)], "label string")
    assert sorted(map(tuple, unknown_labels(table).collect())) == [("literal", 1), ("odd", 2)]
