"""Counters kept step by step, majorities over open labels, directions of the same input."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from condeval.operators import upkeep as U
from condeval.operators import vectors as V
from condeval.operators.rates import label_rates
from condeval.operators.votes import majority_labels, open_majority
from condeval.sources import directions as D
from condeval.sources import tables as S

DDL = "item string, step int, label string"


def labelled(spark, seed, rows=300):
    pick = random.Random(seed)
    labels = ["FIGURATIVE", "LITERAL", "INCOHERENT", "UNPARSEABLE", None]
    return spark.createDataFrame([(f"i{pick.randrange(6)}", pick.randrange(4), pick.choice(labels)) for _ in range(rows)], DDL)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_rates_after_each_append_equal_a_recount(spark, tmp_path):
    out = str(tmp_path / "r")
    schema = labelled(spark, 0).schema
    for seed in range(5):
        S.append_step(labelled(spark, seed), out)
        counts = U.kept_counts(spark, out, schema, ["item", "step"])
        whole = S.read_results(spark, out, schema)
        same(label_rates(counts, "step"), label_rates(whole, "step"))
        same(majority_labels(counts, ["item", "step"]), majority_labels(whole, ["item", "step"]))
        assert U.uncounted_steps(spark, out, "labels") == []


def test_only_new_steps_are_read(spark, tmp_path, monkeypatch):
    out, read = str(tmp_path / "r"), []
    schema = labelled(spark, 0).schema
    counted = U.count_labels

    def spying(rows, keys, label):
        read.extend(re.findall(r"step=(\w+)", " ".join(rows.inputFiles())))
        return counted(rows, keys, label)

    monkeypatch.setattr(U, "count_labels", spying)
    first = S.append_step(labelled(spark, 1), out)
    U.kept_counts(spark, out, schema, "step")
    second = S.append_step(labelled(spark, 2), out)
    counts = U.kept_counts(spark, out, schema, "step")
    assert list(dict.fromkeys(read)) == [first, second]
    assert not any("step=" in file for file in counts.inputFiles())


def test_counting_resumes_after_a_loss(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "r")
    schema = labelled(spark, 0).schema
    S.append_step(labelled(spark, 1), out)
    S.append_step(labelled(spark, 2), out)
    counted, calls = U.count_labels, []

    def lost_on_second(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return counted(*args)

    monkeypatch.setattr(U, "count_labels", lost_on_second)
    with pytest.raises(RuntimeError):
        U.kept_counts(spark, out, schema, "step")
    assert len(U.uncounted_steps(spark, out, "labels")) == 1
    monkeypatch.setattr(U, "count_labels", counted)
    same(label_rates(U.kept_counts(spark, out, schema, "step"), "step"), label_rates(S.read_results(spark, out, schema), "step"))


def test_no_steps_give_no_counters(spark, tmp_path):
    assert U.kept_counts(spark, str(tmp_path / "none"), labelled(spark, 0).schema, "step").count() == 0


def test_open_majorities_equal_brute_force(spark):
    pick = random.Random(8)
    rows = []
    for group in range(150):
        many = pick.choice([1, 2, 3, 50])
        rows += [(f"g{group}", 0, pick.choice([None, "", *(f"label {i}" for i in range(many))])) for _ in range(pick.randrange(1, 12))]
    rows += [("hot", 1, "x" if i % 2 else f"other {i}") for i in range(1001)] + [("hot", 1, "x")] * 3
    rows += [(None, 1, "x"), ("none", None, "x"), ("empty", 2, None)]
    found = {(r["item"], r["step"]): (r["n_labelled"], r["majority"]) for r in open_majority(spark.createDataFrame(rows, DDL), ["item", "step"]).collect()}
    groups = {}
    for item, step, label in rows:
        if item is not None and step is not None:
            groups.setdefault((item, step), Counter()).update([label] if label is not None else [])
    want = {}
    for key, counts in groups.items():
        n = counts.total()
        want[key] = (n, next((label for label, c in counts.items() if 2 * c > n), None))
    assert found == want and found["hot", 1][1] == "x" and found["empty", 2] == (0, None)


def test_the_state_of_a_vote_does_not_grow_with_the_labels(spark):
    table = spark.range(20_000).selectExpr("id % 3 AS item", "string(id) AS label")
    plan = open_majority(table, ["item"])._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan and "partial_count" in plan
    assert {r["majority"] for r in open_majority(table, ["item"]).collect()} == {None}


def test_a_vote_shuffles_narrow_rows(spark):
    """A group mostly has few rows, so 64 counters a group were many times its rows."""
    table = spark.range(1000).selectExpr("id % 400 AS item", "id % 3 AS step", "string(id % 7) AS label")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = open_majority(table, ["item", "step"])._jdf.queryExecution().explainString(mode)
    widths = [int(n) for n in re.findall(r"\) Exchange\s+Input \[(\d+)\]", plan)]
    assert widths and max(widths) <= 6


def test_a_direction_is_reused_for_the_same_rows_only(spark, tmp_path):
    rows = [([3.0, 4.0], 1), ([0.0, 0.0], 0), ([0.0, 1.0], 0)]
    path, built = str(tmp_path / "d"), []

    def make(rows, tasks=1):
        table = spark.createDataFrame(rows, "embedding array<float>, label int").repartition(tasks)

        def build():
            built.append(1)
            return V.direction(table, F.col("label") == 1)

        return D.build_or_reuse_direction(spark, path, build, 14, "m", source=table).first()

    make(rows)
    make(rows[::-1], 3)
    assert len(built) == 1
    changed = [([3.0, 4.5], 1), *rows[1:]]
    for n, other in enumerate((changed, rows, rows[:2], rows, [*rows, rows[1]], [([3.0, 4.0], 1), ([0.0, 0.0], None), ([0.0, 1.0], 0)]), 2):
        make(other)
        assert len(built) == n
    assert make(rows)["model"] == "m"
