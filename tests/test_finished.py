import re
import uuid

import pytest
from pyspark.sql import functions as F

from condeval.operators import batch as X
from condeval.operators.grid import pending_conditions, pending_rows
from condeval.sources import finished as K
from condeval.sources import tables as S

KEYS = ["item", "part", "coefficient"]


@pytest.fixture
def named(spark):
    """A new name for the catalogue, dropped afterwards."""
    name = f"finished_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.fixture
def sorted_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def results(spark, first, count):
    return spark.range(first, first + count).selectExpr(
        "id AS item", "if(id % 50 = 7, NULL, 'p') AS part", "if(id % 3 = 0, -0.0D, 1.5D) AS coefficient", "'t' AS text"
    )


def shuffled(frame):
    """What each exchange of a plan, before its run, stands on."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange"), re.findall(r"Bucketed: (\w+)", plan)


def test_only_the_items_are_shuffled(spark, tmp_path, named, sorted_joins):
    out, schema = str(tmp_path / "r"), results(spark, 0, 1).schema
    S.append_step(results(spark, 0, 300), out)
    S.append_step(results(spark, 200, 300), out)
    index = K.finished_keys(spark, out, schema, KEYS, named, buckets=8)
    rows = results(spark, 400, 300).withColumn("other", F.lit(1))
    todo = K.rows_not_in(rows, index, KEYS)
    assert shuffled(todo) == (1, ["true"])
    want = pending_rows(rows, S.read_results(spark, out, schema), KEYS)
    assert todo.columns == rows.columns and sorted(map(str, todo.collect())) == sorted(map(str, want.collect()))
    assert todo.filter("part IS NULL").count() == 6


def test_conditions_are_pending_as_before(spark, tmp_path, named, sorted_joins):
    out, schema = str(tmp_path / "r"), results(spark, 0, 1).schema
    S.append_step(results(spark, 0, 300), out)
    index = K.finished_keys(spark, out, schema, ["item"], named, ["coefficient"], buckets=8)
    items = spark.range(250, 350).selectExpr("id AS item")
    todo = pending_conditions(items, index, ["item"], [0.0, 1.5, 2.0])
    assert shuffled(todo) == (1, ["true"])
    want = pending_conditions(items, S.read_results(spark, out, schema), ["item"], [0.0, 1.5, 2.0])
    assert sorted(todo.collect()) == sorted(want.collect()) and todo.count() == 50 * 2 + 50 * 3


def test_the_index_follows_the_steps(spark, tmp_path, named, monkeypatch):
    out, schema = str(tmp_path / "r"), results(spark, 0, 1).schema
    keys = lambda: K.finished_keys(spark, out, schema, ["item"], named, buckets=4)
    assert keys().count() == 0
    S.append_step(results(spark, 0, 100), out)
    assert keys().count() == 100 and keys().count() == 100
    marking = K._mark_covered

    def lost(*_):
        raise RuntimeError("lost")

    S.append_step(results(spark, 100, 100), out)
    monkeypatch.setattr(K, "_mark_covered", lost)
    with pytest.raises(RuntimeError):
        keys()
    monkeypatch.setattr(K, "_mark_covered", marking)
    assert keys().distinct().count() == 200 and keys().count() == keys().count()
    rows = results(spark, 50, 300)
    assert K.rows_not_in(rows, keys(), ["item"]).count() == 150
    spark.sql(f"DROP TABLE {named}")  # another session registers it again
    assert keys().distinct().count() == 200


def test_runs_resume_from_the_index(spark, tmp_path, named):
    out = str(tmp_path / "raw")
    load = lambda: lambda prefixes, coefficients, samples: [[f"{p} {i}" for i in range(samples)] for p in prefixes]
    run = lambda items, grid: X.run_generation(items, load, out, ["item"], grid, 2, steps=2, tasks=2, index=named)
    items = lambda n: spark.range(n).selectExpr("id AS item", "string(id) AS prefix")
    assert run(items(10), [0.0]).count() == 20
    whole = run(items(15), [0.0, 1.0])
    assert whole.count() == 60 and whole.dropDuplicates(["item", "coefficient", "sample_i"]).count() == 60
    steps = S.committed_steps(spark, out)
    assert run(items(15), [0.0, 1.0]).count() == 60 and S.committed_steps(spark, out) == steps


def test_labelling_resumes_from_the_index(spark, tmp_path, named):
    out = str(tmp_path / "labelled")
    load = lambda: lambda prompts: ["LITERAL"] * len(prompts)
    run = lambda rows: X.run_labelling(rows, F.col("text"), load, out, KEYS, steps=2, tasks=2, index=named)
    assert run(results(spark, 0, 50)).count() == 50
    assert run(results(spark, 0, 80)).count() == 81  # the row with a NULL key comes again
