"""Steps that enter a table whole, labels asked once, and work dealt by cost."""

import os
import signal
import subprocess
import sys
import textwrap
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from condeval.operators import batch as X
from condeval.operators.dealing import dealt_by_cost
from condeval.sources import tables as S

DDL = "item int, prefix string"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def writer():
    def load():
        return lambda prefixes, coefficients, samples: [[f"{p} {i}" for i in range(samples)] for p in prefixes]

    return load


def generate(items, out, **more):
    return X.run_generation(items, writer(), out, ["item"], [0.0, 1.0], samples=3, tasks=2, **more)


def test_a_step_is_seen_whole_or_not_at_all(spark, frame, tmp_path, monkeypatch):
    """Lost before the rename, and between the rename and the list: readers see the steps before."""
    out = str(tmp_path / "t")
    rows = frame([(i, "p") for i in range(10)], DDL)
    S.append_step(rows, out)
    before = sorted(S.read_results(spark, out, rows.schema).collect())

    def lost(*_):
        raise RuntimeError("lost")

    listing = S._list_step
    monkeypatch.setattr(S, "_list_step", lost)
    with pytest.raises(RuntimeError):
        S.append_step(rows, out)
    monkeypatch.setattr(S, "_list_step", listing)
    rows.write.parquet(f"{out}/{S.WRITING}/half")
    assert sorted(S.read_results(spark, out, rows.schema).collect()) == before
    assert len(S.remove_unlisted(spark, out)) == 2 and S.remove_unlisted(spark, out) == []
    assert sorted(S.read_results(spark, out, rows.schema).collect()) == before
    assert spark.read.parquet(out).count() == 10  # a reader without the list sees whole steps


def test_files_of_plain_appends_are_read_beside_steps(spark, frame, tmp_path):
    out = str(tmp_path / "t")
    rows = frame([(1, "a"), (2, "b")], DDL)
    S.append_rows(rows, out)
    S.append_step(rows, out)
    assert S.read_results(spark, out, rows.schema).count() == 4


KILLED = """
    import os, signal, sys
    sys.path.insert(0, {root!r})
    from condeval.session import local_session
    from condeval.operators import batch as X
    from condeval.sources import tables as S

    spark = local_session(2, "killed", **{{"spark.driver.memory": "1g", "spark.checkpoint.dir": {shared!r}}})
    items = spark.createDataFrame([(i, f"p{{i}}") for i in range(40)], "item int, prefix string")
    calls = []
    listing = S._list_step

    def list_or_die(*place):
        calls.append(1)
        if len(calls) == 2:
            os.kill(os.getpid(), signal.SIGKILL)
        listing(*place)

    S._list_step = list_or_die
    load = lambda: lambda prefixes, coefficients, samples: [[f"{{p}} {{i}}" for i in range(samples)] for p in prefixes]
    X.run_generation(items, load, {out!r}, ["item"], [0.0, 1.0], samples=3, steps=4, tasks=2)
"""


def test_a_killed_run_leaves_no_part_of_a_condition(spark, frame, tmp_path):
    out, shared = str(tmp_path / "raw"), str(tmp_path / "shared")
    script = textwrap.dedent(KILLED.format(root=ROOT, out=out, shared=shared))
    ended = subprocess.run([sys.executable, "-c", script], capture_output=True, timeout=300)
    assert ended.returncode == -signal.SIGKILL, ended.stderr[-2000:]
    items = frame([(i, f"p{i}") for i in range(40)], DDL)
    schema = items.withColumns({"coefficient": F.lit(0.0), "sample_i": F.lit(0), "continuation": F.lit("")}).schema
    seen = S.read_results(spark, out, schema)
    sizes = {r["count"] for r in seen.groupBy("item", "coefficient").count().collect()}
    assert sizes == {3} and 0 < seen.count() < 240 and len(S.committed_steps(spark, out)) == 1
    whole = generate(items, out)
    assert whole.count() == 240 and whole.dropDuplicates(["item", "coefficient", "sample_i"]).count() == 240


def test_steps_follow_from_the_tasks(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "ROWS_PER_TASK", 5)
    out = str(tmp_path / "raw")
    assert generate(frame([(i, f"p{i}") for i in range(40)], DDL), out).count() == 240
    assert len(S.committed_steps(spark, out)) == 8  # 80 conditions, 5 for each of 2 tasks


def counting(folder):
    """A labeller that leaves every prompt it sees in a file of its own."""

    def load():
        def answer(prompts):
            for prompt in prompts:
                with open(f"{folder}/{uuid.uuid4()}", "w") as file:
                    file.write(prompt)
            return ["LITERAL" if "a" in p else "figurative" for p in prompts]

        return answer

    return load


def seen_in(folder):
    return sorted((folder / name).read_text() for name in os.listdir(folder))


def test_each_distinct_prompt_is_asked_once(frame, tmp_path):
    rows = [(i, "hot a" if i % 3 == 0 else f"p{i % 20}") for i in range(120)] + [(200, None), (201, "")]
    table = frame(rows, "_digest int, _prompt string")  # the names used inside
    folder = tmp_path / "calls"
    folder.mkdir()
    got = X.label_distinct(table, "_prompt", counting(folder), 4, tasks=3)
    assert got.columns == ["_digest", "_prompt", "label"]
    found = {r["_digest"]: r["label"] for r in got.collect()}
    assert found == {i: None if p is None else "LITERAL" if "a" in p else "FIGURATIVE" for i, p in rows}
    assert seen_in(folder) == sorted({p for _, p in rows if p is not None})


def test_a_run_asks_once_over_all_its_steps(frame, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    table = frame([(i, f"p{i % 30}") for i in range(300)] + [(999, None)], "n int, continuation string")
    whole = X.run_labelling(table, F.col("continuation"), counting(folder), str(tmp_path / "l"), ["n"], steps=5, tasks=2)
    assert whole.count() == 301 and whole.filter("label IS NULL").count() == 1
    assert seen_in(folder) == sorted(f"p{i}" for i in range(30))


def test_tasks_get_about_the_same_cost(spark):
    """Lengths spread over four orders of magnitude: the largest task is within 1.2 of the mean."""
    lengths = np.exp(np.random.default_rng(3).normal(5, 1.5, 6000)).astype(int).clip(1, 20_000).tolist()
    table = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "i int, n int")
    rows = table.withColumn("digest", F.sha2(F.col("i").cast("string"), 256))
    dealt = dealt_by_cost(rows, "digest", F.col("n"), 8).withColumn("task", F.spark_partition_id())
    costs = [r[1] for r in dealt.groupBy("task").agg(F.sum("n")).collect()]
    assert len(costs) == 8 and max(costs) <= 1.2 * sum(lengths) / 8
    assert sorted(r["i"] for r in dealt.collect()) == list(range(6000))


def test_dealing_few_rows_and_none(spark):
    rows = spark.createDataFrame([(1, "00ff"), (2, "ffff")], "i int, digest string")
    assert sorted(r["i"] for r in dealt_by_cost(rows, "digest", F.lit(1), 5).collect()) == [1, 2]
    assert dealt_by_cost(rows.limit(0), "digest", F.lit(1), 5).count() == 0


def test_the_longest_prompts_of_a_task_do_not_meet(spark, tmp_path):
    """Of 12,000 prompts a tenth is long: no 2,048 in the order they are asked in hold many of these."""
    folder = str(tmp_path)
    table = spark.range(12_000).selectExpr("CASE WHEN id % 10 = 0 THEN repeat(string(id), 500) ELSE string(id) END AS prompt")

    def load():
        def answer(prompts):
            with open(f"{folder}/{os.getpid()}", "a") as out:
                out.writelines(f"{len(p)}\n" for p in prompts)
            return ["Final label: LITERAL"] * len(prompts)

        return answer

    assert X.label_distinct(table, "prompt", load, tasks=1).filter("label = 'LITERAL'").count() == 12_000
    lengths = [int(n) for file in os.listdir(folder) for n in open(f"{folder}/{file}")]
    assert len(lengths) == 12_000
    windows = [sum(lengths[at : at + 2048]) for at in range(0, 12_000 - 2048, 512)]
    assert max(windows) < 1.5 * sum(windows) / len(windows)
