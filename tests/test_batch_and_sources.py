import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from condeval.functions.text import fill_template
from condeval.operators import batch as X
from condeval.operators import vectors as V
from condeval.operators.grid import COEFFICIENTS
from condeval.operators.rates import label_rates
from condeval.sources import directions as D
from condeval.sources import tables as S


def prompt():
    return fill_template("{e}|{t}", e="expression", t="continuation")


def length_labeller():
    def load():
        def answer(prompts):
            assert len(prompts) <= 4
            return ["final label: literal" if len(p) % 2 else "figurative" for p in prompts]

        return answer

    return load


def writer():
    def load():
        def write(prefixes, coefficients, samples):
            return [[f"{p} {c} {i}" for i in range(samples)] for p, c in zip(prefixes, coefficients)]

        return write

    return load


def test_labels_keep_rows_and_order(frame):
    rows = frame([(i, "x" * i) for i in range(23)] + [(99, None)], "i int, continuation string").withColumn("expression", F.lit("e"))
    got = X.label_batches(rows, prompt(), length_labeller(), batch_size=4)
    assert got.columns == ["i", "continuation", "expression", "label"]
    labels = {r["i"]: r["label"] for r in got.collect()}
    assert labels.pop(99) is None
    assert labels == {i: "LITERAL" if (i + 2) % 2 else "FIGURATIVE" for i in range(23)}


def test_only_the_prompt_crosses_to_python(frame):
    rows = frame([("a", "b", "c")], "expression string, continuation string, other string")
    plan = X.label_batches(rows, prompt(), length_labeller())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [answers(") == 1


SUITE = "expression string, variant_id int, prefix string, gold boolean"


@pytest.fixture
def suite(frame):
    return frame([("see red", i, f"p{i}", i == 1) for i in range(1, 4)] + [("on ice", 1, "q", True)], SUITE)


def test_generation_resumes(suite, tmp_path):
    out = str(tmp_path / "raw")
    keys = ["expression", "variant_id"]
    run = lambda items, grid: X.run_generation(items, writer(), out, keys, grid, samples=2, steps=3, tasks=2)
    first = run(suite.filter("gold"), COEFFICIENTS[:2])
    assert first.count() == 2 * 2 * 2
    whole = run(suite, COEFFICIENTS)
    assert whole.count() == 4 * 9 * 2
    assert whole.dropDuplicates([*keys, "coefficient", "sample_i"]).count() == 4 * 9 * 2
    files = sorted(os.listdir(out))
    assert run(suite, COEFFICIENTS).count() == 4 * 9 * 2
    assert sorted(os.listdir(out)) == files
    row = whole.filter("expression = 'on ice' and coefficient = -4.78 and sample_i = 1").first()
    assert row["continuation"] == "q -4.78 1" and row["gold"] is True


def test_labelling_resumes_after_a_failed_step(frame, tmp_path):
    out = str(tmp_path / "labelled")
    rows = frame([("e", i, "x" * i) for i in range(40)], "expression string, n int, continuation string")
    done = []

    def stops_after_one_step(part):
        if done:
            raise RuntimeError("lost")
        done.append(1)
        return X.label_batches(part, prompt(), length_labeller(), 4)

    with pytest.raises(RuntimeError):
        X.run_in_steps(rows, stops_after_one_step, out, steps=4, tasks=2)
    schema = rows.withColumn("label", F.lit("x")).schema
    kept = S.read_results(rows.sparkSession, out, schema).count()
    assert 0 < kept < 40
    whole = X.run_labelling(rows, prompt(), length_labeller(), out, ["expression", "n"], steps=4, tasks=2, batch_size=4)
    assert whole.count() == 40 and whole.select("n").distinct().count() == 40
    assert whole.filter("label is null").count() == 0
    assert label_rates(whole, "expression").first()["coherence_rate"] == 1.0


def test_labelling_keeps_repeated_pending_rows(frame, tmp_path):
    rows = frame([("e", 1, "x"), ("e", 1, "x"), (None, 2, "y")], "expression string, n int, continuation string")
    whole = X.run_labelling(rows, prompt(), length_labeller(), str(tmp_path / "l"), ["expression", "n"], steps=2, tasks=1, batch_size=4)
    assert whole.count() == 3


def test_staging_is_a_new_folder_that_goes_with_the_run(spark, frame, tmp_path):
    one, two = (X._staging_path(spark, "/data/out") for _ in range(2))
    assert one != two and one.startswith(spark.sparkContext.getCheckpointDir())
    X.run_in_steps(frame([(i,) for i in range(9)], "i int"), lambda part: part, str(tmp_path / "o"), steps=2, tasks=1)
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [name for name in os.listdir(shared) if "pending" in name]


def test_rows_per_step_set_the_number_of_steps(spark, frame, tmp_path):
    sizes = []

    def work(part):
        sizes.append(part.count())
        return part

    rows = frame([(i,) for i in range(200)], "i int")
    X.run_in_steps(rows, work, str(tmp_path / "o"), tasks=1, rows_per_step=40)
    assert len(sizes) == 5 and sum(sizes) == 200
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == list(range(200))


def test_null_prefixes_are_not_sent(frame):
    rows = frame([("a", 1.0), (None, 1.0), ("b", 2.0)], "prefix string, coefficient double")
    got = {r["prefix"]: r["continuations"] for r in X.generate_batches(rows, writer(), samples=2).collect()}
    assert got == {"a": ["a 1.0 0", "a 1.0 1"], None: None, "b": ["b 2.0 0", "b 2.0 1"]}


def test_a_generator_with_too_few_texts_fails(frame):
    rows = frame([("a", 1.0)], "prefix string, coefficient double")
    short = lambda: lambda prefixes, coefficients, samples: [["one"] for _ in prefixes]
    with pytest.raises(PySparkException, match="must return 2 texts"):
        X.generate_batches(rows, short, samples=2).collect()


CSV = """category,expression,variant_id,prefix,gold,alpha_factor,sample_i,continuation
Simile,"like a lock, rusted",1,"He said ""no""
and left",true,-4.78,0,NA
Simile,x,2,p,False,0.0,1,
Simile,y,3,null,TRUE,1.2,2,"a
b"
"""


def test_csv_results(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(CSV)
    schema = S.results_schema(S.FIGURATIVE_SUITE)
    rows = S.read_csv_table(spark, str(path), schema).orderBy("variant_id").collect()
    assert rows[0]["expression"] == "like a lock, rusted" and rows[0]["prefix"] == 'He said "no"\nand left'
    assert [r["continuation"] for r in rows] == ["NA", None, "a\nb"]
    assert [r["gold"] for r in rows] == [True, False, True]
    assert rows[2]["prefix"] == "null" and rows[0]["alpha_factor"] == -4.78


def test_csv_header_is_checked(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("expression,variant_id,prefix\na,1,b\n")
    with pytest.raises(Exception, match="header does not conform"):
        S.read_csv_table(spark, str(path), S.IDIOM_SUITE).collect()


def test_report_csv_round_trip(spark, frame, tmp_path):
    table = frame([(-4.78, 0.5, 'a "b"\nc')], "alpha_factor double, rate double, note string")
    S.write_report_csv(table, str(tmp_path / "t"))
    S.write_report_csv(table, str(tmp_path / "t"))
    assert S.read_csv_table(spark, str(tmp_path / "t"), table.schema).collect() == table.collect()


def test_csv_appends_read_as_one_table(spark, frame, tmp_path):
    path = str(tmp_path / "raw")
    schema = S.results_schema(S.IDIOM_SUITE)
    for n in (1, 2):
        rows = spark.createDataFrame([("see red", n, 'p, "q"', 0.0, i, "a\nb") for i in range(3)], schema)
        S.append_csv_rows(rows.repartition(2), path)
    back = S.read_csv_table(spark, path, schema)
    assert back.count() == 6 and {r["continuation"] for r in back.collect()} == {"a\nb"}
    assert {r["prefix"] for r in back.collect()} == {'p, "q"'}


def test_missing_input_names_the_path(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="absent"):
        S.read_csv_table(spark, str(tmp_path / "absent"), S.IDIOM_SUITE)
    with pytest.raises(FileNotFoundError, match="Run the sweep"):
        S.read_parquet_table(spark, str(tmp_path / "absent"), hint="Run the sweep.")
    assert S.read_results(spark, str(tmp_path / "absent"), S.IDIOM_SUITE).count() == 0


def test_pools(spark, frame, tmp_path):
    for name in ("indexes", "queries"):
        frame([("s", "i", "i", "literal")], "sentence string, idiom string, span string, usage string").write.parquet(str(tmp_path / name))
    pools = S.read_pools(spark, str(tmp_path / "indexes"), str(tmp_path / "queries"))
    assert [p.count() for p in pools] == [1, 1]


def test_direction_is_stored_checked_and_reused(spark, frame, tmp_path):
    path = str(tmp_path / "direction")
    rows = frame([([3.0, 4.0], 1), ([0.0, 0.0], 0)], "embedding array<float>, label int")
    built = []

    def build():
        built.append(1)
        return V.direction(rows, F.col("label") == 1)

    with pytest.raises(FileNotFoundError):
        D.load_direction(spark, path)
    make = lambda model="m", **k: D.build_or_reuse_direction(spark, path, build, 14, model, **k)
    row = make().first()
    assert (row["s"], row["source_layer"], row["model"]) == (5.0, 14, "m") and row["v"] == pytest.approx([0.6, 0.8])
    make()
    assert len(built) == 1
    with pytest.raises(PySparkException, match="built on m, not on other"):
        make("other").collect()
    assert make("other", rebuild=True).first()["model"] == "other" and len(built) == 2
