"""Physical properties that matter on large tables."""

import functools
import re

import pytest

from condeval.plans.catalogue import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plan_of(spark):
    @functools.cache
    def explain(name):
        frame = QUERIES[name](spark, FOLDER)
        return frame._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )

    return explain


def read_columns(plan):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*)>", plan)]


@pytest.mark.parametrize(
    "name, columns",
    [
        ("q09_rates_by_step", [{"l_linenumber", "l_quantity", "l_discount", "l_returnflag"}]),
        ("q05_pending_rows", [{"doc_id", "lang", "source", "n_chars"}, {"doc_id"}]),
        ("q33_rating_coverage", [{"doc_id", "lang"}, {"doc_id", "quality", "toxic"}]),
        ("q06_prompt_render", [{"doc_id", "text", "lang", "source"}]),
        ("q29_categories", [{"p_type"}]),
    ],
)
def test_scans_read_only_what_is_used(plan_of, name, columns):
    assert read_columns(plan_of(name)) == columns


def test_filters_reach_the_scan(plan_of):
    assert "IsNotNull(embedding)" in plan_of("q21_direction")


@pytest.mark.parametrize("name", ["q18_rater_agreement", "q19_confusion_rates", "q28_table_shape"])
def test_texts_are_not_read_for_labels(plan_of, name):
    assert all("text" not in columns for columns in read_columns(plan_of(name)))


@pytest.mark.parametrize(
    "name",
    [
        "q01_profile",
        "q04_pending_conditions",
        "q09_rates_by_step",
        "q10_rates_grouping_sets",
        "q14_dose_response",
        "q16_majority_label",
        "q17_label_flips",
        "q18_rater_agreement",
        "q25_suite_invariants",
        "q32_majority_per_item",
    ],
)
def test_rows_are_aggregated_before_the_first_shuffle(plan_of, name):
    plan = plan_of(name)
    assert "partial_" in plan
    aggregate = min(int(n) for n in re.findall(r"\((\d+)\) (?:Object)?HashAggregate", plan))
    shuffles = [int(n) for n in re.findall(r"\((\d+)\) Exchange", plan)]
    assert aggregate < min(shuffles)


def test_vectors_are_summed_before_the_first_shuffle(plan_of):
    """In Arrow blocks, as Spark's own sums of doubles are not exact."""
    plan = plan_of("q21_direction")
    summed = min(int(n) for n in re.findall(r"\((\d+)\) MapInArrow", plan))
    assert summed < min(int(n) for n in re.findall(r"\((\d+)\) Exchange", plan))


@pytest.mark.parametrize(
    "name", ["q02_contrast_pool", "q03_condition_grid", "q06_prompt_render", "q07_label_parse", "q08_span_end_token", "q26_batch_label", "q27_batch_generate"]
)
def test_row_wise_queries_do_not_shuffle(plan_of, name):
    assert "Exchange" not in plan_of(name)


def test_no_query_uses_a_cross_join(plan_of):
    for name in QUERIES:
        plan = plan_of(name)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_python_is_used_for_callers_models_splits_and_exact_sums_only(plan_of):
    with_python = {n for n in QUERIES if re.search("Python|MapInPandas|MapInArrow", plan_of(n))}
    models = {"q26_batch_label", "q27_batch_generate", "q44_label_once"}
    splits = {"q23_bootstrap_ci", "q24_bootstrap_pairwise", "q42_bootstrap_items"}
    assert with_python == models | splits | {"q21_direction", "q22_shift_sweep", "q38_shifted_vectors"}


def test_building_a_query_starts_no_job(spark):
    context = spark.sparkContext
    for name, query in QUERIES.items():
        context.setJobGroup(f"building {name}", name)
        query(spark, FOLDER)
        assert not context.statusTracker().getJobIdsForGroup(f"building {name}"), name
    context.setLocalProperty("spark.jobGroup.id", None)


def test_spans_are_looked_up_in_texts_lowered_once(plan_of):
    plan = plan_of("q08_span_end_token")
    assert plan.count("lower(text") == 1
    assert plan.index("lower(text") < plan.rindex(") Generate")


@pytest.mark.parametrize("name", ["q13_delta_vs_baseline", "q31_rounded_deltas"])
def test_the_lowest_condition_comes_from_the_counts(plan_of, name):
    assert len([c for c in read_columns(plan_of(name)) if "l_discount" in c]) == 1


def test_no_broadcast_hint(plan_of):
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "condeval"
    for file in root.glob("[!l]*/*.py"):
        assert "F.broadcast(" not in file.read_text(), file
