import pytest
from golden import BY_CATEGORY, BY_CONDITION, COUNTS, DELTAS, labelled_rows
from pyspark.sql import functions as F

from condeval.operators import rates as R
from condeval.plans.reports import comparison_report

FIGURATIVE = ("Conventional Metaphor", "Novel Metaphor", "Simile")
DDL = "category string, alpha_factor double, label string"


@pytest.fixture(scope="module")
def idiom(spark):
    return spark.createDataFrame(labelled_rows(["Idiom"]), DDL)


@pytest.fixture(scope="module")
def figurative(spark):
    return spark.createDataFrame(labelled_rows(FIGURATIVE), DDL)


@pytest.fixture(scope="module")
def report(idiom, figurative):
    return comparison_report(idiom, figurative)


def test_published_rates_by_condition(report):
    rows = report["summary_by_condition"].select(
        "alpha_factor",
        "idiom_literal_rate",
        "figurative_literal_rate",
        "idiom_coherence_rate",
        "figurative_coherence_rate",
    )
    assert [tuple(r) for r in rows.collect()] == list(BY_CONDITION)


def test_published_rates_by_category(report):
    rows = [tuple(r) for r in report["summary_by_category"].collect()]
    assert rows == list(BY_CATEGORY)


def test_published_deltas(report):
    got = {r["series"]: r for r in report["deltas"].collect()}
    assert {k: round(v["delta"], 9) for k, v in got.items()} == DELTAS
    assert got["idiom"]["shown"] == "+0.166" and got["Novel Metaphor"]["shown"] == "-0.008"


def test_report_without_trusted_column_has_no_trusted_table(report):
    assert "summary_trusted" not in report


def test_trusted_table_and_delta(figurative, idiom):
    marked = figurative.withColumn("gold", F.col("category") == "Simile")
    tables = comparison_report(idiom, marked)
    assert tables["summary_trusted"].count() == 9
    got = {r["series"]: r["delta"] for r in tables["deltas"].collect()}
    assert got["gold"] == pytest.approx(got["Simile"])


def test_effect_ratio(spark, report):
    got = {r["series"]: r["delta"] for r in report["deltas"].collect()}
    ratio = R.effect_ratio(F.lit(got["figurative"]), F.lit(got["idiom"]))
    assert spark.range(1).select(ratio).first()[0] == pytest.approx(0.7, abs=0.01)


def test_unrounded_delta_matches_published_point(idiom):
    row = R.literal_deltas(idiom, "alpha_factor", -4.78).first()
    assert row["delta"] == 0.16599999999999998


def test_dose_response_of_published_rates(idiom, figurative):
    for rows, peak in ((idiom, -3.59), (figurative, -4.78)):
        row = R.dose_response(R.label_rates(rows, "alpha_factor"), "alpha_factor").first()
        assert row["negatives_above"] and row["positives_not_above"]
        assert row["peak"] == peak
    by_category = R.label_rates(figurative, ["category", "alpha_factor"])
    rows = {r["category"]: r for r in R.dose_response(by_category, "alpha_factor", series="category").collect()}
    assert rows["Simile"]["min_coherence_rate"] == 0.84
    assert not rows["Novel Metaphor"]["negatives_above"]


@pytest.fixture
def edges(frame):
    return frame(
        [
            ("a", 0.0, "LITERAL"),
            ("a", 0.0, None),
            ("a", 0.0, "UNPARSEABLE"),
            ("a", 0.0, "FIGURATIVE"),
            ("a", 1.0, None),
            (None, 0.0, "LITERAL"),
            ("b", None, "LITERAL"),
        ],
        "category string, c double, label string",
    )


def test_null_labels_and_keys_leave_the_rates(edges):
    rows = [tuple(r) for r in R.label_rates(edges, ["category", "c"]).collect()]
    assert rows == [("a", 0.0, 0.333, 0.333, 0.0, 0.667)]


def test_pooled_rates_keep_rows_without_a_group(edges):
    rows = {(r["pooled"], r["category"]): r for r in R.pooled_and_grouped_rates(edges, "category", "c").collect()}
    assert set(rows) == {(True, None), (False, "a")}
    assert rows[(True, None)]["LITERAL"] == 0.5


def test_literal_rate_counts_missing_labels(edges):
    rows = {r["category"]: r["literal_rate"] for r in R.literal_rate(edges.filter("c = 0"), "category").collect()}
    assert rows["a"] == 0.25
    assert R.literal_rate(edges.filter("false")).first()["literal_rate"] is None


def test_label_shares_add_up_to_one(edges):
    shares = R.label_rates(edges, "c", places=None).filter("c = 0").first()
    unparseable = 1 / 4
    total = shares["FIGURATIVE"] + shares["LITERAL"] + shares["INCOHERENT"] + unparseable
    assert total == pytest.approx(1)


def test_full_join_keeps_conditions_of_either_side(frame):
    ddl = "c double, label string"
    first = R.label_rates(frame([(-1.0, "LITERAL"), (0.0, "LITERAL")], ddl), "c")
    second = R.label_rates(frame([(0.0, "FIGURATIVE"), (1.0, "LITERAL")], ddl), "c")
    rows = R.combine_rates(first, second, "c", ("x", "y")).collect()
    assert [(r["c"], r["x_literal_rate"], r["y_literal_rate"]) for r in rows] == [
        (-1.0, 1.0, None),
        (0.0, 1.0, 0.0),
        (1.0, None, 1.0),
    ]


def test_missing_baseline_gives_no_delta(frame):
    rates = R.label_rates(frame([(-1.0, "LITERAL")], "c double, label string"), "c")
    assert R.rate_deltas(rates, "c", -1.0).first()["delta"] is None


def test_rounding_is_half_to_even(frame):
    rows = frame([("LITERAL",)] * 1 + [("FIGURATIVE",)] * 15, "label string").withColumn("c", F.lit(0))
    assert R.label_rates(rows, "c").first()["LITERAL"] == 0.062
