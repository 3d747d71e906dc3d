"""Both experiments from suite files to report files, with rules in place of models."""

from pyspark.sql import functions as F

from condeval.functions.text import fill_template
from condeval.operators import pool as P
from condeval.operators import vectors as V
from condeval.operators.batch import run_generation, run_labelling
from condeval.operators.grid import COEFFICIENTS, SAMPLES
from condeval.plans.reports import bootstrap_report, comparison_report, write_report
from condeval.sources import tables as S
from condeval.sources.directions import build_or_reuse_direction

IDIOMS = ("see red", "on ice", "take a bow")
FIGURES = (("Simile", "like a lock"), ("Simile", "like a vault"), ("Conventional Metaphor", "change gears"), ("Conventional Metaphor", "cut the ties"))


def writer(norm):
    def load():
        def write(prefixes, coefficients, samples):
            # Stronger negative coefficients push more samples to the literal wording.
            return [
                [" as such" if i + (len(p) % 3) - 1 < -c * norm else " in a way" for i in range(samples)]
                for p, c in zip(prefixes, coefficients)
            ]

        return write

    return load


def judge():
    def load():
        def answer(prompts):
            return ["FINAL LABEL: " + ("LITERAL" if "as such" in p else "FIGURATIVE") for p in prompts]

        return answer

    return load


def _experiment(spark, folder, name, suite_path, schema, key, norm):
    suite = S.read_csv_table(spark, suite_path, schema)
    raw = run_generation(
        suite, writer(norm), f"{folder}/raw_{name}", [key, "variant_id"], condition="alpha_factor", steps=2, tasks=2
    )
    assert raw.count() == suite.count() * len(COEFFICIENTS) * SAMPLES
    prompt = fill_template("{e}: {p}{c}", e=key, p="prefix", c="continuation")
    keys = [key, "variant_id", "alpha_factor", "sample_i"]
    return run_labelling(raw, prompt, judge(), f"{folder}/labelled_{name}", keys, steps=2, tasks=2)


def test_two_experiments(spark, frame, tmp_path):
    folder = str(tmp_path)
    idioms = frame([(e, v, f"{v} times, {e}") for e in IDIOMS for v in range(1, 6)], "idiom string, variant_id int, prefix string")
    figures = frame(
        [(c, e, v, f"{v} times, {e}", v == 2) for c, e in FIGURES for v in range(1, 6)],
        "category string, expression string, variant_id int, prefix string, gold boolean",
    )
    S.write_report_csv(idioms, f"{folder}/idioms")
    S.write_report_csv(figures, f"{folder}/figures")
    assert P.suite_invariants(S.read_csv_table(spark, f"{folder}/figures", S.FIGURATIVE_SUITE)).filter("holds").count() == 4

    vectors = frame([([1.0, 0.0], "figurative"), ([0.0, 1.0], "literal")], "embedding array<float>, label string")
    found = build_or_reuse_direction(
        spark, f"{folder}/direction", lambda: V.direction(vectors, F.col("label") == "figurative"), 14, "rule"
    )
    norm = found.first()["s"]

    first = _experiment(spark, folder, "idioms", f"{folder}/idioms", S.IDIOM_SUITE, "idiom", norm)
    second = _experiment(spark, folder, "figures", f"{folder}/figures", S.FIGURATIVE_SUITE, "expression", norm)

    tables = comparison_report(first, second)
    assert set(tables) == {"summary_by_condition", "summary_by_category", "summary_trusted", "deltas"}
    curve = [r["idiom_literal_rate"] for r in tables["summary_by_condition"].collect()]
    assert curve == sorted(curve, reverse=True) and curve[0] > curve[4]
    assert all(r["delta"] > 0 for r in tables["deltas"].collect())

    tested = bootstrap_report(
        first, second, "Idiom", "idiom", -4.78, [("Idiom", "Simile"), ("Simile", "Conventional Metaphor")], replicates=100
    )
    intervals = {r["name"]: r for r in tested["intervals"].collect()}
    assert {k: r["n_groups"] for k, r in intervals.items()} == {"Idiom": 3, "Simile": 2, "Conventional Metaphor": 2}
    assert all(r["ci_lo"] <= r["delta"] + 1e-9 and r["delta"] <= r["ci_hi"] + 1e-9 for r in intervals.values())
    write_report({**tables, **tested}, f"{folder}/report")
    assert spark.read.option("header", True).csv(f"{folder}/report/summary_by_category").count() == 18
