"""Every registered query: (spark, table folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from condeval.functions.text import fill_template, full_text, locate_span_lists, parse_labels
from condeval.operators import agreement as A
from condeval.operators import bootstrap as B
from condeval.operators import grid as G
from condeval.operators import pool as P
from condeval.operators import rates as R
from condeval.operators import vectors as V
from condeval.operators import votes as M
from condeval.operators.batch import generate_batches, label_batches, label_distinct
from condeval.plans import bindings as T
from condeval.plans.bindings import BASELINE, PUSH, STEPS, table
from condeval.plans.reports import comparison_report
from condeval.sources.verdicts import parse_blocks

Query = Callable[[SparkSession, str], DataFrame]

REPLICATES = 1000
ITEM_REPLICATES = 200
PAIRS = (("SMALL", "LARGE"), ("PROMO", "ECONOMY"), ("STANDARD", "MEDIUM"), ("SMALL", "PROMO"))
PROMPT = 'Passage in {lang} from {source}: "{text}"\nAnswer with one of {{FIGURATIVE, LITERAL}}.'


def places(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round float results, so that summation order does not show."""
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def profile(spark, folder):
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    joined = documents.select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    return P.value_counts(joined, ["lang", "source", "quality", "toxic"])


def table_shape(spark, folder):
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    joined = documents.select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    flagged = joined.withColumn("flag", F.col("toxic") == 1)
    return P.shape(flagged, distinct=["doc_id", "lang", "source"], true=["flag"])


def categories(spark, folder):
    return P.distinct_values(table(spark, folder, "part"), "p_type")


def contrast_pool(spark, folder):
    return P.contrast_pool(T.pool_sources(spark, folder))


def class_balance(spark, folder):
    return P.class_balance(contrast_pool(spark, folder))


def condition_grid(spark, folder):
    items = table(spark, folder, "supplier").select("s_suppkey")
    return G.repeat_samples(G.condition_grid(items))


def pending_conditions(spark, folder):
    items = T.suite_items(spark, folder).select("item")
    done = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("item"), (F.rint(F.col("l_discount") * 100) - 5).alias("coefficient")
    )
    return G.pending_conditions(items, done, ["item"], STEPS)


def pending_rows(spark, folder):
    documents = table(spark, folder, "documents").drop("text")
    return G.pending_rows(documents, table(spark, folder, "labels"), ["doc_id"])


def prompt_render(spark, folder):
    prompt = fill_template(PROMPT, lang="lang", source="source", text="text")
    return table(spark, folder, "documents").select("doc_id", prompt.alias("prompt"))


def label_parse(spark, folder):
    return parse_labels(T.answer_texts(spark, folder), "answer").select("doc_id", "label")


def span_lookup(spark, folder):
    return locate_span_lists(T.span_pairs(spark, folder), "text", "spans")


def rates_by_step(spark, folder):
    return R.label_rates(T.labelled_lines(spark, folder), "step").orderBy("step")


def rates_grouping_sets(spark, folder):
    return R.pooled_and_grouped_rates(T.labelled_suite(spark, folder), "category", "step")


def gold_rates(spark, folder):
    return R.trusted_rates(T.labelled_suite(spark, folder), "step")


def combined_by_step(spark, folder):
    first = R.label_rates(T.labelled_lines(spark, folder), "step")
    second = R.label_rates(T.labelled_lines(spark, folder, "l_tax", 4), "step")
    return R.combine_rates(first, second, "step", ("discount", "tax"))


def delta_vs_baseline(spark, folder):
    labelled = T.labelled_suite(spark, folder)
    found = R.literal_deltas(labelled, "step", None, BASELINE, "category")
    return places(found, "baseline_rate", "pushed_rate", "delta")


def rounded_deltas(spark, folder):
    """Deltas of the rounded rates, and their size relative to the pooled delta."""
    rates = rates_grouping_sets(spark, folder)
    deltas = R.rate_deltas(rates, "step", None, BASELINE, ["pooled", "category"])
    pooled = F.max(F.when(F.col("pooled"), F.col("delta"))).over(W.partitionBy())
    ratio = R.effect_ratio(F.col("delta"), pooled)
    return places(deltas.withColumn("ratio", ratio), "delta", "ratio")


def dose_response(spark, folder):
    rates = R.label_rates(T.labelled_suite(spark, folder), ["category", "step"])
    return R.dose_response(rates, "step", BASELINE, "category")


def first_per_category(spark, folder):
    parts = table(spark, folder, "part").withColumn("gold", F.col("p_size") <= 10)
    first = P.first_per_group(parts, "p_type", [F.desc("gold"), F.asc("p_partkey")])
    return first.select("p_type", "p_partkey", "p_brand", "gold")


def first_parts(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    return P.first_rows(parts, ["p_size", "p_partkey"])


def literal_rate(spark, folder):
    return places(R.literal_rate(T.labelled_suite(spark, folder), "category"), "literal_rate")


def comparison_deltas(spark, folder):
    lines, suite = T.labelled_lines(spark, folder), T.labelled_suite(spark, folder)
    found = comparison_report(lines, suite, ("all", "suite"), "step", keep=lambda counts: counts)["deltas"]
    return places(found, "delta")


def majority_label(spark, folder):
    return M.majority_labels(T.labelled_suite(spark, folder), ["expression", "step"])


def majority_per_item(spark, folder):
    return M.majority_labels(T.labelled_lines(spark, folder), ["item", "step"])


def open_majority(spark, folder):
    """Over return flag and line number together, a domain that nobody declares."""
    return M.open_majority(T.open_labels(spark, folder), ["item", "step"])


def label_flips(spark, folder):
    flips = M.label_flips(T.labelled_lines(spark, folder), ["item"], "step", PUSH, BASELINE)
    placed = flips.join(T.suite_items(spark, folder), "item")
    return M.flip_summary(placed, "expression", "category")


def flipped_items(spark, folder):
    return M.label_flips(T.labelled_lines(spark, folder), ["item"], "step", PUSH, BASELINE)


def _pairs(spark, folder):
    rated, judged = T.rated_documents(spark, folder), T.judged_documents(spark, folder)
    return A.pair_ratings(rated, judged, "doc_id")


def rater_agreement(spark, folder):
    return places(A.agreement(_pairs(spark, folder)), "po", "pe", "kappa")


def confusion_rates(spark, folder):
    return places(A.confusion_rates(_pairs(spark, folder)), "rate")


def rating_coverage(spark, folder):
    return A.rating_coverage(T.rated_documents(spark, folder), "lang")


def annotator_merge(spark, folder):
    first, second = (parse_blocks(b) for b in T.verdict_blocks(spark, folder))
    return A.merge_verdicts(first, second)


def verdict_agreement(spark, folder):
    return places(A.verdict_agreement(annotator_merge(spark, folder)), "agreement")


def annotator_summary(spark, folder):
    first, second = (parse_blocks(b) for b in T.verdict_blocks(spark, folder))
    one = A.annotator_summary(first).withColumn("annotator", F.lit(1))
    return one.unionByName(A.annotator_summary(second).withColumn("annotator", F.lit(2)))


def _direction(spark, folder):
    return V.direction(table(spark, folder, "embeddings"), F.col("label") == 0)


def direction(spark, folder):
    """To the last bit: sums are exact, so there is nothing to round away."""
    return _direction(spark, folder).select(
        F.posexplode("v").alias("place", "v"), "s", "midpoint", "n_positive", "n_other"
    )


def shifted_vectors(spark, folder):
    vectors = table(spark, folder, "embeddings")
    shifted = V.shift_vectors(vectors, _direction(spark, folder), -2.39)
    return places(shifted.select("vec_id", F.posexplode("shifted").alias("place", "x")), "x")


def shift_sweep(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return V.shift_sweep(vectors, _direction(spark, folder), "label")


def _cluster_counts(spark, folder):
    labelled = T.labelled_suite(spark, folder)
    return B.cluster_counts(labelled, "category", "expression", "step", PUSH, BASELINE)


def bootstrap_ci(spark, folder):
    counts = _cluster_counts(spark, folder)
    found = B.confidence_intervals(counts, B.bootstrap_deltas(counts, REPLICATES))
    return places(found, "delta", "ci_lo", "ci_hi")


def bootstrap_drawn(spark, folder):
    """The same intervals from draws that are made one by one."""
    counts = _cluster_counts(spark, folder)
    found = B.confidence_intervals(counts, B.bootstrap_deltas(counts, REPLICATES, method="indices"))
    return places(found, "delta", "ci_lo", "ci_hi")


def bootstrap_pairwise(spark, folder):
    deltas = B.bootstrap_deltas(_cluster_counts(spark, folder), REPLICATES)
    return places(B.pairwise_differences(deltas, PAIRS), "diff", "ci_lo", "ci_hi")


def _item_counts(spark, folder):
    """Every part is a cluster, so the number of clusters grows with the tables."""
    labelled = T.labelled_suite(spark, folder)
    return B.cluster_counts(labelled, "category", "item", "step", PUSH, BASELINE)


def cluster_index(spark, folder):
    return B.index_clusters(_item_counts(spark, folder))


def bootstrap_items(spark, folder):
    counts = _item_counts(spark, folder)
    found = B.confidence_intervals(counts, B.bootstrap_deltas(counts, ITEM_REPLICATES))
    return places(found, "delta", "ci_lo", "ci_hi")


def suite_invariants(spark, folder):
    return P.suite_invariants(T.suite_rows(spark, folder))


def article_rule():
    """A stand-in for a model: answers by how often "the" occurs in the prompt."""

    def load():
        def answer(prompts: list[str]) -> list[str]:
            labels = []
            for prompt in prompts:
                often = prompt.count("the") * 100
                if often >= len(prompt):
                    labels.append("Final label: LITERAL")
                elif often > 0:
                    labels.append("<think>LITERAL?</think> it reads figurative")
                else:
                    labels.append("no idea")
            return labels

        return answer

    return load


def batch_label(spark, folder):
    documents = table(spark, folder, "documents")
    labelled = label_batches(documents, F.col("text"), article_rule())
    return labelled.select("doc_id", "lang", "source", "n_chars", "label")


def label_once(spark, folder):
    """The same labels from one call for each distinct text, dealt by length."""
    documents = table(spark, folder, "documents")
    labelled = label_distinct(documents, F.col("text"), article_rule())
    return labelled.select("doc_id", "lang", "source", "n_chars", "label")


def numbered_texts():
    """A stand-in for a model: states the coefficient and the sample."""

    def load():
        def write(prefixes: list[str], coefficients: list[float], samples: int) -> list[list[str]]:
            return [
                [f" [{c:+.2f}] {len(p)} #{i}" for i in range(samples)]
                for p, c in zip(prefixes, coefficients)
            ]

        return write

    return load


def batch_generate(spark, folder):
    items = table(spark, folder, "supplier").select("s_suppkey", F.col("s_name").alias("prefix"))
    texts = G.sample_rows(generate_batches(G.condition_grid(items), numbered_texts()))
    return texts.withColumn("sentence", full_text("prefix", "continuation")).drop("prefix")


QUERIES: dict[str, Query] = {
    "q01_profile": profile,
    "q02_contrast_pool": contrast_pool,
    "q03_condition_grid": condition_grid,
    "q04_pending_conditions": pending_conditions,
    "q05_pending_rows": pending_rows,
    "q06_prompt_render": prompt_render,
    "q07_label_parse": label_parse,
    "q08_span_end_token": span_lookup,
    "q09_rates_by_step": rates_by_step,
    "q10_rates_grouping_sets": rates_grouping_sets,
    "q11_gold_rates": gold_rates,
    "q12_combined_by_step": combined_by_step,
    "q13_delta_vs_baseline": delta_vs_baseline,
    "q14_dose_response": dose_response,
    "q15_first_per_category": first_per_category,
    "q16_majority_label": majority_label,
    "q17_label_flips": label_flips,
    "q18_rater_agreement": rater_agreement,
    "q19_confusion_rates": confusion_rates,
    "q20_annotator_merge": annotator_merge,
    "q21_direction": direction,
    "q22_shift_sweep": shift_sweep,
    "q23_bootstrap_ci": bootstrap_ci,
    "q24_bootstrap_pairwise": bootstrap_pairwise,
    "q25_suite_invariants": suite_invariants,
    "q26_batch_label": batch_label,
    "q27_batch_generate": batch_generate,
    "q28_table_shape": table_shape,
    "q29_categories": categories,
    "q30_class_balance": class_balance,
    "q31_rounded_deltas": rounded_deltas,
    "q32_majority_per_item": majority_per_item,
    "q33_rating_coverage": rating_coverage,
    "q34_verdict_agreement": verdict_agreement,
    "q35_annotator_summary": annotator_summary,
    "q36_first_rows": first_parts,
    "q37_literal_rate": literal_rate,
    "q38_shifted_vectors": shifted_vectors,
    "q39_comparison_deltas": comparison_deltas,
    "q40_flipped_items": flipped_items,
    "q41_cluster_index": cluster_index,
    "q42_bootstrap_items": bootstrap_items,
    "q43_bootstrap_drawn": bootstrap_drawn,
    "q44_label_once": label_once,
    "q45_open_majority": open_majority,
}
