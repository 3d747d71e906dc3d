"""Rater agreement and the merge of two annotators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from condeval.functions.columns import as_list


def pair_ratings(
    rated: DataFrame,
    judged: DataFrame,
    keys: str | Sequence[str],
    human: str = "human_label",
    judge: str = "label",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows with a human label next to the judge's label of the same key.

    Unrated rows are dropped before the join, and only the label columns travel.
    """
    keys = as_list(keys)
    humans = rated.filter(F.col(human).isNotNull()).select(*keys, *keep, human)
    return humans.join(judged.select(*keys, judge), keys)


def contingency(pairs: DataFrame, human: str = "human_label", judge: str = "label") -> DataFrame:
    """Counts per label pair; pairs with a missing side are left out."""
    both = pairs.filter(F.col(human).isNotNull() & F.col(judge).isNotNull())
    return both.groupBy(human, judge).agg(F.count("*").alias("n"))


def agreement(pairs: DataFrame, human: str = "human_label", judge: str = "label") -> DataFrame:
    """One row: pairs, raw agreement, chance agreement and Cohen's kappa.

    Each cell of the small contingency table is split into its row and column
    share, which gives both marginals per label without a join. Kappa is NULL
    when chance agreement is 1.
    """
    cells = contingency(pairs, human, judge)
    agreeing = F.when(F.col(human) == F.col(judge), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    shares = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col(human).alias("value"),
                    F.col("n").alias("h"),
                    zero.alias("j"),
                    agreeing.cast("bigint").alias("same"),
                ),
                F.struct(
                    F.col(judge).alias("value"),
                    zero.alias("h"),
                    F.col("n").alias("j"),
                    zero.alias("same"),
                ),
            )
        )
    )
    margins = shares.groupBy("value").agg(
        F.sum("h").alias("h"), F.sum("j").alias("j"), F.sum("same").alias("same")
    )
    totals = margins.agg(
        F.sum("h").alias("n_pairs"),
        F.sum("same").alias("n_agree"),
        F.sum(F.col("h").cast("double") * F.col("j")).alias("products"),
    )
    observed = F.try_divide("n_agree", "n_pairs")
    chance = F.try_divide("products", F.col("n_pairs").cast("double") * F.col("n_pairs"))
    rated = totals.select("n_pairs", "n_agree", observed.alias("po"), chance.alias("pe"))
    return rated.withColumn("kappa", F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")))


def confusion_rates(
    pairs: DataFrame, human: str = "human_label", judge: str = "label"
) -> DataFrame:
    """Share of each judge label among the rows of one human label."""
    cells = contingency(pairs, human, judge)
    total = F.sum("n").over(W.partitionBy(human))
    return cells.withColumn("rate", F.col("n") / total)


def rating_coverage(
    rated: DataFrame, condition: str, human: str = "human_label"
) -> DataFrame:
    """Rows and hand-labelled rows per condition."""
    return rated.groupBy(condition).agg(
        F.count("*").alias("n_rows"), F.count(human).alias("n_rated")
    )


def merge_verdicts(first: DataFrame, second: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Two annotators side by side: keep when both say VALID, otherwise revise.

    A row that only one annotator returned is kept in the table and revised.
    """

    def side(table: DataFrame, n: int) -> DataFrame:
        return table.select(
            row_id,
            F.col("verdict").alias(f"verdict_{n}"),
            F.col("revision").alias(f"revision_{n}"),
        )

    merged = side(first, 1).join(side(second, 2), row_id, "full")
    keep = (F.col("verdict_1") == "VALID") & (F.col("verdict_2") == "VALID")
    agree = F.coalesce(F.col("verdict_1") == F.col("verdict_2"), F.lit(False))
    return merged.withColumns(
        {"agree": agree, "decision": F.when(keep, "keep").otherwise("revise")}
    )


def verdict_agreement(merged: DataFrame) -> DataFrame:
    """One row: rows, rows on which both annotators agree, and their share."""
    return merged.agg(
        F.count("*").alias("n_rows"),
        F.count_if("agree").alias("n_agree"),
        F.try_divide(F.count_if("agree"), F.count("*")).alias("agreement"),
        F.count_if(F.col("decision") == "keep").alias("n_keep"),
    )


def annotator_summary(verdicts: DataFrame) -> DataFrame:
    """One row: valid, flagged and all rows of one annotator."""
    return verdicts.agg(
        F.count_if(F.col("verdict") == "VALID").alias("n_valid"),
        F.count_if(F.col("verdict") == "INVALID").alias("n_flagged"),
        F.count("*").alias("n_total"),
    )
