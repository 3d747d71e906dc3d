"""The registered queries of these operators, and SQL for those it can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condeval.llm import (
    bpe,
    chat,
    html_text,
    importance,
    jaccard_join,
    language_id,
    mixing,
    pieces,
    repair,
    sharding,
    topk,
    url_filter,
    winnowing,
)
from condeval.llm.common import documents_of


def tokenizer_file() -> str:
    """The vocabulary file: LLM_TOKENIZER names it, else the installed package has it."""
    if path := os.environ.get("LLM_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = documents_of(spark, folder)
    found = language_id.predicted(documents, language_id.fitted_if_any(documents))
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{folder}/embeddings.parquet"), 20, every_row=True)


def op3_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.edited_fingerprints(documents_of(spark, folder))


def quality_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled good documents are drawn four times as readily as labelled bad ones."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(documents_of(spark, folder), quality_weights(spark, folder))


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents_of(spark, folder))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip_digests(documents_of(spark, folder), tokenizer_file())


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(documents_of(spark, folder))


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    conversations = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    planted = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.read_back(conversations.unionByName(planted))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return url_filter.judged(pages, url_filter.trained(spark)).drop("score")


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(spark.read.parquet(f"{folder}/pages.parquet"))


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return importance.resampled(documents_of(spark, folder), benchmark).drop("n_words")


def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    return repair.repaired(repair.damaged(conversations), conversations)


def piece_file() -> str:
    """The SentencePiece model: LLM_PIECES names it, else the installed package has it."""
    if path := os.environ.get("LLM_PIECES"):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip_digests(documents_of(spark, folder), piece_file())


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_top_k": op2_top_k,
    "op3_winnowing": op3_winnowing,
    "op4_mixing": op4_mixing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_bpe": op6_bpe,
    "op7_sharding": op7_sharding,
    "op8_chat": op8_chat,
    "op9_url_filter": op9_url_filter,
    "op10_html_text": op10_html_text,
    "op11_importance": op11_importance,
    "op12_repair": op12_repair,
    "op13_pieces": op13_pieces,
}

ORACLE: dict[str, str] = {
    "op2_top_k": topk.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op11_importance": importance.ORACLE,
    "op12_repair": repair.ORACLE,
}
