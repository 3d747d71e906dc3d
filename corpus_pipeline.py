"""A corpus pipeline: four stages, each calling one of the training-text operators.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is
written as Parquet and read again as the next one's documents. The stages share their
executors' memory, so texts go to Python in batches of bounded size, a setting that stays
with the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from condeval.llm import bpe, jaccard_join, language_id, mixing
from condeval.llm.common import scratch_table, small_batches
from condeval.llm.queries import quality_weights, tokenizer_file

# A document stays if some language holds this share of its bytes' probability.
MIN_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a determined language."""
    small_batches(spark)
    return language_id.kept(docs, language_id.fitted_if_any(docs), MIN_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that word 5-grams link."""
    small_batches(spark)
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target asks for; repeats are rows."""
    return mixing.repeated(docs, quality_weights(spark, sf_dir))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's encoding and decoding."""
    small_batches(spark)
    return bpe.round_trip_digests(docs, tokenizer_file())


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode),
]

# The stages hold trained models and graph components, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every intermediate is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
