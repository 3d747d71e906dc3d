"""How the star-schema tables play the roles of an evaluation.

Line items stand for labelled results: the discount is the coefficient, return
flag and line number give the label, the part gives category, expression and
item. Every binding reads its whole table; queries filter where that is their feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from condeval.operators.counts import with_item_columns
from condeval.sources.tables import columns

LOWER = "abcdefghijklmnopqrstuvwxyz"
BASELINE, PUSH = 0, -5
STEPS = tuple(range(-5, 6))


# Declared columns, so that no job runs just to infer a schema.
TABLES = {
    "lineitem": columns(
        l_partkey="long",
        l_linenumber="integer",
        l_quantity="double",
        l_discount="double",
        l_tax="double",
        l_returnflag="string",
    ),
    "part": columns(
        p_partkey="long", p_name="string", p_brand="string", p_type="string", p_size="integer"
    ),
    "supplier": columns(s_suppkey="long", s_name="string"),
    "documents": columns(
        doc_id="long", text="string", lang="string", source="string", n_chars="long"
    ),
    "labels": columns(doc_id="long", quality="integer", toxic="integer"),
    "embeddings": columns(
        vec_id="long", embedding=types.ArrayType(types.FloatType()), label="integer"
    ),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def line_label() -> Column:
    last = F.col("l_linenumber") == 7
    return (
        F.when(last & (F.col("l_quantity") > 45), F.lit(None).cast("string"))
        .when(last, "UNPARSEABLE")
        .when(F.col("l_returnflag") == "A", "FIGURATIVE")
        .when(F.col("l_returnflag") == "R", "LITERAL")
        .otherwise("INCOHERENT")
    )


def _step(rate: str, shift: int) -> Column:
    return F.rint(F.col(rate) * 100).cast("int") - shift


def labelled_lines(spark: SparkSession, folder: str, rate: str = "l_discount", shift: int = 5) -> DataFrame:
    """(item, step, label) of every line."""
    lines = table(spark, folder, "lineitem")
    return lines.select(
        F.col("l_partkey").alias("item"), _step(rate, shift).alias("step"), line_label().alias("label")
    )


def open_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(item, step, label) of every line, with a label of return flag and line number."""
    label = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    lines = table(spark, folder, "lineitem")
    return lines.select(F.col("l_partkey").alias("item"), _step("l_discount", 5).alias("step"), label.alias("label"))


def suite_items(spark: SparkSession, folder: str) -> DataFrame:
    """(item, category, expression, gold) of every part."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("item"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("expression"),
        (F.col("p_size") <= 10).alias("gold"),
    )


def labelled_suite(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled lines with the category, expression and trust of their part."""
    items = suite_items(spark, folder)
    return with_item_columns(labelled_lines(spark, folder), items, "item", "step")


def pool_sources(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Two pool sources: small and large parts."""
    size = F.col("p_size")
    usage = F.when(size <= 15, "idiomatic").when(size <= 35, "literal").otherwise("other")
    rows = table(spark, folder, "part").select(
        "p_partkey",
        F.col("p_name").alias("sentence"),
        F.col("p_type").alias("idiom"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("span"),
        usage.alias("usage"),
        size.alias("size"),
    )
    return [rows.filter("size <= 25").drop("size"), rows.filter("size > 25").drop("size")]


def judged_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A length rule as the judge."""
    n = F.col("n_chars")
    label = F.when(n > 3000, "FIGURATIVE").when(n > 500, "LITERAL").otherwise("INCOHERENT")
    return table(spark, folder, "documents").select("doc_id", label.alias("label"))


def rated_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Quality and toxicity as the hand label; documents without them are unrated."""
    human = (
        F.when(F.col("toxic") == 1, "INCOHERENT")
        .when(F.col("quality") == 1, "FIGURATIVE")
        .when(F.col("quality") == 0, "LITERAL")
    )
    rated = table(spark, folder, "labels").select("doc_id", human.alias("human_label"))
    return table(spark, folder, "documents").select("doc_id", "lang").join(rated, "doc_id", "left")


def answer_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Free-text answers around whole documents: reasoned, mentioned, bracketed, empty, junk, unclosed."""
    text = F.col("text")
    kind = F.col("n_chars") % 6
    answer = (
        F.when(kind == 0, F.concat(F.lit("<think>"), text, F.lit(" literal</think>\nFinal label: figurative")))
        .when(kind == 1, F.concat(text, F.lit(" it is literally figurative")))
        .when(kind == 2, F.concat(text, F.lit("\nFINAL LABEL: <FIGURATIVE>")))
        .when(kind == 3, F.lit(""))
        .when(kind == 4, text)
        .otherwise(F.concat(F.lit("<think> LITERAL "), text))
    )
    return table(spark, folder, "documents").select("doc_id", answer.alias("answer"))


def span_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Four spans to look up in every document, as an array: a word, two words, its source, nothing."""
    words = F.split("text", r"\s+")
    middle = F.floor(F.size("words") / 2).cast("int")
    one = F.try_element_at("words", middle + 1)
    two = F.concat(one, F.lit(" "), F.try_element_at("words", middle + 2))
    spans = F.array(
        F.struct(F.lit("word").alias("kind"), F.translate(one, LOWER, LOWER.upper()).alias("span")),
        F.struct(F.lit("words").alias("kind"), two.alias("span")),
        F.struct(F.lit("source").alias("kind"), F.col("source").alias("span")),
        F.struct(F.lit("empty").alias("kind"), F.lit("").alias("span")),
    )
    documents = table(spark, folder, "documents").withColumn("words", words)
    return documents.select("doc_id", "text", spans.alias("spans"))


def verdict_blocks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Annotator output of two rules; the second annotator saw only labelled documents."""

    def block(valid: Column) -> Column:
        flat = F.col("flat")
        head = F.concat(F.lit("ROW "), "doc_id", F.lit(" | "), "source", F.lit("\nFIG: "), flat, F.lit("\nLIT: "), "lang")
        tail = F.when(valid, F.lit("\nVERDICT: VALID")).otherwise(
            F.concat(F.lit("\nVERDICT: INVALID\nREVISION: "), flat)
        )
        return F.concat(head, tail).alias("value")

    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    documents = table(spark, folder, "documents").withColumn("flat", flat)
    labels = table(spark, folder, "labels")
    return (
        documents.select(block(F.col("n_chars") > 1000)),
        documents.join(labels, "doc_id").select(block(F.col("quality") == 1)),
    )


def suite_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as suite rows: the last word is the expression, the size the variant."""
    return table(spark, folder, "part").select(
        F.split_part("p_name", F.lit(" "), F.lit(-1)).alias("expression"),
        F.col("p_size").alias("variant_id"),
        F.col("p_name").alias("prefix"),
        (F.col("p_size") <= 10).alias("gold"),
    )
