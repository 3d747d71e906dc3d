"""Annotator output: text blocks to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The annotator output format.
BLOCK_START = "ROW "
BLOCK_BREAK = "\nROW "
HEADER = r"^(?:ROW\s+)?(\d+)\s*\|(.*)"
VERDICT = r"^(VALID|INVALID)\b"
BLANKS = " \t\r"


def parse_blocks(blocks: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per block: row_id, expression, fig, lit, verdict, revision.

    An absent field is NULL, and so is the row_id of text that is no block. A
    block is split into its few lines once, and the fields are picked by their
    line start, in place of searching the whole block once per field.
    """

    def filled(value: Column) -> Column:
        return F.nullif(F.btrim(value, F.lit(BLANKS)), F.lit(""))

    def field(name: str) -> Column:
        start = f"{name}:"
        line = F.get(F.filter("_lines", lambda x: F.startswith(x, F.lit(start))), F.lit(0))
        return filled(F.substr(line, F.lit(len(start) + 1)))

    lines = blocks.select(*keep, F.split(text, "\n").alias("_lines")).withColumn(
        "_head", F.get("_lines", F.lit(0))
    )
    return lines.select(
        *keep,
        F.regexp_extract("_head", HEADER, 1).try_cast("bigint").alias("row_id"),
        filled(F.regexp_extract("_head", HEADER, 2)).alias("expression"),
        field("FIG").alias("fig"),
        field("LIT").alias("lit"),
        F.nullif(F.regexp_extract(field("VERDICT"), VERDICT, 1), F.lit("")).alias("verdict"),
        field("REVISION").alias("revision"),
    )


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Verdict files as rows; text before the first block is dropped.

    The block break is the record separator, so a large file is split over tasks
    and is never held as one string.
    """
    blocks = spark.read.option("lineSep", BLOCK_BREAK).text(path)
    return parse_blocks(blocks).filter(F.col("row_id").isNotNull())
