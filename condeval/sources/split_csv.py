"""One large CSV file with line breaks inside fields, read by many tasks.

Lines are read in pieces, as Spark splits the file. A line with an odd number of quotes
opens or closes a quoted field, so the parity of a piece's quotes tells whether it changes
sides, and summed over the pieces before it, whether it starts inside a field. With that
each piece cuts its lines into records by itself. The ends of records that cross a border,
at most two of a piece, are put together, and whole records go to Spark's own CSV parser.

A field that holds a quote must be quoted and the quote doubled, as Spark and pandas write it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condeval.sources.tables import _or_missing_input

QUOTE = '"'
WHOLE, END, MIDDLE, BEGINNING = range(4)
# Records of a batch of Arrow rows.
BATCH = 4096


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    lines = _or_missing_input(spark.read.option("lineSep", "\n").text, path, "Write it first.")
    return lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )


def open_pieces(lines: DataFrame) -> set[tuple[str, int]]:
    """The pieces, by file and place, that start inside a quoted field.

    A row a piece is all that is gathered, and the driver plans the pieces anyway.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    pieces = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    inside = pieces.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    return {(r["file"], r["start"]) for r in inside.filter("odd").select("file", "start").collect()}


def _cut(lines: DataFrame, opened: set[tuple[str, int]]) -> DataFrame:
    """(file, start, kind, first, text): whole records, and the parts of those that cross a border."""
    shipped = lines.sparkSession.sparkContext.broadcast(opened)
    names = ["file", "start", "kind", "first", "text"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]

    def parts(batches) -> Iterator[tuple]:
        piece, held, inside, begun, first = None, [], False, True, False
        for batch in batches:
            for line, *place in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if place != piece:
                    if held:
                        yield (*piece, BEGINNING if begun else MIDDLE, first, "\n".join(held))
                    piece, held = place, []
                    inside = tuple(place) in shipped.value
                    begun, first = not inside, place[1] == 0
                held.append(line)
                if line.count(QUOTE) % 2:
                    inside = not inside
                if not inside:
                    yield (*piece, WHOLE if begun else END, first, "\n".join(held))
                    held, begun, first = [], True, False
        if held:
            yield (*piece, BEGINNING if begun else MIDDLE, first, "\n".join(held))

    def run(batches):
        rows: list[tuple] = []
        for row in parts(batches):
            rows.append(row)
            if len(rows) >= BATCH:
                yield made(rows)
                rows = []
        yield made(rows)

    def made(rows):
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return lines.mapInArrow(run, "file string, start bigint, kind int, first boolean, text string")


def _stitched(parts: DataFrame) -> DataFrame:
    """(first, text) of the records that cross borders, each from a beginning, any middles and an end."""
    crossing = parts.filter(F.col("kind") != WHOLE)
    sofar = W.partitionBy("file").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = crossing.withColumn("record", F.count_if(F.col("kind") == BEGINNING).over(sofar))
    pieces = F.array_sort(F.collect_list(F.struct("start", "text")))
    return numbered.groupBy("file", "record").agg(
        F.bool_or("first").alias("first"), F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("text")
    )


def _header_fits(text: Column, schema: T.StructType) -> Column:
    found = F.transform(F.split(text, ","), lambda name: F.btrim(name, F.lit(QUOTE + "﻿")))
    return found == F.array(*(F.lit(name) for name in schema.names))


def read_split_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """A header CSV with a declared schema, like ``read_csv_table``, of which many tasks read one file.

    The file is read twice, first for its quotes, when this is called. An empty field is
    NULL, the header is checked against the schema, and a malformed record fails.
    """
    lines = _lines(spark, path)
    parts = _cut(lines, open_pieces(lines))
    records = parts.filter(F.col("kind") == WHOLE).select("first", "text").unionByName(
        _stitched(parts).select("first", "text")
    )
    # Where records end in two characters, so do lines inside fields, and both are read as one.
    plain = F.replace(F.regexp_replace("text", "\r$", ""), F.lit("\r\n"), F.lit("\n"))
    text = F.when(F.endswith("text", F.lit("\r")), plain).otherwise(F.col("text"))
    message = F.concat(F.lit("the CSV header does not conform to the schema: "), "text")
    fits = ~F.col("first") | _header_fits(F.col("text"), schema)
    checked = records.withColumn("text", text).filter(F.assert_true(fits, message).isNull() & (F.col("text") != ""))
    options = {"escape": QUOTE, "mode": "FAILFAST", "multiLine": "true"}
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
    parsed = checked.filter(~F.col("first")).select(F.from_csv("text", columns, options).alias("row"))
    return parsed.select(*(F.col("row")[name].alias(name) for name in schema.names))
