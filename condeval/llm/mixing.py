"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share the mix by weight, up to a cap of ``cap`` times their size; what a capped
source can't use is shared among the others again until none is above its cap. A source
is taken whole as often as its target allows (complete epochs); the rest of its target
is a weighted sample without replacement: each document draws an exponential key, divided
by its quality weight, and documents are taken by rising key until their sizes fill the
budget. The last one is taken in part, so a source meets its target to the word.

Keys come from a digest of (seed, key), so reruns agree whatever the partitioning. The
running sum within a source is made slice by slice of the keys' range, so a source with
a third of all rows isn't sorted in one task.

Defined cases: NULL text has size 0; a NULL source is a source of its own, the last; a
document of size 0 takes nothing; no words at all give targets of 0; rows that repeat a
key share its draw and follow each other by size; a NULL, absent or non-positive quality
weight counts as 1; an empty table gives an empty table; other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condeval.llm.common import checkpointed, free_names, running_totals

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2, 11
# Documents of a slice, about.
SLICE_ROWS = 8192


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, rows, target) from (source, source_size, rows), one row a source.

    Weights repeat along the sources in code-point order. A source is capped exactly if
    its cap for a unit of weight is below the common level; taking sources by that ratio,
    the level that leaves all before capped and none after is the largest one.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name)
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighed = sizes.withColumn("weight", F.element_at(cycle, ((place - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("limit", cap * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = F.max("_level").over(everything)
    return (
        weighed.withColumn("_level", (total - filled) / open_weight)
        .withColumn("target", F.least("limit", level * F.col("weight")))
        .select("source", "source_size", "rows", "target")
    )


def draw(key: Column, weight: Column, seed: int = SEED) -> Column:
    """An exponential key with the weight as its rate."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight


def mixed(
    table: DataFrame,
    quality: DataFrame | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
) -> DataFrame:
    """(key, size, source_size, target, taken) of each row; quality holds (key, weight) rows."""
    sized = table.select(
        F.col(key).alias("key"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )
    if quality is not None:
        known = quality.groupBy(F.col(quality.columns[0]).alias("key")).agg(
            F.avg(quality.columns[1]).alias("weight")
        )
        sized = sized.join(known, "key", "left")
    else:
        sized = sized.withColumn("weight", F.lit(1.0))
    usable = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    named = F.coalesce(F.col("key").cast("string"), F.lit("null"))
    sized = checkpointed(sized.withColumn("draw", draw(named, usable)).drop("weight"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    aims = targets(sums, weights, share, cap).withColumnRenamed("source", "_source")
    rows = sized.join(aims, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    slices = F.ceil(F.col("rows") / SLICE_ROWS)
    placed = running_totals(
        rows,
        ["source"],
        F.floor((1 - F.exp(-F.col("draw"))) * slices),
        [F.col("draw"), F.col("key"), F.col("size")],
        {"earlier": "size"},
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = F.round(F.col("target") - epochs * F.col("source_size")).cast("bigint")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("earlier")))
    return placed.select(
        F.col("key").alias(key),
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + part).cast("bigint").alias("taken"),
    )


def repeated(table: DataFrame, quality: DataFrame | None = None, key: str = "doc_id", **settings) -> DataFrame:
    """The mix itself: each row, with all its columns, as often as it is taken.

    Rows stay whole: a part counts as one copy from half its size on. Rows that share a
    key are each repeated as often as their words together are taken.
    """
    own, copies = free_names(table.columns, "_key", "_copies")
    times = F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int")
    taken = mixed(table, quality, key, **settings).groupBy(F.col(key).alias(own)).agg(times.alias(copies))
    rows = table.join(taken.where(F.col(copies) > 0), F.col(key).eqNullSafe(F.col(own)))
    each = free_names([*table.columns, own, copies], "_copy")[0]
    return rows.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*table.columns)


ORACLE = f"""
WITH sized AS (
  SELECT d.doc_id, d.source, CAST(len(regexp_extract_all(coalesce(d.text, ''), '{WORD}')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('{SEED}:' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / {float(1 << 52)})
      / CASE WHEN q.weight > 0 THEN q.weight ELSE 1.0 END AS draw
  FROM documents d LEFT JOIN (
    SELECT doc_id, avg(CASE WHEN quality = 1 THEN 2.0 ELSE 0.5 END) AS weight FROM labels GROUP BY doc_id
  ) q USING (doc_id)
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
    2.0::DOUBLE * source_size AS bound, 1.5::DOUBLE * (SELECT sum(source_size) FROM sums)::DOUBLE AS total FROM sums
), levels AS (
  SELECT *, (total - coalesce(sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), aims AS (
  SELECT source, source_size, least(bound, weight * (SELECT max(level) FROM levels)) AS target,
    CASE WHEN source_size > 0 THEN floor(least(bound, weight * (SELECT max(level) FROM levels)) / source_size)
      ELSE 0 END AS epochs FROM levels
), placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, a.epochs,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size,
  CAST(round(target - epochs * source_size) AS BIGINT) - earlier)) AS BIGINT) AS taken FROM placed
"""
