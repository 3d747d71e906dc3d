"""Cluster bootstrap of literal-rate deltas, intervals and pairwise tests.

Rates only need sums, so rows shrink to four counts per cluster before anything
is drawn; a replicate then draws cluster indices and adds up counts.

Draws are split and not made: ``condeval.operators.splitting`` gives how often each
cluster of a range is drawn in a replicate, as a pure function of (seed, series,
replicate, cluster index). A task holds a block of clusters, works out their counts by
itself and sends one sum a replicate, so nothing is shuffled a draw, and numbers depend on
no partitioning, retry or executor loss. They can be repeated in SQL. The series name is
part of them, so series are resampled independently.

``method="indices"`` makes each draw from a hash of (seed, series, replicate, slot) and
joins it with its cluster: replicates x clusters rows. ``method="multinomial"`` draws how
often each distinct combination of counts comes up, where these are few. Both are other
random numbers of the same distribution.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from condeval.functions.columns import all_present
from condeval.functions.numeric import zero_inside
from condeval.operators.rates import condition_counts, point_delta
from condeval.operators.splitting import multiplicities, series_state

COUNTS = ("k0", "n0", "k1", "n1")
# A block of clusters, as a power of two, and the replicates a task works out at a time.
BLOCK_LEVELS, BLOCK_REPLICATES = 12, 64
# Slots one task row expands at a time.
SLOTS = 1 << 16
# Distinct count combinations that fit in one task next to a block of replicates.
FEW_COMBINATIONS = 50_000
# Replicates one task row resamples at a time.
REPLICATE_BLOCK = 32


def cluster_counts(
    labelled: DataFrame,
    series: str,
    cluster: str,
    condition: str,
    push: Column | float,
    baseline: float = 0.0,
    label: str = "label",
) -> DataFrame:
    """Literal and all rows of each cluster at the baseline and at the push.

    Clusters without rows at either condition stay, since they can be drawn;
    NULL clusters and NULL series are dropped.
    """
    return (
        labelled.filter(all_present([series, cluster]))
        .groupBy(F.col(series).alias("series"), F.col(cluster).cast("string").alias("cluster"))
        .agg(
            *condition_counts(labelled, condition, baseline, label, "0"),
            *condition_counts(labelled, condition, push, label, "1"),
        )
    )


def _order() -> Column:
    return F.substring(F.md5("cluster"), 1, 3)


def index_clusters(counts: DataFrame) -> DataFrame:
    """Dense 0-based cluster index ``ix`` per series, with ``n_clusters``.

    Clusters are ordered by a hash bucket and then by name. They are ranked inside
    each (series, bucket), and only the bucket sizes are summed up per series, so
    no series is sorted in one task.
    """
    inside = W.partitionBy("series", "bucket").orderBy("cluster")
    ranked = counts.withColumn("bucket", _order()).withColumn("rank", F.row_number().over(inside))
    whole = W.partitionBy("series")
    before = whole.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = (
        ranked.groupBy("series", "bucket")
        .agg(F.count("*").alias("size"))
        .withColumns(
            {
                "start": F.coalesce(F.sum("size").over(before), F.lit(0)),
                "n_clusters": F.sum("size").over(whole),
            }
        )
    )
    return ranked.join(buckets, ["series", "bucket"]).select(
        "series", (F.col("start") + F.col("rank") - 1).alias("ix"), "n_clusters", *COUNTS
    )


def draws_of(blocks: DataFrame, seed: int) -> DataFrame:
    """(series, replicate, ix) of each slot in ``[first, last)`` of a block.

    An md5 gives two draws of 60 bits, for an even slot and the one after it, each
    taken modulo the number of clusters.
    """
    pairs = F.sequence(F.floor(F.col("first") / 2), F.floor((F.col("last") - 1) / 2))
    key = F.concat_ws(
        "|", F.lit(str(seed)), "series", F.col("replicate").cast("string"), F.col("pair").cast("string")
    )
    halves = F.array(F.substring("digest", 1, 15), F.substring("digest", 17, 15))
    drawn = (
        blocks.withColumn("pair", F.explode(pairs))
        .withColumn("digest", F.md5(key))
        .select("*", F.posexplode(halves).alias("half", "bits"))
        .filter(F.col("pair") * 2 + F.col("half") < F.col("last"))
    )
    ix = F.conv("bits", 16, 10).cast("bigint") % F.col("n_clusters")
    return drawn.select("series", "replicate", ix.alias("ix"))


def bootstrap_deltas(
    counts: DataFrame,
    replicates: int = 5000,
    seed: int = 0,
    tasks: int | None = None,
    method: str = "splitting",
    few: int = FEW_COMBINATIONS,
) -> DataFrame:
    """(series, replicate, delta): resample as many clusters as the series has.

    ``splitting`` works out how often each cluster is drawn, block by block.
    ``indices`` draws cluster indices and joins the indexed counts; whether these
    are broadcast is the session's decision and never changes a number.
    ``multinomial`` fails beyond ``few`` distinct count combinations. The methods give
    other random numbers of one distribution. The delta is NULL where a replicate
    drew no rows for one of the conditions. ``tasks`` is the session's parallelism by
    default.
    """
    tasks = tasks or counts.sparkSession.sparkContext.defaultParallelism
    if method == "splitting":
        totals = _split_totals(index_clusters(counts), replicates, seed, tasks)
    elif method == "indices":
        totals = _drawn_totals(index_clusters(counts), replicates, seed, tasks)
    elif method == "multinomial":
        combined = counts.groupBy("series", *COUNTS).agg(F.count("*").alias("clusters"))
        if combined.limit(few + 1).count() > few:
            raise ValueError(f"more than {few} distinct count combinations: draw indices instead")
        totals = _resampled_totals(combined, replicates, seed, tasks)
    else:
        raise ValueError(f"no bootstrap method {method!r}")
    return totals.select("series", "replicate", point_delta().alias("delta"))


def _split_totals(indexed: DataFrame, replicates: int, seed: int, tasks: int) -> DataFrame:
    """Summed counts per replicate, a row per replicate and task in between.

    A block of clusters is one row. The fewer blocks a series has, the more ranges of
    replicates it is copied to, up to ``tasks``; a large series is not copied.
    """
    size = 1 << BLOCK_LEVELS
    cell = F.struct("ix", *COUNTS)
    blocks = indexed.groupBy("series", F.shiftright("ix", BLOCK_LEVELS).alias("block")).agg(
        F.max("n_clusters").alias("n_clusters"), F.array_sort(F.collect_list(cell)).alias("cells")
    )
    shares = F.ceil(F.lit(tasks) / F.ceil(F.col("n_clusters") / size))
    width = F.greatest(F.lit(1), F.ceil(F.lit(replicates) / F.greatest(F.lit(1), shares))).cast("int")
    dealt = (
        blocks.withColumn("width", width)
        .withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.col("width"))))
        .repartition(tasks, "series", "block", "start")
    )
    columns = [f"cells.{name}" for name in COUNTS]

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                state = series_state(seed, row.series)
                counts = np.stack([getattr(row, name) for name in COUNTS], axis=1)
                end = min(row.start + row.width, replicates)
                for start in range(row.start, end, BLOCK_REPLICATES):
                    numbers = np.arange(start, min(start + BLOCK_REPLICATES, end))
                    drawn = multiplicities(state, row.n_clusters, row.block * size, size, numbers)
                    sums = drawn @ counts
                    made = {name: sums[:, i] for i, name in enumerate(COUNTS)}
                    yield pd.DataFrame({"series": row.series, "replicate": numbers, **made})

    schema = "series string, replicate int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    sent = dealt.select("series", "block", "n_clusters", "width", "start", *columns).mapInPandas(split, schema)
    return sent.groupBy("series", "replicate").agg(*(F.sum(c).alias(c) for c in COUNTS))


def _drawn_totals(indexed: DataFrame, replicates: int, seed: int, tasks: int) -> DataFrame:
    """Summed counts per replicate, one row per draw in between.

    Replicates are spread over the tasks before their slots are expanded.
    """
    sizes = indexed.groupBy("series").agg(F.max("n_clusters").alias("n_clusters"))
    n, block = F.col("n_clusters"), F.col("block")
    last_block = F.floor((n - 1) / SLOTS)
    blocks = (
        sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
        .repartition(tasks, "series", "replicate", "block")
        .withColumns({"first": block * SLOTS, "last": F.least(n, (block + 1) * SLOTS)})
    )
    looked_up = indexed.drop("n_clusters")
    sums = draws_of(blocks, seed).join(looked_up, ["series", "ix"]).groupBy("series", "replicate")
    return sums.agg(*(F.sum(c).alias(c) for c in COUNTS))


def _resampled_totals(
    combined: DataFrame, replicates: int, seed: int, tasks: int
) -> DataFrame:
    """Summed counts per replicate, from multinomial multiplicities of each combination.

    A series travels as one array of its (few) combinations, copied to each block
    of replicates. The random state depends on seed, series and block only.
    """
    cell = F.struct(*COUNTS, "clusters")
    series = combined.groupBy("series").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    starts = F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(REPLICATE_BLOCK))
    blocks = series.withColumn("start", F.explode(starts)).repartition(tasks, "series", "start")
    columns = [f"cells.{name}" for name in (*COUNTS, "clusters")]

    def resample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                key = md5(f"{seed}|{row.series}|{row.start}".encode()).hexdigest()
                numbers = np.arange(row.start, min(row.start + REPLICATE_BLOCK, replicates))
                total = row.clusters.sum()
                drawn = np.random.default_rng(int(key, 16)).multinomial(
                    total, row.clusters / total, size=len(numbers)
                )
                sums = {name: drawn @ getattr(row, name) for name in COUNTS}
                yield pd.DataFrame({"series": row.series, "replicate": numbers, **sums})

    schema = "series string, replicate int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return blocks.select("series", "start", *columns).mapInPandas(resample, schema)


def _interval(delta: str = "delta") -> list[Column]:
    """95% percentile interval (linear interpolation), NULL if any replicate is undefined."""
    ends = F.percentile(delta, F.array(F.lit(0.025), F.lit(0.975)))
    complete = F.count(delta) == F.count("*")
    return [
        F.when(complete, ends[0]).alias("ci_lo"),
        F.when(complete, ends[1]).alias("ci_hi"),
        (F.count("*") - F.count(delta)).alias("n_undefined"),
    ]


def confidence_intervals(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Per series: clusters, full-data delta (unrounded) and its 95% interval."""
    totals = counts.groupBy("series").agg(
        F.count("*").alias("n_groups"), *(F.sum(c).alias(c) for c in COUNTS)
    )
    points = totals.select("series", "n_groups", point_delta().alias("delta"))
    spread = deltas.groupBy("series").agg(*_interval())
    return points.join(spread, "series").withColumnRenamed("series", "name")


def pairwise_differences(deltas: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Replicate-wise difference of two series: mean, 95% interval, distinguishable.

    Each delta is sent to the pairs it belongs to with its sign, and the two
    halves meet in one aggregation; the replicates are not computed twice. A pair
    that is listed again counts once, and one with an unknown series is a row of
    NULLs.
    """
    pairs = list(dict.fromkeys(pairs))
    members: dict[str, list[Column]] = {}
    for first, second in pairs:
        name = F.lit(f"{first} vs {second}").alias("pair")
        members.setdefault(first, []).append(F.struct(name, F.lit(1.0).alias("sign")))
        members.setdefault(second, []).append(F.struct(name, F.lit(-1.0).alias("sign")))
    target = F.lit(None)
    for series, targets in members.items():
        target = F.when(F.col("series") == series, F.array(*targets)).otherwise(target)
    sent = deltas.select("replicate", "delta", F.inline(target))
    joined = sent.groupBy("pair", "replicate").agg(
        F.when(F.count("delta") == 2, F.sum(F.col("sign") * F.col("delta"))).alias("diff"),
        F.count("*").alias("sides"),
    )
    both = joined.filter("sides = 2")
    names = F.array(*(F.lit(f"{first} vs {second}") for first, second in pairs))
    listed = deltas.sparkSession.range(1).select(F.explode(names).alias("pair"))
    found = both.groupBy("pair").agg(
        F.when(F.count("diff") == F.count("*"), F.avg("diff")).alias("mean_diff"), *_interval("diff")
    )
    return listed.join(found, "pair", "left").select(
        "pair",
        F.col("mean_diff").alias("diff"),
        "ci_lo",
        "ci_hi",
        (~zero_inside("ci_lo", "ci_hi")).alias("distinguishable"),
        "n_undefined",
    )
