"""Sharding by jump consistent hashing.

A row's shard depends on its key and the number of shards alone: the key's hash seeds a
sequence of jumps, and the last jump below the number of shards is the shard. With one
more shard a row stays or moves into the new one. There is no table of ring positions.

Slots count a shard's rows without gaps, by hash of key and text. They are numbered slice
by slice of that hash, so a large shard isn't sorted in one task.

Defined cases: NULL text has size 1 and checksum 0; NULL keys share a shard; rows that
repeat share a shard and have slots of their own; an empty table gives an empty table;
other columns are neither read nor returned.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condeval.llm.common import checkpointed, running_totals

SHARDS = 8
# Rows of a slice, about.
SLICE_ROWS = 8192
# Fixed values of the published algorithm.
STEP_FACTOR = 2862933555777941757
HASH_BITS = 31


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    target = np.zeros(len(state), np.int64)
    moving = np.ones(len(state), bool)
    while moving.any():
        shard[moving] = target[moving]
        state[moving] = state[moving] * np.uint64(STEP_FACTOR) + np.uint64(1)
        scale = float(1 << HASH_BITS) / ((state[moving] >> np.uint64(64 - HASH_BITS)).astype(np.float64) + 1)
        target[moving] = ((shard[moving] + 1) * scale).astype(np.int64)
        moving = target < shards
    return shard.astype(np.int32)


def jump_column(hashes, shards: int):
    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(jump(values.to_numpy(np.int64).view(np.uint64), shards))

    return place(hashes)


def sharded(table: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = table.select(
        F.col(key).alias("key"),
        (F.octet_length(bytes_) + 1).cast("bigint").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
        F.xxhash64(key).alias("hash"),
    )
    rows = checkpointed(
        rows.select(
            "*",
            jump_column(F.col("hash"), shards).alias("shard"),
            jump_column(F.col("hash"), shards + 1).alias("grown_shard"),
            F.shiftrightunsigned(F.xxhash64("hash", "text_crc32", "size"), 33).alias("order"),
        )
    )
    slices = max(1, ceil(rows.count() / shards / SLICE_ROWS))
    placed = running_totals(
        rows.withColumn("one", F.lit(1).cast("bigint")),
        ["shard"],
        F.floor(F.col("order") * slices / float(1 << HASH_BITS)),
        [F.col("order"), F.col("key"), F.col("text_crc32"), F.col("size")],
        {"slot": "one"},
    )
    return placed.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def write_shards(table: DataFrame, folder: str, shards: int = SHARDS, key: str = "doc_id") -> None:
    """Write a table's rows into a folder a shard, spread over tasks within a shard."""
    placed = table.withColumn("shard", jump_column(F.xxhash64(key), shards))
    placed.write.partitionBy("shard").parquet(folder)
