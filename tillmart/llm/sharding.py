"""Sharding by jump consistent hashing.

A key's shard follows from its hash and the number of shards alone: no table of ring positions,
and one more shard takes from each old shard only the keys that move into it.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmart.llm.common import ready_workers
from tillmart.operators.staging import stage


def jump_shards(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key. Every step moves a key to its next higher shard; about ln(shards) steps."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(state), np.int64)
    target = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        shard[moving] = target[moving]
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (np.uint64(1 << 31) / ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))
        target[moving] = ((shard[moving] + 1) * step).astype(np.int64)
        moving = moving[target[moving] < shards]
    return shard.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of any column: its 64-bit hash picks it. Null is a key like any other."""

    @F.pandas_udf("int")
    def pick(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in batches:
            yield pd.Series(jump_shards(hashes.to_numpy(np.int64).view(np.uint64), shards))

    return pick(F.xxhash64(key))


def shard_rows(rows: DataFrame, key_col: str, text_col: str, shards: int) -> DataFrame:
    """One row per row: key, size, text_crc32, law, shard, slot, grown_shard.

    Equal keys, null among them, lie in one shard. Slots count from 0 without gaps in each shard.
    They are dealt out by the parts in which the rows are read: each part counts its rows per
    shard, the counts are summed in order of the parts, and rows are numbered inside their part,
    so no shard and no key is ever gathered in one task. A null text has 0 bytes and the CRC of
    an empty one. An empty table gives an empty result. Other columns play no part.
    """
    ready_workers(rows.sparkSession)
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    placed = rows.select(
        F.col(key_col).alias("key"), (F.octet_length(data).cast("bigint") + 8).alias("size"), F.crc32(data).alias("text_crc32"),
        jump_shard(F.col(key_col), shards).alias("shard"), jump_shard(F.col(key_col), shards + 1).alias("grown_shard"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"),
    )
    placed = stage(placed, "placed")
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")).cast("bigint") - 1
    numbered = placed.withColumn("inside", inside).join(starts, ["shard", "part"])
    return numbered.select(
        F.col("key").alias(key_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("inside")).alias("slot"), "grown_shard",
    )
