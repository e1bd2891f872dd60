"""Shards by jump consistent hashing: no ring table, and growth moves only what it must."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import narrow
from panelcast.session import stage

MULTIPLIER = 2862933555777941757  # fixed value of the published algorithm
BLOCK_ROWS = 50_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key: all keys jump together until each has landed."""
    key = keys.astype(np.uint64, copy=True)
    landed = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    flying = np.arange(len(key))
    while len(flying):
        landed[flying] = ahead[flying]
        key[flying] = key[flying] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = (key[flying] >> np.uint64(33)).astype(np.float64) + 1
        ahead[flying] = ((landed[flying] + 1) * (2147483648.0 / draw)).astype(np.int64)
        flying = flying[ahead[flying] < shards]
    return landed


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a 64-bit integer key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("there must be at least one shard")

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(jump(ids.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(F.coalesce(key.cast("long"), F.lit(0)))


def assign_shards(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row.

    ``shard`` depends on the id and ``shards`` alone; ``grown_shard`` is the place with
    one more shard, either the same or the new one.  ``slot`` numbers a shard's rows from
    0 without gaps, in the order of (block, id): rows are numbered in blocks of about
    ``BLOCK_ROWS`` and a block's start is the count of the blocks before it, so no task
    takes a whole shard.  A null text has size 8 and checksum 0; rows that repeat an id
    share its shard and take a slot each; string keys go through ``xxhash64`` first.
    """
    rows = narrow(docs, id_col, text_col)
    placed = stage(
        rows.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            shard_of(F.col("doc_id"), shards).alias("shard"),
            shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
        ),
        "shards",
    )
    blocks = max(1, ceil(placed.count() / shards / BLOCK_ROWS))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "block")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id")) - 1
    return (
        placed.withColumn("inside", inside)
        .join(starts, ["shard", "block"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("inside")).alias("slot"),
            "grown_shard",
        )
    )
