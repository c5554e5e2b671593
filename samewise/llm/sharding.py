"""Sharding by jump consistent hashing (Lamping and Veach 2014).

A row's key and the number of shards decide its shard; no ring table is kept.
With one shard more, a row either stays or moves to the new shard.  Slots number the rows of a shard without gaps: a shard is cut into
SLOT_BUCKETS hashed buckets, rows are numbered within a bucket, and a bucket's
offset is the running sum of the counts before it, so no task sorts a whole
shard.  Texts are read for their size and checksum where they lie; only the
narrow rows are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

SLOT_BUCKETS = 512
ROW_BYTES = 8


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key among ``shards``."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.int64).view(np.uint64).copy()
    at = np.zeros(len(key), dtype=np.int64)
    open_ = np.arange(len(key))
    while len(open_):
        k = key[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        key[open_] = k
        to = ((at[open_] + 1) * ((1 << 31) / ((k >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        open_, to = open_[to < shards], to[to < shards]
        at[open_] = to
    return at.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """Column of shards for a column of 64-bit keys."""

    @pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards))

    return place(key)


def shard(docs: DataFrame, shards: int = 24, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row.

    The key is hashed by xxhash64, so keys of any type do; all null keys go to
    one shard.  A null text has no bytes: size 8 and checksum 0, as an empty
    one; very long texts are read where they lie.  Rows with one key lie in one
    shard; repeated rows take a slot each.  An empty table gives no rows.  A key column may not be
    named as one of the other results; further columns, whatever their names, are not read.
    """
    if key_col in ("size", "text_crc32", "law", "shard", "slot", "grown_shard"):
        raise ValueError(f"a result has the name of the key column, {key_col}")
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key_col), (F.octet_length(data) + ROW_BYTES).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(F.col(key_col)).alias("_key"))
    rows = rows.select(key_col, "size", "text_crc32", jump_shard(F.col("_key"), shards).alias("shard"), jump_shard(F.col("_key"), shards + 1).alias("grown_shard"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key_col), F.col("text_crc32")), F.lit(SLOT_BUCKETS)).cast("int"))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_bucket").orderBy(F.col(key_col), "text_crc32", "size")
    numbered = rows.withColumn("_within", F.row_number().over(within) - 1)
    # shards * SLOT_BUCKETS rows at most, whatever the input
    placed = numbered.join(F.broadcast(offsets), ["shard", "_bucket"])
    return placed.select(key_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_within")).cast("long").alias("slot"), "grown_shard")
