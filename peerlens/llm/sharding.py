"""Sharding by jump consistent hash.

shard_of() needs no ring table: a key jumps through ever larger shard counts, and the last jump
below the wanted count is its shard. With one more shard a key either stays or moves into the new one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of 64-bit keys, all keys at a time; takes O(log shards) rounds on average."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    k = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.full(len(k), -1, np.int64)
    nxt = np.zeros(len(k), np.int64)
    live = np.arange(len(k))
    while len(live):
        shard[live] = nxt[live]
        k[live] = k[live] * np.uint64(2862933555777941757) + np.uint64(1)
        r = (k[live] >> np.uint64(33)).astype(np.float64) + 1.0
        nxt[live] = ((shard[live] + 1) * (float(1 << 31) / r)).astype(np.int64)
        live = live[nxt[live] < shards]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """int shard of a bigint key."""

    @F.pandas_udf(T.IntegerType())
    def jump(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64), shards))

    return jump(key)


def shard_documents(docs: DataFrame, shards: int = 8, rows_a_bucket: int = 100_000) -> DataFrame:
    """Puts documents into shards and numbers each shard's rows without gaps.

    Returns doc_id, size (UTF-8 bytes of text plus 1; null text: 1), text_crc32 (unsigned; null: of
    the empty text), law ("key"), shard, slot (from 0 in each shard), grown_shard (with one more shard).

    Slots ascend by hash bucket, then doc_id, size and checksum. Buckets keep each sort small; their offsets
    come from a table of counts. Equal rows are summed before the shuffle and expanded afterwards, so many copies
    of a row don't meet in one task. Null doc_id is a key like any other; equal rows each get a slot;
    an empty table gives an empty result; further columns are ignored. Of a text only its length and checksum are kept, however long it is. doc_ids are numbers (or
    text of digits, which is cast), as the jump hash takes a number.
    """
    d = pick(docs, doc_id="bigint", text="string")
    text = F.coalesce("text", F.lit(""))
    rows = (
        d.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("copies"))
    )
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    buckets = max(1, -(-d.count() // rows_a_bucket))
    keyed = rows.withColumn("key", key).select(
        "*", shard_of(F.col("key"), shards).alias("shard"), shard_of(F.col("key"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    counts = keyed.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    before = "sum(n) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding)"
    offsets = counts.select("shard", "bucket", F.coalesce(F.expr(before), F.lit(0)).alias("base"))
    own = "sum(copies) over (partition by shard, bucket order by doc_id, size, text_crc32 rows between unbounded preceding and 1 preceding)"
    return (
        keyed.withColumn("own", F.coalesce(F.expr(own), F.lit(0)))
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "grown_shard", (F.col("base") + F.col("own")).alias("first"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("nth"))
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("first") + F.col("nth")).alias("slot"), "grown_shard")
    )
