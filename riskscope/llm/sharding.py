"""Sharding (operator 2): jump consistent hashing.

A key and the number of shards decide the shard, without a ring table; with
one more shard a row either stays or moves into the new shard.  Contract:
law ``key``.

Slots number the rows of a shard from 0 in key order.  They come from a
range-sorted narrow table in the shared folder: a row's slot is the start of
its (file, shard) piece plus its place in the file, so no task ever holds a
whole shard, and rows that share one key are spread over files too.

Nulls: a null key counts as key 0 for the hash and sorts first; a null text
has no bytes (size 1, crc32 0).  Repeated rows each get their own slot; the
order among equal keys is arbitrary but gapless.  An empty table gives an
empty result.  Other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskscope.llm.common import keyed_text, stored
from riskscope.session import scratch_path

_LCG = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key (Lamping and Veach's jump hash, all keys in
    step: a key leaves the loop once its next jump passes the last shard)."""
    if shards < 1:
        raise ValueError(f"shards must be positive, got {shards}")
    state = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    nxt = np.zeros(len(state), np.int64)
    while live.size:
        at[live] = nxt[live]
        state[live] = state[live] * _LCG + np.uint64(1)
        draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        nxt[live] = ((at[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[nxt[live] < shards]
    return at


def shard_of(key, shards: int):
    """Column: the shard of a long key (hash other keys to a long first)."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.fillna(0).to_numpy(np.int64), shards), dtype="int32")

    return jump(F.coalesce(key, F.lit(0).cast("long")))


def with_slots(rows: DataFrame, shard: str, key: str) -> DataFrame:
    """``rows`` with a gapless ``slot`` from 0 inside each shard, in key order."""
    spark = rows.sparkSession
    path = scratch_path(spark, "shards")
    tie = F.monotonically_increasing_id()
    (rows.withColumn("__tie", tie).repartitionByRange(shard, key, "__tie").drop("__tie")
         .sortWithinPartitions(shard, key).write.parquet(path))
    back = spark.read.schema(rows.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    pieces = back.groupBy("__file", shard).agg(
        F.count("*").alias("n"), F.min("__row").alias("__first"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    before = Window.partitionBy(shard).orderBy("lo", "hi", "__file").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("__file", shard, "__first",
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return (back.join(pieces, ["__file", shard])
                .withColumn("slot", F.col("__start") + F.col("__row") - F.col("__first"))
                .drop("__file", "__row", "__first", "__start"))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per document."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    narrow = keyed_text(docs, key, text).select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        shard_of(F.col("doc_id"), shards).alias("shard"), shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"))
    placed = with_slots(stored(narrow, "shard-rows"), "shard", "doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
