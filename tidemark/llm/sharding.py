"""Sharding by jump consistent hashing: stable keys to shards, without a ring table.

The law is ``key``: the id and the number of shards decide, so equal ids share a shard, and one more shard takes rows
only into itself. Rows are numbered within a shard by order of the key; the numbers come from counts per sorted
partition, so no shard is gathered in one task.

Null ids share the key 0. Null texts have size 1. Rows that repeat get a slot each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, ordered_parts


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, from 0, of each unsigned 64-bit key (Lamping and Veach)."""
    keys = keys.astype(np.uint64)
    shard, ahead = np.zeros(len(keys), np.int64), np.zeros(len(keys))
    while (go := ahead < shards).any():
        shard[go] = ahead[go].astype(np.int64)
        keys[go] = keys[go] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[go] = np.floor((shard[go] + 1) * (2147483648.0 / ((keys[go] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)))
    return shard.astype(np.int32)


def jump_hash(key, shards: int):
    """A column with the shard of a long column; null keys count as 0."""

    @F.pandas_udf("int")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(jump(s.fillna(0).to_numpy(np.int64).view(np.uint64).copy(), shards))

    return of(F.coalesce(key, F.lit(0)).cast("long"))


def shards(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, size, text_crc32, law, shard, slot, grown_shard (with one more shard)."""
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).alias("text_crc32"),
    )
    rows = rows.withColumns({"shard": jump_hash(F.col("id"), n), "grown_shard": jump_hash(F.col("id"), n + 1)})
    placed = ordered_parts(scratch, rows, "id", "size", "text_crc32")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("k"))
    before = counts.select("shard", "part", (F.sum("k").over(Window.partitionBy("shard").orderBy("part")) - F.col("k")).alias("before"))
    here = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "size", "text_crc32"))
    out = placed.withColumn("here", here).join(before, ["shard", "part"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("here") - 1).cast("long").alias("slot"), "grown_shard")
