"""Sharding by a keyed permutation of global row numbers.

Rows are numbered in the order of id and content; a balanced Feistel network with cycle walking permutes the numbers;
a number's remainder by the shard count is its shard, its quotient its slot. So shard sizes differ by one row at most,
slots have no gaps, and any row's place can be computed from its number, the row count and the seed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import running_total

ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A bijection of range(n), applied to each number."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int(k) for k in np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 62, ROUNDS)]
    out, walking = numbers.astype(np.uint64), np.arange(len(numbers))
    while len(walking):
        left, right = out[walking] >> shift, out[walking] & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right, k) & mask)
        out[walking] = (left << shift) | right
        walking = walking[out[walking] >= np.uint64(n)]  # outside the range: permute again
    return out.astype(np.int64)


def permuted_column(number: Column, n: Column, seed: int) -> Column:
    @F.pandas_udf("long")
    def place(x: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(), int(size.iloc[0]), seed) if len(x) else [], dtype="int64")

    return place(number, n)


def shard_rows(docs: DataFrame, n_shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns a row for each document: id_col, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 16 (null: 16, with the crc of no bytes). Null ids come first. Rows that repeat
    id and text are alike and get places of their own, counted before they are numbered. The texts are only measured,
    never shuffled; other columns are left out. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("__print"))
    alike = slim.groupBy(id_col, "size", "text_crc32", "__print").agg(F.count(F.lit(1)).alias("__n"))
    order = [F.col(id_col).asc_nulls_first(), F.col("size"), F.col("text_crc32"), F.col("__print")]
    numbered = running_total(alike, order, F.col("__n"), "__first", "__rows")
    numbered = numbered.withColumn("__number", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__n") - 1)))
    placed = numbered.withColumn("__place", permuted_column(F.col("__number"), F.col("__rows"), seed))
    return placed.select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"), (F.col("__place") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("__place") / n_shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
