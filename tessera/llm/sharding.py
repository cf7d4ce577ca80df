"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key alone decides the shard: no ring table is kept, and when a shard is appended, a row either stays
where it was or moves into the new shard.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import fields, table, written

#: Fixed values of the published algorithm.
MULTIPLIER = 2862933555777941757
SHIFT = 33


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, all keys at once."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    active = np.arange(len(key))
    after = np.zeros(len(key), np.int64)
    with np.errstate(over="ignore"):
        while len(active):
            shard[active] = after[active]
            k = key[active] * np.uint64(MULTIPLIER) + np.uint64(1)
            key[active] = k
            step = float(1 << 31) / ((k >> np.uint64(SHIFT)).astype(np.float64) + 1.0)
            after[active] = ((shard[active] + 1) * step).astype(np.int64)
            active = active[after[active] < shards]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a bigint column (see ``stable_key`` for other types)."""
    if isinstance(shards, bool) or not isinstance(shards, int) or shards < 1:
        raise ValueError("shards must be a positive int")

    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards))

    of.__annotations__ = {"keys": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, T.IntegerType())(key)


def stable_key(df: DataFrame, column: str) -> Column:
    """Integers stand for themselves, other types for the hash of their text, null for 0."""
    whole = isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    key = F.col(f"`{column}`")
    return F.coalesce(key.cast("bigint") if whole else F.xxhash64(key.cast("string")), F.lit(0).cast("bigint"))


def shard_rows(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n_shards: int = 16,
    rows_per_block: int = 20_000,
) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1 (a null text has no bytes and the checksum 0). ``slot`` counts the
    rows of a shard from 0 without gaps. No window ever holds a whole shard: rows are numbered in blocks of about
    ``rows_per_block`` and the blocks' sizes are summed, so a shard's rows never meet in one task. Equal keys
    share a shard and get their own slots; an empty table gives an empty result.
    """
    base = fields(df.withColumn("__key", stable_key(df, key)), key=key, hash_key="__key", text=text)
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    narrow = base.select(
        "key",
        (F.octet_length(data).cast("bigint") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
        shard_of(F.col("hash_key"), n_shards).alias("shard"),
        shard_of(F.col("hash_key"), n_shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(narrow, "shards")
    blocks = max(1, math.ceil(rows.count() / (n_shards * rows_per_block)))
    spread = F.xxhash64("key", "size", "text_crc32", F.col("row") % 64)  # equal rows spread over blocks too
    rows = rows.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int"))
    sizes = rows.groupBy("shard", "block").count()
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("shard", "block").orderBy("key", "row")
    numbered = rows.withColumn("place", F.row_number().over(within).cast("bigint") - 1)
    return numbered.join(starts, ["shard", "block"]).select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("base") + F.col("place")).alias("slot"),
        "grown_shard",
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


#: The checksum bit by bit over the bytes, the jumps with wide integers; slots as for a table of one block.
OP5_SQL = """
WITH RECURSIVE t AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS k))),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, length(h) // 2 AS n, list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i:
  (ascii(h[2 * i + 1]) - CASE WHEN h[2 * i + 1] > '9' THEN 55 ELSE 48 END) * 16 + ascii(h[2 * i + 2]) - CASE WHEN h[2 * i + 2] > '9' THEN 55 ELSE 48 END)) AS b FROM h),
z AS (SELECT doc_id, n + 1 AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
j(doc_id, n, k, b, j) AS (SELECT doc_id, n, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END, -1::BIGINT, 0::BIGINT
    FROM documents, (VALUES (16), (17)) AS v(n)
  UNION ALL SELECT doc_id, n, k, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE))::BIGINT
    FROM (SELECT doc_id, n, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k, j FROM j WHERE j < n)),
g AS (SELECT doc_id, max(b) FILTER (WHERE n = 16) AS shard, max(b) FILTER (WHERE n = 17) AS grown_shard FROM j WHERE j >= n GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard::INT AS grown_shard
FROM z JOIN g USING (doc_id)
"""
