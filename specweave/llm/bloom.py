"""Blocked Bloom filter in plain DataFrame operations.

A key picks one block of eight 64-bit words and one bit in each word.  The
number of blocks follows the keys but never exceeds ``max_blocks``, so the
filter is at most 72 bytes x ``max_blocks`` and may be broadcast whatever the
number of keys: with more keys it only lets more of the others through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
MAX_BLOCKS = 1 << 18
KEYS_PER_BLOCK = 32


def blocks_for(n_keys: int, max_blocks: int = MAX_BLOCKS) -> int:
    return max(1, min(max_blocks, n_keys // KEYS_PER_BLOCK + 1))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(n_blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    spread = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def build(keys: DataFrame, column: str, n_blocks: int) -> DataFrame:
    """(block, w0 .. w7): one row for each block that has a key; null keys are left out."""
    key = F.col(column)
    bits = keys.where(key.isNotNull()).select(_block(key, n_blocks).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(key))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def probe(df: DataFrame, column: str, filter_: DataFrame, n_blocks: int, flag: str = "maybe") -> DataFrame:
    """``df`` with a boolean ``flag``: false only where the key surely isn't listed (null keys: false)."""
    key = F.col(column)
    own = filter_.select(F.col("block").alias("__block"), *(F.col(f"w{i}").alias(f"__w{i}") for i in range(WORDS)))
    joined = df.withColumn("__block", _block(key, n_blocks)).join(F.broadcast(own), "__block", "left")
    hit = F.lit(True)
    for i, b in enumerate(_bits(key)):
        hit = hit & (F.col(f"__w{i}").bitwiseAND(b) != 0)
    return joined.withColumn(flag, key.isNotNull() & F.coalesce(hit, F.lit(False))).drop("__block", *(f"__w{i}" for i in range(WORDS)))
