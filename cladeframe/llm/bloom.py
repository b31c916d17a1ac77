"""Blocked Bloom filters as tables, made and read by DataFrame functions alone.

The hash of a key chooses one block of four 64-bit words and two bits in each.  The
filter is a table (block, w0..w3) built by bit_or; a key reads its one block, so a
filter costs a lookup and no shuffle where it is broadcast, which its size decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
#: Blocks (32 bytes each) that are broadcast at most.
BROADCAST_BLOCKS = 1 << 20
_WORDS = ("w0", "w1", "w2", "w3")


def blocks_for(keys: int) -> int:
    return max(1, -(-keys * BITS_PER_KEY // 256))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _masks(key: Column) -> list[Column]:
    """Two bits in each of four words, from a second hash."""
    h = F.xxhash64(key, F.lit(1))
    six = lambda n: F.shiftrightunsigned(h, 6 * n).bitwiseAND(F.lit(63)).cast("int")
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), six(n))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(4)]


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w3): a blocked Bloom filter of the distinct ``key`` values."""
    masks = keys.select(_block(F.col(key), blocks).alias("block"), *[m.alias(w) for w, m in zip(_WORDS, _masks(F.col(key)), strict=True)])
    return masks.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in _WORDS])


def marked(rows: DataFrame, key: str, bloom: DataFrame, blocks: int, into: str) -> DataFrame:
    """``rows`` with a further column: whether the filter may hold their key (a null key: no)."""
    bloom = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom
    names = {w: f"__{into}_{w}" for w in ("block", *_WORDS)}
    probed = rows.withColumn(names["block"], _block(F.col(key), blocks)).join(bloom.withColumnsRenamed(names), names["block"], "left")
    hit = F.col(key).isNotNull()
    for w, m in zip(_WORDS, _masks(F.col(key)), strict=True):
        hit = hit & (F.col(names[w]).bitwiseAND(m) == m)
    return probed.withColumn(into, F.coalesce(hit, F.lit(False))).drop(*names.values())


def possible_hits(rows: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key the filter may hold."""
    return marked(rows, key, bloom, blocks, "may_hold").where("may_hold").drop("may_hold")


def narrowed(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose key is none of ``keys`` (one column): what a join with them shuffles.

    Where there are too many keys for a broadcast filter, the rows as they are.
    """
    blocks = blocks_for(keys.count())
    if blocks > BROADCAST_BLOCKS:
        return rows
    return possible_hits(rows, key, bloom_filter(keys.toDF(key), key, blocks), blocks)
