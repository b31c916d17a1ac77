"""Placement of rows on shards by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size:
(offset + j * skip) mod size for j = 0, 1, ..., which is a permutation as the
size is prime.  Shards take turns; a shard claims its next preferred slot that is
free, until all are taken.  Shards so own equal shares (they differ by one slot at
most for equal weights) and few slots change hands when a shard comes or goes.

The table has ``size`` rows whatever the data, so its broadcast is bounded.  A row
is placed by the hash of its key: slot = hash mod size, shard = table[slot].

Only the filling, a loop over the fixed number of slots, runs outside the
DataFrame; rows meet nothing but DataFrame functions.

Defined cases: a null key counts as the empty text and rows with equal keys share
a shard, so give a key that varies (an id) where one value has many rows.  Columns
of the input stay as they are, whatever their names; only an input column named like
the new one (in any case of letters) is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm.common import fresh

#: Prime; a hundred times as many slots as shards keep shares within a percent.
TABLE_SIZE = 65537


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def key_hash(key: Column) -> Column:
    """60 bits of the MD5 of a key's text, as any SQL engine can compute them."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> position in ``shards``; every shard claims a slot in its turn."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if size < len(shards) or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime and no less than the number of shards")
    offset = [_hash(f"{s}/offset") % size for s in shards]
    skip = [_hash(f"{s}/skip") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    at, table, taken = offset[:], [-1] * size, 0
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            taken += 1
            if taken == size:
                return table


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The table as rows (slot, shard), from one literal."""
    table = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",").cast("array<int>")
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    rows = spark.range(1).select(F.posexplode(table).alias("slot", "n"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("n") + 1).alias("shard"))


def place(rows: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, into: str = "shard") -> DataFrame:
    """``rows`` with the shard of each, by a broadcast of the table's ``size`` rows."""
    slot, shard = fresh("_slot", rows), fresh("_shard", rows)
    table = table_frame(rows.sparkSession, shards, size).select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    placed = rows.withColumn(slot, key_hash(F.col(f"`{key}`")) % size).join(F.broadcast(table), slot, "left")
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() != into.lower()], F.col(shard).alias(into))


def write_shards(rows: DataFrame, key: str, shards: list[str], path: str, size: int = TABLE_SIZE, files: int = 1) -> None:
    """Write each shard's rows as one partition folder of ``files`` files at most."""
    salt = fresh("_salt", rows)
    placed = place(rows.withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(files))), key, shards, size)
    placed.repartition("shard", salt).drop(salt).write.partitionBy("shard").parquet(path)
