"""Helpers that the training-data operators share.

Words are what the contracts call words: the UTF-8 bytes of a text, A-Z
lower-cased, split at the six ASCII white-space characters.  ``bytes.lower``
and ``bytes.split`` do exactly that, so no Unicode rule interferes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators.components import shared_folder

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by the path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends here.

    The rows survive the loss of any executor, and what made them runs once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of the frames has it (in any case of letters)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column's text, modulo ``n`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def crc_mod_py(value: object, n: int) -> int:
    """The same for one value in Python."""
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of SplitMix64), element-wise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX_A
        x = (x ^ (x >> np.uint64(27))) * _MIX_B
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered for as many words as fit ``bound``."""

    def __init__(self, bound: int = 300_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words of a text; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``width`` words.

    A shorter text that has words at all is one shingle; a text without words
    has none.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(width, n)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, np.uint64(k), np.uint64)
        for i in range(k):
            out = mix64(out * GOLDEN + words[i : n - k + 1 + i])
    return np.unique(out)


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, list]]:
    """The runs of equal ``key`` of a sorted partition, as columns of lists."""
    held: dict[str, list] = {}
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        k, start, n = cols[key], 0, batch.num_rows
        for i in range(1, n + 1):
            if i < n and k[i] == k[start]:
                continue
            part = {c: v[start:i] for c, v in cols.items()}
            if held and held[key][0] == part[key][0]:
                for c in held:
                    held[c] += part[c]
            else:
                if held:
                    yield held
                held = part
            start = i
    if held:
        yield held
