"""Exact deduplication with counting quotient filters.

A 64-bit fingerprint of the normalised text is split into a quotient (its high
bits) and a remainder.  Each partition of the input builds one counting
quotient filter per range of quotients: the run length of every quotient that
occurs, the remainders of a run in ascending order (in as many bytes as they
need), and a counter for each.  The number of ranges follows from the number of
rows, so a merging task's share stays the same however many there are.
Since runs are sorted, filters of the same range merge without loss by merging
remainders and adding counters.  Fingerprints whose merged count is above one
are only candidates: their rows go on to verification on the bytes, the others
are known to be alone.

Hot groups: a partition sends a fingerprint once with its count, group figures
are aggregated before their shuffle, and the joins that return a group's row to
its members are ordinary joins whose hot side Spark may split.

Defined cases: null text counts as empty; empty texts and texts of white space
only are one group.  Rows that repeat a doc_id count as rows; all rows with the kept id are
marked as kept, unless a row key tells them apart.  Ties in length
go to the smaller doc_id (a null doc_id last); any long may be a doc_id.  Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.bloom import BROADCAST_BLOCKS, blocks_for, bloom_filter, marked
from cladeframe.llm.common import cut, runs_of

#: Rows that a range's merging task gets on average.
RANGE_ROWS = 500_000


def range_bits(rows: int) -> int:
    """High bits of a fingerprint that choose its range."""
    return max(3, (-(-rows // RANGE_ROWS) - 1).bit_length())


def remainder_bits(ranges: int) -> int:
    """Low bits that are a remainder, in whole bytes; those between are the quotient inside a range."""
    return 40 if ranges <= 16 else 32


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


class CountingQuotientFilter:
    """Sorted remainders of ``bits`` bits with counters, in runs by quotient, of one range."""

    def __init__(self, bits: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        #: (quotient, run length) pairs, remainders and counters in run order.
        self.bits, self.runs, self.remainders, self.counts = bits, runs, remainders, counts

    @classmethod
    def build(cls, low: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From ascending distinct fingerprints (without their range bits)."""
        quotient, length = np.unique(low >> np.uint64(bits), return_counts=True)
        rest = low & np.uint64((1 << bits) - 1)
        return cls(bits, np.stack([quotient.astype(np.uint32), length.astype(np.uint32)]), rest, counts.astype(np.uint64))

    def fingerprints(self) -> np.ndarray:
        """Ascending, without the range bits: nothing was lost."""
        return (np.repeat(self.runs[0].astype(np.uint64), self.runs[1]) << np.uint64(self.bits)) | self.remainders

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        low = np.concatenate([f.fingerprints() for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(low, kind="stable")
        low, counts = low[order], counts[order]
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else np.empty(0, np.int64)
        return cls.build(low[first], np.add.reduceat(counts, first) if len(low) else counts, filters[0].bits)

    def to_bytes(self) -> bytes:
        head = np.array([self.runs.shape[1], len(self.remainders)], np.uint32)
        narrow = np.uint8 if not len(self.counts) or self.counts.max() < 256 else np.uint64
        rest = np.ascontiguousarray(self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.bits // 8])
        return b"".join([head.tobytes(), bytes([np.dtype(narrow).itemsize, self.bits]), self.runs.tobytes(), rest.tobytes(), self.counts.astype(narrow).tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, n = np.frombuffer(data, np.uint32, 2)
        kind, bits, at = (np.uint8 if data[8] == 1 else np.uint64), data[9], 10
        runs = np.frombuffer(data, np.uint32, 2 * q, at).reshape(2, q)
        wide, at = np.zeros((n, 8), np.uint8), at + 8 * int(q)
        wide[:, : bits // 8] = np.frombuffer(data, np.uint8, int(n) * (bits // 8), at).reshape(n, -1)
        return cls(bits, runs, wide.view("<u8").reshape(-1), np.frombuffer(data, kind, n, at + int(n) * (bits // 8)).astype(np.uint64))


def _filters(fps: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    value, count = np.unique(fps.astype(np.uint64), return_counts=True)
    part = (value >> np.uint64(64 - ranges)).astype(np.int64)
    low = value & np.uint64((1 << (64 - ranges)) - 1)
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for a, b in zip(edges, [*edges[1:], len(part)], strict=True):
        yield int(part[a]), CountingQuotientFilter.build(low[a:b], count[a:b], remainder_bits(ranges)).to_bytes()


def _build(batches: Iterator[pa.RecordBatch], ranges: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out() -> pa.RecordBatch:
        got = list(_filters(np.concatenate(held), ranges))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([f for _, f in got], pa.binary())], ["part", "filter"])

    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        n += batch.num_rows
        if n >= most:
            yield out()
            n = 0
    if n:
        yield out()


def _repeated(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    for run in runs_of(batches, "part"):
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(b) for b in run["filter"]])
        many = merged.counts > 1
        if many.any():
            fp = merged.fingerprints()[many] | (np.uint64(run["part"][0]) << np.uint64(64 - ranges))
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(merged.counts[many].astype(np.int64))], ["fp", "n"])


def repeated_fingerprints(fps: DataFrame) -> DataFrame:
    """(fp, n): the fingerprints of a one-column table that occur more than once."""
    ranges = range_bits(fps.count())
    built = fps.mapInArrow(partial(_build, ranges=ranges), "part int, filter binary")
    return built.repartition("part").sortWithinPartitions("part").mapInArrow(partial(_repeated, ranges=ranges), "fp long, n long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of texts with equal bytes after normalisation, the row with the most code
    points stays, of those the one with the smallest doc_id.

    ``key_col``: a column of longs that no two rows share.  It comes back as
    row_key, and exactly one row of each group is kept, whatever the doc_ids:
    further ties go to the smaller key.
    """
    key = ["row_key"] if key_col else []
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(key_col).cast("long").alias(k) for k in key], text.alias("text"), normalised(text).alias("norm"))
    print_of = F.xxhash64("norm")
    facts = cut(
        base.select("doc_id", *key, F.coalesce(F.length("text"), F.lit(0)).alias("points"), print_of.alias("fp"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.octet_length("norm").alias("bytes")),
        "prints",
    )
    again = cut(repeated_fingerprints(facts.select("fp")), "repeated")
    # rows whose fingerprint surely occurs once are done; the filter lets few of them through
    blocks = blocks_for(again.count())
    if blocks <= BROADCAST_BLOCKS:
        facts = marked(facts, "fp", bloom_filter(again.select("fp"), "fp", blocks), blocks, "possible")
    else:
        facts = facts.withColumn("possible", F.lit(True))
    possible = facts.where("possible")
    routed = possible.join(again.select("fp"), "fp", "left_semi")
    # Verification on the bytes: their number and a 256-bit digest over all of them must agree.
    order = F.struct((-F.col("points")).alias("short"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", *key)
    groups = cut(routed.groupBy("fp", "text_sha256", "bytes").agg(F.min(order).alias("best"), F.count("*").alias("group_size")), "groups")
    groups = groups.select("fp", "text_sha256", "bytes", F.col("best.doc_id").alias("keep_id"), "group_size", *[F.col("best.row_key").alias("keep_key") for _ in key])
    out = possible.join(groups, ["fp", "text_sha256", "bytes"], "left").unionByName(facts.where("NOT possible"), allowMissingColumns=True)
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    kept = F.coalesce(F.col("row_key") == F.col("keep_key"), F.lit(True)) if key else F.col("doc_id").eqNullSafe(keep)
    return out.select("doc_id", *key, keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), "text_sha256")
