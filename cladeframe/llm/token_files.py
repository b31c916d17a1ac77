"""Token ids as flat binary files that readers map into memory.

A corpus is a folder of shards. Shard k is three files of little-endian numbers:

- ``ids-k.bin``: the ids of its documents, one after the other, as unsigned
  16-bit integers where all ids of the vocabulary fit, else 32-bit ones;
- ``offsets-k.bin``: for each document the place of its first id in that file,
  and the end of the last one, as 64-bit integers;
- ``docs-k.bin``: the number of leading rows without a doc_id, then the doc_ids, 64-bit.

``bases.bin`` has a row (shard, id base, document base) for each shard and a last
one with the totals: prefix sums of the shards' counts, so that a document's place
in the whole corpus is its shard's base and its offset. ``corpus.json`` has the
width and the end id; it is written last and marks the corpus as complete.

Documents are in ascending doc_id order, range-partitioned by Spark: a shard is
written by one task, front to back, whatever its size. The files appear under
their names only when they are whole, so a task that runs twice leaves the same.

Defined cases: null or empty text is the end id alone. A null doc_id sorts first,
equal doc_ids by a hash of their texts; rows equal in both may go to several
shards, so no doc_id is too frequent. An empty table gives a corpus of no shards.
Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm.common import fresh
from cladeframe.llm.kneser_ney import local_folder
from cladeframe.llm.packing import encoder

#: Bytes of text for a shard on average.
SHARD_BYTES = 1 << 28
#: Ids that a reading task holds at once, unless one document has more.
READ_IDS = 1 << 21

FIGURES = "shard long, n_docs long, n_ids long, unnamed long, first long, last long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _little(x: np.ndarray) -> np.ndarray:
    return x if sys.byteorder == "little" else x.byteswap()


def _write(batches: Iterator[pa.RecordBatch], tokenizer: str, folder: str, end_id: int, width: str) -> Iterator[pa.RecordBatch]:
    """The three files of this task's shard; one row of figures."""
    encode, shard, mark = encoder(tokenizer), TaskContext.get().partitionId(), uuid.uuid4().hex
    parts = {kind: f"{folder}/{kind}-{shard}.bin" for kind in ("ids", "offsets", "docs")}
    unnamed, named, edges = 0, [], [np.zeros(1, "<i8")]
    with open(f"{parts['ids']}.{mark}", "wb") as out:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch, lengths = whole.slice(k, 512), []
                for text in batch.column("text"):
                    ids = np.array([*encode(text.as_py() or ""), end_id], width)
                    lengths.append(len(ids))
                    out.write(ids.tobytes())
                edges.append(edges[-1][-1] + np.cumsum(lengths, dtype="<i8"))
                docs = batch.column("doc_id")
                unnamed += docs.null_count
                named.append(docs.drop_null().to_numpy().astype("<i8"))
    docs, offsets = np.concatenate([np.array([unnamed], "<i8"), *named]), np.concatenate(edges)
    n = len(offsets) - 1
    if not n:
        os.remove(f"{parts['ids']}.{mark}")
        return
    for kind, x in (("offsets", offsets), ("docs", docs)):
        with open(f"{parts[kind]}.{mark}", "wb") as out:
            out.write(x.tobytes())
    for path in parts.values():
        os.replace(f"{path}.{mark}", path)
    ends = [None, None] if n == unnamed else [None if unnamed else int(docs[1]), int(docs[-1])]
    figures = [shard, n, int(offsets[-1]), unnamed, *ends]
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in figures], [c.split()[0] for c in FIGURES.split(", ")])


@dataclass(frozen=True)
class Corpus:
    """A complete folder of token files; reads need nothing but the folder."""

    folder: str
    width: str
    end_id: int
    bases: np.ndarray

    @classmethod
    def open(cls, folder: str) -> Corpus:
        with open(f"{folder}/corpus.json", encoding="utf-8") as f:
            head = json.load(f)
        return cls(folder, head["width"], head["end_id"], np.fromfile(f"{folder}/bases.bin", "<i8").reshape(-1, 3))

    @property
    def n_ids(self) -> int:
        return int(self.bases[-1, 1])

    @property
    def n_docs(self) -> int:
        return int(self.bases[-1, 2])

    def _map(self, kind: str, k: int, width: str) -> np.ndarray:
        return np.memmap(f"{self.folder}/{kind}-{self.bases[k, 0]}.bin", width, "r")

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Mapped ids and offsets of the k-th shard, its doc_ids and how many rows before them have none."""
        docs = self._map("docs", k, "<i8")
        return self._map("ids", k, self.width), self._map("offsets", k, "<i8"), docs[1:], int(docs[0])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from place ``start`` to ``stop`` of the whole corpus, over as many shards as that takes."""
        start, stop = max(start, 0), min(stop, self.n_ids)
        out, k = [np.empty(0, self.width)], int(np.searchsorted(self.bases[:-1, 1], start, side="right")) - 1
        while start < stop:
            end = min(stop, int(self.bases[k + 1, 1]))
            out.append(self._map("ids", k, self.width)[start - self.bases[k, 1] : end - self.bases[k, 1]])
            start, k = end, k + 1
        return np.concatenate(out)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, its end id included."""
        if not 0 <= i < self.n_docs:
            raise IndexError(i)
        k = int(np.searchsorted(self.bases[:-1, 2], i, side="right")) - 1
        ids, offsets, *_ = self.shard(k)
        at = i - int(self.bases[k, 2])
        return ids[offsets[at] : offsets[at + 1]]

    def remove(self) -> None:
        """Delete the files; rows that were not read yet are lost."""
        shutil.rmtree(self.folder)


def write_corpus(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> Corpus:
    """Encode all documents into ``folder`` (new and mounted on all workers; else one is made in the shared folder)."""
    spark = docs.sparkSession
    folder = folder or local_folder(spark, "tokens")
    os.makedirs(folder, exist_ok=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    width = "<u2" if max(encoder(tokenizer).core.max_token_value, end_id) < 1 << 16 else "<u4"
    tie, row = fresh("tie", rows), fresh("row", rows)
    order = [F.col("doc_id").asc_nulls_first(), F.col(tie), F.col(row)]
    dealt = rows.withColumns({tie: F.xxhash64("text"), row: F.monotonically_increasing_id()}).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    written = dealt.select("doc_id", "text").mapInArrow(partial(_write, tokenizer=tokenizer, folder=folder, end_id=end_id, width=width), FIGURES)
    # one row for each task: what the bases are made of
    figures = sorted(written.collect(), key=lambda r: r.shard)
    before = None
    for r in figures:
        if before is not None and (r.unnamed or r.first < before):
            raise RuntimeError(f"shard {r.shard} begins before its predecessor ends")
        before = r.last if r.last is not None else before
    counts = np.array([(r.n_ids, r.n_docs) for r in figures], "<i8").reshape(-1, 2)
    bases = np.concatenate([np.zeros((1, 2), "<i8"), np.cumsum(counts, axis=0)])
    np.column_stack([[*(r.shard for r in figures), -1], bases]).astype("<i8").tofile(f"{folder}/bases.bin")
    whole = f"{folder}/corpus.json"
    with open(f"{whole}.part", "w", encoding="utf-8") as f:
        json.dump({"width": width, "end_id": end_id, "n_docs": int(bases[-1, 1]), "n_ids": int(bases[-1, 0])}, f)
    os.replace(f"{whole}.part", whole)
    return Corpus.open(folder)


def _blocks(corpus: Corpus, k: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """doc_ids, edges and mapped ids of a shard's documents, some at a time."""
    ids, offsets, named, unnamed = corpus.shard(k)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + READ_IDS, side="right")) - 1)
        last = min(last, first + 10_000)
        docs = [None] * max(0, min(last, unnamed) - first) + named[max(0, first - unnamed) : max(0, last - unnamed)].tolist()
        yield docs, np.asarray(offsets[first : last + 1]), ids
        first = last


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    corpus = Corpus.open(folder)
    for batch in batches:
        for k in batch.column("id").to_pylist():
            for docs, edges, ids in _blocks(corpus, k):
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
                columns = [pa.array(docs, pa.int64()), pa.array(edges[:-1] + corpus.bases[k, 1]), pa.array(np.diff(edges)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def _read_ids(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    corpus = Corpus.open(folder)
    for batch in batches:
        for k in batch.column("id").to_pylist():
            for docs, edges, ids in _blocks(corpus, k):
                flat = pa.array(ids[edges[0] : edges[-1]].astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array((edges - edges[0]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(edges[:-1] + corpus.bases[k, 1]), lists], ["doc_id", "start", "ids"])


def read_corpus(spark: SparkSession, corpus: Corpus, ids: bool = False) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32, or with ``ids`` doc_id, start, ids."""
    shards = len(corpus.bases) - 1
    at = spark.range(0, shards, 1, max(1, shards))
    if ids:
        return at.mapInArrow(partial(_read_ids, folder=corpus.folder), "doc_id long, start long, ids array<int>")
    return at.mapInArrow(partial(_read, folder=corpus.folder), ROWS)
