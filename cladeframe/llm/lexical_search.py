"""Ranked lexical search: dense blocked matrix products in float64 that are exact.

Every document is ranked for every item.  A term is a maximal run of ASCII letters
and digits and of anything beyond ASCII, A-Z lower-cased.  A document's impact for a
term is an integer, w * ((10**9 * tf) div (1000 * tf + 8 * m)), and its score for an
item the sum of the impacts of the item's terms, repeats included: a matrix product
of the items' counts with the documents' impacts.

- Items' distinct texts go to the workers in batches of bounded size; a batch has a
  vocabulary of its own, and one pass over the documents keeps their counts of it.
- Within a batch, items are cut into tiles, and the terms of a tile into vocabulary
  tiles: no item's sum over one can reach 2**53, as an impact is at most 10**6 * w.
  So all products and sums of a tile are whole numbers that a double holds, in
  whatever order BLAS adds them; sums of tiles are added in 64-bit integers.
- Documents come in tiles too.  Of each product the k best of each item are kept
  with all they tie with, then cut by (score, doc_id), in the task and once more
  over all tasks by a window with a group limit.

Defined cases: a null or empty text has no terms: as a document it is never
found, as an item it has no rows.  Rows of the items that share a text get the same
documents; rows of the documents that share a doc_id are ranked each for itself; a null
doc_id comes last among equal scores.  Without items, without documents, or where all
documents are empty there are no rows.  Extra columns are not read.  Scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import cut

#: Bytes of items' texts in a batch on average.
BATCH_BYTES = 1 << 24
#: Cells of an item tile's matrix of counts (8 bytes each); one item may have more terms.
TILE_CELLS = 1 << 22
#: Documents of a tile.
TILE_DOCS = 256
#: Whole numbers up to here are exact in a double.
EXACT = 1 << 53
#: No impact exceeds this many times a term's weight.
MOST = 10**6

_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    """The terms of a text, in order."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(_TERM).split()


def _count(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Each document's number of terms and its counts of the vocabulary's."""
    size = len(vocabulary)
    for whole in batches:
        for k in range(0, whole.num_rows, 512):
            batch = whole.slice(k, 512)
            words = [terms_of(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            n = np.array([len(w) for w in words], np.int64)
            ids = np.concatenate([np.fromiter(map(vocabulary.get, w, repeat(-1)), np.int64, len(w)) for w in words])
            row = np.repeat(np.arange(len(words)), n)[ids >= 0]
            key, tf = np.unique(row * size + ids[ids >= 0], return_counts=True)
            edges = pa.array(np.searchsorted(key, np.arange(len(words) + 1) * size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (key % max(size, 1), tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "ids", "tf"])


@dataclass(frozen=True)
class Tile:
    """Some items of a batch: their places, and (term ids, counts) of each vocabulary tile."""

    items: list[int]
    blocks: list[tuple[np.ndarray, np.ndarray]]


def vocabulary_tiles(counts: np.ndarray, weights: np.ndarray, most: int = EXACT) -> list[tuple[np.ndarray, np.ndarray]]:
    """Split items x terms into (columns, counts) with no item's greatest sum at ``most`` or more.

    A count that is too large alone is dealt over several tiles.
    """
    out = []
    left = counts.astype(np.int64)
    limit = np.maximum((most - 1) // np.maximum(weights * MOST, 1), 1)
    while left.any():
        part = np.minimum(left, limit)
        left = left - part
        begin, bound = 0, np.zeros(len(part), np.int64)
        for j in range(part.shape[1]):
            more = part[:, j] * int(weights[j]) * MOST
            if (bound + more >= most).any():
                out.append((np.arange(begin, j), part[:, begin:j]))
                begin, bound = j, np.zeros(len(part), np.int64)
            bound += more
        out.append((np.arange(begin, part.shape[1]), part[:, begin:]))
    return [(columns[used], block[:, used].astype(np.float64)) for columns, block in out if (used := block.any(axis=0)).any()]


def tiles_of(items: list[Counter], weights: np.ndarray) -> list[Tile]:
    """Item tiles of at most TILE_CELLS cells, each over the terms that its items have."""
    out, begin = [], 0
    while begin < len(items):
        end, seen = begin, set()
        while end < len(items):
            more = seen | items[end].keys()
            if end > begin and len(more) * (end + 1 - begin) > TILE_CELLS:
                break
            seen, end = more, end + 1
        terms = np.array(sorted(seen), np.int64)
        counts = np.zeros((end - begin, len(terms)), np.int64)
        for i in range(begin, end):
            mine = np.array(sorted(items[i].items()), np.int64).reshape(-1, 2)
            counts[i - begin, np.searchsorted(terms, mine[:, 0])] = mine[:, 1]
        blocks = [(terms[columns], block) for columns, block in vocabulary_tiles(counts, weights[terms])]
        out.append(Tile(list(range(begin, end)), blocks))
        begin = end
    return out


def impacts(tf: np.ndarray, n: np.ndarray, weights: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """w * ((10**9 * tf) div (1000 * tf + 8 * m)), where m = 25 + (75 * n * docs) div terms."""
    if len(n) and 75 * int(n.max()) * docs < 1 << 63:
        m = 25 + 75 * n * docs // terms
    else:
        m = np.array([25 + 75 * x * docs // terms for x in n.tolist()], np.int64)
    return weights * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Best:
    """The k best documents of each item so far, by score, then doc_id (null last)."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows = [(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)) for _ in range(items)]
        self.least = np.ones(items, np.int64)

    def add(self, items: list[int], scores: np.ndarray, docs: np.ndarray, unnamed: np.ndarray) -> None:
        """``scores``: items x documents. Equals of the last one kept are looked at as well, as their doc_id may be smaller."""
        good = scores >= self.least[items, None]
        for i in np.flatnonzero(good.any(axis=1)):
            new = np.flatnonzero(good[i])
            held = self.rows[items[i]]
            score, none, doc = (np.concatenate([a, b]) for a, b in zip(held, (scores[i, new], unnamed[new], docs[new]), strict=True))
            order = np.lexsort((doc, none, -score))[: self.k]
            self.rows[items[i]] = score[order], none[order], doc[order]
            if len(order) == self.k:
                self.least[items[i]] = score[order[-1]]


def _rank(batches: Iterator[pa.RecordBatch], keys: list[str], tiles: list[Tile], weights: np.ndarray, docs: int, terms: int, k: int) -> Iterator[pa.RecordBatch]:
    best, place = Best(len(keys), k), np.full(len(weights), -1, np.int64)
    for whole in batches:
        for at in range(0, whole.num_rows, TILE_DOCS):
            batch = whole.slice(at, TILE_DOCS)
            ids, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "tf"))
            if not len(ids):
                continue
            size = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), size)
            n = batch.column("n").to_numpy()
            used = np.unique(ids)
            place[used] = np.arange(len(used))
            dense = np.zeros((len(used), batch.num_rows))
            dense[place[ids], row] = impacts(tf, n[row], weights[ids], docs, terms)
            doc = batch.column("doc_id")
            unnamed, doc = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
            for tile in tiles:
                scores = np.zeros((len(tile.items), batch.num_rows), np.int64)
                for columns, counts in tile.blocks:
                    here = place[columns]
                    scores += (counts[:, here >= 0] @ dense[here[here >= 0]]).astype(np.int64)
                best.add(tile.items, scores, doc, unnamed)
            place[used] = -1
    for key, (score, none, doc) in zip(keys, best.rows, strict=True):
        if len(score):
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(score)), pa.array(doc, mask=none), pa.array(score)], ["key", "doc_id", "score"])


def _batch(texts: list[tuple[str, str]], rows: DataFrame, k: int, cut_label: str) -> DataFrame | None:
    """Each task's best documents of a batch of (key, text) items; None if nothing can be found."""
    vocabulary: dict[bytes, int] = {}
    items = [Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text)) for _, text in texts]
    if not vocabulary:
        return None
    counted = cut(rows.mapInArrow(partial(_count, vocabulary=vocabulary), "doc_id long, n long, ids array<int>, tf array<int>"), cut_label)
    docs, terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not docs:
        return None
    found = np.zeros(len(vocabulary), np.int64)
    # as many rows as the batch has terms
    for term, df in counted.select(F.explode("ids").alias("term")).groupBy("term").count().collect():
        found[term] = df
    weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for df in found.tolist()], np.int64)
    tiles = tiles_of(items, weights)
    return counted.mapInArrow(partial(_rank, keys=[key for key, _ in texts], tiles=tiles, weights=weights, docs=docs, terms=terms, k=k), "key string, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score. Both tables have a text column of the same name."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    asked = asked.withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    texts = cut(asked.groupBy("key").agg(F.first("text").alias("text")), "items")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = -(-size // BATCH_BYTES)
    found = []
    for b in range(batches):
        here = texts.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == b).orderBy("key").collect()
        ranked = _batch([(r.key, r.text) for r in here], rows, k, f"counts-{b}")
        found += [] if ranked is None else [ranked]
    if not found:
        return spark.createDataFrame([], asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).schema)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked.select("item_id", "key").join(best, "key").select("item_id", "rank", "doc_id", "score")
