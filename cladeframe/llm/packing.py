"""Packing documents into sequences: the sum-of-squares rule.

A document is its token ids and an end id.  Only documents longer than a
sequence are cut, into full sequences; what is over is their first piece.

A shard of pieces (dealt by hash, of bounded size whatever the corpus) is packed
longest first.  With N(g) the number of open bins that have g tokens left, a
piece of length s goes where the sum over g of N(g)**2 becomes smallest: taking
a bin with gap g changes it by 2 * (N(g - s) - N(g)) + 2 (terms of gap 0, full
bins, don't count), and opening a bin by 2 * N(B - s) + 1.  Gaps so stay
evenly spread and each later piece finds one that suits it.  The emptiest bins
of a shard are then opened again and their pieces placed by the same rule, in open
bins as long as one has room, while that saves a bin.

Defined cases: null or empty text is the end id alone; each row is a document
of its own even if doc_ids repeat or are null; extra columns are not read.
Ties in length go to the smaller doc_id and piece, ties in the rule to the
smallest gap, an open bin before a new one.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import cut, runs_of

SEQUENCE = 2048
#: Pieces that one packing task gets on average.
SHARD_PIECES = 60_000


class Encoder:
    """Ids of the byte-level vocabulary in a tokenizers file, without the template's tokens.

    The ids are those of the tokenizers library; tiktoken, given the file's own
    merges as ranks, finds them faster.  The file's added tokens are found in
    the text first, as that library does.  Where tiktoken refuses a text, the
    library itself encodes it.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        to_byte = {c: b for b, c in _byte_alphabet().items()}
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = frozenset(special)
        self.slow = None

    def __call__(self, text: str) -> list[int]:
        try:
            return self.core.encode(text, allowed_special=self.special) if any(s in text for s in self.special) else self.core.encode_ordinary(text)
        except BaseException as error:  # tiktoken panics on texts that its pattern engine can't match
            if isinstance(error, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return self.slow.encode(text, add_special_tokens=False).ids


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _cut_up(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    for whole in batches:
        for k in range(0, whole.num_rows, 512):
            batch = whole.slice(k, 512)
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                first = len(ids) % size or size
                edges = [0, *range(first, len(ids) + 1, size)]
                out += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


class Bins:
    """Open bins by gap, and where each placed piece went."""

    def __init__(self, size: int):
        self.size = size
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.count = np.zeros(size + 1, np.int64)
        self.inside: list[list[int]] = []

    def _best(self, s: int, new: bool) -> int:
        """The gap to use, or 0 for a new bin (-1: none, where no bin may be opened)."""
        gaps = self.count[s:]
        after = self.count[: len(gaps)].copy()
        change = 2 * (after - gaps) + 2
        change[0] = 1 - 2 * gaps[0]  # a bin that gets full leaves the sum
        change[gaps == 0] = np.iinfo(np.int64).max
        at = int(change.argmin())
        none = gaps[at] == 0
        if new and (none or (2 * self.count[self.size - s] + 1 if s < self.size else 0) < change[at]):
            return 0
        return -1 if none else s + at

    def hold(self, pieces: list[int], gap: int) -> None:
        """Take over a bin that is already packed."""
        if gap:
            self.open[gap].append(len(self.inside))
            self.count[gap] += 1
        self.inside.append(pieces)

    def put(self, piece: int, s: int, new: bool = True) -> bool:
        """Place a piece by the rule; without ``new`` only in an open bin, False if none has room."""
        gap = self._best(s, new)
        if gap < 0:
            return False
        if gap:
            b = self.open[gap].pop()
            self.count[gap] -= 1
        else:
            b, gap = len(self.inside), self.size
            self.inside.append([])
        self.inside[b].append(piece)
        if gap > s:
            self.open[gap - s].append(b)
            self.count[gap - s] += 1
        return True


def sum_of_squares(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of positions of ``lengths``, which are in descending order."""
    full = int(np.searchsorted(-lengths, -size, side="right"))
    bins = Bins(size)
    for i in range(full, len(lengths)):
        bins.put(i, int(lengths[i]))
    kept = [b for b in bins.inside if b]
    return [[i] for i in range(full)] + _fewer(kept, lengths, size)


def _fewer(packed: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Open the emptiest bins again and deal their pieces by the rule, while that takes fewer bins."""
    while True:
        fill = np.array([lengths[b].sum() for b in packed], np.int64)
        spare = int((size - fill).sum()) // size
        if not spare:
            return packed
        order = np.argsort(fill, kind="stable")
        most = len(packed)
        for n in sorted({min(most, k) for k in (2 * spare + 1, 2 * spare + 4, 6 * spare + 8, 20 * spare + 32, most // 8, most // 2)}):
            bins = Bins(size)
            for i in order[n:]:
                bins.hold(list(packed[i]), int(size - fill[i]))
            for p in sorted((p for i in order[:n] for p in packed[i]), key=lambda p: (-lengths[p], p)):
                if not bins.put(p, int(lengths[p]), new=False):
                    bins.put(p, int(lengths[p]))
            if len(bins.inside) < most:
                packed = bins.inside
                break
        else:
            return packed


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for run in runs_of(batches, "shard"):
        length = np.array(run["length"], np.int64)
        order = np.argsort(-length, kind="stable")
        seq, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        for n, members in enumerate(sum_of_squares(length[order], size)):
            at = 0
            for m in members:
                seq[order[m]], offset[order[m]] = (run["shard"][0] << 36) | n, at
                at += length[order[m]]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(run[c], t) for c, t in zip(names, kinds, strict=True)] + [pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = cut(texts.mapInArrow(partial(_cut_up, path=tokenizer, size=size, end_id=end_id), kind), "pieces")
    shards = max(1, -(-pieces.count() // SHARD_PIECES))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece")
    return dealt.mapInArrow(partial(_pack, size=size), kind + ", sequence_id long, offset long")
