"""Token counts that follow edits without encoding a text anew.

A byte-level BPE vocabulary encodes each pre-token (a match of the splitting
pattern) on its own, so a text's count is the sum of its pre-tokens' counts.  For
each document a segment tree keeps the pre-tokens in blocks at its leaves and, in
every node, the characters, tokens and pre-tokens below it.

An edit replaces some characters.  The tree finds the first pre-token whose match
could have looked at the edited place: a match reads at most two characters behind
its end (the longest contraction), so those that end two characters before stay.
From there the pattern runs over the new text until it meets an old border behind
the edit; as a match depends on nothing before its start, all later pre-tokens are
as they were.  The pre-tokens between the two places are replaced, only those are
encoded, and the sums on their leaves' paths are updated.

``build`` makes the state (text and tree as columns), ``apply_edits`` applies each
row's edits in order and returns the new state: a table that is kept between runs.

Defined cases: null text counts as empty, without tokens.  Places beyond the text's
end mean its end, negative ones its start; null lists mean no edits, null members
of an edit 0 or the empty text.  Special tokens in a text are ordinary text.  Rows
that repeat a doc_id are documents of their own.  A pre-token that tiktoken's pattern
engine refuses is merged without the pattern.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
LOOKAHEAD = 2
REMEMBER = 400_000


class Counter(dict):
    """pre-token -> tokens, remembered."""

    def __init__(self, path: str):
        super().__init__()
        from public_tokenizers import PATTERN

        from cladeframe.llm.packing import encoder

        self.core = encoder(path).core
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        try:
            n = len(self.core.encode_ordinary(piece))
        except BaseException as error:  # tiktoken panics on texts that its pattern engine can't match
            if isinstance(error, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            n = len(self.core._encode_single_piece(piece))  # merges alone, as a pre-token needs no pattern
        self[piece] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class PreTokenTree:
    """Segment tree over blocks of (characters, tokens) of pre-tokens."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self.rebuilt(lengths, counts)

    def rebuilt(self, lengths: list[int], counts: list[int]) -> None:
        self.blocks = [(lengths[k : k + BLOCK], counts[k : k + BLOCK]) for k in range(0, len(lengths), BLOCK)] or [([], [])]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        zero = (0, 0, 0)
        leaves = [(sum(a), sum(b), len(a)) for a, b in self.blocks]
        self.sums = [zero] * self.size + leaves + [zero] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            self._pull(i)

    def _pull(self, i: int) -> None:
        a, b = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    @property
    def characters(self) -> int:
        return self.sums[1][0]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    @property
    def pre_tokens(self) -> int:
        return self.sums[1][2]

    def find(self, place: int) -> tuple[int, int, int]:
        """(block, index, start) of the first pre-token that ends behind ``place``; behind all if none does."""
        if place >= self.characters:
            b = len(self.blocks) - 1
            return b, len(self.blocks[b][0]), self.characters
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if start + self.sums[i][0] <= place:
                start += self.sums[i][0]
                i += 1
        b, k = i - self.size, 0
        for n in self.blocks[b][0]:
            if start + n > place:
                break
            start += n
            k += 1
        return b, k, start

    def replace(self, at: tuple[int, int], until: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        """Put new pre-tokens in place of those from ``at`` to before ``until``."""
        (b, i), (c, j) = at, until
        tail = self.blocks[c][0][j:], self.blocks[c][1][j:]
        self.blocks[b] = self.blocks[b][0][:i] + lengths, self.blocks[b][1][:i] + counts
        if c > b:
            for k in range(b + 1, c):
                self.blocks[k] = [], []
            self.blocks[c] = tail
        else:
            self.blocks[b] = self.blocks[b][0] + tail[0], self.blocks[b][1] + tail[1]
        if len(self.blocks[b][0]) > 4 * BLOCK:
            self.rebuilt([x for p, _ in self.blocks for x in p], [x for _, p in self.blocks for x in p])
            return
        for k in range(b, c + 1):
            n = self.size + k
            self.sums[n] = (sum(self.blocks[k][0]), sum(self.blocks[k][1]), len(self.blocks[k][0]))
            while n := n // 2:
                self._pull(n)

    def to_bytes(self) -> bytes:
        both = [np.array([x for p in self.blocks for x in p[k]], np.uint32) for k in (0, 1)]
        return np.concatenate(both).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PreTokenTree:
        both = np.frombuffer(data, np.uint32)
        n = len(both) // 2
        return cls(both[:n].tolist(), both[n:].tolist())


def tree_of(text: str, count: Counter) -> PreTokenTree:
    pieces = count.pattern.findall(text)
    return PreTokenTree(list(map(len, pieces)), [count[p] for p in pieces])


def edit(text: str, tree: PreTokenTree, start: int, length: int, insert: str, count: Counter) -> tuple[str, int]:
    """The edited text and how many of its characters were encoded again; ``tree`` follows."""
    start = min(max(start, 0), len(text))
    stop = min(start + max(length, 0), len(text))
    shift = len(insert) - (stop - start)
    new = text[:start] + insert + text[stop:]
    b, i, begin = tree.find(max(0, start - LOOKAHEAD))
    at, old, place = (b, i), begin, begin
    lengths: list[int] = []
    counts: list[int] = []
    if place < len(new):
        for m in count.pattern.finditer(new, begin):
            lengths.append(m.end() - m.start())
            counts.append(count[m.group()])
            place = m.end()
            if place >= start + len(insert):
                # walk the old borders up to here
                while old < place - shift:
                    while i >= len(tree.blocks[b][0]):
                        b, i = b + 1, 0
                    old += tree.blocks[b][0][i]
                    i += 1
                if old == place - shift:
                    break
    if place >= len(new):  # to the end: nothing of the old rest stays
        b, i = len(tree.blocks) - 1, len(tree.blocks[-1][0])
    tree.replace(at, (b, i), lengths, counts)
    return new, place - begin


_STATE = ["doc_id", "text", "n_tokens", "n_pre_tokens", "tree"]


def _build(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = counter(path)
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            batch = whole.slice(k, 256)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            trees = [tree_of(t, count) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([t.tokens for t in trees], pa.int64()), pa.array([t.pre_tokens for t in trees], pa.int64()), pa.array([t.to_bytes() for t in trees], pa.binary())], _STATE)


def _apply(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = counter(path)
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            batch = whole.slice(k, 256)
            texts, trees, again, many = [], [], [], []
            for text, data, edits in zip(*(batch.column(c).to_pylist() for c in ("text", "tree", "edits")), strict=True):
                tree, chars = PreTokenTree.from_bytes(data), 0
                for e in edits or []:
                    e = e or {}
                    text, n = edit(text, tree, e.get("start") or 0, e.get("length") or 0, e.get("insert") or "", count)
                    chars += n
                texts.append(text)
                trees.append(tree)
                again.append(chars)
                many.append(len(edits or []))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([t.tokens for t in trees], pa.int64()), pa.array([t.pre_tokens for t in trees], pa.int64()), pa.array([t.to_bytes() for t in trees], pa.binary()), batch.column("n_tokens"), pa.array(many, pa.int64()), pa.array(again, pa.int64())],
                [*_STATE, "n_tokens_before", "n_edits", "encoded_chars"],
            )


_STATE_SCHEMA = "doc_id long, text string, n_tokens long, n_pre_tokens long, tree binary"


def build(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The state of each row: doc_id, text, n_tokens, n_pre_tokens, tree."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_build, path=tokenizer), _STATE_SCHEMA)


def apply_edits(state: DataFrame, tokenizer: str) -> DataFrame:
    """The state after the edits of each row's ``edits`` column (array of start, length, insert), applied in order.

    n_tokens_before, n_edits and encoded_chars (characters encoded again) are added.
    """
    kind = "array<struct<start: long, length: long, insert: string>>"
    rows = state.select("doc_id", "text", "n_tokens", "tree", F.col("edits").cast(kind).alias("edits"))
    return rows.mapInArrow(partial(_apply, path=tokenizer), f"{_STATE_SCHEMA}, n_tokens_before long, n_edits long, encoded_chars long")


def with_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """``state`` with the edits of each document from a table (doc_id, seq, start, length, insert).

    Edits of one document are one list in order of seq; a document without any has
    null.  Edits of unknown documents fall away.
    """
    ordered = F.sort_array(F.collect_list(F.struct("seq", "start", "length", "insert")))
    lists = edits.groupBy("doc_id").agg(F.transform(ordered, lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["insert"].alias("insert"))).alias("edits"))
    return state.join(lists, "doc_id", "left")


def sample_edits(text: str = "text", key: str = "doc_id") -> list:
    """Three edits made from a row's own id and length: replace, delete, insert (for trials)."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    one = lambda start, length, insert: F.struct(start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), insert.alias("insert"))
    return F.array(
        one(h % (n + 1), 5, F.concat(F.lit("'re edited "), F.col(key).cast("string"))),
        one(F.floor(n / 2), 12, F.lit("")),
        one(F.floor(n / 4), 0, F.lit("  new\n")),
    )
