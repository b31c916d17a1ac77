"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the model says (here: blanks become the mark U+2581 and
one mark is put in front) and split into units: wherever two neighbouring
characters are neighbours in no piece of the vocabulary, no merge can ever cross
the border between them.  Units are so encoded independently and remembered.  (A
model without byte pieces may join unknown characters of neighbouring units, so
there the whole text is one unit.)

Inside a unit an agenda holds the adjacent symbol pairs that form a piece,
ordered by score, then from the left.  The best pair is merged, its new
neighbours enter the agenda, entries whose symbols have changed are skipped.
What is left is looked up; a symbol that isn't in the vocabulary falls back to
its UTF-8 bytes.

A batch's units are dictionary-encoded by Arrow, so Python meets each distinct one
once; the ids and decoded texts of documents are joined from those of the units.

Every unit that a task meets for the first time is also encoded by the
sentencepiece library, in one call for each batch, and one whole document in
each ``WHOLE`` of a batch is checked in both directions.  A difference raises an error.

Defined cases: null counts as empty; an empty text has no ids and decodes to an
empty text.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Units of a generation: a worker remembers the units met in this one and in the last.
REMEMBER = 300_000
#: Bytes of text and documents worked on at once, and of how many one is checked as a whole.
CHUNK_BYTES, CHUNK_ROWS, WHOLE = 4_000_000, 2048, 256
#: Up to so many symbols the agenda is a plain list.
_SHORT, _NONE = 40, float("inf")


class Borders:
    """Which neighbouring characters are neighbours in no piece."""

    def __init__(self, pieces: list[str]):
        pairs = sorted({p[i : i + 2] for p in pieces for i in range(len(p) - 1)})
        letters = sorted({c for p in pairs for c in p})
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.n = len(letters) + 1
        a, b = (self.kind[[ord(p[k]) for p in pairs]].astype(np.int64) for k in (0, 1))
        self.keys = np.sort(a * self.n + b)
        self.table = None
        if self.n <= 8192:
            self.table = np.ones(self.n * self.n, bool)
            self.table[self.keys] = False

    def between(self, points: np.ndarray) -> np.ndarray:
        """True at i where a border lies between code points i and i + 1."""
        kind = self.kind[points].astype(np.int64)
        key = kind[:-1] * self.n + kind[1:]
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return self.keys[at] != key if len(self.keys) else np.ones(len(key), bool)


class Codec:
    """Encoder and decoder read from a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        self.pieces = [self.lib.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if self.lib.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        hidden = {i for i in range(n) if self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i)} | set(self.byte_of)
        self.hidden = hidden
        self.id_of = {p: i for i, p in enumerate(self.pieces) if i not in hidden}
        self.score = {p: -self.lib.get_score(i) for p, i in self.id_of.items()}
        self.unknown = self.lib.unk_id()
        self.borders = Borders(list(self.id_of)) if self.byte_id else None
        #: What the library is given before a unit that doesn't begin with a mark: a border lies behind it.
        self.lead = next(c for c in "\n\t\x01" if not any(c in p for p in self.id_of))
        self.lead_ids = len(self.lib.encode(self.lead))
        self.known: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def merge(self, unit: str) -> list[int]:
        """Ids of one unit by the agenda."""
        out: list[int] = []
        for s in self._merged(unit) if len(unit) > _SHORT else self._merged_short(unit):
            i = self.id_of.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in s.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _merged_short(self, unit: str) -> list[str]:
        """Few symbols: the agenda is a list that keeps the pairs' places."""
        get, none = self.score.get, _NONE
        sym = list(unit)
        agenda = [get(a + b, none) for a, b in zip(sym, sym[1:], strict=False)]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            sym[i : i + 2] = [sym[i] + sym[i + 1]]
            del agenda[i]
            if i:
                agenda[i - 1] = get(sym[i - 1] + sym[i], none)
            if i < len(agenda):
                agenda[i] = get(sym[i] + sym[i + 1], none)
        return sym

    def _merged(self, unit: str) -> list[str]:
        """Many symbols: the agenda is a heap over a linked list."""
        sym: list[str] = list(unit)
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        score = self.score
        agenda = [(score[p], i, i + 1, p) for i in range(n - 1) if (p := sym[i] + sym[i + 1]) in score]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, piece = heapq.heappop(agenda)
            if right[a] != b or sym[a] + sym[b] != piece or not sym[a]:
                continue
            sym[a], sym[b] = piece, ""
            c = right[a] = right[b]
            if c >= 0:
                left[c] = a
                if (p := piece + sym[c]) in score:
                    heapq.heappush(agenda, (score[p], a, c, p))
            z = left[a]
            if z >= 0 and (p := sym[z] + piece) in score:
                heapq.heappush(agenda, (score[p], z, a, p))
        return [s for s in sym if s]

    def cut_up(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The units of all texts one after the other, and where each text's begin (and the last's end)."""
        marked = pc.replace_substring(texts, " ", MARK)
        marked = pc.if_else(pc.equal(marked, ""), marked, pc.binary_join_element_wise(MARK, marked, ""))
        if isinstance(marked, pa.ChunkedArray):
            marked = marked.combine_chunks()
        edges = np.frombuffer(marked.buffers()[1], np.int32, len(marked) + 1, 4 * marked.offset)
        size = int(edges[-1])
        data = marked.buffers()[2]
        raw = np.frombuffer(data, np.uint8, size) if size else np.empty(0, np.uint8)
        begins = np.zeros(size, bool)
        begins[edges[:-1][edges[:-1] < size]] = True
        if self.borders is not None and size:
            place = np.flatnonzero((raw & 0xC0) != 0x80)  # of each character's first byte
            points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
            begins[place[1:][self.borders.between(points)]] = True
        starts = np.flatnonzero(begins)
        offsets = np.append(starts, size).astype(np.int32)
        units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), data) if size else pa.array([], pa.string())
        return units.dictionary_encode(), np.searchsorted(starts, edges)

    def units(self, text: str) -> list[str]:
        """Units of a text in order; joined they are the normalised text."""
        return self.cut_up(pa.array([text], pa.string()))[0].to_pylist()

    def learn(self, units: list[str]) -> list[tuple[str, int, str]]:
        """(ids, their number, decoded) of distinct units; those not yet known are encoded and checked against the library."""
        if len(self.known) > REMEMBER:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for u in units:
            if u not in known:
                if u in older:
                    known[u] = older[u]
                else:
                    new.append(u)
        # The library puts a mark in front itself: take a unit's first one off, lead up to a unit without one.
        asked = [u[1:].replace(MARK, " ") if u[0] == MARK else self.lead + u for u in new]
        theirs = self.lib.encode(asked, num_threads=1) if new else []
        pieces, plain = self.pieces, self.byte_of.keys() | {self.unknown}
        for u, ids in zip(new, theirs, strict=True):
            mine = self.merge(u)
            if mine != (ids if u[0] == MARK else ids[self.lead_ids :]) and u != MARK:  # the library makes nothing of an empty text
                raise ValueError(f"unit {u!r}: {mine} here, {ids} in sentencepiece")
            whole = plain.isdisjoint(mine)
            known[u] = ",".join(map(str, mine)), len(mine), "".join([pieces[i] for i in mine]).replace(MARK, " ") if whole else self.decode(mine, inside=True)
        return [known[u] for u in units]

    def encode(self, text: str) -> list[int]:
        return [i for u in self.units(text) for i in self.merge(u)]

    def decode(self, ids: list[int], inside: bool = False) -> str:
        """Pieces joined, marks as blanks without the first; runs of bytes as UTF-8, each bad byte as U+FFFD.

        ``inside``: the ids are from inside a text, so a first mark stays.
        """
        out: list[str] = []
        held: list[int] = []
        first = not inside

        def flush() -> None:
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()

        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            flush()
            if i in self.hidden:
                out.append(" ⁇ " if i == self.unknown else "")
            else:
                p = self.pieces[i]
                if first and not out and p.startswith(MARK):
                    p = p[1:]
                out.append(p.replace(MARK, " "))
            first = False
        flush()
        return "".join(out)


def _utf8(data: bytes) -> str:
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _joined(rows: pa.Array, units: np.ndarray, edges: np.ndarray, by: str) -> tuple[memoryview, list[int]]:
    """The members of each text's units as UTF-8, joined: all bytes, and the texts' borders in them."""
    out = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows.take(pa.array(units))), pa.scalar(by, pa.large_string()))
    return memoryview(out.buffers()[2] or b""), np.frombuffer(out.buffers()[1], np.int64, len(out) + 1).tolist()


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of bounded number and bytes, one row at least."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > begin and (held + n > CHUNK_BYTES or i - begin >= CHUNK_ROWS):
            yield begin, i
            begin, held = i, 0
        held += n
    if len(size) > begin:
        yield begin, len(size)


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for whole in batches:
        for begin, end in _slices(whole.column("text")):
            batch = whole.slice(begin, end - begin)
            texts = pc.fill_null(batch.column("text"), "")
            units, edges = c.cut_up(texts)
            got = c.learn(units.dictionary.to_pylist())
            at = units.indices.to_numpy()
            tokens = np.append(0, np.cumsum(np.array([g[1] for g in got], np.int64)[at]))[edges]
            ids, id_edges = _joined(pa.array([g[0] for g in got], pa.large_string()), at, edges, ",")
            back, back_edges = _joined(pa.array([g[2] for g in got], pa.large_string()), at, edges, "")
            # The mark in front of a text is no part of it: one byte, a blank, at each start.
            back_starts = [a + (b > a) for a, b in zip(back_edges, back_edges[1:], strict=False)]
            sha = lambda data, starts, ends: [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(starts, ends, strict=True)]
            for n in range(0, batch.num_rows, WHOLE):
                mine = [int(i) for i in bytes(ids[id_edges[n] : id_edges[n + 1]]).split(b",") if i]
                text = texts[n].as_py()
                if c.lib.encode(text, num_threads=1) != mine or c.lib.decode(mine).encode() != bytes(back[back_starts[n] : back_edges[n + 1]]):
                    raise ValueError("a document differs from sentencepiece")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(tokens)), pa.array(sha(ids, id_edges[:-1], id_edges[1:])), pa.array(sha(back, back_starts, back_edges[1:]))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def encode_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(partial(_digest, path=model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
