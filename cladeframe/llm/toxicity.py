"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.
Each holds the words that its class uses in significantly more contexts than
the other class, followed by the words common to both; a word is followed by
what it shares with no other, so texts without class words compress alike under
both.  (The library's own trainer picks whatever repeats, which both classes
share; dictionaries trained that way told the classes apart hardly better than
chance, so the contents are chosen here and given to zstandard as they are.)

A text is cut into windows of a few words.  Each window is compressed with both
dictionaries in two spellings: as plain text, where inflected forms of a known
word still match in part, and with each word as an 8-byte code, where only whole
words match.  The difference of the two lengths is a window's distance; the
largest and the mean positive distance of each spelling are calibrated to a
probability on labelled rows that the dictionaries have not seen.

Bounds: dictionaries and thresholds are fitted on at most ``TOXIC_SAMPLE`` toxic
and ``ORDINARY_SAMPLE`` ordinary labelled documents, chosen by a hash of doc_id, of
longer ones on a part of ``SAMPLE_LENGTH`` characters from a place that a hash chooses.
Every document is scored over its whole text.

Defined cases: null counts as empty; an empty text has no distance and gets the
score of that.  Without labels of both classes every score is 0.  A doc_id that
is labelled more than once counts as toxic if any label says so; rows with null
ids or labels teach nothing.  Repeated rows are scored each.  Neither labels,
lang, source nor doc_id enter a score.  Extra columns stay as they are; one named
like the score's (in any case of letters) is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.llm.common import crc_mod

TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_LENGTH = 4000, 8000, 20_000
#: Words a window, zstandard level, words common to both dictionaries.
WINDOW, LEVEL, COMMON = 8, 5, 3000
#: A class word: deviation in standard errors, times as frequent, contexts at least.
DEVIATION, RATIO, CONTEXTS = 4.5, 5.0, 4
_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased runs of ASCII letters and digits and of non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_BLANK).split()


def _spell_text(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def _spell_code(words: list[bytes]) -> bytes:
    return b"".join(map(xxhash.xxh64_digest, words))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _distinct(parts: Iterator[np.ndarray]) -> np.ndarray:
    """Sorted distinct values of many arrays, a million at a time."""
    found, held, size = np.empty(0, np.uint64), [], 0
    for x in parts:
        held.append(x)
        size += len(x)
        if size > 1 << 20:
            found, held, size = np.unique(np.concatenate([found, *held])), [], 0
    return np.unique(np.concatenate([found, *held]))


def contexts(texts: list[str], known: np.ndarray) -> np.ndarray:
    """Of each word, by its hash's place in ``known``, the distinct left neighbours (the begin of a text is one): copies of a passage add none."""

    def pairs(text: str) -> np.ndarray:
        at = np.searchsorted(known, _hashes(plain_words(text))).astype(np.uint64)
        return np.append(np.uint64(len(known)), at[:-1])[: len(at)] << np.uint64(32) | at

    held, times = [np.unique(pairs(x)) for x in texts], np.zeros(len(known), np.int64)
    # a sixteenth of the words at a time: a sort of all pairs takes several times their memory
    for part in range(16):
        found = np.unique(np.concatenate([np.empty(0, np.uint64), *(x[x & np.uint64(15) == part] for x in held)])) & np.uint64(0xFFFFFFFF)
        word, n = np.unique(found, return_counts=True)
        times[word.astype(np.int64)] = n
    return times


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """(toxic words, ordinary words, common words), the most telling last.

    Words are 64-bit hashes until it is known which ones count: a driver's memory then
    doesn't grow with the vocabulary's text.
    """
    known = _distinct(_hashes(plain_words(x)) for x in (*toxic, *ordinary))
    t, o = contexts(toxic, known), contexts(ordinary, known)
    nt, no, both = max(1, int(t.sum())), max(1, int(o.sum())), t + o
    z = np.zeros(len(known))
    some = np.flatnonzero(both >= CONTEXTS)
    p = both[some] / (nt + no)
    z[some] = (t[some] / nt - o[some] / no) / np.sqrt(p * (1 - p) * (1 / nt + 1 / no))
    mine = (z >= DEVIATION) & (t / nt >= RATIO * (o + 1) / no) & (t >= CONTEXTS)
    theirs = (z <= -DEVIATION) & (o / no >= RATIO * (t + 1) / nt) & (o >= CONTEXTS)
    rest = np.sort(both[~mine & ~theirs])
    common = ~mine & ~theirs & (both >= max(1, int(rest[-COMMON:].min(initial=np.iinfo(np.int64).max))))
    wanted, name = mine | theirs | common, {}
    for text in (*toxic, *ordinary):
        words = plain_words(text)
        at = np.searchsorted(known, _hashes(words))
        name.update((int(at[k]), words[k]) for k in np.flatnonzero(wanted[at]))
    listed = lambda which, value: [w for _, w in sorted((value(k), name[k]) for k in np.flatnonzero(which).tolist())]
    return listed(mine, lambda k: z[k]), listed(theirs, lambda k: -z[k]), listed(common, lambda k: both[k])[-COMMON:]


class Distances:
    """Compressors of both classes in both spellings."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes], common: list[bytes]):
        self.parts = toxic, ordinary, common
        self.pairs = None

    def __getstate__(self):
        return {"parts": self.parts, "pairs": None}

    def _open(self) -> None:
        import zstandard as z

        def compressor(content: bytes):
            # Below 8 bytes zstandard takes no dictionary content.
            d = z.ZstdCompressionDict(content.ljust(8), dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        toxic, ordinary, common = self.parts
        self.pairs = [(spell, compressor(spell(ordinary) + spell(common)), compressor(spell(toxic) + spell(common))) for spell in (_spell_code, _spell_text)]

    def features(self, words: list[bytes]) -> list[float]:
        """Largest and mean positive window distance of each spelling."""
        if self.pairs is None:
            self._open()
        out = []
        for spell, plain, toxic in self.pairs:
            d = [len(plain(x)) - len(toxic(x)) for x in (spell(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW))]
            out += [max(d), sum(v for v in d if v > 0) / len(d)] if d else [0.0, 0.0]
        return [max(0.0, out[0]), np.log1p(out[1]), max(0.0, out[2]), np.log1p(out[3])]


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Logistic weights, the constant last (Newton's method)."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = ridge * np.append(np.ones(x.shape[1] - 1), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], toxic: list[int]) -> tuple[Distances, np.ndarray] | None:
    """Dictionaries from two thirds of a sample, thresholds from the rest."""
    y = np.array(toxic, float)
    if not (0 < y.sum() < len(y)):
        return None
    learn = np.arange(len(y)) % 3 != 2
    of = lambda kind: [t for t, k, v in zip(texts, learn, y, strict=True) if k and v == kind]
    model = Distances(*train_dictionaries(of(1), of(0)))
    rest = np.flatnonzero(~learn) if 0 < y[~learn].sum() < (~learn).sum() else np.arange(len(y))
    x = np.array([model.features(plain_words(texts[i])) for i in rest])
    return model, calibrate(x, y[rest])


def _score(batches: Iterator[pa.RecordBatch], model: tuple[Distances, np.ndarray] | None, text: int, into: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            batch = whole.slice(k, 256)
            if model is None:
                score = np.zeros(batch.num_rows)
            else:
                x = np.array([model[0].features(plain_words(t)) for t in batch.column(text).to_pylist()])
                score = 1 / (1 + np.exp(-np.clip(x @ model[1][:-1] + model[1][-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, into])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Distances, np.ndarray] | None:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0, within the sample bounds; ``labels`` has doc_id and toxic."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(crc_mod("doc_id", 5) != 0)
    text = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    # of a longer text a part teaches, from a place that a hash chooses
    over = F.greatest(F.length("text") - SAMPLE_LENGTH, F.lit(0))
    part = F.substring(F.col("text"), F.pmod(F.xxhash64("doc_id"), over + 1).cast("int") + 1, F.lit(SAMPLE_LENGTH))
    fair = known.join(text.select("doc_id"), "doc_id", "left_semi")
    pick = lambda k, n: fair.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = pick(1, TOXIC_SAMPLE).unionByName(pick(0, ORDINARY_SAMPLE))
    # Repeated rows of an id count once: the text that comes first.
    rows = text.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", part.alias("text")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), r["doc_id"]))
    return fit([r["text"] for r in rows], [int(r["toxic"]) for r in rows])


def score_column(docs: DataFrame, model: tuple[Distances, np.ndarray] | None, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` and the score of each row's ``text_col`` as a further column ``into``."""
    if not isinstance(docs.schema[text_col].dataType, T.StringType):
        docs = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    names = [c for c in docs.columns if c.lower() != into.lower()]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.DoubleType())])
    return rows.mapInArrow(partial(_score, model=model, text=names.index(text_col), into=into), schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    scored = score_column(rows, train(docs, labels, id_col, text_col))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
