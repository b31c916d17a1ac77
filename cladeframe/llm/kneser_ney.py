"""Language-model scores: an interpolated modified Kneser-Ney n-gram model of any order from two.

Tokens are A-Z lower-cased words and one end after each text; before a text stand as
many starts as a context is long.  Words are 64-bit hashes throughout.

Counting, in Spark.  Tasks count the n-grams of bounded chunks of training texts with
numpy and send sorted arrays, a packed block per shard of the hash space, instead of
a row per n-gram; the task that owns a shard merges the blocks.  First words, whose
counts also tell which are frequent.  Then the longest n-grams, by context; a merged
shard tells how many distinct words stand before each shorter n-gram, and these
counts are the blocks of the next level, down to words.  A context is no more
frequent than any of its words: if all of them are frequent, its n-grams are dealt
over several shards by their last word, and the figures of its parts are added up in
one step more.

The model is a set of files in the folder that the cluster shares, per level and
shard the sorted hashes and, in the same order, their figures.  Workers map them into
memory and search only the shards that a batch needs; no worker, and never the
driver, holds the model.  The driver keeps totals and one row for each frequent word
(at most 4 for a shard).  A shard without n-grams has empty files, so a file that a
worker does not find is an error and never counts as unknown words.

  P(w|uv) = (c(uvw) - D(c(uvw))) / c(uv) + g(uv) P(w|v)
  P(w|v)  = (n(vw) - D'(n(vw))) / n(v) + g'(v) P(w)
  P(w)    = (n(w) - D"(n(w))) / n + g" / (V + 1)

c: counts, at the highest level; n(vw): distinct words before vw, n(v): their sum
over w; D: the modified discounts for counts of 1, 2 and more, from a level's counts
of counts; g: the mass they free, one where the context is unknown.  The one word
more in V + 1 is the unknown word, so each distribution sums to one over V words and
it.

Defined cases: null counts as empty: a text of one token, its end.  Rows with null
or repeated doc_ids are rows like others (the remainder of a null id is that of the
empty text).  Without training rows every word is unknown and has probability one.
Extra columns are not read.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import GOLDEN, WordHashes, crc_mod, cut, mix64, runs_of, words_of
from cladeframe.operators.components import shared_folder

#: No word contains a blank, so these are no words.
START, END = xxhash.xxh64_intdigest(b" start"), xxhash.xxh64_intdigest(b" end")
#: Characters of text for each shard, and the least number of shards.
SHARD_CHARS, LEAST_SHARDS = 16_000_000, 16
#: Tasks that the shards are dealt to at most.
MOST_TASKS = 50_000
#: Tokens that a task counts or looks up at once.
CHUNK = 1_500_000


class Frequent(NamedTuple):
    """Frequent words, ascending, their counts, and the count that a shard should not exceed."""

    words: np.ndarray
    counts: np.ndarray
    share: float

    def parts(self, before: list[np.ndarray]) -> np.ndarray:
        """Over how many shards each context is dealt: its rarest word decides."""
        out = np.full(len(before[0]), np.inf)
        if not len(self.words):
            return np.ones(len(out), np.uint64)
        for v in before:
            at = np.minimum(np.searchsorted(self.words, v), len(self.words) - 1)
            out = np.minimum(out, np.where(self.words[at] == v, self.counts[at], 0))
        return np.maximum(1, np.ceil(out / self.share)).astype(np.uint64)


class Model(NamedTuple):
    """What the driver keeps of a model; the arrays are in ``folder``.

    ``cuts`` holds the discounts of each level from words up, ``pairs`` the sum of
    the words' figures, ``left`` the mass that the word level leaves.
    """

    folder: str
    shards: int
    order: int
    tokens: int
    words: int
    pairs: int
    cuts: tuple[tuple[float, float, float], ...]
    left: float
    frequent: Frequent

    def remove(self) -> None:
        """Delete the model's files; scores that were not computed yet are lost."""
        shutil.rmtree(self.folder)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(v * GOLDEN + w)


def context_key(before: list[np.ndarray]) -> np.ndarray:
    """Hash of a context; its words are given from the nearest to the farthest."""
    out = before[0]
    for v in before[1:]:
        out = pair_key(v, out)
    return out


def _gram_shard(before: list[np.ndarray], context: np.ndarray, w: np.ndarray, shards: int, frequent: Frequent) -> np.ndarray:
    """An n-gram's shard: by its context, if that is frequent by a part of the last word's hash as well."""
    parts = frequent.parts(before)
    part = (w >> np.uint64(32)) * parts >> np.uint64(32)
    return shard_of(np.where(parts > 1, pair_key(context, part), context), shards)


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[np.ndarray]:
    """Hashes of whole texts, each followed by END, in arrays of about ``most`` tokens."""
    hashes, held, n = WordHashes(), [], 0
    end = np.array([END], np.uint64)
    for batch in batches:
        for text in batch.column("text"):
            held += [hashes.of(words_of(text.as_py())), end]
            n += len(held[-2]) + 1
            if n >= most:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def _contexts(w: np.ndarray, n: int) -> list[np.ndarray]:
    """For every token the ``n`` words before it, the nearest first."""
    first = np.append(True, w[:-1] == np.uint64(END))
    out = [w]
    for _ in range(n):
        v = np.roll(out[-1], 1)
        v[first] = START
        out.append(v)
    return out[1:]


def _packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(arrays), *[len(a) for a in arrays]], np.int64).tobytes() + bytes(a.dtype.itemsize for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpacked(block: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    size, out = np.frombuffer(data, np.int64, n, 8), []
    at = 8 + 8 * n + n
    for k, width in zip(size.tolist(), data[8 + 8 * n : at], strict=True):
        out.append(np.frombuffer(data, {1: np.uint8, 4: np.uint32, 8: np.uint64}[width], k, at))
        at += k * width
    return out


def _narrow(counts: np.ndarray) -> np.ndarray:
    top = counts.max() if len(counts) else 0
    return counts.astype(np.uint8 if top < 256 else np.uint32 if top < 2**32 else np.uint64)


def _blocks(shard: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    """A packed block per shard of arrays that are sorted by it."""
    edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.empty(0, np.int64)
    ends = np.append(edges[1:], len(shard))[: len(edges)]
    out = [_packed(*[_narrow(a[i:j]) if k else a[i:j] for k, a in enumerate(arrays)]) for i, j in zip(edges, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(shard[edges], pa.int64()), pa.array(out, pa.binary())], ["shard", "block"])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order].astype(np.uint64), first) if len(keys) else counts.astype(np.uint64)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all, so a second attempt of a task may write it again."""
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, f"{folder}/{name}.npy")


@lru_cache(maxsize=4096)
def _map(folder: str, name: str) -> np.ndarray:
    """Every shard has its files, be they empty: one that is not there is an error, not a shard without words."""
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")


def _of_blocks(blocks: list[bytes | None], columns: int) -> list[list[np.ndarray]]:
    """The blocks' arrays, column by column; a null block has none."""
    parts = [_unpacked(b) for b in blocks if b is not None]
    return [[np.empty(0, np.uint64), *(p[k] for p in parts)] for k in range(columns)]


def _count_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for w in _texts(batches, CHUNK):
        word, n = np.unique(w, return_counts=True)
        yield _blocks(shard_of(word, shards), word, n)


def _merge_words(batches: Iterator[pa.RecordBatch], folder: str, shards: int) -> Iterator[pa.RecordBatch]:
    for run in runs_of(batches, "shard"):
        words, counts = _of_blocks(run["block"], 2)
        word, n = _summed(np.concatenate(words), np.concatenate(counts))
        s = run["shard"][0]
        _save(folder, f"word-{s}", word)
        _save(folder, f"word-count-{s}", n)
        # Only a word with this share of its own shard can have it of the whole.
        often = np.flatnonzero(n.astype(np.float64) * 4 * shards > n.sum())
        ends = int(n[word == np.uint64(END)].sum())
        yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([len(word)]), pa.array([ends]), pa.array([word[often].view(np.int64)]), pa.array([n[often].astype(np.int64)])], ["tokens", "words", "ends", "often", "times"])


def _gram_blocks(before: list[np.ndarray], w: np.ndarray, n: np.ndarray, shards: int, frequent: Frequent) -> pa.RecordBatch:
    """A packed block per shard: the contexts' words, how many n-grams each has, last words, counts."""
    context = context_key(before)
    shard = _gram_shard(before, context, w, shards, frequent)
    order = np.lexsort((context, shard))
    shard, context = shard[order], context[order]
    change = np.append(True, shard[1:] != shard[:-1])[: len(w)]
    edges = np.append(np.flatnonzero(change), len(w))
    runs = np.flatnonzero(change | np.append(True, context[1:] != context[:-1])[: len(w)])
    length = np.diff(np.append(runs, len(w)))
    at = np.searchsorted(runs, edges)
    before, w, n = [v[order[runs]] for v in before], w[order], n[order]
    out = [_packed(*[v[p:q] for v in before], _narrow(length[p:q]), w[i:j], _narrow(n[i:j])) for i, j, p, q in zip(edges, edges[1:], at, at[1:])]  # noqa: B905
    return pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]], pa.int64()), pa.array(out, pa.binary())], ["shard", "block"])


def _count_grams(batches: Iterator[pa.RecordBatch], order: int, shards: int, frequent: Frequent) -> Iterator[pa.RecordBatch]:
    for w in _texts(batches, CHUNK):
        before = _contexts(w, order - 1)
        _, first, n = np.unique(pair_key(context_key(before), w), return_index=True, return_counts=True)
        yield _gram_blocks([v[first] for v in before], w[first], n, shards, frequent)


def _merge_grams(batches: Iterator[pa.RecordBatch], level: int, folder: str, shards: int, frequent: Frequent) -> Iterator[pa.RecordBatch]:
    """Files of a shard of n-grams of ``level`` words; rows: blocks of the level below, blocks of split contexts, one row of counts of counts."""

    def rows(kind: str, shard: pa.Array, block: pa.Array, of: list | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(shard), pa.string()), shard, block, pa.array([of] * len(shard), pa.list_(pa.int64()))], ["kind", "shard", "block", "of"])

    for run in runs_of(batches, "shard"):
        *contexts, length, words, counts = _of_blocks(run["block"], level + 2)
        s = run["shard"][0]
        length = np.concatenate(length).astype(np.int64)
        before = [np.repeat(np.concatenate(c), length) for c in contexts]
        w, n = np.concatenate(words), np.concatenate(counts).astype(np.uint64)
        key = pair_key(context_key(before), w)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
        key, n = key[first], np.add.reduceat(n, first) if len(n) else n
        before, w = [v[order[first]] for v in before], w[order[first]]
        _save(folder, f"gram-{level}-{s}", key)
        _save(folder, f"gram-count-{level}-{s}", _narrow(n))
        context = context_key(before)
        order = np.argsort(context, kind="stable")
        context, at = np.unique(context[order], return_index=True)
        each = lambda x: np.add.reduceat(x[order].astype(np.uint64), at) if len(at) else np.empty(0, np.uint64)  # noqa: B023, E731
        figures = np.stack([each(n), each(n == 1), each(n == 2), each(n > 2)])
        split = frequent.parts([v[order[at]] for v in before]) > 1
        _save(folder, f"context-{level}-{s}", context[~split])
        _save(folder, f"context-figures-{level}-{s}", np.stack([_narrow(x) for x in figures[:, ~split]]))
        if level > 2:
            _, first, found = np.unique(pair_key(context_key(before[:-1]), w), return_index=True, return_counts=True)
            below = _gram_blocks([v[first] for v in before[:-1]], w[first], found, shards, frequent)
        else:
            word, found = np.unique(w, return_counts=True)
            below = _blocks(shard_of(word, shards), word, found)
        yield rows("below", below.column(0), below.column(1))
        if split.any():
            parts = _blocks(shard_of(context[split], shards), context[split], *figures[:, split])
            yield rows("split", parts.column(0), parts.column(1))
        yield rows("figures", pa.array([s]), pa.array([None], pa.binary()), [int((n == k).sum()) for k in (1, 2, 3, 4)])


def _merge_split(batches: Iterator[pa.RecordBatch], level: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Files of the contexts that were dealt over several shards, with the sums of their parts."""
    for run in runs_of(batches, "shard"):
        contexts, *figures = (np.concatenate(x) for x in _of_blocks(run["block"], 5))
        summed = [_summed(contexts, x) for x in figures]
        s = run["shard"][0]
        _save(folder, f"split-{level}-{s}", summed[0][0])
        _save(folder, f"split-figures-{level}-{s}", np.stack([x for _, x in summed]))
        yield pa.RecordBatch.from_arrays([pa.array([len(summed[0][0])])], ["contexts"])


def _merge_contexts(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for run in runs_of(batches, "shard"):
        words, counts = _of_blocks(run["block"], 2)
        word, n = _summed(np.concatenate(words), np.concatenate(counts))
        s = run["shard"][0]
        mine = _map(folder, f"word-{s}")
        contexts = np.zeros(len(mine), np.uint64)
        contexts[np.searchsorted(mine, word)] = n
        _save(folder, f"word-contexts-{s}", _narrow(contexts))
        yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), *[pa.array([int((n == k).sum())]) for k in (1, 2, 3, 4)], pa.array([int((n > 2).sum())])], ["pairs", "n1", "n2", "n3", "n4", "more"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified discounts of counts 1, 2 and above; a half of the least count where counts of counts are missing."""
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.01), k - 0.01) for x, k in zip(d, (1, 2, 3), strict=True))  # type: ignore[return-value]


def local_folder(spark, kind: str = "ngrams") -> str:
    """A new folder in the shared one, as the path under which every worker sees it."""
    at = urlsplit(shared_folder(spark))
    if at.scheme not in ("", "file"):
        raise ValueError("the files are mapped into memory: spark.checkpoint.dir has to be a mounted folder (file:)")
    path = f"{at.path}/{kind}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _discard(frame: DataFrame) -> None:
    """Delete what ``cut`` wrote: it is in the folder that has to be mounted."""
    for folder in {os.path.dirname(urlsplit(f).path) for f in frame.inputFiles()}:
        shutil.rmtree(unquote(folder))


def train(texts: DataFrame, characters: int, order: int = 2) -> Model:
    """Count the ``text`` column into files; ``characters`` decides the number of shards."""
    if order < 2:
        raise ValueError("the order has to be two or more")
    spark = texts.sparkSession
    folder = local_folder(spark)
    shards = max(LEAST_SHARDS, -(-characters // SHARD_CHARS))
    block = "shard long, block binary"

    def by_shard(blocks: DataFrame) -> DataFrame:
        """All blocks of a shard in one run, one run for each shard: those without blocks get a null one."""
        every = spark.range(shards, numPartitions=1).selectExpr("id AS shard", "CAST(NULL AS BINARY) AS block")
        # by number, as hashes of few shards would put several into one task
        tasks = min(shards, MOST_TASKS)
        return blocks.select("shard", "block").unionByName(every).repartitionById(tasks, (F.col("shard") % tasks).cast("int")).sortWithinPartitions("shard")

    words = by_shard(texts.mapInArrow(partial(_count_words, shards=shards), block))
    words = cut(words.mapInArrow(partial(_merge_words, folder=folder, shards=shards), "tokens long, words long, ends long, often array<long>, times array<long>"), "words")
    tokens, n_words, starts = (x or 0 for x in words.agg(F.sum("tokens"), F.sum("words"), F.sum("ends")).first())
    share = max(1.0, tokens / (4 * shards))
    rows = words.select(F.inline(F.arrays_zip("often", "times"))).where(F.col("times") > share).collect()
    often = {r["often"] % 2**64: r["times"] for r in rows}
    often.pop(END, None)
    if starts > share:
        often[START] = starts
    frequent = Frequent(np.array(sorted(often), np.uint64), np.array([often[w] for w in sorted(often)], np.float64), share)
    blocks = texts.mapInArrow(partial(_count_grams, order=order, shards=shards, frequent=frequent), block)
    cuts, used = [], [words]
    for level in range(order, 1, -1):
        merge = partial(_merge_grams, level=level, folder=folder, shards=shards, frequent=frequent)
        merged = cut(by_shard(blocks).mapInArrow(merge, f"kind string, {block}, of array<long>"), f"grams-{level}")
        figures = merged.where("kind = 'figures'").agg(*[F.sum(F.get("of", F.lit(k))) for k in range(4)]).first()
        cuts.append(discounts(*(x or 0 for x in figures)))
        if often:
            by_shard(merged.where("kind = 'split'")).mapInArrow(partial(_merge_split, level=level, folder=folder), "contexts long").agg(F.sum("contexts")).first()
        blocks = merged.where("kind = 'below'")
        used.append(merged)
    low = by_shard(blocks).mapInArrow(partial(_merge_contexts, folder=folder), "pairs long, n1 long, n2 long, n3 long, n4 long, more long")
    pairs, *m, more = (x or 0 for x in low.agg(*[F.sum(c) for c in ("pairs", "n1", "n2", "n3", "n4", "more")]).first())
    for frame in used:
        _discard(frame)
    cuts.append(discounts(*m))
    left = (cuts[-1][0] * m[0] + cuts[-1][1] * m[1] + cuts[-1][2] * more) / pairs if pairs else 1.0
    return Model(folder, shards, order, tokens, n_words, pairs, tuple(reversed(cuts)), left, frequent)


def _find(folder: str, name: str, s: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, found) of ascending keys in a shard's sorted file."""
    have = _map(folder, f"{name}-{s}")
    if not len(have):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return at, have[at] == keys


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.append(True, shard[order][1:] != shard[order][:-1])[: len(shard)])
    for i, j in zip(edges, np.append(edges[1:], len(order)), strict=False):
        yield int(shard[order[i]]), order[i:j]


def _discounted(n: np.ndarray, cuts: tuple[float, float, float]) -> np.ndarray:
    return n - np.array([0.0, *cuts])[np.minimum(n, 3).astype(np.int64)]


def word_figures(model: Model, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, P(w)) of ascending distinct words."""
    count, contexts = np.zeros(len(word)), np.zeros(len(word))
    for s, rows in _by_shard(shard_of(word, model.shards)):
        at, ok = _find(model.folder, "word", s, word[rows])
        if ok.any():
            count[rows[ok]] = _map(model.folder, f"word-count-{s}")[at[ok]]
            contexts[rows[ok]] = _map(model.folder, f"word-contexts-{s}")[at[ok]]
    return count, _discounted(contexts, model.cuts[0]) / max(1, model.pairs) + model.left / (model.words + 1)


def context_figures(model: Model, before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(count, mass left to the level below) of contexts in ascending order of their keys."""
    level, context = len(before) + 1, context_key(before)
    total, left = np.zeros(len(context)), np.ones(len(context))
    split = model.frequent.parts(before) > 1
    for name, of in (("context", ~split), ("split", split)):
        these = np.flatnonzero(of)
        for s, rows in _by_shard(shard_of(context[these], model.shards)):
            rows = these[rows]
            at, ok = _find(model.folder, f"{name}-{level}", s, context[rows])
            if ok.any():
                all_, *few = _map(model.folder, f"{name}-figures-{level}-{s}")[:, at[ok]].astype(np.float64)
                total[rows[ok]], left[rows[ok]] = all_, np.array(model.cuts[level - 1]) @ np.array(few) / all_
    return total, left


def gram_counts(model: Model, before: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    """Figures of n-grams in ascending order of their keys."""
    level, context = len(before) + 1, context_key(before)
    key, out = pair_key(context, w), np.zeros(len(w))
    for s, rows in _by_shard(_gram_shard(before, context, w, model.shards, model.frequent)):
        at, ok = _find(model.folder, f"gram-{level}", s, key[rows])
        if ok.any():
            out[rows[ok]] = _map(model.folder, f"gram-count-{level}-{s}")[at[ok]]
    return out


def log_probabilities(model: Model, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(training count, log10 of the probability) of each token of texts that END closes."""
    word, of_word = np.unique(w, return_inverse=True)
    count, p = (x[of_word] for x in word_figures(model, word))
    before = _contexts(w, model.order - 1)
    for level in range(2, model.order + 1):
        near = before[: level - 1]
        context = context_key(near)
        _, first, of_context = np.unique(context, return_index=True, return_inverse=True)
        total, left = (x[of_context] for x in context_figures(model, [v[first] for v in near]))
        _, first, of_gram = np.unique(pair_key(context, w), return_index=True, return_inverse=True)
        n = gram_counts(model, [v[first] for v in near], w[first])[of_gram]
        p = _discounted(n, model.cuts[level - 1]) / np.maximum(total, 1) + left * p
    return count, np.log10(p)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        size = np.array([len(h[2]) for h in held])
        count, logs = log_probabilities(model, np.concatenate([h[2] for h in held]))
        at = np.append(0, np.cumsum(size)[:-1])
        base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
        columns = [np.add.reduceat(x, at) for x in ((count > 0).astype(np.int64), base, logs)]
        out = [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.bool_()), pa.array(size.astype(np.int64)), pa.array(columns[0])]
        out += [pa.array(np.full(len(held), model.tokens)), pa.array(columns[1]), pa.array(columns[2])]
        held.clear()
        return pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    n = 0
    for batch in batches:
        for doc, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text"), strict=True):
            tokens = np.append(hashes.of(words_of(text.as_py())), np.uint64(END))
            held.append((doc, out, tokens))
            n += len(tokens)
            if n >= CHUNK // 2:
                yield flush()
                n = 0
    if held:
        yield flush()


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, order: int = 2) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("held_out", crc_mod("doc_id", folds) == 0)
    characters = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = train(rows.where("NOT held_out").select("text"), characters, order)
    return rows.mapInArrow(partial(_score, model=model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
