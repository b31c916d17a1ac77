"""Near-duplicate documents: SuperMinHash signatures, banding, verification.

1. A-Z lower-cased words, distinct shingles of ``width`` words as 64-bit hashes.
   Documents with equal sets are one class; everything below works on classes.
2. SuperMinHash: element e draws, for j = 0, 1, ..., a rank in [j, j+1) and the
   j-th entry of a random permutation of the slots.  A slot keeps its smallest
   rank.  Once all slots of a document hold ranks below j+1 nothing later can
   lower them: the early stop.
3. Bands of ``rows`` ranks are hashed; classes that share a band key are
   candidates.  Each bucket links its members to its smallest class only, and
   the components of those links are families: no bucket emits pairs.
4. Verification inside families on the full sets.  A family of moderate size
   is one group: an inverted index counts intersections, and only classes that
   the largest component has not taken yet are compared with all others.  A
   large family is dealt in blocks of bounded classes and shingles: first each
   member against one centre, then the blocks of those left over against all
   blocks.  Nothing is capped.
5. Union-find: components of the confirmed links; smallest doc_id names them.

Defined cases: null or empty text, or one without words, has no shingles, is
linked with nothing and is its own component.  Rows that repeat a doc_id are
kept as rows of their own.  A null doc_id can't name a component: such a row
gets its class's component if another row names it, else null.  Extra columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.bloom import narrowed
from cladeframe.llm.common import GOLDEN, WordHashes, cut, mix64, runs_of, shingle_set, words_of
from cladeframe.operators.components import connected_components

#: A family goes to one task up to this many classes and shingles in all.
FAMILY_CLASSES, FAMILY_SHINGLES = 1024, 2_000_000
#: Block sizes for larger families, left-over by all: classes, and shingles, whichever are reached first.
LEFT_BLOCK, RIGHT_BLOCK = 512, 2048
LEFT_SHINGLES, RIGHT_SHINGLES = 500_000, 1_000_000
_SLICE = 32_768
_ONE = np.uint64(1)


def bands_for(threshold: float, miss: float = 1e-5, longest: int = 256) -> tuple[int, int]:
    """(bands, rows): most rows a band, while a pair right at the threshold is missed with probability ``miss`` at most."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
        if bands * rows <= longest:
            return bands, rows
    raise ValueError("no banding reaches this threshold")


def superminhash(elements: np.ndarray, owner: np.ndarray, n: int, slots: int) -> np.ndarray:
    """Signatures (n, slots) of n sets; ``owner[i]`` is the set of ``elements[i]``."""
    h = np.full((n, slots), np.inf)
    flat = h.reshape(-1)
    kind = np.uint8 if slots <= 256 else np.uint32
    perm = np.broadcast_to(np.arange(slots, dtype=kind), (len(elements), slots)).copy()
    at = np.arange(len(elements))
    base = owner.astype(np.int64) * slots
    for j in range(slots):
        with np.errstate(over="ignore"):
            draw = mix64(elements + GOLDEN * np.uint64(2 * j + 1))
            turn = mix64(draw ^ np.uint64(0x5851F42D4C957F2D))
        pick = (j + turn % np.uint64(slots - j)).astype(np.int64)
        slot = perm[at, pick]
        perm[at, pick] = perm[at, j]
        np.minimum.at(flat, base + slot, (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + j)
        full = h.max(axis=1) < j + 1
        if full.all():
            break
        live = ~full[base // slots]
        if live.sum() < 0.75 * len(live):
            elements, base, perm = elements[live], base[live], perm[live]
            at = np.arange(len(elements))
    return h


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures of many non-empty sets, in slices that bound memory.

    A set is cut where a slice ends; the minimum of the parts' signatures is
    the signature of the whole.
    """
    out = np.full((len(sets), slots), np.inf)
    todo: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        ids, first = np.unique([i for i, _ in todo], return_inverse=True)
        owner = np.repeat(first, [len(s) for _, s in todo])
        got = superminhash(np.concatenate([s for _, s in todo]), owner, len(ids), slots)
        out[ids] = np.minimum(out[ids], got)
        todo.clear()
        size = 0

    for i, s in enumerate(sets):
        for k in range(0, len(s), _SLICE):
            todo.append((i, s[k : k + _SLICE]))
            size += len(todo[-1][1])
            if size >= _SLICE:
                flush()
    if todo:
        flush()
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) 64-bit keys; a key mixes the band's number with its ranks."""
    raw = np.ascontiguousarray(sig[:, : bands * rows]).view(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN), raw.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix64(key * GOLDEN + raw[:, :, r])
    return key


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sketch(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            batch = whole.slice(k, 256)
            sets = [shingle_set(hashes.of(words_of(t)), width) for t in batch.column("text").to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            band: list = [None] * len(sets)
            if some:
                got = band_keys(signatures([sets[i] for i in some], bands * rows), bands, rows).view(np.int64)
                for i, b in zip(some, got, strict=True):
                    keys[i], band[i] = set_key(sets[i]), b
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(band, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )


class _Index:
    """Inverted index of a block of sets: counts its intersections with a set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        self.tokens, self.start = np.unique(tokens[order], return_index=True)
        self.stop = np.append(self.start[1:], len(tokens))

    def linked(self, s: np.ndarray, share: Fraction) -> np.ndarray:
        """Positions of the sets with intersection / union >= share."""
        at = np.searchsorted(self.tokens, s)
        inside = at < len(self.tokens)
        at, s_in = at[inside], s[inside]
        at = at[self.tokens[at] == s_in]
        count = self.stop[at] - self.start[at]
        offset = np.repeat(self.start[at] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        both = np.bincount(self.owner[offset], minlength=len(self.sizes))
        union = self.sizes + len(s) - both
        return np.flatnonzero((both > 0) & (share.denominator * both >= share.numerator * union))


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def family_links(sets: list[np.ndarray], share: Fraction) -> list[tuple[int, int]]:
    """Links that give a family's components: a spanning set of the confirmed ones."""
    if len(sets) == 1:
        return []
    index = _Index(sets)
    parent = list(range(len(sets)))
    out = []

    def compare(i: int) -> None:
        for j in index.linked(sets[i], share).tolist():
            a, b = _root(parent, i), _root(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))

    compare(0)
    main = _root(parent, 0)
    for i in range(1, len(sets)):
        if _root(parent, i) != main:
            compare(i)
            main = _root(parent, 0)
    return out


def _load(ids: list[int], keys: list[bytes], texts: list[str], width: int, hashes: WordHashes) -> tuple[list[int], list[np.ndarray]]:
    """Sets of the rows whose text really has the class's key; one row a class."""
    seen, who, sets = set(), [], []
    for i, k, t in zip(ids, keys, texts, strict=True):
        if k not in seen and set_key(s := shingle_set(hashes.of(words_of(t)), width)) == k:
            seen.add(k)
            who.append(i)
            sets.append(s)
    return who, sets


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["src", "dst"])


def _whole_families(batches: Iterator[pa.RecordBatch], width: int, share: Fraction) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for run in runs_of(batches, "family"):
        who, sets = _load(run["rep"], run["set_key"], run["text"], width, hashes)
        order = np.argsort(who)
        who, sets = [who[i] for i in order], [sets[i] for i in order]
        if sets:
            yield _edges([(who[i], who[j]) for i, j in family_links(sets, share)])


def _against_centre(batches: Iterator[pa.RecordBatch], width: int, share: Fraction) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    last: tuple[str, _Index] | None = None
    for batch in batches:
        rows = batch.to_pydict()
        keep, near = [], []
        for i in range(batch.num_rows):
            who, sets = _load(rows["rep"][i : i + 1], rows["set_key"][i : i + 1], rows["text"][i : i + 1], width, hashes)
            if not who:
                continue
            if last is None or last[0] != rows["centre_text"][i]:
                last = rows["centre_text"][i], _Index([shingle_set(hashes.of(words_of(rows["centre_text"][i])), width)])
            keep.append(i)
            near.append(len(last[1].linked(sets[0], share)) > 0)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("family", "rep", "centre", "set_key", "n_shingles")] + [pa.array(near, pa.bool_())], ["family", "rep", "centre", "set_key", "n_shingles", "near"])


def _blocks(batches: Iterator[pa.RecordBatch], width: int, share: Fraction) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for run in runs_of(batches, "block"):
        rows = list(zip(run["side"], run["rep"], run["set_key"], run["text"], strict=True))
        part = lambda side: _load(*([r[k] for r in rows if r[0] == side] for k in (1, 2, 3)), width, hashes)  # noqa: B023, E731
        left, right = part(0), part(1)
        index, found, parent = _Index(right[1]), [], {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:  # noqa: B023
                parent[x] = parent[parent[x]]  # noqa: B023
                x = parent[x]  # noqa: B023
            return x

        for i, s in zip(*left, strict=True):
            for j in index.linked(s, share).tolist():
                a, b = root(i), root(right[0][j])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((i, right[0][j]))
        if found:
            yield _edges(found)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts whose shingle sets have 100 * intersection >= percent * union are
    linked; see the module for the method and the defined cases.
    """
    share = Fraction(percent, 100)
    bands, rows = bands_for(percent / 100)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = cut(texts.mapInArrow(partial(_sketch, width=width, bands=bands, rows=rows), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "sketch")
    classes = cut(sketch.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    named = classes.where("rep IS NOT NULL")
    one = sketch.join(named.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key"])
    band = one.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    bucket = band.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("key", "first")
    star = band.join(bucket, "key").where("rep <> first").select("rep", "first").distinct()
    family = connected_components(star, "rep", "first").select(F.col("id").alias("rep"), F.col("component").alias("family"))
    size = sketch.select(F.col("doc_id").alias("rep"), "set_key", "n_shingles").dropDuplicates(["rep", "set_key"])
    family = cut(family.join(named, "rep").join(size, ["rep", "set_key"]), "families")
    sizes = family.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.min("rep").alias("centre"))
    large = (F.col("n") > FAMILY_CLASSES) | (F.col("s") > FAMILY_SHINGLES)
    member = family.join(sizes.withColumn("large", large & (F.col("n") > 2)), "family").select("family", "rep", "set_key", "n_shingles", "centre", "large")
    # most texts are in no family: a filter of the families' ids keeps them out of the join
    wanted = narrowed(texts.withColumnRenamed("doc_id", "rep"), "rep", family.select("rep"))
    member = cut(member.join(wanted.hint("merge"), "rep"), "members")
    whole = (
        member.where("NOT large").select("family", "rep", "set_key", "text").repartition("family").sortWithinPartitions("family")
        .mapInArrow(partial(_whole_families, width=width, share=share), "src long, dst long")
    )
    links = whole.unionByName(_large_family_links(member.where("large"), width, share))
    comp = connected_components(cut(links, "links")).select(F.col("id").alias("rep"), "component")
    named = classes.join(comp, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("named"))
    out = sketch.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("named")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _large_family_links(member: DataFrame, width: int, share: Fraction) -> DataFrame:
    """Links inside families too large for one task, by blocks."""
    if member.isEmpty():
        return member.select(F.col("rep").alias("src"), F.col("rep").alias("dst"))
    centre = member.where("rep = centre").dropDuplicates(["family"]).select("family", F.col("text").alias("centre_text"))
    near = member.where("rep <> centre").join(centre, "family").select("family", "rep", "centre", "set_key", "n_shingles", "text", "centre_text")
    near = cut(near.mapInArrow(partial(_against_centre, width=width, share=share), "family long, rep long, centre long, set_key binary, n_shingles long, near boolean"), "near")
    star = near.where("near").select(F.col("rep").alias("src"), F.col("centre").alias("dst"))
    far = ~F.col("near")
    count = near.groupBy("family").agg(F.count("*").alias("n"), F.count_if(far).alias("left"), F.sum("n_shingles").alias("all_s"), F.sum(F.when(far, F.col("n_shingles"))).alias("left_s"))
    parts = lambda n, of_n, s, of_s: F.greatest(F.ceil(n / of_n), F.ceil(F.col(s) / of_s)).cast("int")
    blocks = count.where("left > 0").select("family", parts(F.col("left"), LEFT_BLOCK, "left_s", LEFT_SHINGLES).alias("nl"), parts(F.col("n") + 1, RIGHT_BLOCK, "all_s", RIGHT_SHINGLES).alias("nr"))
    slot = lambda n: F.pmod(F.xxhash64("rep", F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    text = member.select("family", "rep", "set_key", "text").dropDuplicates(["rep", "set_key"])
    left = near.where("NOT near").select("rep", "set_key").join(text, ["rep", "set_key"]).join(blocks, "family")
    left = left.select("family", "rep", "set_key", "text", slot("nl").alias("l"), every("nr").alias("r"), F.lit(0).alias("side"))
    right = text.join(blocks, "family")
    right = right.select("family", "rep", "set_key", "text", every("nl").alias("l"), slot("nr").alias("r"), F.lit(1).alias("side"))
    pairs = left.unionByName(right).withColumn("block", F.concat_ws("/", "family", "l", "r"))
    found = pairs.select("block", "side", "rep", "set_key", "text").repartition("block").sortWithinPartitions("block").mapInArrow(partial(_blocks, width=width, share=share), "src long, dst long")
    return star.unionByName(found)
