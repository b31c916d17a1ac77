"""Pairs of sequences: distances, alignment, clusters, and how well taxa can be aligned."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType
from pyspark.sql.window import Window

from cladeframe.functions import sequences as q
from cladeframe.operators.components import connected_components

#: Bins of the distance histograms: width 1/1000, values above 2 in the last one.
BINS, PER_UNIT = 2000, 1000
#: Fixed values of the alignment: opening and extending a gap, equal and different bases.
GAP_OPEN, GAP_EXTEND, MATCH, MISMATCH = -15, -1, 7, -5


def sequence_pairs(seqs: DataFrame, block: list[str] | None = None, min_length: int = 0) -> DataFrame:
    """All unordered pairs a < b of seq_id, within equal ``block`` columns.

    Without a block this is n(n-1)/2 pairs, whatever runs it; a block (a gene, a
    taxon, a length class) keeps it an equi-join.
    """
    s = seqs.where(F.length("sequence") > min_length).dropDuplicates(["seq_id"]) if min_length else seqs.dropDuplicates(["seq_id"])
    keys = block or []
    a = s.select(*keys, *[F.col(c).alias(f"{c}_a") for c in s.columns if c not in keys])
    b = s.select(*keys, *[F.col(c).alias(f"{c}_b") for c in s.columns if c not in keys])
    less = F.col("seq_id_a") < F.col("seq_id_b")
    return a.join(b, keys).where(less) if keys else a.join(b, less)


def consecutive_pairs(rows: DataFrame, order: str) -> DataFrame:
    """Rows 1 and 2, 3 and 4, ... of a table in an order: (pair, a, b) as in a file of pairs.

    The order column has to be the dense record number from 0 that a reader gives.
    """
    k = rows.withColumn("pair", F.floor(F.col(order) / 2))
    left, right = k.where(F.col(order) % 2 == 0), k.where(F.col(order) % 2 == 1)
    name = lambda d, x: d.select("pair", *[F.col(c).alias(f"{c}_{x}") for c in rows.columns])
    return name(left, "a").join(name(right, "b"), "pair")


def distances(pairs: DataFrame, gaps: bool = False) -> DataFrame:
    """``pairs`` with states_a, states_b: compared, differences, similarity, p, jc and jc_minus_p."""
    p = pairs.withColumn("compared", q.compared_sites(F.col("states_a"), F.col("states_b"), gaps)).withColumn("differences", q.hamming(F.col("states_a"), F.col("states_b"), gaps))
    p = p.withColumn("similarity", q.similarity(F.col("differences"), F.col("compared"))).withColumn("p", 1 - F.col("similarity"))
    return p.withColumn("jc", q.jukes_cantor(F.col("p"))).withColumn("jc_minus_p", F.col("jc") - F.col("p"))


#: Sequences of a tile's side, on average: two sides meet in a task, so a large block of sequences is dealt to many.
TILE = 512


def _masks(states: pa.ChunkedArray) -> np.ndarray:
    """State sets as (sequences, sites); sites that a sequence lacks are empty."""
    lists = states.combine_chunks()
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)
    return out


def _proportions(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """p of each row of x with each row of y: products of 0 and 1 count the sites that both have and those where the sets meet."""
    compared = (x != 0).astype(np.float32) @ (y != 0).astype(np.float32).T
    meet = np.zeros_like(compared)
    for m in np.unique(x[x != 0]):
        meet += (x == m).astype(np.float32) @ ((y & m) != 0).astype(np.float32).T
    differences = (compared - meet).astype(np.float64)
    return 1 - np.where(compared == 0, 1.0, 1 - differences / np.maximum(compared, 1))


def _tile(rows: pa.Table, keys: list[str], below: float | None) -> pa.Table:
    rows = rows.sort_by("seq_id")
    low, high, side = rows["low"][0].as_py(), rows["high"][0].as_py(), rows["side"].to_numpy()
    left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
    states = _masks(rows["states"])
    p = _proportions(states[left], states[right])
    wanted = np.ones(p.shape, bool) if below is None else p < below
    if low == high:
        wanted = np.triu(wanted, 1)
    i, j = np.nonzero(wanted)
    a, b = np.minimum(left[i], right[j]), np.maximum(left[i], right[j])
    out = rows.select([*keys, "seq_id"]).take(a).rename_columns([*keys, "seq_id_a"])
    return out.append_column("seq_id_b", rows["seq_id"].take(b)).append_column("p", pa.array(p[i, j]))


def tiled_distances(seqs: DataFrame, block: list[str], below: float | None = None) -> DataFrame:
    """(``block``, seq_id_a, seq_id_b, p): what ``distances`` of ``sequence_pairs`` give, for blocks of any size.

    A block's sequences are dealt by a hash to sides of about ``TILE``, and each two sides (and each
    with itself) are a task's unit: units grow in number with a block, not in size.  ``below``: only
    pairs nearer than that are returned; all are compared.
    """
    s = seqs.select(*block, "seq_id", "states").dropna(subset=[*block, "seq_id"]).dropDuplicates(["seq_id"])
    sides = s.groupBy(*block).agg(F.ceil(F.count("*") / TILE).alias("sides"))
    s = s.join(F.broadcast(sides), block).withColumn("side", F.pmod(F.xxhash64("seq_id"), "sides"))
    units = F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda k: F.struct(F.least("side", k).alias("low"), F.greatest("side", k).alias("high")))
    dealt = s.withColumn("unit", F.explode(units)).select(*block, "seq_id", "states", "side", "unit.low", "unit.high")
    # by number: joined small partitions would give few tasks, as units are small and make many pairs
    dealt = dealt.repartition(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *block, "low", "high")
    kind = seqs.schema
    schema = StructType([kind[k] for k in block]).add("seq_id_a", kind["seq_id"].dataType).add("seq_id_b", kind["seq_id"].dataType).add("p", DoubleType())
    return dealt.groupBy(*block, "low", "high").applyInArrow(lambda rows: _tile(rows, block, below), schema)


def _diagonals(x: np.ndarray, y: np.ndarray, begin: int, end: int, state: tuple, seen=None) -> tuple[tuple, list]:
    """Cells (i, j) with i + j from ``begin`` to before ``end`` of all pairs at once; (state, ways back of each diagonal).

    ``state``: of the diagonal before, best scores and those that end in a gap of either kind, and the best ones of the diagonal
    before that, each by i.  Without ``seen`` the ways back are kept: which of the three is best (a match before a gap),
    and whether each kind of gap was just opened; with it, each diagonal's best scores are handed to it instead.
    """
    n, m, low = x.shape[1], y.shape[1], -(10**9)
    back = y[:, ::-1]
    before, last, up, left = state
    ways = []
    for d in range(begin, end):
        lo, hi = max(1, d - m), min(n, d - 1) + 1
        here, over = slice(lo, hi), slice(lo - 1, hi - 1)
        opened_up, opened_left = last[:, over] + GAP_OPEN, last[:, here] + GAP_OPEN
        u, v = np.maximum(opened_up, up[:, over] + GAP_EXTEND), np.maximum(opened_left, left[:, here] + GAP_EXTEND)
        match = before[:, over] + np.where((x[:, over] & back[:, lo + m - d : hi + m - d]) != 0, np.int32(MATCH), np.int32(MISMATCH))
        b = np.maximum(np.maximum(match, u), v)
        before, last = last, np.zeros_like(last)
        up, left = np.full_like(up, low), np.full_like(left, low)
        last[:, here], up[:, here], left[:, here] = b, u, v
        if seen is None:
            ways.append((lo, np.where(match == b, 0, np.where(u == b, 1, 2)).astype(np.uint8) | (u == opened_up).view(np.uint8) << 2 | (v == opened_left).view(np.uint8) << 3))
        else:
            seen(d, last)
    return (before, last, up, left), ways


def align_many(pairs: list[tuple[str, str]]) -> list[tuple[str, str, int]]:
    """Best alignments with affine gaps that cost nothing at the ends, of pairs that have about the same lengths.

    All pairs go through the same anti-diagonal at once.  Only every few of them are kept; the
    ways back are made again from there, so memory grows with length ** 1.5, not with its square.
    """
    low, count = np.int32(-(10**9)), len(pairs)
    n_of, m_of = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    n, m = int(n_of.max(initial=0)), int(m_of.max(initial=0))
    x, y = np.zeros((count, n), np.int32), np.zeros((count, m), np.int32)
    for k, (a, b) in enumerate(pairs):
        x[k, : len(a)], y[k, : len(b)] = [q.DNA.get(c, 0) for c in a.upper()], [q.DNA.get(c, 0) for c in b.upper()]
    each = np.arange(count)
    zero, none = np.zeros((count, n + 1), np.int32), np.full((count, n + 1), low)
    # the last row and column, where an alignment may end: of equals the longer, a row before a column
    row, col = np.zeros(count, np.int64), np.zeros(count, np.int64)
    row_at, col_at = np.zeros(count, np.int64), np.zeros(count, np.int64)

    def seen(d: int, best: np.ndarray) -> None:
        j, i = d - n_of, d - m_of
        of = np.flatnonzero((j >= 0) & (j <= m_of))
        v = best[of, n_of[of]]
        better = v >= row[of]
        row[of[better]], row_at[of[better]] = v[better], j[of[better]]
        of = np.flatnonzero((i >= 0) & (i <= n_of))
        v = best[of, i[of]]
        better = v >= col[of]
        col[of[better]], col_at[of[better]] = v[better], i[of[better]]

    for d in (0, 1):
        seen(d, zero)
    step = max(16, int(4 * np.sqrt(n + m)))
    marks, state = [], (zero, zero, none, none)
    for d in range(2, n + m + 1, step):
        marks.append((d, state))
        state, _ = _diagonals(x, y, d, min(d + step, n + m + 1), state, seen)
    by_row = row >= col
    i, j = np.where(by_row, n_of, col_at), np.where(by_row, row_at, m_of)
    score, end_i, end_j = np.where(by_row, row, col), i.copy(), j.copy()
    mode, moves = np.zeros(count, np.int64), []
    for begin, state in reversed(marks):
        if not ((i > 0) & (j > 0) & (i + j >= begin)).any():
            continue
        _, ways = _diagonals(x, y, begin, min(begin + step, n + m + 1), state)
        for d in range(begin + len(ways) - 1, begin - 1, -1):
            of = np.flatnonzero((i + j == d) & (i > 0) & (j > 0))
            if not len(of):
                continue
            lo, way = ways[d - begin]
            w = way[of, i[of] - lo].astype(np.int64)
            move = np.where(mode[of] == 0, w & 3, mode[of])
            mode[of] = np.where((move == 1) & (w & 4 == 0), 1, np.where((move == 2) & (w & 8 == 0), 2, 0))
            i[of] -= move != 2
            j[of] -= move != 1
            moves.append((of, move))
    made = [[] for _ in range(count)]
    for of, move in reversed(moves):
        for k, v in zip(of.tolist(), move.tolist(), strict=True):
            made[k].append(v)
    out = []
    for k in each.tolist():
        a, b = pairs[k]
        at_i, at_j = int(i[k]), int(j[k])
        top, bottom = [a[:at_i], "-" * at_j], ["-" * at_i, b[:at_j]]
        for v in made[k]:
            top.append("-" if v == 2 else a[at_i])
            bottom.append("-" if v == 1 else b[at_j])
            at_i, at_j = at_i + (v != 2), at_j + (v != 1)
        top += [a[end_i[k] :], "-" * (len(b) - end_j[k])]
        bottom += ["-" * (len(a) - end_i[k]), b[end_j[k] :]]
        out.append(("".join(top), "".join(bottom), int(score[k])))
    return out


def _align(a: str, b: str) -> tuple[str, str, int]:
    return align_many([(a, b)])[0]


#: Cells of an anti-diagonal that are held at once, over all pairs of a bucket.
DIAGONAL_CELLS = 1 << 17


def _buckets(pairs: list[tuple[str, str]]) -> Iterator[list[int]]:
    """Places of pairs whose lengths are alike: within a bucket no side is padded by over a quarter and 16."""
    held: list[int] = []
    for k in sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1]))):
        longest = max(len(pairs[k][0]), 1)
        if held:
            first = pairs[held[0]]
            lengths = [len(pairs[h][1]) for h in (held[0], k)]
            if longest > 1.25 * len(first[0]) + 16 or max(lengths) > 1.25 * min(lengths) + 16 or (len(held) + 1) * longest > DIAGONAL_CELLS:
                yield held
                held = []
        held.append(k)
    if held:
        yield held


def _align_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        pairs = [(a or "", b or "") for a, b in zip(rows["sequence_a"], rows["sequence_b"], strict=True)]
        got: list = [None] * len(pairs)
        for bucket in _buckets(pairs):
            for k, found in zip(bucket, align_many([pairs[k] for k in bucket]), strict=True):
                got[k] = found
        yield pd.DataFrame({"seq_id_a": rows["seq_id_a"], "seq_id_b": rows["seq_id_b"], "aligned_a": [g[0] for g in got], "aligned_b": [g[1] for g in got], "score": [g[2] for g in got]})


def align_pairs(pairs: DataFrame) -> DataFrame:
    """Pairwise alignments: pairs are dealt evenly, as each costs the product of its lengths."""
    rows = pairs.select(F.col("seq_id_a").cast("string"), F.col("seq_id_b").cast("string"), "sequence_a", "sequence_b")
    return rows.repartition("seq_id_a", "seq_id_b").mapInPandas(_align_batches, "seq_id_a string, seq_id_b string, aligned_a string, aligned_b string, score long")


def completeness(sequence: Column) -> Column:
    """Known bases less unknown ones: what makes a sequence a cluster's lead."""
    n = F.length(F.regexp_replace(F.upper(sequence), "[^N]", ""))
    return F.length(sequence) - 2 * n


def cluster(seqs: DataFrame, pairs: DataFrame, cut_off: float = 0.999, by: str | None = None, cut_offs: DataFrame | None = None) -> DataFrame:
    """(member, lead): components of the pairs whose similarity exceeds the cut-off.

    ``seqs``: seq_id, completeness. The most complete member leads, of equal ones the
    smallest id.  Sequences without a link are their own lead.  ``cut_offs``: a table
    (``by``, cut_off) with a value for some of the pairs' genes (or other column ``by``).
    """
    if by and cut_offs is not None:
        pairs = pairs.join(cut_offs.select(by, "cut_off"), by, "left")
        links = pairs.where(F.col("similarity") > F.coalesce("cut_off", F.lit(cut_off)))
    else:
        links = pairs.where(F.col("similarity") > cut_off)
    comp = connected_components(links, "seq_id_a", "seq_id_b").withColumnRenamed("id", "seq_id")
    named = seqs.select("seq_id", "completeness").join(comp, "seq_id", "left").withColumn("component", F.coalesce("component", "seq_id"))
    best = F.min_by("seq_id", F.struct(-F.col("completeness"), "seq_id")).alias("lead")
    return named.join(named.groupBy("component").agg(best), "component").select(F.col("seq_id").alias("member"), "lead")


def common_taxon(a: Column, b: Column) -> Column:
    """The common leading ranks of two ;-separated taxonomies, as an array."""
    x, y = F.split(a, r"\s*;\s*"), F.split(b, r"\s*;\s*")
    same = F.zip_with(x, y, lambda s, t: F.coalesce(s == t, F.lit(False)))
    stop = F.array_position(same, F.lit(False))
    n = F.when(stop > 0, stop - 1).otherwise(F.least(F.size(x), F.size(y)))
    return F.slice(x, F.lit(1), n.cast("int"))


def taxon_distances(pairs: DataFrame, value: str = "jc_minus_p") -> DataFrame:
    """(taxon, bin): each pair counted in the common taxon of its two sequences and all taxa above it."""
    ranks = common_taxon(F.col("taxonomy_a"), F.col("taxonomy_b"))
    v = F.floor(F.least(F.col(value) * PER_UNIT, F.lit(float(BINS - 1)))).cast("int")  # infinite ones in the last bin
    p = pairs.select(ranks.alias("ranks"), v.alias("bin")).where(F.size("ranks") > 0)
    return p.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("ranks")), lambda k: F.array_join(F.slice("ranks", 1, k), ";"))).alias("taxon"), "bin")


def mad_by_taxon(pairs: DataFrame, value: str = "jc_minus_p") -> DataFrame:
    """(taxon, n, mad): 1.4826 / 1000 times the lower median of the bins' deviations from their lower median.

    Histograms are aggregated first, so a taxon has at most one row per bin.
    """
    h = taxon_distances(pairs, value).groupBy("taxon", "bin").agg(F.count("*").alias("k"))

    def lower_median(rows: DataFrame, column: str, name: str) -> DataFrame:
        w = Window.partitionBy("taxon").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
        all_of = Window.partitionBy("taxon")
        run = rows.withColumn("c", F.sum("k").over(w)).withColumn("n", F.sum("k").over(all_of))
        return run.where(F.col("c") >= F.ceil(F.col("n") / 2)).groupBy("taxon").agg(F.min(column).alias(name), F.max("n").alias("n"))

    med = lower_median(h, "bin", "med").drop("n")
    dev = h.join(med, "taxon").withColumn("dev", F.abs(F.col("bin") - F.col("med"))).groupBy("taxon", "dev").agg(F.sum("k").alias("k"))
    return lower_median(dev, "dev", "mad").select("taxon", "n", (F.col("mad") * 1.4826 / PER_UNIT).alias("mad"))


def alignment_groups(mads: DataFrame, below: float = 0.01) -> DataFrame:
    """(taxon, kind): the highest taxa with a MAD below the limit (A), and the lowest taxa that none of those covers (T)."""
    t = mads.select("taxon", "mad", F.split("taxon", ";").alias("ranks"))
    above = t.select("taxon", "mad", F.explode(F.transform(F.sequence(F.lit(1), F.size("ranks")), lambda k: F.array_join(F.slice("ranks", 1, k), ";"))).alias("upper"))
    good = mads.where(F.col("mad") < below).select(F.col("taxon").alias("upper"))
    covered = above.where("upper <> taxon").join(good, "upper", "left_semi").select("taxon").distinct()
    parent = above.where("upper <> taxon").select(F.col("upper").alias("taxon")).distinct()
    free = t.select("taxon", "mad").join(covered, "taxon", "left_anti")
    a = free.where(F.col("mad") < below).select("taxon", F.lit("A").alias("kind"))
    return a.unionByName(free.where(F.col("mad") >= below).join(parent, "taxon", "left_anti").select("taxon", F.lit("T").alias("kind")))


def distance_matrix(pairs: DataFrame, value: str = "jc") -> DataFrame:
    """(i, j, d) with both ends' ids as i < j."""
    return pairs.select(F.col("seq_id_a").alias("i"), F.col("seq_id_b").alias("j"), F.col(value).alias("d"))


def alignable_groups(seqs: DataFrame, pairs: DataFrame, value: str = "jc_minus_p", limit: float = 0.01, rounds: int | None = None) -> DataFrame:
    """(seq_id, grp): sequences halved by a midpoint-rooted neighbour-joining tree until the MAD is low.

    ``seqs`` and ``pairs`` carry a column grp, the groups to begin with.  Each round
    halves all groups that are too diverse, at once, until none of them has more than
    two sequences or can be split; ``rounds``: stop after so many.  Infinite distances are
    as ``neighbour_joining`` takes them; a group that only they hold together is cut
    into its parts first.
    """
    from cladeframe.operators.build import neighbour_joining
    from cladeframe.operators.components import _checkpoint, _written
    from cladeframe.operators.transform import midpoint_root
    from cladeframe.schema import index_forest

    now = _checkpoint(seqs.select("seq_id", F.col("grp").cast("string").alias("grp")))
    link = pairs.select("seq_id_a", "seq_id_b", F.col(value).alias("v"), F.col("jc").alias("d"))
    for _ in count() if rounds is None else range(rounds):
        a = now.select(F.col("seq_id").alias("seq_id_a"), "grp")
        b = now.select(F.col("seq_id").alias("seq_id_b"), F.col("grp").alias("grp_b"))
        inner = _checkpoint(link.join(a, "seq_id_a").join(b, "seq_id_b").where("grp = grp_b").drop("grp_b"))
        mads = mad_by_taxon(inner.select(F.col("grp").alias("taxonomy_a"), F.col("grp").alias("taxonomy_b"), "v"), "v")
        wide = mads.where(F.col("mad") >= limit).select(F.col("taxon").alias("grp"))
        big = now.join(wide, "grp", "left_semi").groupBy("grp").agg(F.count("*").alias("n")).where("n > 2").select("grp")
        big = _checkpoint(big)
        if big.isEmpty():
            break
        dist = inner.join(big, "grp", "left_semi").select(F.xxhash64("grp").alias("matrix_id"), F.col("seq_id_a").cast("string").alias("i"), F.col("seq_id_b").cast("string").alias("j"), "d")
        names = big.select("grp", F.xxhash64("grp").alias("tree_id"))
        joined = _checkpoint(index_forest(neighbour_joining(dist)))
        # where no way of finite distances leads from one part to another, the group is cut there
        parted = joined.where("depth = 1 AND branch_length IS NULL").select("tree_id").distinct()
        whole = index_forest(midpoint_root(_checkpoint(joined.join(parted, "tree_id", "left_anti"))))
        tree = _checkpoint(whole.unionByName(joined.join(parted, "tree_id", "left_semi")))
        top = tree.where("depth = 1").select("tree_id", F.col("pre").alias("lo"), F.col("last").alias("hi"), F.row_number().over(Window.partitionBy("tree_id").orderBy("pre")).alias("half"))
        side = tree.where("is_tip").join(top, "tree_id").where("pre BETWEEN lo AND hi").join(names, "tree_id").select(F.col("label").alias("seq"), "grp", "half")
        before = now.select("grp").distinct().count()
        now = _written(now.join(side, [now["seq_id"].cast("string") == side["seq"], now["grp"] == side["grp"]], "left").select("seq_id", F.when(F.col("half").isNull(), now["grp"]).otherwise(F.concat_ws(".", now["grp"], F.col("half").cast("string"))).alias("grp")))
        if now.select("grp").distinct().count() == before:
            break
    return now
