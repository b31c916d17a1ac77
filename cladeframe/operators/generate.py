"""Random trees and gene coverage.  Every tree has a generator of its own, seeded by (seed, tree_id)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cladeframe.operators.components import _checkpoint
from cladeframe.schema import RAW, RAW_COLUMNS, Shape, by_sorting, whole_trees
from cladeframe.sources.newick import numbered


#: Rows of drawn trees that a task holds at once.
MOST_ROWS = 200_000


def _frame(rows: list[list]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=RAW_COLUMNS).astype({"tree_id": "int64", "node_id": "int32", "parent_id": "Int32", "child_ord": "int32", "branch_length": "float64"})


def _trees(sizes: DataFrame, make: Callable[[np.random.Generator, dict], list[list]], seed: int) -> DataFrame:
    columns = sizes.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made: list[list] = []
            for r in rows[columns].to_dict("records"):
                rng = np.random.Generator(np.random.PCG64([seed, int(r["tree_id"]) % 2**64]))
                made += [[r["tree_id"], *row] for row in make(rng, r)]
                if len(made) > MOST_ROWS:
                    yield _frame(made)
                    made = []
            yield _frame(made)

    return sizes.mapInPandas(run, RAW)


def _topology(rng: np.random.Generator, n: int, waits: Callable[[int], float] | None) -> list[list]:
    """Two lineages picked at random join, until one is left; lengths from the waits between joins."""
    rows = [[i, None, 0, str(i), None] for i in range(1, n + 1)]
    born = {i: 0.0 for i in range(1, n + 1)}
    live, now, new = list(range(1, n + 1)), 0.0, n + 1
    while len(live) > 1:
        if waits:
            now += waits(len(live))
        pair = [live.pop(int(rng.integers(len(live)))) for _ in range(2)]
        for order, c in enumerate(pair):
            rows[c - 1][1:3] = [new, order]
            if waits:
                rows[c - 1][4] = now - born[c]
        rows.append([new, None, 0, None, 0.0 if waits else None])
        born[new] = now
        live.append(new)
        new += 1
    return rows


def random_trees(sizes: DataFrame, depths: str | None = None, rate: float = 1.0, seed: int = 0) -> DataFrame:
    """Raw trees of ``n`` tips labelled 1..n for each (tree_id, n).

    ``depths``: None (no lengths), "yule" (exponential waits at k * rate) or
    "coalescent" (at k (k - 1) / 2 * rate); both are ultrametric.
    """

    def make(rng: np.random.Generator, r: dict) -> list[list]:
        waits = {None: None, "yule": lambda k: rng.exponential(1 / (k * rate)), "coalescent": lambda k: rng.exponential(2 / (k * (k - 1) * rate))}[depths]
        return _topology(rng, int(r["n"]), waits)

    return _trees(sizes.select("tree_id", "n"), make, seed)


def _birth_death(rng: np.random.Generator, birth: float, death: float, age: float, most: int | None = None) -> list[list]:
    rows = [[1, None, 0, None, 0.0]]
    begun, live, now = {1: 0.0}, [1], 0.0
    while live and birth + death > 0 and (most is None or len(rows) < most):
        now += rng.exponential(1 / (len(live) * (birth + death)))
        if now >= age:
            break
        x = live.pop(int(rng.integers(len(live))))
        rows[x - 1][4] = now - begun[x]
        if rng.random() < birth / (birth + death):
            for order in (0, 1):
                k = len(rows) + 1
                rows.append([k, x, order, None, 0.0])
                begun[k] = now
                live.append(k)
    for x in live:
        rows[x - 1][4] = min(now, age) - begun[x] if most is not None and len(rows) >= most and now < age else age - begun[x]
    return rows


def birth_death_trees(sizes: DataFrame, birth: float, death: float, age: float, most_nodes: int | None = None, seed: int = 0) -> DataFrame:
    """Raw trees grown for a time at birth and death rates; extinct lineages stay; tips are Tip1, Tip2, ...

    A tree has about exp((birth - death) * age) lineages.  ``most_nodes``: stop growing a
    tree at so many nodes.
    """

    def make(rng: np.random.Generator, r: dict) -> list[list]:
        rows = _birth_death(rng, birth, death, age, most_nodes)
        inner = {x[1] for x in rows}
        for k, x in enumerate([x for x in rows if x[0] not in inner], 1):
            x[3] = f"Tip{k}"
        return rows

    return _trees(sizes.select("tree_id"), make, seed)


def add_branches(nodes: DataFrame, birth: float, death: float = 0.0, seed: int = 0) -> DataFrame:
    """Raw trees with new lineages on their branches: each branch, if a birth falls on it, gets a birth-death tree there.

    The wait for a birth from a branch's upper end is exponential; what grows ends at the
    height of the furthest tip below the branch.  New tips are Tip1, Tip2, ... of a tree.
    """

    def run(rows: pd.DataFrame, shape: Shape) -> pd.DataFrame:
        dist, length = rows["root_dist"].to_numpy(), np.nan_to_num(rows["branch_length"].to_numpy(float))
        far = shape.fold(np.where(rows["is_tip"].to_numpy(), dist, -np.inf), np.maximum)
        out: list[list] = []
        columns = [[None if v != v or v is pd.NA else v for v in rows[c].tolist()] for c in RAW_COLUMNS[1:]]
        ids, stops = rows["tree_id"].tolist(), [*shape.starts[1:].tolist(), len(rows)]
        for start, stop in zip(shape.starts.tolist(), stops, strict=True):
            rng = np.random.Generator(np.random.PCG64([seed, ids[start] % 2**64]))
            made = [list(r) for r in zip(*[c[start:stop] for c in columns], strict=True)]
            new, tips = max(r[0] for r in made) + 1, 0
            for i, row in zip(range(start, stop), list(made), strict=True):
                wait = rng.exponential(1 / birth) if birth > 0 else np.inf
                if row[1] is None or wait >= length[i]:
                    continue
                joint = new
                grown = _birth_death(rng, birth, death, far[i] - (dist[i] - length[i] + wait))
                inner = {x[1] for x in grown}
                made.append([joint, row[1], row[2], None, wait])
                row[1], row[2], row[4] = joint, 0, length[i] - wait
                for k, parent, order, _, l in grown:
                    tips += k not in inner
                    made.append([joint + k, joint if parent is None else joint + parent, 1 if parent is None else order, None if k in inner else f"Tip{tips}", l])
                new = joint + len(grown) + 1
            out += [[ids[start], *r] for r in made]
        return _frame(out)

    return whole_trees(nodes.select(*RAW_COLUMNS, "pre", "depth", "is_tip", "root_dist"), run, RAW)


def random_decisiveness(masks: DataFrame, topologies: int = 100, seed: int = 0) -> DataFrame:
    """(set_id, topology, branches, distinguished) over random topologies of the taxa of each set.

    ``masks``: set_id (long), label, mask (see ``gene_masks``).  Feed the result to
    ``decisive_share`` for the shares.  A task draws a set's topologies (those of ``random_trees``) and
    counts on them as ``decisiveness`` does; no node of them leaves it.
    """
    number = F.row_number().over(Window.partitionBy("set_id").orderBy("label"))
    taxa = masks.select("set_id", number.alias("k"), "mask").groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("k", "mask"))).alias("own"))
    ids = F.transform(F.sequence(F.lit(0), F.lit(topologies - 1)), lambda t: F.xxhash64("set_id", t))
    sets = taxa.select("set_id", F.transform("own", lambda x: x["mask"]).alias("masks"), ids.alias("tree_ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for n, some in rows.groupby(rows["masks"].map(len)):
                # sets of equally many taxa side by side, as many topologies at a time as MOST_ROWS nodes allow
                width = max((len(m) for own in some["masks"] for m in own if m is not None), default=1)
                trees = np.concatenate(some["tree_ids"].to_numpy())
                of, topology = np.divmod(np.arange(len(trees)), topologies)
                step = max(1, MOST_ROWS // (2 * n * width))
                for i in range(0, len(trees), step):
                    here, back = np.unique(of[i : i + step], return_inverse=True)
                    own = np.array([[np.zeros(width, np.int64) if m is None else m for m in some["masks"].iloc[k]] for k in here], np.int64)
                    branches, hit = _drawn_counts(_joins(trees[i : i + step], n, seed), own, back)
                    made = pd.DataFrame({"set_id": some["set_id"].to_numpy()[of[i : i + step]], "topology": topology[i : i + step], "branches": branches, "distinguished": hit})
                    yield made[branches > 0]

    # a set is few bytes and much work: its number of tasks is given, or Spark would merge them by size
    tasks = max(4 * masks.sparkSession.sparkContext.defaultParallelism, int(masks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sets.repartition(tasks, "set_id").mapInPandas(run, "set_id long, topology int, branches long, distinguished long")


def _joins(trees: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(trees, n - 1, 2): the nodes that join, one after the other, in the topologies that ``random_trees`` draws without lengths; tips are 0 .. n - 1, the k-th join is node n + k."""
    out = np.zeros((len(trees), n - 1, 2), np.int64)
    among = np.stack([np.arange(n, 1, -1), np.arange(n - 1, 0, -1)], axis=1).reshape(-1)
    for t, tree in enumerate(trees.tolist() if n > 1 else []):
        at, live, new = np.random.Generator(np.random.PCG64([seed, tree % 2**64])).integers(among).tolist(), list(range(n)), n
        flat = []
        for k in range(0, len(at), 2):
            flat += [live.pop(at[k]), live.pop(at[k + 1])]
            live.append(new)
            new += 1
        out[t].reshape(-1)[:] = flat
    return out


def _drawn_counts(joins: np.ndarray, masks: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``_distinguished`` counts, for binary trees given by their joins; ``masks``: (sets, n, words), ``of``: each tree's set."""
    rows, n = np.arange(len(joins)), masks.shape[1]
    below = np.zeros((len(joins), 2 * n - 1, masks.shape[2]), np.int64)
    below[:, :n] = masks[of]
    up, beside = np.zeros((2, len(joins), 2 * n - 1), np.int64)
    for k, (a, b) in enumerate(joins.transpose(1, 2, 0)):
        below[:, n + k] = below[rows, a] | below[rows, b]
        up[rows, a] = up[rows, b] = n + k
        beside[rows, a], beside[rows, b] = b, a
    root, outside = 2 * n - 2, np.zeros_like(below)
    branches, hit = np.zeros((2, len(joins)), np.int64)
    for k in range(n - 3, -1, -1):
        x, (a, b) = n + k, joins[:, k].T
        sibling, above = below[rows, beside[:, n + k]], outside[rows, up[:, n + k]]
        outside[:, x] = above | sibling
        inner = up[:, x] != root
        branches += inner
        hit += inner & ((below[rows, a] & below[rows, b] & sibling & above) != 0).any(axis=1)
    if n > 1:
        # the two sides of the root are one branch, which counts where both have two subtrees
        both = np.flatnonzero((joins[:, -1] >= n).all(axis=1))
        four = joins[both[:, None], joins[both, -1] - n].reshape(len(both), 4)
        branches[both] += 1
        hit[both] += (np.bitwise_and.reduce(below[both[:, None], four], axis=1) != 0).any(axis=1)
    return branches, hit


def gene_masks(genes: DataFrame) -> DataFrame:
    """(label, mask): the genes of each taxon as bits of as many longs as it takes; from (taxon, gene)."""
    genes = _checkpoint(genes.select("taxon", "gene").where("gene IS NOT NULL").distinct())
    names = _checkpoint(genes.select("gene").distinct())
    number = numbered(names.orderBy("gene"), "k").select("gene", (F.col("k") - 1).alias("k"))
    words = -(-max(1, names.count()) // 63)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("k") % 63).cast("int"))
    # a mask holds a bit for each gene, so their names are few, and some of them frequent
    word = genes.join(F.broadcast(number), "gene").groupBy(F.col("taxon").alias("label"), F.floor(F.col("k") / 63).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits"))
    of = word.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
    return by_sorting(of.select("label", F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("long"))).alias("mask")))


def _distinguished(rows: pd.DataFrame, shape: Shape) -> pd.DataFrame:
    """Counts of the inner branches of whole trees, and of those that some gene distinguishes."""
    width = max((len(m) for m in rows["mask"] if m is not None), default=1)
    none = np.zeros(width, np.int64)
    own = np.array([none if m is None else m for m in rows["mask"]], np.int64).reshape(len(rows), width)
    tips = rows["is_tip"].to_numpy()
    below = shape.fold(np.where(tips[:, None], own, 0), np.bitwise_or)
    up, (first, last) = shape.up, shape.ends()
    kids = np.bincount(up[up >= 0], minlength=len(rows))
    # genes of the tips beside each node: its siblings', from the left and from the right
    beside = np.zeros_like(below)
    for order in (np.arange(len(rows)), np.arange(len(rows))[::-1]):
        nodes = order[up[order] >= 0]
        nodes = nodes[np.argsort(up[nodes], kind="stable")]
        at = np.arange(len(nodes)) - np.searchsorted(up[nodes], up[nodes])
        run = np.zeros_like(below)
        for k in range(1, int(at.max(initial=0)) + 1):
            here = np.flatnonzero(at == k)
            run[nodes[here]] = run[nodes[here - 1]] | below[nodes[here - 1]]
        beside |= run
    outside = np.zeros_like(below)
    for here in shape.levels[1:]:
        outside[here] = outside[up[here]] | beside[here]
    b = np.flatnonzero((up >= 0) & ~tips & (kids >= 2))
    at_root = rows["depth"].to_numpy()[b] == 1
    over = at_root & (kids[up[b]] == 2)
    b, at_root, over = (x[~(over & (last[up[b]] == b))] for x in (b, at_root, over))  # the same branch from its other end
    sibling = np.where(first[up[b]] == b, last[up[b]], first[up[b]])
    whole = np.where(over, kids[sibling] >= 2, ~at_root | (kids[up[b]] > 2))  # all four sides are there
    b, over, sibling = b[whole], over[whole], sibling[whole]
    third = np.where(over[:, None], below[first[sibling]], np.where((kids[up[b]] == 2)[:, None], below[sibling], beside[b]))
    fourth = np.where(over[:, None], below[last[sibling]], outside[up[b]])
    wide = kids[up[b]] > 2
    if wide.any():  # a node of many children: the first sibling against the other ones and what is outside
        for i in np.flatnonzero(wide & ~over):
            others = np.flatnonzero((up == up[b[i]]) & (np.arange(len(rows)) != b[i]))
            third[i] = below[others[0]]
            fourth[i] = outside[up[b[i]]] | (np.bitwise_or.reduce(below[others[1:]], axis=0) if len(others) > 1 else 0)
    hit = ((below[first[b]] & below[last[b]] & third & fourth) != 0).any(axis=1)
    n = len(shape.starts)
    made = pd.DataFrame({"tree_id": rows["tree_id"].to_numpy()[shape.starts], "branches": np.bincount(shape.tree[b], minlength=n), "distinguished": np.bincount(shape.tree[b], weights=hit, minlength=n).astype(np.int64)})
    return made[made["branches"] > 0]


def decisiveness(nodes: DataFrame, masks: DataFrame) -> DataFrame:
    """(tree_id, branches, distinguished): inner branches that some gene distinguishes.

    ``masks``: label, mask (array of longs), optionally tree_id.  A branch is
    distinguished if one gene has taxa in all four subtrees around it: the two below,
    the sibling's, and the rest above.  At a root of two children the sibling's two
    subtrees are the other two.  Branches with an empty side don't count.
    """
    keys = [k for k in ("tree_id", "label") if k in masks.columns]
    rows = nodes.select("tree_id", "pre", "depth", "is_tip", "label").join(masks.select(*keys, "mask"), keys, "left")
    rows = rows.select("tree_id", "pre", "depth", "is_tip", F.when(F.col("is_tip"), F.col("mask")).alias("mask"))
    return whole_trees(rows, _distinguished, "tree_id long, branches long, distinguished long")


def decisive_share(counts: DataFrame) -> DataFrame:
    """One row: the share of trees all of whose branches are distinguished, and the share of branches."""
    return counts.agg(F.avg(F.when(F.col("branches") == F.col("distinguished"), 1.0).otherwise(0.0)).alias("decisive_trees"), (F.sum("distinguished") / F.sum("branches")).alias("distinguished_branches"))
