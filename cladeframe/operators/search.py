"""Parsimony searches by interchanges, scored by what changes.

Across an inner branch there are four subtrees.  An interchange pairs them otherwise;
what happens inside each of them stays.  With the state sets of all subtrees, seen
from above (down sets) and from below (up sets), the score of every tree one
interchange away follows from four sets, and so does its set of splits, of which one
changes.  So a round looks at all neighbours of all trees in one pass over whole
trees, linear in nodes x characters; only trees that are kept are made.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.build import _fitch_up, _sets
from cladeframe.operators.components import _checkpoint, _written
from cladeframe.operators.transform import nearest_neighbours
from cladeframe.schema import COLUMNS, Shape, index_forest, whole_trees

SCORED = "search long, tree_id long, alt int, score long, shape long"


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What a node above two sets holds."""
    both = a & b
    return np.where(both == 0, a | b, both)


def _up_sets(sets: np.ndarray, shape: Shape, beside: np.ndarray) -> np.ndarray:
    """For each row below the root, the state sets of all that is not below it, as seen from its branch."""
    out = np.full_like(sets, -1)
    for depth, here in enumerate(shape.levels[1:], 1):
        out[here] = sets[beside[here]] if depth == 1 else _joint(sets[beside[here]], out[shape.up[here]])
    return out


def _cost(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Changes at the three joints of (p, q) with (r, s)."""
    return ((p & q) == 0).sum(axis=1) + ((r & s) == 0).sum(axis=1) + ((_joint(p, q) & _joint(r, s)) == 0).sum(axis=1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def _split_hash(k1: np.ndarray, k2: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """One hash of both sides of a branch: of the side with the smaller key."""
    other = ((k1 ^ x1) < k1) | (((k1 ^ x1) == k1) & ((k2 ^ x2) < k2))
    a, b = np.where(other, k1 ^ x1, k1), np.where(other, k2 ^ x2, k2)
    with np.errstate(over="ignore"):
        return _mix(a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _mix(b.view(np.uint64)))


def interchange_scores(nodes: DataFrame, characters: DataFrame, every: bool = False) -> DataFrame:
    """(search, tree_id, alt, score, shape) of binary trees and their neighbours, none of which is made.

    ``nodes`` has a column search, and so may ``characters`` (label, states), which then are
    that search's own.  alt is 0 for the tree itself, else as in ``nearest_neighbours``; ``shape`` is a
    hash of all splits.  Without ``every``, only neighbours that are no worse than their tree.
    """
    keys = [k for k in ("search", "label") if k in characters.columns]
    rows = nodes.select("search", "tree_id", "node_id", "pre", "depth", "is_tip", "label").join(characters.select(*keys, "states"), keys, "left")
    named = F.col("is_tip") & F.col("label").isNotNull()
    key = lambda *c: F.when(named, F.xxhash64(*c)).otherwise(0).cast("long")
    rows = rows.select("search", "tree_id", "pre", "depth", F.when(F.col("is_tip"), F.col("states")).alias("states"), F.when(named, 1).otherwise(0).cast("long").alias("size"), key("label").alias("k1"), key("label", F.lit(17)).alias("k2"))

    def run(part: pd.DataFrame, shape: Shape) -> pd.DataFrame:
        sets, _ = _sets(part, shape)
        own = np.add.reduceat(_fitch_up(sets, shape), shape.starts)
        first, last = shape.ends()
        depth, root = part["depth"].to_numpy(), shape.starts
        below = np.flatnonzero(shape.up >= 0)
        if (np.bincount(shape.up[below], minlength=len(part))[first >= 0] != 2).any():
            raise ValueError("interchanges are scored on binary trees: resolve polytomies first")
        beside = np.full(len(part), -1)
        beside[below] = first[shape.up[below]] + last[shape.up[below]] - below
        up = _up_sets(sets, shape, beside)
        size, k1, k2 = (shape.fold(part[c].to_numpy(), by) for c, by in (("size", np.add), ("k1", np.bitwise_xor), ("k2", np.bitwise_xor)))
        top = root[shape.tree]
        # the second branch at the root is the first one again
        once = (shape.up >= 0) & ~((depth == 1) & (beside < np.arange(len(part))))
        number = np.cumsum(once) - (np.cumsum(once) - once)[top]
        split = once & (size >= 2) & (size <= size[top] - 2)
        hashes = np.where(split, _split_hash(k1, k2, k1[top], k2[top]), np.uint64(0))
        form = np.bitwise_xor.reduceat(hashes, root) if len(root) else hashes
        tree = part["tree_id"].to_numpy()
        out = [pd.DataFrame({"tree": np.arange(len(root)), "alt": 0, "score": own, "shape": form})]
        x = np.flatnonzero(once & (first >= 0))
        x = x[(depth[x] > 1) | (first[beside[x]] >= 0)]
        over = depth[x] == 1
        s = np.where(over, first[beside[x]], beside[x])
        rest = np.where(over[:, None], sets[last[beside[x]]], up[shape.up[x]])
        a, b, c = sets[first[x]], sets[last[x]], sets[s]
        now = _cost(a, b, c, rest)
        for i, (p, q, stays) in enumerate([(c, b, last[x]), (a, c, first[x])], 1):
            # child i of x has changed places with s
            score = own[shape.tree[x]] + _cost(p, q, a if i == 1 else b, rest) - now
            new = _split_hash(k1[s] ^ k1[stays], k2[s] ^ k2[stays], k1[top[x]], k2[top[x]])
            found = pd.DataFrame({"tree": shape.tree[x], "alt": 2 * number[x] + i - 2, "score": score, "shape": form[shape.tree[x]] ^ hashes[x] ^ new})
            out.append(found if every else found[score <= own[shape.tree[x]]])
        made = pd.concat(out, ignore_index=True)
        at = root[made["tree"].to_numpy()]
        return pd.DataFrame({"search": part["search"].to_numpy()[at], "tree_id": tree[at], "alt": made["alt"].to_numpy(np.int32), "score": made["score"].to_numpy(np.int64), "shape": made["shape"].to_numpy(np.uint64).view(np.int64)})

    return whole_trees(rows, run, SCORED)


def _moved(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Node tables (with search) of chosen neighbours: (search, tree_id, alt, new_id)."""
    asked = chosen.select("tree_id", "alt")
    near = nearest_neighbours(nodes.join(asked.select("tree_id").distinct(), "tree_id", "left_semi"), only=asked)
    made = near.join(chosen, ["tree_id", "alt"]).drop("tree_id", "alt").withColumnRenamed("new_id", "tree_id")
    owner = chosen.select(F.col("new_id").alias("tree_id"), "search")
    return index_forest(made).join(owner, "tree_id").select(*COLUMNS, "search")


def best_sets(start: DataFrame, characters: DataFrame, plateau: int | None = 1, rounds: int | None = None) -> DataFrame:
    """Node tables of the equally best trees of many searches side by side, with search and score.

    ``start``: node table with a column search; all trees of one search have the same tips.
    Each round scores all neighbours of the trees that are new.  Where some are better than the
    search's best, the best of them, one of each topology, are its set; else those as good as the best
    that are not in the set yet join it.  Trees found by ``plateau`` such steps in a row (None:
    any number) have no neighbours looked at.  The sets have no bound; ``rounds``: stop after so many.
    """
    front = _written(start.select(*COLUMNS, "search"))
    pool, idle = [front], _checkpoint(front.select("search", "tree_id").distinct().withColumn("idle", F.lit(0)))
    kept = None
    for step in count():
        scored = _checkpoint(interchange_scores(front, characters))
        if kept is None:
            own = scored.where("alt = 0")
            least = own.groupBy("search").agg(F.min("score").alias("best"))
            one = own.join(least, "search").where("score = best").groupBy("search", "shape", "score").agg(F.min("tree_id").alias("tree_id"))
            kept = _checkpoint(one.select("search", "tree_id", "shape", "score"))
            scored = scored.join(kept.select("search", "tree_id"), ["search", "tree_id"], "left_semi")
        if rounds is not None and step >= rounds:
            break
        best = kept.select("search", F.col("score").alias("best")).distinct()
        near = scored.where("alt > 0").join(best, "search")
        least = near.groupBy("search", "best").agg(F.min("score").alias("least"))
        near = near.join(least.select("search", "least"), "search").where("score = least AND score <= best").join(idle, ["search", "tree_id"])
        near = near.where(F.col("score") < F.col("best")).unionByName(near.where("score = best").join(kept.select("search", "shape"), ["search", "shape"], "left_anti"), allowMissingColumns=True)
        source = F.min(F.struct("tree_id", "alt", "idle")).alias("s")
        new = near.groupBy("search", "shape", "score", "best").agg(source).select("search", "s.tree_id", "s.alt", "shape", "score", F.when(F.col("score") < F.col("best"), 0).otherwise(F.col("s.idle") + 1).alias("idle"), (F.col("score") < F.col("best")).alias("better"), F.xxhash64("search", "shape", F.lit(step)).alias("new_id"))
        new = _checkpoint(new)
        if new.isEmpty():
            break
        made = _written(_moved(front, new.select("search", "tree_id", "alt", "new_id")))
        pool.append(made)
        left = kept.join(new.where("better").select("search").distinct(), "search", "left_anti")
        kept = _written(left.unionByName(new.select("search", F.col("new_id").alias("tree_id"), "shape", "score")))
        idle = _checkpoint(new.select("search", F.col("new_id").alias("tree_id"), "idle"))
        if plateau is not None:
            idle = idle.where(F.col("idle") < plateau)
        front = made.join(idle.select("tree_id"), "tree_id", "left_semi")
    every = pool[0]
    for more in pool[1:]:
        every = every.unionByName(more)
    return every.join(kept.select("search", "tree_id", "score"), ["search", "tree_id"]).select(*COLUMNS, "search", "score")


def hill_climb(start: DataFrame, characters: DataFrame, rounds: int | None = None, plateau: int | None = 1) -> DataFrame:
    """Node tables of the equally best trees that interchanges lead to from all of ``start``: one search, with its score."""
    return best_sets(start.withColumn("search", F.lit(0).cast("long")), characters, plateau, rounds).drop("search")


def improve(start: DataFrame, characters: DataFrame, rounds: int | None = None) -> DataFrame:
    """(tree_id, round, score): many searches side by side, each moving to its best neighbour while that is better.

    ``characters`` has a tree_id: each tree is scored on its own matrix.  Scores are
    whole numbers that fall each round, so every search ends; ``rounds``: stop after so many.
    """
    now = _checkpoint(start.select(*COLUMNS).withColumn("search", F.col("tree_id")))
    chars = _checkpoint(characters.select(F.col("tree_id").alias("search"), "label", "states"))
    log: list[DataFrame] = []
    for step in count():
        scored = _checkpoint(interchange_scores(now, chars))
        if not step:
            log.append(scored.where("alt = 0").select("tree_id", F.lit(0).alias("round"), "score"))
        if rounds is not None and step >= rounds:
            break
        had = scored.where("alt = 0").select("tree_id", F.col("score").alias("had"))
        near = scored.where("alt > 0").join(had, "tree_id").where("score < had")
        # of equally good ones, by a hash: no branch is preferred
        top = near.groupBy("search", "tree_id").agg(F.min_by(F.struct("alt", "score"), F.struct("score", F.xxhash64("tree_id", "alt"))).alias("b"))
        top = _checkpoint(top.select("search", "tree_id", "b.alt", "b.score", F.col("tree_id").alias("new_id")))
        if top.isEmpty():
            break
        log.append(top.select("tree_id", F.lit(step + 1).alias("round"), "score"))
        now = _written(_moved(now, top.drop("score")))
    every = log[0]
    for more in log[1:]:
        every = every.unionByName(more)
    return every
