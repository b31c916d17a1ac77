"""Groups of tips by the tree they are on: one pass over whole trees each, up for what clades hold, down for what tips belong to."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.forest import tips
from cladeframe.schema import Shape, whole_trees

CLUSTERS = "tree_id long, cluster int, label string"


def _labelled(part: pd.DataFrame, cluster: np.ndarray) -> pd.DataFrame:
    """(tree_id, cluster, label) of the tips, by the row that each belongs to."""
    node = part["node_id"].to_numpy()
    tip = np.flatnonzero(part["is_tip"].to_numpy() & (cluster >= 0))
    return pd.DataFrame({"tree_id": part["tree_id"].to_numpy()[tip], "cluster": node[cluster[tip]], "label": part["label"].to_numpy()[tip]})


def _highest(shape: Shape, good: np.ndarray) -> np.ndarray:
    """The highest good row at or above each row, -1 for none."""
    out = np.where(good, np.arange(len(good)), -1)
    for here in shape.levels[1:]:
        above = out[shape.up[here]]
        out[here] = np.where(above >= 0, above, out[here])
    return out


def cluster_by_branch_length(nodes: DataFrame, below: float) -> DataFrame:
    """Maximal clades in which, at every node, the nearest tips of the two sides are together closer than a value.

    A tip that no such clade holds is a cluster of its own.
    """

    def run(part: pd.DataFrame, shape: Shape) -> pd.DataFrame:
        dist, length = part["root_dist"].to_numpy(), np.nan_to_num(part["branch_length"].to_numpy(float))
        near = shape.fold(np.where(part["is_tip"].to_numpy(), dist, np.inf), np.minimum) - dist + length
        sides = np.zeros(len(part))
        kids = np.flatnonzero(shape.up >= 0)
        np.add.at(sides, shape.up[kids], near[kids])
        far = shape.fold((sides >= below) & ~part["is_tip"].to_numpy(), np.logical_or)
        return _labelled(part, _highest(shape, ~far))

    return whole_trees(nodes.select("tree_id", "pre", "depth", "node_id", "label", "is_tip", "root_dist", "branch_length"), run, CLUSTERS)


def cluster_by_long_branch(nodes: DataFrame, above: float) -> DataFrame:
    """(tree_id, cluster, label): tips that stay together when branches longer than a value are cut.

    The two branches below a root of two children are one.  A tip belongs to the
    lowest cut branch above it, or to the root's part.
    """

    def run(part: pd.DataFrame, shape: Shape) -> pd.DataFrame:
        length, depth = np.nan_to_num(part["branch_length"].to_numpy(float)), part["depth"].to_numpy()
        cut = length > above
        top = np.flatnonzero(depth == 1)
        two = np.bincount(shape.tree[top], minlength=len(shape.starts))[shape.tree[top]] == 2
        left, right = top[two][::2], top[two][1::2]
        cut[left], cut[right] = length[left] + length[right] > above, False
        out = np.arange(len(part))
        for here in shape.levels[1:]:
            out[here] = np.where(cut[here], here, out[shape.up[here]])
        return _labelled(part, out)

    return whole_trees(nodes.select("tree_id", "pre", "depth", "node_id", "label", "is_tip", "branch_length"), run, CLUSTERS)


def cluster_by_value(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """Maximal clades whose tips all have the same value: (tree_id, cluster, label).

    ``values``: label, value, optionally tree_id.  A tip without a value, or with several, matches nothing.
    """
    keys = [k for k in ("tree_id", "label") if k in values.columns]
    one_each = values.groupBy(*keys).agg(F.min("value").alias("value"), F.max("value").alias("most"), F.count_if(F.col("value").isNull()).alias("none"))
    one_each = one_each.select(*keys, F.when((F.col("value") == F.col("most")) & (F.col("none") == 0), F.col("value")).alias("value"))
    rows = nodes.select("tree_id", "pre", "depth", "node_id", "label", "is_tip").join(one_each, keys, "left")

    def run(part: pd.DataFrame, shape: Shape) -> pd.DataFrame:
        tip = part["is_tip"].to_numpy()
        code = pd.factorize(part["value"])[0].astype(float)
        code = np.where(code < 0, -1.0 - np.arange(len(code)), code)  # a tip without a value is like no other
        low, high = (shape.fold(np.where(tip, code, rest), by) for rest, by in ((np.inf, np.minimum), (-np.inf, np.maximum)))
        one = shape.fold(tip.astype(np.int64), np.add) == 1
        return _labelled(part, _highest(shape, one | (low == high)))

    return whole_trees(rows, run, CLUSTERS)


def cluster_by_tip_name(nodes: DataFrame, separator: str = ",", position: int = 1) -> DataFrame:
    """Maximal clades whose tips' names agree in one field."""
    named = tips(nodes).select("tree_id", "label", F.split_part("label", F.lit(separator), F.lit(position)).alias("value"))
    return cluster_by_value(nodes, named)
