"""The node table: a forest of rooted trees as rows, with an interval index.

``x`` lies in the clade of ``a`` iff both have the same tree_id and x.pre is between
a.pre and a.last.  Operators that read trees are joins and aggregates over that;
operators that rewrite trees return (tree_id, node_id, parent_id, child_ord, label,
branch_length) and ``index_forest`` derives the other columns again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that describe a tree; the root has a null parent_id.
RAW = "tree_id long, node_id int, parent_id int, child_ord int, label string, branch_length double"
#: Columns that follow from them.
INDEX = "is_tip boolean, pre int, last int, depth int, n_tips int, root_dist double"
NODES = f"{RAW}, {INDEX}"
RAW_COLUMNS = [c.split()[0] for c in RAW.split(", ")]
COLUMNS = [c.split()[0] for c in NODES.split(", ")]


def by_sorting(rows: DataFrame) -> DataFrame:
    """``rows``, which joins then sort instead of sending a side through the driver.

    Before a query runs, Spark takes a table for as large as the compressed files it is made of, whatever
    rows multiply on the way, and so would broadcast forests of any size.
    """
    return rows.hint("merge")


def index_columns(tree: np.ndarray, node: np.ndarray, parent: np.ndarray, order: np.ndarray, length: np.ndarray) -> dict[str, np.ndarray]:
    """Index columns of whole trees: one pass down and one up over their levels, all trees at once."""
    n = len(node)
    position = pd.Series(np.arange(n), index=pd.MultiIndex.from_arrays([tree, node]))
    up = np.full(n, -1)
    inner = parent >= 0
    if inner.any():
        up[inner] = position.reindex(pd.MultiIndex.from_arrays([tree[inner], parent[inner]])).fillna(-1).astype(int).to_numpy()
    level = np.flatnonzero(up < 0)
    by_parent = np.lexsort((node, order, up))
    start = np.searchsorted(up[by_parent], np.arange(n))
    stop = np.searchsorted(up[by_parent], np.arange(n), side="right")
    levels, depth, dist = [], np.zeros(n, np.int32), np.nan_to_num(length).copy()
    while len(level):
        levels.append(level)
        count = stop[level] - start[level]
        kids = by_parent[np.repeat(start[level] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())]
        depth[kids] = depth[up[kids]] + 1
        dist[kids] += dist[up[kids]]
        level = kids
    size, tips = np.ones(n, np.int32), (start == stop).astype(np.int32)
    for kids in reversed(levels[1:]):
        np.add.at(size, up[kids], size[kids])
        np.add.at(tips, up[kids], tips[kids])
    pre = np.zeros(n, np.int32)
    for kids in levels[1:]:
        before = np.cumsum(size[kids]) - size[kids]
        first = np.append(True, up[kids][1:] != up[kids][:-1])
        pre[kids] = pre[up[kids]] + 1 + before - np.maximum.accumulate(np.where(first, before, 0))
    return {"is_tip": start == stop, "pre": pre, "last": pre + size - 1, "depth": depth, "n_tips": tips, "root_dist": dist}


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: pd.DataFrame | None = None

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        parent = rows["parent_id"].fillna(-1).astype("int64").to_numpy()
        found = index_columns(rows["tree_id"].to_numpy(), rows["node_id"].to_numpy(), parent, rows["child_ord"].fillna(0).to_numpy(), rows["branch_length"].to_numpy(float))
        out = rows[RAW_COLUMNS].assign(**found)
        return out.astype({"parent_id": "Int32", "child_ord": "Int32", "node_id": "Int32"})

    for rows in batches:
        if not len(rows):
            continue
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        open_tree = rows["tree_id"].to_numpy() == rows["tree_id"].iloc[-1]  # may go on in the next batch
        held = rows[open_tree].reset_index(drop=True)
        if not open_tree.all():
            yield done(rows[~open_tree].reset_index(drop=True))
    if held is not None:
        yield done(held)


def index_forest(raw: DataFrame) -> DataFrame:
    """The node table of ``raw``: one shuffle by tree, then a pass over whole trees."""
    rows = raw.select(F.col("tree_id").cast("long"), F.col("node_id").cast("int"), F.col("parent_id").cast("int"), F.col("child_ord").cast("int"), "label", F.col("branch_length").cast("double"))
    return by_sorting(rows.repartition("tree_id").sortWithinPartitions("tree_id").mapInPandas(_index, NODES))


def tree_batches(nodes: DataFrame, function: Callable[[pd.DataFrame, list[int]], pd.DataFrame | None], schema: str, key: str = "tree_id", order: str | None = "pre") -> DataFrame:
    """``function`` on batches of whole trees' rows and the places where a tree begins, the end included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def done(rows: pd.DataFrame) -> pd.DataFrame | None:
            keys = rows[key].to_numpy()
            return function(rows, [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)])

        for rows in batches:
            if not len(rows):
                continue
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            last = rows[key].to_numpy() == rows[key].iloc[-1]
            held = rows[last].reset_index(drop=True)
            if not last.all() and (out := done(rows[~last].reset_index(drop=True))) is not None:
                yield out
        if held is not None and (out := done(held)) is not None:
            yield out

    return by_sorting(nodes.repartition(key).sortWithinPartitions(key, *([order] if order else [])).mapInPandas(run, schema))


def per_tree(nodes: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "tree_id", order: str | None = "pre") -> DataFrame:
    """``function`` on the rows of each tree: like a grouped map, but a task's trees share its Arrow batches."""

    def each(rows: pd.DataFrame, edges: list[int]) -> pd.DataFrame | None:
        made = [function(rows.iloc[a:b].reset_index(drop=True)) for a, b in zip(edges, edges[1:], strict=False)]
        made = [m for m in made if len(m)]
        return pd.concat(made, ignore_index=True) if made else None

    return tree_batches(nodes, each, schema, key, order)


class Shape:
    """Whole trees in preorder: each row's parent and the levels, for passes over all trees at once."""

    def __init__(self, tree: np.ndarray, depth: np.ndarray):
        self.starts = np.flatnonzero(np.append(True, tree[1:] != tree[:-1])) if len(tree) else np.empty(0, np.int64)
        self.tree = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(tree))))
        order = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[order], np.arange(depth.max(initial=-1) + 2))
        self.levels = [order[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        self.up = np.full(len(tree), -1)
        for above, here in zip(self.levels, self.levels[1:], strict=False):
            # in preorder a row's parent is the last row before it that is one level higher
            self.up[here] = above[np.searchsorted(above, here) - 1]

    def fold(self, values: np.ndarray, by: np.ufunc) -> np.ndarray:
        """Each row's values and those of all rows below it, folded."""
        out = values.copy()
        for here in reversed(self.levels[1:]):
            by.at(out, self.up[here], out[here])
        return out

    def path_sum(self, values: np.ndarray) -> np.ndarray:
        """Sums from the root down to each row."""
        out = values.copy()
        for here in self.levels[1:]:
            out[here] += out[self.up[here]]
        return out

    def total(self, values: np.ndarray) -> np.ndarray:
        """The sum of each row's tree."""
        return np.add.reduceat(values, self.starts)[self.tree] if len(values) else values

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Each row's first and last child, -1 for none."""
        first, last = np.full(len(self.up), -1), np.full(len(self.up), -1)
        kids = np.flatnonzero(self.up >= 0)
        last[self.up[kids]] = kids
        first[self.up[kids[::-1]]] = kids[::-1]
        return first, last


def whole_trees(nodes: DataFrame, function: Callable[[pd.DataFrame, Shape], pd.DataFrame], schema: str, unit: str = "tree_id") -> DataFrame:
    """``function`` on batches of whole trees in preorder; ``nodes`` has tree_id, pre and depth.  One shuffle by tree.

    ``unit``: a column of trees that have to be in one batch, such as the two of a pair.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            return function(rows, Shape(rows["tree_id"].to_numpy(), rows["depth"].to_numpy()))

        for rows in batches:
            if not len(rows):
                continue
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            last = rows[unit].to_numpy() == rows[unit].iloc[-1]  # may go on in the next batch
            held = rows[last].reset_index(drop=True)
            if not last.all():
                yield done(rows[~last].reset_index(drop=True))
        if held is not None:
            yield done(held)

    return by_sorting(nodes.repartition(unit).sortWithinPartitions(*dict.fromkeys([unit, "tree_id", "pre"])).mapInPandas(run, schema))


#: Folds of ``fold_clades``: the function, and what stands for a null.
FOLDS = {
    "sum": (np.add, 0), "xor": (np.bitwise_xor, 0), "or": (np.bitwise_or, 0),
    "min": (np.minimum, np.inf), "max": (np.maximum, -np.inf),
}


def fold_clades(nodes: DataFrame, keep: list[str], **folds: tuple[Column, str]) -> DataFrame:
    """``keep`` columns of each node and, per named (value, fold), the values of all nodes of its clade folded.

    Folds: sum, xor, or (longs or doubles by the value's type), min and max (doubles).
    Nulls add nothing; where nothing is, sums are 0, min and max infinite.
    """
    rows = nodes.select(*dict.fromkeys([*keep, "tree_id", "pre", "depth"]), *[v.alias(f"fold_{name}") for name, (v, _) in folds.items()])
    kind = {name: "double" if how in ("min", "max") or rows.schema[f"fold_{name}"].dataType.simpleString() == "double" else "bigint" for name, (_, how) in folds.items()}
    schema = ", ".join([f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in keep] + [f"`{n}` {k}" for n, k in kind.items()])
    how = {name: h for name, (_, h) in folds.items()}
    filled = rows.select(*keep, *[c for c in ("tree_id", "pre", "depth") if c not in keep], *[F.coalesce(F.col(f"fold_{n}").cast(kind[n]), F.lit(FOLDS[h][1]).cast(kind[n])).alias(f"fold_{n}") for n, h in how.items()])

    def run(part: pd.DataFrame, shape: Shape) -> pd.DataFrame:
        return part[keep].assign(**{n: shape.fold(part[f"fold_{n}"].to_numpy(), FOLDS[h][0]) for n, h in how.items()})

    return whole_trees(filled, run, schema)


def heap_forest(rows: DataFrame) -> DataFrame:
    """Raw nodes of a complete binary tree for each ``tree_id`` of a plain table.

    ``rows``: tree_id, rank (0, 1, ... within a tree), label, tip_length, inner_length,
    inner_label, and optionally m, the tree's number of rows.  Of m rows, row r is tip m + r and, for r >= 1, inner node r; the
    parent of node k is k div 2.
    """
    if "m" not in rows.columns:
        rows = rows.join(rows.groupBy("tree_id").agg(F.count("*").cast("int").alias("m")), "tree_id")
    # a row makes its tip and, but for the first, an inner node: one pass
    tip = F.struct((F.col("m") + F.col("rank")).alias("node_id"), F.col("label").alias("label"), F.col("tip_length").alias("branch_length"))
    inner = F.struct(F.col("rank").alias("node_id"), F.col("inner_label").alias("label"), F.col("inner_length").alias("branch_length"))
    both = rows.select("tree_id", F.inline(F.when(F.col("rank") >= 1, F.array(tip, inner)).otherwise(F.array(tip))))
    parent = F.when(F.col("node_id") > 1, F.floor(F.col("node_id") / 2).cast("int"))
    return both.select("tree_id", F.col("node_id").cast("int").alias("node_id"), parent.alias("parent_id"), (F.col("node_id") % 2).cast("int").alias("child_ord"), "label", "branch_length")
