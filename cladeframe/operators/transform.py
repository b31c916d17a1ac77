"""Operators that change trees.

All of them take the node table and return the raw columns (or the node table, where
the shape stays); ``schema.index_forest`` derives the index of raw columns.  New
parents, orders and lengths come from joins over the interval index, so a forest is
changed in one go; only the order-dependent dropping of short tips walks each tree.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cladeframe.operators.components import _held
from cladeframe.operators.forest import inside, mrca, relaxed_outgroup, tips, unrooted_branches
from cladeframe.schema import COLUMNS, NODES, RAW, RAW_COLUMNS, Shape, by_sorting, index_columns, index_forest, per_tree, whole_trees

LENGTH = "branch_length"


def _length() -> Column:
    return F.coalesce(F.col(LENGTH), F.lit(0.0))


# Lengths and labels: the shape stays.


def scale_branches(nodes: DataFrame, factor: float) -> DataFrame:
    """All lengths, the root's too, times a factor."""
    return nodes.withColumn(LENGTH, F.col(LENGTH) * factor).withColumn("root_dist", F.col("root_dist") * factor)


def set_branch_lengths(nodes: DataFrame, value: float) -> DataFrame:
    """Every length a constant."""
    return nodes.withColumn(LENGTH, F.lit(float(value))).withColumn("root_dist", (F.col("depth") + 1) * F.lit(float(value)))


def null_short_branches(nodes: DataFrame, below: float) -> DataFrame:
    """Lengths under a value become 0 (raw columns: distances change below them)."""
    return nodes.withColumn(LENGTH, F.when(F.col(LENGTH) < below, 0.0).otherwise(F.col(LENGTH))).select(RAW_COLUMNS)


def clear_internal_labels(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("label", F.when(F.col("is_tip"), F.col("label")))


def divide_labels(nodes: DataFrame, by: float) -> DataFrame:
    """Numeric inner labels divided by a value, such as a number of trees."""
    number = F.expr("try_cast(label AS double)")
    return nodes.withColumn("label", F.when(F.col("is_tip") | number.isNull(), F.col("label")).otherwise((number / by).cast("string")))


def rename_tips(nodes: DataFrame, changes: list[tuple[str, str]]) -> DataFrame:
    """Tip names by pairs in order: a later pair sees what an earlier one made."""
    final: dict[str, str] = {}
    for old, new in changes:
        for k, v in final.items():
            if v == old:
                final[k] = new
        final.setdefault(old, new)
    if not final:
        return nodes
    known = F.create_map(*[F.lit(x) for kv in final.items() for x in kv])
    return nodes.withColumn("label", F.when(F.col("is_tip"), F.coalesce(F.element_at(known, F.col("label")), F.col("label"))).otherwise(F.col("label")))


def rename_tips_by_table(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Tip names by a table (label, new_label), of any size."""
    named = nodes.join(names.select("label", "new_label").dropDuplicates(["label"]), "label", "left")
    return named.withColumn("label", F.when(F.col("is_tip"), F.coalesce("new_label", "label")).otherwise(F.col("label"))).select(nodes.columns)


def skyline_lengths(nodes: DataFrame, cuts: list[tuple[float, float]]) -> DataFrame:
    """``nodes`` with the lengths of ``skyline_scale``; other columns, root_dist too, stay as they were."""
    return _skyline(nodes, cuts).select(nodes.columns)


def skyline_scale(nodes: DataFrame, cuts: list[tuple[float, float]]) -> DataFrame:
    """Lengths times rates that hold by distance from the root: (cut, rate) up to each cut, 1 beyond the last.

    The root's own branch is left as it is; distances start below it.
    """
    return _skyline(nodes, cuts).select(RAW_COLUMNS)


def _skyline(nodes: DataFrame, cuts: list[tuple[float, float]]) -> DataFrame:
    root = nodes.where("parent_id IS NULL").select("tree_id", _length().alias("own"))
    n = nodes.join(root, "tree_id")
    hi = F.col("root_dist") - F.col("own")
    lo = hi - _length()
    parts, last = [], 0.0
    for cut, rate in sorted(cuts):
        parts.append(F.greatest(F.lit(0.0), F.least(hi, F.lit(cut)) - F.greatest(lo, F.lit(last))) * rate)
        last = cut
    parts.append(F.greatest(F.lit(0.0), hi - F.greatest(lo, F.lit(last))))
    new = parts[0]
    for p in parts[1:]:
        new = new + p
    return n.withColumn(LENGTH, F.when(F.col("parent_id").isNull(), F.col(LENGTH)).otherwise(new))


def clade_scale(nodes: DataFrame, clades: DataFrame) -> DataFrame:
    """Lengths of edges strictly below a set's common ancestor times the set's rate; the innermost clade counts.

    ``clades``: label, set_id, rate, and optionally tree_id.
    """
    return clade_lengths(nodes, clades).select(RAW_COLUMNS)


def clade_lengths(nodes: DataFrame, clades: DataFrame) -> DataFrame:
    """``nodes`` with the lengths of ``clade_scale``; other columns, root_dist too, stay as they were."""
    rated = clade_sets(nodes, clades)
    return rated.withColumn(LENGTH, F.col(LENGTH) * F.coalesce("rate", F.lit(1.0))).select(nodes.columns)


def clade_sets(nodes: DataFrame, clades: DataFrame) -> DataFrame:
    """``nodes`` with set_id and rate of the innermost clade that each branch lies strictly below, null for none."""
    keys = [k for k in ("tree_id", "label") if k in clades.columns]
    top = mrca(nodes, clades.select(*keys, "set_id"))
    rates = clades.select("set_id", "rate", *[k for k in keys if k == "tree_id"]).distinct()
    top = top.join(rates, [c for c in ("tree_id", "set_id") if c in rates.columns])
    # one set for each ancestor, handed down to all that is below it until another one's begins
    own = top.groupBy("tree_id", "node_id").agg(F.max_by(F.struct("set_id", "rate"), "set_id").alias("own"))
    rows = nodes.join(own, ["tree_id", "node_id"], "left").select(*nodes.columns, F.col("own.set_id").alias("set_id"), F.col("own.rate").cast("double").alias("rate"))

    def run(part: pd.DataFrame, shape: Shape) -> pd.DataFrame:
        has, ruler = part["set_id"].notna().to_numpy(), np.full(len(part), -1)
        for here in shape.levels[1:]:
            up = shape.up[here]
            ruler[here] = np.where(has[up], up, ruler[up])
        out = part.copy()
        of = part["set_id"].to_numpy()
        out["set_id"] = [of[k] if k >= 0 else None for k in ruler]
        out["rate"] = np.where(ruler >= 0, part["rate"].to_numpy(float)[ruler], np.nan)
        return out

    made = whole_trees(rows, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))
    return made.withColumn("rate", F.when(~F.isnan("rate"), F.col("rate")))


def ladderize(nodes: DataFrame, larger_first: bool = True) -> DataFrame:
    """Children ordered by their number of tips; equal ones keep their order."""
    size = F.desc("n_tips") if larger_first else F.asc("n_tips")
    order = F.row_number().over(Window.partitionBy("tree_id", "parent_id").orderBy(size, "pre")) - 1
    return nodes.withColumn("child_ord", order.cast("int")).select(RAW_COLUMNS)


def resolve_polytomies(nodes: DataFrame) -> DataFrame:
    """Binary trees: the first children of a node move below new nodes of length 0, nested to the left."""
    kids = nodes.where("parent_id IS NOT NULL")
    w = Window.partitionBy("tree_id", "parent_id")
    k = kids.withColumn("i", F.row_number().over(w.orderBy("pre"))).withColumn("m", F.count("*").over(w))
    most = nodes.groupBy("tree_id").agg(F.max("node_id").alias("top"))
    # the new nodes: a parent of m children needs m - 2, numbered behind all others
    need = k.where("m > 2 AND i BETWEEN 3 AND m").join(most, "tree_id")
    number = F.row_number().over(Window.partitionBy("tree_id").orderBy("parent_id", F.desc("i")))
    new = need.withColumn("new_id", (F.col("top") + number).cast("int")).select("tree_id", F.col("parent_id").alias("p"), (F.col("i") - 1).alias("level"), "new_id", "m")
    # node for level j holds children 1..j; level m is the parent itself
    inner = new.join(new.select("tree_id", "p", (F.col("level") - 1).alias("level"), F.col("new_id").alias("above")), ["tree_id", "p", "level"], "left")
    inner = inner.select("tree_id", F.col("new_id").alias("node_id"), F.coalesce("above", "p").alias("parent_id"), F.lit(0).alias("child_ord"), F.lit(None).cast("string").alias("label"), F.lit(0.0).alias(LENGTH))
    at = new.select("tree_id", F.col("p").alias("parent_id"), "level", "new_id")
    placed = k.withColumn("level", F.greatest("i", F.lit(2))).join(at, ["tree_id", "parent_id", "level"], "left")
    first = F.when(F.col("i") == 1, 0).otherwise(1)
    moved = placed.select("tree_id", "node_id", F.coalesce("new_id", "parent_id").alias("parent_id"), F.when(F.col("m") > 2, first).otherwise(F.col("child_ord")).cast("int").alias("child_ord"), "label", LENGTH)
    return nodes.where("parent_id IS NULL").select(RAW_COLUMNS).unionByName(moved).unionByName(inner)


# Rooting.


def reroot(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each tree rooted on the branch above a node; trees without a target stay.

    ``targets``: tree_id, node_id, and optionally below, the part of the branch that
    stays on the node's side (half of it by default).  Branches keep their labels: an
    inner label moves to the node that is below its branch now.  A root that is left
    with one child falls away, its two branches become one.  The root as a target, or
    its child without ``below``, changes nothing.
    """
    nodes = _held(nodes)
    t = targets.select("tree_id", F.col("node_id").alias("x"), *([F.col("below")] if "below" in targets.columns else [F.lit(None).cast("double").alias("below")]))
    kids = nodes.where("parent_id IS NOT NULL").groupBy("tree_id", "parent_id").agg(F.count("*").alias("k"))
    roots = nodes.where("parent_id IS NULL").select("tree_id", F.col("node_id").alias("root"), F.col(LENGTH).alias("root_length"))
    roots = roots.join(kids.select("tree_id", F.col("parent_id").alias("root"), "k"), ["tree_id", "root"], "left").join(nodes.groupBy("tree_id").agg(F.max("node_id").alias("top")), "tree_id")
    x = nodes.withColumn("x", F.col("node_id")).join(t, ["tree_id", "x"]).select("tree_id", "x", "below", F.col("pre").alias("xpre"), F.col("depth").alias("xdepth"), F.col("parent_id").alias("xparent"), _length().alias("xlen"), F.when(~F.col("is_tip"), F.col("label")).alias("xlabel"))
    x = x.join(roots, "tree_id").where("x <> root")
    x = x.where(~((F.col("xdepth") == 1) & F.col("below").isNull()))
    x = x.withColumn("binary", F.col("k") == 2)
    n = nodes.join(x, "tree_id", "left")
    path = (F.col("x").isNotNull()) & F.col("xpre").between(F.col("pre"), F.col("last")) & (F.col("node_id") != F.col("x"))
    n = n.withColumn("on_path", F.coalesce(path, F.lit(False)))
    w = Window.partitionBy("tree_id", "on_path").orderBy("depth")
    # what the path's next lower node hands up: its id, length and label
    low = F.struct(F.lead("node_id").over(w).alias("id"), F.lead(_length()).over(w).alias("len"), F.lead("label").over(w).alias("label"))
    n = _held(n.withColumn("low", F.when(F.col("on_path"), low)))
    same_edge = (F.col("xdepth") == 1) & F.col("binary")
    whole = n.where("x IS NULL").select(RAW_COLUMNS)
    c = n.where("x IS NOT NULL")
    # rebalancing a branch that already carries the root
    other = c.where(same_edge & (F.col("depth") == 1) & (F.col("node_id") != F.col("x"))).select("tree_id", F.col(LENGTH).alias("other_length"))
    still = c.where(same_edge).join(other, "tree_id")
    still_length = F.when(F.col("node_id") == F.col("x"), F.col("below")).when(F.col("depth") == 1, F.col("xlen") + F.coalesce("other_length", F.lit(0.0)) - F.col("below")).otherwise(F.col(LENGTH))
    still = still.select("tree_id", "node_id", "parent_id", "child_ord", "label", still_length.alias(LENGTH))
    m = c.where(~same_edge)
    gone = F.col("binary") & (F.col("depth") == 0)
    # below a root that falls away: the child off the path hangs on the child on it
    top = m.where(F.col("on_path") & (F.col("depth") == 1)).select("tree_id", F.col("node_id").alias("path_child"), _length().alias("path_length"))
    m = m.join(top, "tree_id", "left")
    orphan = F.col("binary") & (F.col("depth") == 1) & ~F.col("on_path") & (F.col("node_id") != F.col("x"))
    root_id = F.when(F.col("binary"), F.col("root")).otherwise(F.col("top") + 1).cast("int")
    split = F.coalesce("below", F.col("xlen") / 2)
    deepest = F.col("on_path") & (F.col("depth") == F.col("xdepth") - 1)
    parent = F.when(F.col("node_id") == F.col("x"), root_id).when(deepest, root_id).when(F.col("on_path"), F.col("low.id")).when(orphan, F.col("path_child")).otherwise(F.col("parent_id"))
    length = F.when(F.col("node_id") == F.col("x"), split).when(deepest, F.col("xlen") - split).when(F.col("on_path"), F.col("low.len")).when(orphan, _length() + F.col("path_length")).otherwise(F.col(LENGTH))
    label = F.when(deepest, F.col("xlabel")).when(F.col("on_path"), F.col("low.label")).otherwise(F.col("label"))
    order = F.when(F.col("node_id") == F.col("x"), 0).when(F.col("on_path"), 1 << 20).when(orphan, 1 << 21).otherwise(F.col("child_ord"))
    moved = m.where(~gone).select("tree_id", "node_id", parent.cast("int").alias("parent_id"), order.cast("int").alias("child_ord"), label.alias("label"), length.alias(LENGTH))
    fresh = m.where("depth = 0").select("tree_id", root_id.alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("child_ord"), F.lit(None).cast("string").alias("label"), F.col("root_length").alias(LENGTH))
    return whole.unionByName(still).unionByName(moved).unionByName(fresh)


def outgroup_root(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """Rooted on the branch above the common ancestor of the named tips."""
    nodes = _held(nodes)
    return reroot(nodes, mrca(nodes, taxa).select("tree_id", "node_id"))


def relaxed_outgroup_root(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """Rooted on the branch that best sets the named tips apart."""
    nodes = _held(nodes)
    return reroot(nodes, relaxed_outgroup(nodes, taxa).select("tree_id", "node_id"))


def _middle(rows: pd.DataFrame, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each tree with two tips or more: the row whose branch holds the middle of its longest path, the part of the branch below it, the path."""
    dist, at = rows["root_dist"].to_numpy(float), np.arange(len(rows))
    # the furthest tip below each node, of equally far ones the leftmost: the highest rank
    order = np.lexsort((-at, dist))
    rank = np.empty(len(rows), np.int64)
    rank[order] = at
    tip = order[shape.fold(np.where(rows["is_tip"].to_numpy(bool), rank, -1), np.maximum)]
    far = dist[tip]
    # the two furthest children of each node, side by side
    kids = np.flatnonzero(shape.up >= 0)
    kids = kids[np.lexsort((kids, -far[kids], shape.up[kids]))]
    first = np.flatnonzero(np.append(True, shape.up[kids][1:] != shape.up[kids][:-1])) if len(kids) else kids
    first = first[first + 1 < len(kids)]
    one, two = kids[first], kids[first + 1]
    pair = shape.up[one] == shape.up[two]
    one, two = one[pair], two[pair]
    top = shape.up[one]
    path = far[one] + far[two] - 2 * dist[top]
    best = np.lexsort((-top, path, shape.tree[top]))
    best = best[np.append(shape.tree[top[best]][1:] != shape.tree[top[best]][:-1], True)] if len(best) else best
    one, top, path = one[best], top[best], path[best]
    middle = far[one] - path / 2
    here, found = tip[one], np.full(len(one), -1)
    while (live := here != top).any():
        found = np.where(live & (dist[here] >= middle), here, found)
        here = np.where(live, shape.up[here], here)
    ok = found >= 0
    return found[ok], dist[found[ok]] - middle[ok], path[ok]


def midpoints(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, below, path): the branch with the middle of the longest path between two tips."""

    def run(rows: pd.DataFrame, shape: Shape) -> pd.DataFrame:
        at, below, path = _middle(rows, shape)
        return rows.iloc[at][["tree_id", "node_id"]].assign(below=below, path=path)

    return whole_trees(nodes.select("tree_id", "node_id", "pre", "depth", "root_dist", "is_tip"), run, "tree_id long, node_id int, below double, path double")


def midpoint_root(nodes: DataFrame) -> DataFrame:
    nodes = _held(nodes)
    return reroot(nodes, midpoints(nodes).where("path > 0"))


# Removing and adding.


def _on_tips(part: pd.DataFrame, shape: Shape, tip: np.ndarray) -> pd.DataFrame:
    """Raw rows of the trees on some of their tips."""
    dist, ids = part["root_dist"].to_numpy(), part["node_id"].to_numpy()
    held = shape.fold(tip.astype(np.int64), np.add) > 0
    kids = np.bincount(shape.up[held & (shape.up >= 0)], minlength=len(part))
    stays = tip | (kids >= 2)
    above = np.full(len(part), -1)  # the nearest node above that stays
    for here in shape.levels[1:]:
        p = shape.up[here]
        above[here] = np.where(stays[p], p, above[p])
    length = dist - np.where(above >= 0, dist[above], 0.0)
    parent = pd.array(np.where(above >= 0, ids[above], 0), dtype="Int32")
    parent[above < 0] = pd.NA
    made = part[["tree_id", "node_id"]].assign(parent_id=parent, child_ord=part["pre"], label=part["label"], branch_length=length)
    return made[stays]


def keep_tips(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """Trees on the kept tips (tree_id, node_id): nodes left with one child fall away, lengths add up."""
    flag = kept.select("tree_id", "node_id").distinct().withColumn("kept", F.lit(True))
    rows = nodes.select("tree_id", "node_id", "pre", "depth", "label", "root_dist", "is_tip").join(flag, ["tree_id", "node_id"], "left")
    rows = rows.withColumn("kept", F.col("is_tip") & F.col("kept").isNotNull())
    return whole_trees(rows, lambda part, shape: _on_tips(part, shape, part["kept"].to_numpy()), RAW)


def drop_tips(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """Trees without the named tips; a tree of nothing else disappears."""
    nodes = _held(nodes)
    keys = [k for k in ("tree_id", "label") if k in taxa.columns]
    return keep_tips(nodes, tips(nodes).join(taxa, keys, "left_anti"))


def _drop_short(rows: pd.DataFrame, below: float) -> list[int]:
    """Tips to drop from one tree, one after the other from the left, lengths adding up as nodes fall away."""
    parent = dict(zip(rows["node_id"], rows["parent_id"], strict=True))
    length = dict(zip(rows["node_id"], rows["branch_length"].fillna(0.0), strict=True))
    kids: dict[int, list[int]] = {}
    for i, p in zip(rows["node_id"], rows["parent_id"], strict=True):
        if pd.notna(p):
            kids.setdefault(int(p), []).append(i)
    dropped = []
    for tip in rows.loc[rows["is_tip"], "node_id"]:  # in preorder
        p = parent[tip]
        if length[tip] >= below or pd.isna(p):
            continue
        dropped.append(int(tip))
        kids[int(p)].remove(tip)
        if len(kids[int(p)]) == 1:
            (only,) = kids.pop(int(p))
            length[only] += length[p]
            parent[only] = parent[p]
            if pd.notna(parent[p]):
                siblings = kids[int(parent[p])]
                siblings[siblings.index(p)] = only
    return dropped


def drop_tips_on_short_branches(nodes: DataFrame, below: float) -> DataFrame:
    """Trees after dropping, from left to right, each tip whose branch is then shorter than a value."""

    nodes = _held(nodes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        gone = _drop_short(rows, below)
        return pd.DataFrame({"tree_id": [rows["tree_id"].iloc[0]] * len(gone), "node_id": gone})

    gone = _held(per_tree(nodes.select("tree_id", "node_id", "parent_id", "branch_length", "is_tip", "pre"), run, "tree_id long, node_id int"))
    return keep_tips(nodes, tips(nodes).join(gone, ["tree_id", "node_id"], "left_anti"))


def prune_clade(nodes: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is left, the clades): each tree cut above a node (tree_id, node_id)."""
    nodes = _held(nodes)
    t = targets.select("tree_id", "node_id")
    top = nodes.join(t, ["tree_id", "node_id"], "left_semi").alias("a")
    below = nodes.alias("x").join(top.alias("a"), inside()).select("x.*", F.col("a.node_id").alias("cut"))
    clade = below.withColumn("parent_id", F.when(F.col("node_id") != F.col("cut"), F.col("parent_id"))).select(RAW_COLUMNS)
    rest = keep_tips(nodes, tips(nodes).join(below, ["tree_id", "node_id"], "left_anti"))
    return rest, clade


def add_node_on_branch(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """A new tip (tree_id, node_id, label, tip_length) on the middle of the branch above each node."""
    n = nodes.join(targets.select("tree_id", "node_id", F.col("label").alias("new_label"), "tip_length"), ["tree_id", "node_id"], "left")
    most = nodes.groupBy("tree_id").agg(F.max("node_id").alias("top"))
    i = F.row_number().over(Window.partitionBy("tree_id").orderBy("node_id"))
    new = n.where("new_label IS NOT NULL AND parent_id IS NOT NULL").join(most, "tree_id").withColumn("joint", (F.col("top") + 2 * i - 1).cast("int"))
    joint = new.select("tree_id", F.col("joint").alias("node_id"), "parent_id", "child_ord", F.lit(None).cast("string").alias("label"), (_length() / 2).alias(LENGTH))
    tip = new.select("tree_id", (F.col("joint") + 1).alias("node_id"), F.col("joint").alias("parent_id"), F.lit(1).alias("child_ord"), F.col("new_label").alias("label"), F.col("tip_length").alias(LENGTH))
    hung = n.join(new.select("tree_id", "node_id", "joint"), ["tree_id", "node_id"], "left")
    old = hung.select("tree_id", "node_id", F.coalesce("joint", "parent_id").alias("parent_id"), F.when(F.col("joint").isNotNull(), 0).otherwise(F.col("child_ord")).alias("child_ord"), "label", F.when(F.col("joint").isNotNull(), _length() / 2).otherwise(F.col(LENGTH)).alias(LENGTH))
    return old.unionByName(joint).unionByName(tip)


def _interchanges(nodes: DataFrame, branch: int | None = None) -> DataFrame:
    """(tree_id, alt, x, q, c, s, c_ord, s_ord, ...): the interchanges of ``nearest_neighbours``, a row each: c of x and s of q change places."""
    b = unrooted_branches(nodes).withColumn("number", F.row_number().over(Window.partitionBy("tree_id").orderBy("pre")))
    b = b.where(~F.col("is_tip"))
    if branch is not None:
        b = b.where(F.col("number") == branch)
    w = Window.partitionBy("tree_id", "parent_id")
    kids = nodes.where("parent_id IS NOT NULL").withColumn("i", F.row_number().over(w.orderBy("pre"))).withColumn("m", F.count("*").over(w)).select("tree_id", "node_id", "parent_id", "child_ord", "i", "m")
    x = b.select("tree_id", F.col("node_id").alias("x"), F.col("parent_id").alias("p"), "depth", "number")
    c = kids.where("i <= 2").select("tree_id", F.col("parent_id").alias("x"), F.col("node_id").alias("c"), F.col("child_ord").alias("c_ord"), "i")
    s = kids.select("tree_id", F.col("parent_id").alias("p"), F.col("node_id").alias("s"), F.col("child_ord").alias("s_ord"), "i", "m")
    near = x.join(s.withColumnRenamed("i", "j"), ["tree_id", "p"]).where("s <> x")
    first = near.where("NOT (depth = 1 AND m = 2)").groupBy("tree_id", "x", "p", "number").agg(F.min_by(F.struct("s", "s_ord"), "j").alias("o")).select("tree_id", "x", F.col("p").alias("q"), "number", "o.*")
    # over the root: the other side's first child takes part
    over = near.where("depth = 1 AND m = 2").select("tree_id", "x", F.col("s").alias("q"), "number").join(kids.where("i = 1").select("tree_id", F.col("parent_id").alias("q"), F.col("node_id").alias("s"), F.col("child_ord").alias("s_ord")), ["tree_id", "q"])
    swap = first.unionByName(over.select("tree_id", "x", "q", "number", "s", "s_ord")).join(c, ["tree_id", "x"])
    return swap.withColumn("alt", (2 * F.col("number") + F.col("i") - 2).cast("int"))


def nearest_neighbours(nodes: DataFrame, branch: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """All trees one interchange away: raw columns and alt (two per inner branch), tree_id staying the source's.

    Across the branch above x, a child of x changes places with a sibling of x; over a
    root of two children the sides of the root are the branch's two ends.  ``branch``:
    only that branch, by its number among the unrooted ones.  ``only``: the (tree_id, alt) to make.
    """
    swap = _interchanges(nodes, branch)
    if only is not None:
        swap = swap.join(only, ["tree_id", "alt"], "left_semi")
    n = nodes.join(swap, "tree_id")
    parent = F.when(F.col("node_id") == F.col("c"), F.col("q")).when(F.col("node_id") == F.col("s"), F.col("x")).otherwise(F.col("parent_id"))
    order = F.when(F.col("node_id") == F.col("c"), F.col("s_ord")).when(F.col("node_id") == F.col("s"), F.col("c_ord")).otherwise(F.col("child_ord"))
    return n.select("tree_id", "alt", "node_id", parent.alias("parent_id"), order.alias("child_ord"), "label", LENGTH)


def random_neighbour(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """Raw trees one interchange away, for each tree one of its alternatives by a hash of (seed, tree)."""
    pick = _interchanges(nodes).groupBy("tree_id").agg(F.min_by("alt", F.xxhash64(F.lit(seed), "tree_id", "alt")).alias("alt"))
    return nearest_neighbours(nodes, only=by_sorting(pick)).select(RAW_COLUMNS)


def _cuts(rows: pd.DataFrame, shape: Shape, by: str, rooted: bool) -> np.ndarray:
    """The rows above which trees are cut in two, one of each tree that can be cut."""
    if by == "midpoint":
        return _middle(rows, shape)[0]
    length, depth = rows[LENGTH].to_numpy(float), rows["depth"].to_numpy()
    rank, can, away = np.where(np.isnan(length), -np.inf, length), shape.up >= 0, np.ones(len(rows), bool)
    if not rooted:
        # the two branches at a root of two children are one, cut on the side of fewer tips
        top = np.flatnonzero(depth == 1)
        top = top[np.bincount(shape.tree[top], minlength=len(shape.starts))[shape.tree[top]] == 2]
        left, right = top[::2], top[1::2]
        tips_below = rows["n_tips"].to_numpy()
        small = np.where(tips_below[right] < tips_below[left], right, left)
        can[left + right - small] = False
        rank[small] = np.nan_to_num(length[left]) + np.nan_to_num(length[right])
        away[small] = False
    at = np.flatnonzero(can)
    # of equally long branches one away from the root is cut, then the shallower, then the leftmost
    at = at[np.lexsort((-at, -depth[at], away[at], rank[at], shape.tree[at]))]
    return at[np.append(shape.tree[at][1:] != shape.tree[at][:-1], True)] if len(at) else at


def _indexed(raw: pd.DataFrame) -> pd.DataFrame:
    """Raw rows of whole trees with their index columns, in preorder."""
    parent = raw["parent_id"].fillna(-1).to_numpy("int64")
    found = index_columns(raw["tree_id"].to_numpy(), raw["node_id"].to_numpy(), parent, raw["child_ord"].fillna(0).to_numpy(float), raw[LENGTH].to_numpy(float))
    return raw.assign(**found).sort_values(["tree_id", "pre"], ignore_index=True)


def split_trees(nodes: DataFrame, pieces: int | None = None, by: str = "longest", choose: str = "tips", stop_tips: int = 1, rooted: bool = True, max_tips: int | None = None) -> DataFrame:
    """Each tree cut again and again, into ``pieces`` parts or until no part has more than ``max_tips`` tips.

    A cut is at the longest branch (``rooted``: a root's two branches count each, else
    as one) or at the midpoint (``by``).  With ``pieces``, one part of each tree is cut
    at a time, that with most tips or with the longest branch (``choose``); with
    ``max_tips`` all parts that are too large are cut at once, as their order doesn't
    matter.  Parts of ``stop_tips`` tips or fewer, and those that can't be cut, stay.
    One shuffle by tree: the rounds run over all trees of a batch inside a task.
    Returns (source, tree_id, part, raw and index columns).
    """
    if (pieces is None) == (max_tips is None):
        raise ValueError("either pieces or max_tips")
    columns = [c for c in COLUMNS if c != "tree_id"]
    limit = max(stop_tips, max_tips or 0)

    def run(rows: pd.DataFrame, shape: Shape) -> pd.DataFrame:
        sources, top = rows["tree_id"].to_numpy()[shape.starts], np.zeros(len(shape.starts), np.int64)
        ids = {c: "Int32" for c in ("parent_id", "child_ord")}
        rows = rows.assign(tree_id=shape.tree.astype(np.int64) << 32).astype(ids)  # in here: place of the source, part
        whole = []
        for _ in count() if pieces is None else range(1, pieces):
            cut = _cuts(rows, shape, by, rooted)
            cut = cut[rows["n_tips"].to_numpy()[shape.starts[shape.tree[cut]]] > limit]
            if max_tips is None and len(cut):
                if choose == "tips":
                    rank = rows["n_tips"].to_numpy(float)[shape.starts]
                else:
                    length = rows[LENGTH].to_numpy(float)
                    rank = np.maximum.reduceat(np.where((shape.up < 0) | np.isnan(length), -np.inf, length), shape.starts)
                source = rows["tree_id"].to_numpy()[cut] >> 32
                order = np.lexsort((-cut, rank[shape.tree[cut]], source))
                cut = np.sort(cut[order[np.append(source[order][1:] != source[order][:-1], True)]])
            if not len(cut):
                break
            key = rows["tree_id"].to_numpy()
            hit = np.isin(shape.tree, shape.tree[cut])
            first = np.full(len(shape.starts), -1)
            first[shape.tree[cut]] = cut
            start, own = first[shape.tree], np.arange(len(rows)) - shape.starts[shape.tree]
            inside_cut = hit & (own >= rows["pre"].to_numpy()[start]) & (own <= rows["last"].to_numpy()[start])
            rest = _on_tips(rows, shape, rows["is_tip"].to_numpy(bool) & hit & ~inside_cut)
            # new parts are numbered behind the source's others, in the order of the parts cut
            source = key[cut] >> 32
            nth = np.arange(len(cut)) - np.searchsorted(source, source) + 1
            fresh = np.zeros(len(shape.starts), np.int64)
            fresh[shape.tree[cut]] = source << 32 | top[source] + nth
            np.maximum.at(top, source, top[source] + nth)
            clade = rows.loc[inside_cut, RAW_COLUMNS].assign(tree_id=fresh[shape.tree[inside_cut]])
            clade["parent_id"] = clade["parent_id"].where(np.flatnonzero(inside_cut) != start[inside_cut])
            same = rows[~hit]
            made = _indexed(pd.concat([rest.astype(ids), clade], ignore_index=True))
            if max_tips is None:
                rows = pd.concat([same, made], ignore_index=True).sort_values(["tree_id", "pre"], ignore_index=True)
            else:  # what isn't cut now never is
                whole.append(same)
                rows = made
            shape = Shape(rows["tree_id"].to_numpy(), rows["depth"].to_numpy())
        out = pd.concat([*whole, rows], ignore_index=True)
        key = out["tree_id"].to_numpy(np.int64)
        return out.assign(source=sources[key >> 32], part=key & 0xFFFFFFFF)[["source", "part", *columns]]

    parts = whole_trees(nodes.select(COLUMNS), run, f"source long, part int, {NODES.removeprefix('tree_id long, ')}")
    return parts.select("source", F.xxhash64("source", "part").alias("tree_id"), "part", *columns)


def mean_path_ages(nodes: DataFrame, ages: DataFrame, n_char: float = 1.0) -> DataFrame:
    """Node ages by mean path lengths, adjusted between calibrations: (tree_id, node_id, mean_path, age, rate).

    ``ages``: tree_id, node_id, age of some nodes.  A calibrated node rules the nodes
    below it down to the next calibrated ones.  Its rate is the mean path to the ends
    of its section (tips, and calibrated nodes, counted with their tips; a path that
    ends at age e of a section of age a is stretched by a / (a - e)) over its age.  A
    node inside takes its mean path to those ends, with rate * age added at calibrated
    ones, over the rate.  A section without a calibration above takes the median of its
    tree's rates; a tree without any has no rows.  A calibration that is not younger
    than the one above it is ignored, ages of 0 or less as well.  mean_path: to all tips
    below; rate: expected changes per character and time on the branch above.
    """
    given = ages.where("age > 0").groupBy("tree_id", "node_id").agg(F.max("age").alias("given"))
    rows = nodes.select("tree_id", "node_id", "pre", "depth", "n_tips", "is_tip", _length().alias("length"), "root_dist").join(given, ["tree_id", "node_id"], "left")

    def run(part: pd.DataFrame, shape: Shape) -> pd.DataFrame:
        length, n = part["length"].to_numpy(float), part["n_tips"].to_numpy(float)
        tip, age, up = part["is_tip"].to_numpy(), part["given"].to_numpy(float).copy(), shape.up
        age[tip] = np.nan
        dist = part["root_dist"].to_numpy(float)
        mean_path = (shape.fold(np.where(tip, dist, 0.0), np.add) - n * dist) / n
        ruler = np.where(np.isnan(age), -1, np.arange(len(age)))  # the nearest calibrated node, the node itself included
        above = np.full(len(age), np.nan)  # the age of the section that a node ends or is inside of
        for here in shape.levels[1:]:
            over = ruler[up[here]]
            above[here] = np.where(over >= 0, age[over], np.nan)
            age[here] = np.where(age[here] >= above[here], np.nan, age[here])
            ruler[here] = np.where(np.isnan(age[here]), over, here)
        end = tip | ~np.isnan(age)
        end_age = np.where(np.isnan(age), 0.0, age)
        stretch = np.where(np.isnan(above), 1.0, above / (above - end_age))
        path, aged, stretched, weight = (np.zeros(len(age)) for _ in range(4))
        for here in reversed(shape.levels[1:]):
            e = end[here]
            w = np.where(e, n[here] * stretch[here], weight[here])
            np.add.at(path, up[here], np.where(e, 0.0, path[here]) + length[here] * n[here])
            np.add.at(aged, up[here], np.where(e, n[here] * end_age[here], aged[here]))
            np.add.at(stretched, up[here], np.where(e, 0.0, stretched[here]) + length[here] * w)
            np.add.at(weight, up[here], w)
        held = np.flatnonzero(~np.isnan(age))
        rate = np.full(len(age), np.nan)
        rate[held] = stretched[held] / n[held] / age[held]
        rate[held[rate[held] <= 0]] = np.nan
        middle = pd.Series(rate[held]).groupby(shape.tree[held]).median().reindex(range(len(shape.starts))).to_numpy()
        r = np.where(ruler >= 0, rate[ruler], middle[shape.tree])
        r = np.where(np.isnan(r), middle[shape.tree], r)
        made = np.where(np.isnan(age), (path + r * aged) / n / r, age)
        made[tip & ~np.isnan(r)] = 0.0
        over = np.where(up >= 0, made[up], np.nan)
        on_branch = np.where(over > made, length / (n_char * np.where(over > made, over - made, 1)), np.nan)
        return part[["tree_id", "node_id"]].assign(mean_path=mean_path, age=made, rate=on_branch)[~np.isnan(r)]

    out = whole_trees(rows, run, "tree_id long, node_id int, mean_path double, age double, rate double")
    return out.select("tree_id", "node_id", "mean_path", "age", F.when(~F.isnan("rate"), F.col("rate")).alias("rate"))
