"""Measures and projections of trees: they read the node table and change nothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cladeframe.schema import Shape, fold_clades, whole_trees


def support() -> Column:
    """An inner node's label as a number, where it is one."""
    return F.expr("try_cast(label AS double)")


def tips(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_tip")


def tip_count(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tree_id").agg(F.count_if("is_tip").alias("n_tips"))


def node_count(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tree_id").agg(F.count("*").alias("n_nodes"))


def tree_length(nodes: DataFrame) -> DataFrame:
    """Sum of all branch lengths, the root's included."""
    return nodes.groupBy("tree_id").agg(F.sum("branch_length").alias("tree_length"))


def tree_depth(nodes: DataFrame) -> DataFrame:
    """Largest distance from the root to a tip, the root's branch included."""
    return tips(nodes).groupBy("tree_id").agg(F.max("root_dist").alias("tree_depth"))


def inside(a: str = "a", x: str = "x") -> Column:
    """Row ``x`` lies in the clade of row ``a``."""
    return (F.col(f"{a}.tree_id") == F.col(f"{x}.tree_id")) & F.col(f"{x}.pre").between(F.col(f"{a}.pre"), F.col(f"{a}.last"))


def shortest_to_tip(nodes: DataFrame) -> DataFrame:
    """Per node, the shortest way to a tip below it, its own branch included."""
    below = fold_clades(nodes, ["tree_id", "node_id", "root_dist", "branch_length"], nearest=(F.when(F.col("is_tip"), F.col("root_dist")), "min"))
    return below.select("tree_id", "node_id", (F.col("nearest") - F.col("root_dist") + F.coalesce("branch_length", F.lit(0.0))).alias("shortest"))


def furthest_tip(nodes: DataFrame) -> DataFrame:
    """The tip furthest from the root; of equally far ones the rightmost."""
    best = F.max_by(F.struct("label", "root_dist"), F.struct("root_dist", "pre")).alias("best")
    return tips(nodes).groupBy("tree_id").agg(best).select("tree_id", "best.label", F.col("best.root_dist").alias("distance"))


def tip_root_distance(nodes: DataFrame) -> DataFrame:
    """Per tip, the inner nodes between it and the root, and its distance without the root's branch."""
    root = nodes.where("parent_id IS NULL").select("tree_id", F.coalesce("branch_length", F.lit(0.0)).alias("root_length"))
    return tips(nodes).join(root, "tree_id").select("tree_id", "label", (F.col("depth") - 1).alias("nodes_between"), (F.col("root_dist") - F.col("root_length")).alias("distance"))


def patristic_sum(nodes: DataFrame) -> DataFrame:
    """Per tip, the sum of its distances to all other tips.

    Not by pairs: with n tips, tip x and k(e) tips below edge e, the sum is
    sum over x's ancestors e of len(e) * (n - 2 k(e)) plus the sum over all e of
    len(e) * k(e); the root's branch lies between no tips.
    """
    length = F.when(F.col("parent_id").isNotNull(), F.coalesce("branch_length", F.lit(0.0))).otherwise(0.0)

    def run(rows: pd.DataFrame, shape: Shape) -> pd.DataFrame:
        below, own = rows["n_tips"].to_numpy(), rows["length"].to_numpy()
        n = below[shape.starts][shape.tree]
        sums = shape.path_sum(own * (n - 2 * below)) + shape.total(own * below)
        return rows[["tree_id", "label"]].assign(distance_sum=sums)[rows["is_tip"].to_numpy()]

    rows = nodes.select("tree_id", "pre", "depth", "n_tips", "is_tip", F.when(F.col("is_tip"), F.col("label")).alias("label"), length.alias("length"))
    return whole_trees(rows, run, "tree_id long, label string, distance_sum double")


def pair_distance(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (tree_id, a, b: tip labels) with the path length between the two."""
    t = tips(nodes).select("tree_id", "label", "pre", "root_dist")
    both = pairs.join(t.select("tree_id", F.col("label").alias("a"), F.col("pre").alias("pa"), F.col("root_dist").alias("da")), ["tree_id", "a"]).join(t.select("tree_id", F.col("label").alias("b"), F.col("pre").alias("pb"), F.col("root_dist").alias("db")), ["tree_id", "b"])
    common = both.alias("p").join(nodes.alias("n"), (F.col("p.tree_id") == F.col("n.tree_id")) & F.least("pa", "pb").between(F.col("n.pre"), F.col("n.last")) & F.greatest("pa", "pb").between(F.col("n.pre"), F.col("n.last")))
    return common.groupBy("p.tree_id", "a", "b").agg((F.max("da") + F.max("db") - 2 * F.max_by("n.root_dist", "n.depth")).alias("distance"))


def all_pair_distances(nodes: DataFrame) -> DataFrame:
    """(tree_id, a, b, distance): each pair of a tree's tips once, by a pass over whole trees.

    A node's tips are consecutive in preorder, so the distance of two tips follows from the
    least depth of what stands between them; rows are made per tip, not per pair of nodes.
    """
    rows = nodes.select("tree_id", "pre", "depth", "last", "is_tip", "label", "root_dist")

    def run(part: pd.DataFrame, shape: Shape) -> pd.DataFrame:
        tip, dist, label = part["is_tip"].to_numpy(), part["root_dist"].to_numpy(float), part["label"].to_numpy()
        pre, last, depth = (part[c].to_numpy() for c in ("pre", "last", "depth"))
        # where each tip meets the next one of its tree: going up from it until a clade holds that one
        own = np.flatnonzero(tip)
        same = shape.tree[own[1:]] == shape.tree[own[:-1]]
        meets = np.where(same, own[:-1], -1)
        live = np.flatnonzero(same)
        while len(live):
            meets[live] = shape.up[meets[live]]
            live = live[last[meets[live]] < pre[own[live + 1]]]
        # tips further apart meet at the highest of what is between
        x, joint = np.flatnonzero(same), meets[same]
        first, second, joints = [], [], []
        k = 1
        while len(x):
            first.append(own[x])
            second.append(own[x + k])
            joints.append(joint)
            k += 1
            on = x + k < len(own)
            x, joint = x[on], joint[on]
            on = shape.tree[own[x]] == shape.tree[own[x + k]]
            x, joint = x[on], joint[on]
            more = meets[x + k - 1]
            joint = np.where(depth[more] < depth[joint], more, joint)
        a, b, joint = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (first, second, joints))
        return pd.DataFrame({"tree_id": part["tree_id"].to_numpy()[a], "a": label[a], "b": label[b], "distance": dist[a] + dist[b] - 2 * dist[joint]})

    return whole_trees(rows, run, "tree_id long, a string, b string, distance double")


def branch_lengths(nodes: DataFrame, root: bool = False) -> DataFrame:
    """Branch lengths in postorder as one array per tree."""
    rows = nodes if root else nodes.where("parent_id IS NOT NULL")
    listed = F.sort_array(F.collect_list(F.struct("last", (-F.col("pre")).alias("up"), "branch_length")))
    return rows.groupBy("tree_id").agg(F.transform(listed, lambda x: x["branch_length"]).alias("branch_lengths"))


def tip_names(nodes: DataFrame, separator: str = ",") -> DataFrame:
    """Tip labels from left to right."""
    listed = F.sort_array(F.collect_list(F.struct("pre", "label")))
    return tips(nodes).groupBy("tree_id").agg(F.array_join(F.transform(listed, lambda x: x["label"]), separator).alias("tip_names"))


def mrca(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """The nodes that are most recent common ancestors of each set of ``taxa``.

    ``taxa``: label and optionally tree_id and set_id.  Labels that a tree lacks are
    ignored; a tree with none of them has no row.
    """
    keys = [k for k in ("tree_id", "label") if k in taxa.columns]
    sets = ["set_id"] if "set_id" in taxa.columns else []
    span = tips(nodes).join(taxa.select(*keys, *sets).distinct(), keys).groupBy("tree_id", *sets).agg(F.min("pre").alias("lo"), F.max("pre").alias("hi"), F.count("*").alias("n_named"))
    n, s = nodes.alias("n"), span.alias("s")
    covers = (F.col("n.tree_id") == F.col("s.tree_id")) & (F.col("n.pre") <= F.col("s.lo")) & (F.col("n.last") >= F.col("s.hi"))
    best = F.max_by(F.struct("n.node_id", "n.pre", "n.last", "n.depth", "n.n_tips", "n.root_dist", "n.branch_length"), "n.depth").alias("m")
    found = n.join(s, covers).groupBy("s.tree_id", *[f"s.{c}" for c in sets]).agg(best, F.max("s.n_named").alias("n_named"))
    return found.select("tree_id", *sets, "m.*", "n_named")


def clade_members(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """Tips below the most recent common ancestor of ``taxa``."""
    a = mrca(nodes, taxa).alias("a")
    return tips(nodes).alias("x").join(a, inside()).select("x.tree_id", *(["a.set_id"] if "set_id" in taxa.columns else []), "x.label")


def stem_clade_members(nodes: DataFrame, ingroup: DataFrame, outgroup: DataFrame) -> DataFrame:
    """Tips of the most inclusive clade with all of ``ingroup`` and none of ``outgroup``."""
    keys = lambda d: [k for k in ("tree_id", "label") if k in d.columns]
    out = tips(nodes).join(outgroup, keys(outgroup), "left_semi").select("tree_id", "pre")
    span = tips(nodes).join(ingroup, keys(ingroup), "left_semi").groupBy("tree_id").agg(F.min("pre").alias("lo"), F.max("pre").alias("hi"))
    n = nodes.select("tree_id", "node_id", "pre", "last", "depth").join(span, "tree_id").where("pre <= lo AND last >= hi")
    clean = n.alias("a").join(out.alias("x"), inside(), "left_anti")
    widest = clean.groupBy("tree_id").agg(F.min_by(F.struct("pre", "last"), "depth").alias("w")).select("tree_id", "w.*")
    return tips(nodes).alias("x").join(widest.alias("a"), inside()).select("x.tree_id", "x.label")


def is_monophyletic(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """Whether the clade of the named tips holds nothing else; a tree without them has no row."""
    sets = ["set_id"] if "set_id" in taxa.columns else []
    return mrca(nodes, taxa).select("tree_id", *sets, (F.col("n_tips") == F.col("n_named")).alias("monophyletic"))


def complement(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """Per tree, the tips that ``taxa`` does not name."""
    return tips(nodes).join(taxa, [k for k in ("tree_id", "label") if k in taxa.columns], "left_anti").select("tree_id", "label")


def taxa_present(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    return tips(nodes).join(taxa, [k for k in ("tree_id", "label") if k in taxa.columns], "left_semi").select("tree_id", "label")


def n_supported(nodes: DataFrame, above: float) -> DataFrame:
    """Inner nodes whose numeric label is above a value."""
    return nodes.groupBy("tree_id").agg(F.count_if(~F.col("is_tip") & (support() > above)).alias("n_supported"))


def log_clade_credibility(nodes: DataFrame) -> DataFrame:
    """Sum of the logarithms of inner labels; labels of 0 and others than numbers add nothing."""
    return nodes.groupBy("tree_id").agg(F.coalesce(F.sum(F.when(~F.col("is_tip") & (support() > 0), F.ln(support()))), F.lit(0.0)).alias("log_credibility"))


def node_label_stats(nodes: DataFrame, above: float = 0.0, value: Column | None = None) -> DataFrame:
    """Figures of inner labels (or of ``value``, such as an annotation) that are numbers."""
    v = (support() if value is None else value).alias("v")
    rows = nodes.where(~F.col("is_tip")).select("tree_id", v).where("v IS NOT NULL")
    return rows.groupBy("tree_id").agg(F.sum("v").alias("sum"), F.product("v").alias("product"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_pop("v").alias("sd"), F.count_if(F.col("v") > above).alias("n_above"), F.max("v").alias("max"), F.min("v").alias("min"), F.count("*").alias("n"))


def gamma_statistic(nodes: DataFrame) -> DataFrame:
    """Pybus and Harvey's gamma from the inner nodes' distances and the tallest tip's; null below three."""
    root = nodes.where("parent_id IS NULL").select("tree_id", F.coalesce("branch_length", F.lit(0.0)).alias("own"))
    flat = nodes.join(root, "tree_id").select("tree_id", "is_tip", (F.col("root_dist") - F.col("own")).alias("h"), "pre")
    top = flat.where("is_tip").groupBy("tree_id").agg(F.max("h").alias("h")).select("tree_id", "h", F.lit(2**31 - 1).alias("pre"))
    w = Window.partitionBy("tree_id").orderBy("h", "pre")
    heights = flat.where(~F.col("is_tip")).select("tree_id", "h", "pre").unionByName(top)
    steps = heights.select("tree_id", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("tree_id")).alias("n"), (F.col("h") - F.lag("h").over(w)).alias("g"))
    part = steps.where("i >= 1").withColumn("t", (F.col("i") + 1) * F.col("g"))
    run = part.withColumn("c", F.sum("t").over(Window.partitionBy("tree_id").orderBy("i")))
    sums = run.groupBy("tree_id").agg(F.sum("t").alias("T"), F.sum(F.when(F.col("i") <= F.col("n") - 2, F.col("c"))).alias("S"), F.max("n").alias("n"))
    value = (F.col("S") / (F.col("n") - 2) - F.col("T") / 2) / (F.col("T") * F.sqrt(1 / (12 * (F.col("n") - 2))))
    return sums.select("tree_id", F.when((F.col("n") > 2) & (F.col("T") > 0), value).alias("gamma"))


def extreme_branch(nodes: DataFrame, longest: bool = True, root: bool = False) -> DataFrame:
    """The longest (or shortest) branch; of equal ones the shallower, then the leftmost."""
    rows = nodes if root else nodes.where("parent_id IS NOT NULL")
    row = F.struct("node_id", "branch_length")
    order = F.struct("branch_length", -F.col("depth"), -F.col("pre")) if longest else F.struct("branch_length", "depth", "pre")
    best = (F.max_by if longest else F.min_by)(row, order).alias("b")
    return rows.groupBy("tree_id").agg(best).select("tree_id", "b.*")


def clade_counts(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """Nodes with the number of named tips below each, and per tree all tips and all named ones."""
    keys = [k for k in ("tree_id", "label") if k in taxa.columns]
    named = taxa.select(*keys).distinct().withColumn("named", F.lit(1))
    rows = nodes.join(named, keys, "left").select(*nodes.columns, F.when(F.col("is_tip") & F.col("named").isNotNull(), 1).otherwise(0).alias("named"))

    def run(part: pd.DataFrame, shape: Shape) -> pd.DataFrame:
        hit = part["named"].to_numpy()
        out = part.drop(columns="named").assign(n_in=shape.fold(hit, np.add), all_tips=part["n_tips"].to_numpy()[shape.starts][shape.tree], all_in=shape.total(hit))
        return out[out["all_in"] > 0]

    kinds = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in nodes.columns)
    return whole_trees(rows, run, f"{kinds}, n_in int, all_tips int, all_in int")


def relaxed_outgroup(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """The branch that best sets the named tips apart: score and whether they are below it or above.

    With k named of N tips, n_in named and n_out others below a node, the score is the
    larger of (n_in - n_out) / k and ((k - n_in) - (N - k - n_out)) / k.
    """
    c = clade_counts(nodes, taxa).where("all_in > 0").withColumn("n_out", F.col("n_tips") - F.col("n_in"))
    down = (F.col("n_in") - F.col("n_out")) / F.col("all_in")
    up = ((F.col("all_in") - F.col("n_in")) - (F.col("all_tips") - F.col("all_in") - F.col("n_out"))) / F.col("all_in")
    c = c.withColumn("score", F.greatest(down, up)).withColumn("below", down >= up)
    best = F.max_by(F.struct("node_id", "score", "below"), F.struct("score", -F.col("pre"))).alias("b")
    return c.groupBy("tree_id").agg(best).select("tree_id", "b.*")


def clock_z(nodes: DataFrame, n_char: float = 1.0) -> DataFrame:
    """Per inner node, how unequal the mean ways to the tips of its first two children are, in standard errors.

    A child's clade has a = n_char * sum of tip distances and c = n_char * sum over its
    edges of length * tips below squared, its own edge included.
    """
    length = F.when(F.col("parent_id").isNotNull(), F.coalesce("branch_length", F.lit(0.0))).otherwise(0.0) * n_char
    sums = fold_clades(nodes, ["tree_id", "parent_id", "pre", "n_tips"], a=(length * F.col("n_tips"), "sum"), c=(length * F.col("n_tips") ** 2, "sum")).where("parent_id IS NOT NULL")
    k = F.row_number().over(Window.partitionBy("tree_id", "parent_id").orderBy("pre"))
    s = sums.withColumn("k", k).where("k <= 2")
    side = lambda i, e: F.max(F.when(F.col("k") == i, e))
    mean, var = F.col("a") / F.col("n_tips"), F.col("c") / F.col("n_tips") ** 2
    z = s.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(side(1, mean).alias("m1"), side(2, mean).alias("m2"), side(1, var).alias("v1"), side(2, var).alias("v2"))
    return z.select("tree_id", "node_id", F.when(F.col("v1") + F.col("v2") > 0, (F.col("m1") - F.col("m2")) / F.sqrt(F.col("v1") + F.col("v2"))).alias("z"))


def branch_numbers(nodes: DataFrame) -> DataFrame:
    """Inner nodes numbered from 1 in preorder."""
    number = F.row_number().over(Window.partitionBy("tree_id").orderBy("pre"))
    return nodes.where(~F.col("is_tip")).select("tree_id", "node_id", number.alias("number"))


def node_by_number(nodes: DataFrame, number: int, what: str = "inner") -> DataFrame:
    """The inner node, tip or unrooted branch of that preorder number.

    Branches of the unrooted tree leave out the root and, below a root of two
    children, the second one's branch, which is the same branch as the first one's.
    """
    rows = {"inner": nodes.where(~F.col("is_tip")), "tip": nodes.where("is_tip"), "branch": unrooted_branches(nodes)}[what]
    k = F.row_number().over(Window.partitionBy("tree_id").orderBy("pre"))
    return rows.withColumn("number", k).where(F.col("number") == number).select("tree_id", "node_id", "label", "number")


def unrooted_branches(nodes: DataFrame) -> DataFrame:
    """Non-root nodes, one of the two below a root of two children."""
    roots = nodes.where("parent_id IS NULL").select("tree_id", F.col("node_id").alias("root_id"))
    kids = nodes.where("parent_id IS NOT NULL").join(roots, "tree_id")
    w = Window.partitionBy("tree_id", "parent_id")
    twice = (F.col("parent_id") == F.col("root_id")) & (F.count("*").over(w) == 2) & (F.row_number().over(w.orderBy("pre")) == 2)
    return kids.withColumn("twice", twice).where("NOT twice").drop("twice", "root_id")


def tree_interval(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """The trees with ids from ``first`` to ``last``: a filter that reaches the scan."""
    return nodes.where(F.col("tree_id").between(first, last))
