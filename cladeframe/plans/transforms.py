"""Queries that change the order forest and measure what comes out."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.operators import forest as f
from cladeframe.operators import splits as s
from cladeframe.operators import transform as t
from cladeframe.plans import trees
from cladeframe.plans.derived import named_tips
from cladeframe.plans.trees import MRCA_SQL, below_sql, query, whole
from cladeframe.schema import index_forest

_before = set(trees.QUERIES)


@query("SELECT tree_id, k AS node_id, len * 2.5 AS branch_length FROM nodes")
def scale_branches(nodes, spark, sf_dir):
    return whole(t.scale_branches(nodes, 2.5).select("tree_id", "node_id", "branch_length"), "node_id")


@query("SELECT tree_id, k AS node_id, CAST(1.5 AS DOUBLE) * (depth + 1) AS root_dist FROM nodes JOIN dist USING (tree_id, k)")
def set_branch_lengths(nodes, spark, sf_dir):
    """How far each node then is from the root."""
    return whole(index_forest(t.set_branch_lengths(nodes, 1.5)).select("tree_id", "node_id", "root_dist"), "node_id")


@query("SELECT tree_id, k AS node_id, CASE WHEN len < 2 THEN 0.0 ELSE len END AS branch_length FROM nodes")
def null_short(nodes, spark, sf_dir):
    return whole(t.null_short_branches(nodes, 2).select("tree_id", "node_id", "branch_length"), "node_id")


@query("SELECT tree_id, k AS node_id, CASE WHEN tip THEN label END AS label FROM nodes")
def clear_labels(nodes, spark, sf_dir):
    return whole(t.clear_internal_labels(nodes).select("tree_id", "node_id", "label"), "node_id")


@query("SELECT tree_id, k AS node_id, CASE WHEN tip THEN CAST(label AS DOUBLE) ELSE round(CAST(label AS DOUBLE) / 100, 6) END AS label FROM nodes")
def divide_labels(nodes, spark, sf_dir):
    """Labels of tips stay; here all labels are numbers."""
    return whole(t.divide_labels(nodes, 100).select("tree_id", "node_id", F.round(F.col("label").cast("double"), 6).alias("label")), "node_id")


@query("""SELECT n.tree_id, CASE WHEN tip THEN o_orderpriority || '/' || n.label ELSE n.label END AS label FROM nodes n LEFT JOIN o ON tip AND n.label = CAST(o_orderkey AS VARCHAR)""")
def rename_tips(nodes, spark, sf_dir):
    from cladeframe.plans.derived import table

    names = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("label"), F.concat_ws("/", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("new_label"))
    return t.rename_tips_by_table(nodes, names).select("tree_id", "label")


@query(""", root AS (SELECT tree_id, len AS own FROM nodes WHERE k = 1),
e AS (SELECT n.tree_id, n.k, d - own AS hi, d - own - len AS lo FROM nodes n JOIN dist USING (tree_id, k) JOIN root USING (tree_id) WHERE n.k > 1)
SELECT tree_id, k AS node_id, greatest(0, least(hi, 5.0) - greatest(lo, 0.0)) * 2 + greatest(0, least(hi, 12.5) - greatest(lo, 5.0)) * 0.5 + greatest(0, hi - greatest(lo, 12.5)) AS branch_length FROM e""")
def skyline_scale(nodes, spark, sf_dir):
    r = t.skyline_scale(nodes, [(5.0, 2.0), (12.5, 0.5)]).where("parent_id IS NOT NULL")
    return whole(r.select("tree_id", "node_id", "branch_length"), "node_id")


@query(MRCA_SQL + f"""SELECT n.tree_id, n.k AS node_id, n.len * CASE WHEN m.k IS NOT NULL AND n.k <> m.k AND {below_sql('n', 'm')} THEN 3.0 ELSE 1.0 END AS branch_length
FROM nodes n LEFT JOIN mrca m USING (tree_id)""")
def clade_scale(nodes, spark, sf_dir):
    sets = named_tips(spark, sf_dir).select("tree_id", "label", F.lit("urgent").alias("set_id"), F.lit(3.0).alias("rate"))
    return whole(t.clade_scale(nodes, sets).select("tree_id", "node_id", "branch_length"), "node_id")


@query("SELECT tree_id, k AS node_id, row_number() OVER (PARTITION BY tree_id, k // 2 ORDER BY n DESC, k) - 1 AS child_ord FROM below WHERE k > 1")
def ladderize(nodes, spark, sf_dir):
    r = t.ladderize(nodes).where("parent_id IS NOT NULL")
    return whole(r.select("tree_id", "node_id", "child_ord"), "node_id", "child_ord")


@query(trees.ORACLES["patristic_sum"].removeprefix(trees.NODES_SQL))
def reroot(nodes, spark, sf_dir):
    """Rooting on the named tips' clade changes no distance between tips."""
    return f.patristic_sum(index_forest(t.outgroup_root(nodes, named_tips(spark, sf_dir))))


@query(trees.SPLIT_SQL + trees.ORACLES["patristic_sum"].removeprefix(trees.NODES_SQL).replace("SELECT t.tree_id, t.label, t.n * t.d", ", num AS (SELECT tree_id, count(*) AS c FROM split GROUP BY tree_id) SELECT t.tree_id, t.label, coalesce(num.c, 0) AS n_splits, t.n * t.d") + " LEFT JOIN num ON num.tree_id = t.tree_id")
def relaxed_outgroup_root(nodes, spark, sf_dir):
    """Rooting keeps the splits' number and the distances between tips."""
    from cladeframe.operators.components import _held

    r = _held(index_forest(t.relaxed_outgroup_root(nodes, named_tips(spark, sf_dir))))
    n = s.splits(r).groupBy("tree_id").agg(F.count("*").alias("n_splits"))
    return f.patristic_sum(r).join(n, "tree_id", "left").withColumn("n_splits", F.coalesce("n_splits", F.lit(0)).cast("long"))


#: pd(tree_id, x, y, d): the distance of each ordered pair of tips, through the lowest node above both.
PAIRS_SQL = """, tipd AS MATERIALIZED (SELECT n.tree_id, n.k, n.label, d FROM nodes n JOIN dist USING (tree_id, k) WHERE tip),
above AS MATERIALIZED (SELECT u.tree_id, u.a, u.k, t.label, t.d FROM up u JOIN tipd t USING (tree_id, k)),
both2 AS MATERIALIZED (SELECT x.tree_id, x.label AS x, y.label AS y, max(x.a) AS a, any_value(x.d + y.d) AS d FROM above x JOIN above y ON y.tree_id = x.tree_id AND y.a = x.a WHERE x.k <> y.k GROUP BY x.tree_id, x.label, y.label),
pd AS MATERIALIZED (SELECT b.tree_id, x, y, b.d - 2 * z.d AS d FROM both2 b JOIN dist z ON z.tree_id = b.tree_id AND z.k = b.a)
"""


@query(PAIRS_SQL + """, longest AS (SELECT tree_id, arg_max(x, (d, x, y)) AS x, arg_max(y, (d, x, y)) AS y, max(d) AS path FROM pd GROUP BY tree_id),
ends AS (SELECT p.tree_id, p.x AS label, l.path, p.d FROM pd p JOIN longest l ON l.tree_id = p.tree_id AND p.y IN (l.x, l.y))
SELECT tree_id, label, max(d) - any_value(path) / 2 AS root_dist FROM ends WHERE path > 0 GROUP BY tree_id, label""")
def midpoint_root(nodes, spark, sf_dir):
    """The root's place: each tip is as far from it as from the middle of the longest path, however that is found."""
    r = index_forest(t.midpoint_root(nodes))
    return f.tip_root_distance(r).select("tree_id", "label", F.col("distance").alias("root_dist")).join(t.midpoints(nodes).where("path > 0").select("tree_id"), "tree_id", "left_semi")


@query(""", kept AS (SELECT n.tree_id, n.k, n.label FROM nodes n WHERE tip AND NOT EXISTS (SELECT 1 FROM named x WHERE x.tree_id = n.tree_id AND x.label = n.label)),
t AS (SELECT kept.*, d, count(*) OVER w AS n, sum(d) OVER w AS s FROM kept JOIN dist USING (tree_id, k) WINDOW w AS (PARTITION BY kept.tree_id)),
held AS (SELECT u.tree_id, u.a AS k, count(*) AS n FROM kept JOIN up u USING (tree_id, k) GROUP BY u.tree_id, u.a),
shared AS (SELECT t.tree_id, t.k, sum(e.len * b.n) AS x FROM t JOIN up u USING (tree_id, k) JOIN nodes e ON e.tree_id = u.tree_id AND e.k = u.a JOIN held b ON b.tree_id = u.tree_id AND b.k = u.a GROUP BY t.tree_id, t.k)
SELECT t.tree_id, t.label, t.n * t.d + t.s - 2 * x AS distance_sum FROM t JOIN shared USING (tree_id, k)""")
def drop_tips(nodes, spark, sf_dir):
    """Distances between the tips that stay don't change."""
    return f.patristic_sum(index_forest(t.drop_tips(nodes, named_tips(spark, sf_dir))))


#: A right child takes over its parent's branch once all tips left of it are gone, and so on up; a clade goes if all its chains of right children are short.
DROP_SHORT_SQL = """, ends AS MATERIALIZED (SELECT u.tree_id, u.k, u.a, t.d - x.d + n.len AS s, u.k + 1 = (u.a + 1) << CAST(t.depth - x.depth AS INTEGER) AS rightmost
  FROM up u JOIN nodes q ON q.tree_id = u.tree_id AND q.k = u.k AND q.tip JOIN dist t ON t.tree_id = u.tree_id AND t.k = u.k JOIN dist x ON x.tree_id = u.tree_id AND x.k = u.a JOIN nodes n ON n.tree_id = u.tree_id AND n.k = u.a),
gone AS (SELECT u.tree_id, u.a AS k FROM up u JOIN ends e ON e.tree_id = u.tree_id AND e.a = u.k AND rightmost WHERE u.k = u.a OR u.k % 2 = 0 GROUP BY u.tree_id, u.a HAVING bool_and(s < 3)),
hung AS (SELECT e.tree_id, e.k, max(e.a) AS a, arg_max(e.s, e.a) AS s FROM ends e LEFT JOIN gone g ON g.tree_id = e.tree_id AND g.k = e.a - 1 WHERE e.a = 1 OR e.a % 2 = 0 OR g.k IS NULL GROUP BY e.tree_id, e.k)
SELECT tree_id, count(*) AS n_tips FROM hung WHERE a = 1 OR s >= 3 GROUP BY tree_id"""


@query(DROP_SHORT_SQL)
def drop_short_tips(nodes, spark, sf_dir):
    return f.tip_count(index_forest(t.drop_tips_on_short_branches(nodes, 3.0)))


@query(""", num AS (SELECT tree_id, tip, row_number() OVER (PARTITION BY tree_id ORDER BY substr(bin(k), 2)) AS number FROM nodes WHERE k > 1 AND k <> 3),
whole AS (SELECT tree_id, count(*) FILTER (tip) AS n_tips, sum(len) AS tree_length FROM nodes GROUP BY tree_id)
SELECT tree_id, 2 * number - i AS alt, n_tips, tree_length FROM num JOIN m USING (tree_id) JOIN whole USING (tree_id), (SELECT UNNEST([0, 1]) AS i) WHERE NOT tip AND m > 3""")
def nni(nodes, spark, sf_dir):
    """A binary tree of m tips has m - 3 inner branches and two interchanges across each; tips and length stay."""
    near = t.nearest_neighbours(nodes).groupBy("tree_id", "alt").agg(F.count(F.when(F.col("parent_id") != F.col("node_id"), 1)).alias("edges"), F.sum("branch_length").alias("tree_length"))
    return near.select("tree_id", F.col("alt").cast("long").alias("alt"), (F.col("edges") / 2 + 1).cast("long").alias("n_tips"), "tree_length")


@query("SELECT a AS tree_id, CAST(2 AS BIGINT) AS rf FROM (SELECT tree_id AS a FROM m WHERE m > 3)")
def random_nni(nodes, spark, sf_dir):
    """A tree and its random neighbour differ in one split on either side."""
    from cladeframe.operators.components import _held

    base = _held(nodes)
    near = index_forest(t.random_neighbour(base, seed=7)).withColumn("tree_id", -F.col("tree_id") - 1)
    pairs = base.select("tree_id").distinct().select(F.col("tree_id").alias("a"), (-F.col("tree_id") - 1).alias("b"))
    r = s.robinson_foulds(base.unionByName(near), pairs, same_tips=True).where("n_shared > 3")
    return r.select(F.col("a").alias("tree_id"), F.col("rf").cast("long").alias("rf"))


@query(""", x AS (SELECT n.tree_id, arg_max(n.k, (n.len, -depth, -rank)) AS k FROM (SELECT n.*, depth, row_number() OVER (PARTITION BY n.tree_id ORDER BY substr(bin(k), 2)) AS rank FROM nodes n JOIN dist USING (tree_id, k)) n WHERE n.k > 1 GROUP BY n.tree_id)
SELECT x.tree_id, b.n AS clade_tips, m - b.n AS rest_tips FROM x JOIN below b USING (tree_id, k) JOIN m USING (tree_id)""")
def prune_longest(nodes, spark, sf_dir):
    rest, clade = t.prune_clade(nodes, f.extreme_branch(nodes))
    a = f.tip_count(index_forest(clade)).withColumnRenamed("n_tips", "clade_tips")
    return a.join(f.tip_count(index_forest(rest)).withColumnRenamed("n_tips", "rest_tips"), "tree_id")


@query("SELECT tree_id, m + 1 AS n_tips, len + 2.0 AS tree_length FROM m JOIN (SELECT tree_id, sum(len) AS len FROM nodes GROUP BY tree_id) USING (tree_id) WHERE m > 1")
def add_tip(nodes, spark, sf_dir):
    target = f.extreme_branch(nodes).select("tree_id", "node_id", F.lit("new").alias("label"), F.lit(2.0).alias("tip_length"))
    r = index_forest(t.add_node_on_branch(nodes, target).join(target.select("tree_id"), "tree_id", "left_semi"))
    return f.tip_count(r).join(f.tree_length(r), "tree_id")


#: The first cut x leaves n0 tips as part 0 and n1 below it as part 1; z cuts the larger one.  With x gone its parent's branch and its sibling's are one.
SPLIT_SQL = """, c AS MATERIALIZED (SELECT tree_id, k, len, depth, row_number() OVER (PARTITION BY tree_id ORDER BY substr(bin(k), 2)) AS rank FROM nodes JOIN dist USING (tree_id, k)),
x AS (SELECT tree_id, arg_max(k, (len, -depth, -rank)) AS x FROM c WHERE k > 1 GROUP BY tree_id),
two AS MATERIALIZED (SELECT x.tree_id, x, CAST(c.depth AS INTEGER) AS dx, b.n AS n1, m - b.n AS n0 FROM x JOIN m USING (tree_id) JOIN below b ON b.tree_id = x.tree_id AND b.k = x JOIN c ON c.tree_id = x.tree_id AND c.k = x),
seen AS (SELECT two.*, c.*, n1 > n0 AS low, depth >= dx AND k >> greatest(CAST(depth AS INTEGER) - dx, 0) = x AS below_x, depth >= dx AND k >> greatest(CAST(depth AS INTEGER) - dx, 0) = xor(x, 1) AS beside
  FROM two JOIN c ON c.tree_id = two.tree_id WHERE greatest(n0, n1) > 1),
can AS (
  SELECT tree_id, x, dx, low, n1, k, depth, rank, len FROM seen WHERE low AND below_x AND k <> x
  UNION ALL SELECT s.tree_id, x, dx, low, n1, s.k, s.depth - CAST(beside AS INTEGER), s.rank, s.len + CASE WHEN s.k = xor(x, 1) THEN p.len ELSE 0 END
  FROM seen s JOIN c p ON p.tree_id = s.tree_id AND p.k = x // 2 WHERE NOT low AND NOT below_x AND s.k > 1 AND s.k <> x // 2 AND NOT (x < 4 AND s.k = xor(x, 1))),
z AS (SELECT tree_id, any_value(x) AS x, any_value(dx) AS dx, any_value(low) AS low, any_value(n1) AS n1, arg_max(k, (len, -depth, -rank)) AS z FROM can GROUP BY tree_id),
nz AS (SELECT z.tree_id, low, b.n - CASE WHEN NOT low AND dx >= length(bin(z)) - 1 AND x >> greatest(dx - CAST(length(bin(z)) AS INTEGER) + 1, 0) = z THEN n1 ELSE 0 END AS n2 FROM z JOIN below b ON b.tree_id = z.tree_id AND b.k = z)
SELECT tree_id AS source, CAST(0 AS INTEGER) AS part, m AS n_tips FROM m WHERE m = 1
UNION ALL SELECT tree_id, 0, n0 - CASE WHEN NOT low THEN n2 ELSE 0 END FROM two LEFT JOIN nz USING (tree_id)
UNION ALL SELECT tree_id, 1, n1 - CASE WHEN low THEN n2 ELSE 0 END FROM two LEFT JOIN nz USING (tree_id)
UNION ALL SELECT tree_id, 2, n2 FROM nz"""


@query(SPLIT_SQL)
def split_tree(nodes, spark, sf_dir):
    parts = t.split_trees(nodes, 3)
    return parts.where("is_tip").groupBy("source", "part").agg(F.count("*").alias("n_tips"))


@query("SELECT tree_id AS source, m AS n_tips, TRUE AS small, CAST(2 * m AS BIGINT) AS n_nodes_and_parts FROM m")
def split_by_size(nodes, spark, sf_dir):
    """Cut at the longest branches until no part has more than 4 tips; binary parts have 2 n - 1 nodes."""
    parts = t.split_trees(nodes, max_tips=4, rooted=False)
    n = parts.groupBy("source", "part").agg(F.count_if("is_tip").alias("tips"), F.count("*").alias("nodes"))
    return n.groupBy("source").agg(F.sum("tips").alias("n_tips"), (F.max("tips") <= 4).alias("small"), F.sum(F.col("nodes") + 1).cast("long").alias("n_nodes_and_parts"))


@query(PAIRS_SQL + " SELECT tree_id, x, y, d FROM pd WHERE x < y")
def nj_additive(nodes, spark, sf_dir):
    """Neighbour joining on the distances within each tree finds these distances again."""
    from cladeframe.operators.build import neighbour_joining
    from cladeframe.operators.components import _held

    base = _held(nodes)
    own = f.all_pair_distances(base).withColumnsRenamed({"tree_id": "matrix_id", "a": "i", "b": "j", "distance": "d"})
    made = _held(index_forest(neighbour_joining(own)))
    found = f.all_pair_distances(made)
    return found.select("tree_id", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.round("distance", 6).alias("d"))


#: Two sections: below x, the dated ancestor (20), and the rest below the root (100), where x is an end that counts as often as its tips.
CALIBRATED_SQL = MRCA_SQL + f""", x AS MATERIALIZED (SELECT m.tree_id, m.k, d FROM mrca m JOIN below b USING (tree_id, k) JOIN dist USING (tree_id, k) WHERE b.n > 1 AND m.k > 1),
t AS MATERIALIZED (SELECT n.tree_id, n.k, e.d, x.k IS NOT NULL AND {below_sql('n', 'x')} AS low FROM nodes n JOIN dist e USING (tree_id, k) LEFT JOIN x ON x.tree_id = n.tree_id WHERE n.tip),
sums AS MATERIALIZED (SELECT u.tree_id, u.a AS k, coalesce(sum(d) FILTER (NOT low), 0) AS s0, count(*) FILTER (NOT low) AS n0, coalesce(sum(d) FILTER (low), 0) AS s1, count(*) FILTER (low) AS n1 FROM up u JOIN t USING (tree_id, k) GROUP BY u.tree_id, u.a),
v AS MATERIALIZED (SELECT h.tree_id, h.k, e.d, s0, n0, s1, n1, x.k AS x, coalesce(x.d, 0) AS dx, x.k IS NOT NULL AND {below_sql('h', 'x')} AS low FROM sums h JOIN dist e USING (tree_id, k) LEFT JOIN x ON x.tree_id = h.tree_id),
r0 AS (SELECT tree_id, nullif(greatest((s0 - n0 * d + 1.25 * n1 * (dx - d)) / (n0 + n1) / 100, 0), 0) AS r FROM v WHERE k = 1),
rx AS (SELECT tree_id, nullif(greatest((s1 - n1 * d) / n1 / 20, 0), 0) AS r FROM v WHERE k = x),
rates AS MATERIALIZED (SELECT r0.tree_id, coalesce(r0.r, rx.r) AS r0, coalesce(rx.r, r0.r) AS rx FROM r0 LEFT JOIN rx USING (tree_id))
SELECT v.tree_id, v.k AS node_id, round(CASE WHEN n.tip THEN 0 WHEN v.k = 1 THEN 100 WHEN v.k = x THEN 20 WHEN low THEN (s1 - n1 * d) / n1 / rx
  ELSE (s0 - n0 * d + n1 * (dx - d) + r0 * n1 * 20) / (n0 + n1) / r0 END, 8) AS age
FROM v JOIN rates USING (tree_id) JOIN nodes n USING (tree_id, k) WHERE r0 IS NOT NULL
"""


@query(CALIBRATED_SQL)
def calibrated_ages(nodes, spark, sf_dir):
    """Ages with every root put at 100 and the common ancestor of the urgent orders at 20."""
    root = nodes.where("parent_id IS NULL AND NOT is_tip").select("tree_id", "node_id", F.lit(100.0).alias("age"))
    inner = f.mrca(nodes, named_tips(spark, sf_dir)).where("n_tips > 1 AND depth > 0").select("tree_id", "node_id", F.lit(20.0).alias("age"))
    r = t.mean_path_ages(nodes, root.unionByName(inner))
    return whole(r.select("tree_id", "node_id", F.round("age", 8).alias("age")), "node_id")


@query(""", far AS MATERIALIZED (SELECT n.tree_id, n.k, d FROM nodes n JOIN dist USING (tree_id, k) WHERE tip),
paths AS MATERIALIZED (SELECT u.tree_id, u.a AS k, sum(d) AS d, count(*) AS n FROM up u JOIN far f ON f.tree_id = u.tree_id AND f.k = u.k GROUP BY u.tree_id, u.a),
mp AS MATERIALIZED (SELECT p.tree_id, p.k, (p.d - n * y.d) / n AS mean_path FROM paths p JOIN dist y USING (tree_id, k)),
rr AS (SELECT tree_id, mean_path / 100.0 AS r FROM mp WHERE k = 1 AND mean_path > 0)
SELECT mp.tree_id, mp.k AS node_id, mean_path, round(mean_path / r, 10) AS age FROM mp JOIN rr USING (tree_id)""")
def mean_path_ages(nodes, spark, sf_dir):
    """Ages with every root put at 100."""
    root = nodes.where("parent_id IS NULL").select("tree_id", "node_id", F.lit(100.0).alias("age"))
    r = t.mean_path_ages(nodes, root)
    return whole(r.select("tree_id", "node_id", "mean_path", F.round("age", 10).alias("age")), "node_id")


@query("""SELECT tree_id, count(*) FILTER (tip) AS n_tips, count(*) AS n_nodes, sum(len) AS tree_length FROM nodes GROUP BY tree_id""")
def resolve_polytomies(nodes, spark, sf_dir):
    """Trees with their inner supported nodes collapsed to the root, resolved again: as many nodes and as long as before."""
    root = nodes.where("parent_id IS NULL").select("tree_id", F.col("node_id").alias("root"))
    star = nodes.where("is_tip OR parent_id IS NULL").join(root, "tree_id")
    flat = star.select("tree_id", "node_id", F.when(F.col("parent_id").isNotNull(), F.col("root")).alias("parent_id"), F.col("pre").alias("child_ord"), "label", "branch_length")
    r = index_forest(t.resolve_polytomies(index_forest(flat)))
    inner = nodes.where("NOT is_tip AND parent_id IS NOT NULL").groupBy("tree_id").agg(F.sum("branch_length").alias("lost"))
    n = r.groupBy("tree_id").agg(F.count_if("is_tip").alias("n_tips"), F.count("*").alias("n_nodes"), F.sum("branch_length").alias("kept"))
    return n.join(inner, "tree_id", "left").select("tree_id", "n_tips", "n_nodes", (F.col("kept") + F.coalesce("lost", F.lit(0.0))).alias("tree_length"))


QUERIES = {k: v for k, v in trees.QUERIES.items() if k not in _before}
ORACLES = {k: v for k, v in trees.ORACLES.items() if k in QUERIES}
