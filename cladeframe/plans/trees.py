"""Queries over the order forest: measures, transforms and comparisons of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import forest as f
from cladeframe.operators import splits as s
from cladeframe.operators.components import _checkpoint, _held
from cladeframe.plans.derived import NODES_SQL, named_tips, order_forest, table, tree_pairs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, prefix: str = NODES_SQL):
    """Register a function of (nodes, spark, sf_dir) under its own name, with the SQL behind the node relation."""

    def add(function):
        QUERIES[function.__name__] = lambda spark, sf_dir: function(order_forest(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLES[function.__name__] = prefix + sql
        return function

    return add


def whole(df: DataFrame, *columns: str) -> DataFrame:
    """Integer columns as BIGINT, as the SQL has them."""
    return df.select(*[F.col(c).cast("long").alias(c) if c in columns else F.col(c) for c in df.columns])


def without_pending(nodes: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest whose date trees lack the orders of status P."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") * 3 + 1).alias("tree_id"), F.col("o_orderkey").cast("string").alias("label"))
    return nodes.where("NOT is_tip").unionByName(nodes.where("is_tip").join(gone, ["tree_id", "label"], "left_anti").select(nodes.columns))


@query("SELECT tree_id, count(*) FILTER (tip) AS n_tips FROM nodes GROUP BY tree_id")
def tree_tip_count(nodes, spark, sf_dir):
    return f.tip_count(nodes)


@query("SELECT tree_id, count(*) AS n_nodes FROM nodes GROUP BY tree_id")
def tree_node_count(nodes, spark, sf_dir):
    return f.node_count(nodes)


@query("SELECT tree_id, sum(len) AS tree_length FROM nodes GROUP BY tree_id")
def tree_length(nodes, spark, sf_dir):
    return f.tree_length(nodes)


@query("SELECT n.tree_id, max(d) AS tree_depth FROM nodes n JOIN dist USING (tree_id, k) WHERE tip GROUP BY n.tree_id")
def tree_depth(nodes, spark, sf_dir):
    return f.tree_depth(nodes)


@query("""SELECT u.tree_id, u.a AS node_id, min(x.d - y.d + n.len) AS shortest
FROM up u JOIN nodes t ON t.tree_id = u.tree_id AND t.k = u.k AND t.tip JOIN dist x ON x.tree_id = u.tree_id AND x.k = u.k
JOIN dist y ON y.tree_id = u.tree_id AND y.k = u.a JOIN nodes n ON n.tree_id = u.tree_id AND n.k = u.a GROUP BY u.tree_id, u.a""")
def shortest_to_tip(nodes, spark, sf_dir):
    return whole(f.shortest_to_tip(nodes), "node_id")


@query("""SELECT tree_id, arg_max(label, (d, substr(bin(k), 2))) AS label, max(d) AS distance FROM nodes JOIN dist USING (tree_id, k) WHERE tip GROUP BY tree_id""")
def furthest_tip(nodes, spark, sf_dir):
    return f.furthest_tip(nodes)


@query("""SELECT n.tree_id, n.label, CAST(depth - 1 AS BIGINT) AS nodes_between, d - r.len AS distance
FROM nodes n JOIN dist USING (tree_id, k) JOIN nodes r ON r.tree_id = n.tree_id AND r.k = 1 WHERE n.tip""")
def tip_root_distance(nodes, spark, sf_dir):
    return whole(f.tip_root_distance(nodes), "nodes_between")


@query(""", t AS (SELECT n.tree_id, n.k, n.label, d, count(*) OVER w AS n, sum(d) OVER w AS s FROM nodes n JOIN dist USING (tree_id, k) WHERE n.tip WINDOW w AS (PARTITION BY n.tree_id)),
shared AS (SELECT t.tree_id, t.k, sum(e.len * b.n) AS x FROM t JOIN up u USING (tree_id, k) JOIN nodes e ON e.tree_id = u.tree_id AND e.k = u.a JOIN below b ON b.tree_id = u.tree_id AND b.k = u.a GROUP BY t.tree_id, t.k)
SELECT t.tree_id, t.label, t.n * t.d + t.s - 2 * x AS distance_sum FROM t JOIN shared USING (tree_id, k)""")
def patristic_sum(nodes, spark, sf_dir):
    return f.patristic_sum(nodes)


@query(""", ends AS (SELECT tree_id, min(CAST(label AS BIGINT)) AS a, max(CAST(label AS BIGINT)) AS b FROM nodes WHERE tip GROUP BY tree_id),
e AS (SELECT ends.*, x.k AS ka, y.k AS kb FROM ends JOIN nodes x ON x.tree_id = ends.tree_id AND x.tip AND x.label = CAST(a AS VARCHAR)
  JOIN nodes y ON y.tree_id = ends.tree_id AND y.tip AND y.label = CAST(b AS VARCHAR))
SELECT e.tree_id, CAST(e.a AS VARCHAR) AS a, CAST(e.b AS VARCHAR) AS b, max(x.d) + max(y.d) - 2 * arg_max(c.d, u.a) AS distance
FROM e JOIN up u ON u.tree_id = e.tree_id AND u.k = ka JOIN up v ON v.tree_id = e.tree_id AND v.k = kb AND v.a = u.a
JOIN dist c ON c.tree_id = e.tree_id AND c.k = u.a JOIN dist x ON x.tree_id = e.tree_id AND x.k = ka JOIN dist y ON y.tree_id = e.tree_id AND y.k = kb
GROUP BY e.tree_id, e.a, e.b""")
def pair_distance(nodes, spark, sf_dir):
    ends = f.tips(nodes).groupBy("tree_id").agg(F.min(F.col("label").cast("long")).cast("string").alias("a"), F.max(F.col("label").cast("long")).cast("string").alias("b"))
    return f.pair_distance(nodes, ends)


@query("""SELECT tree_id, string_agg(CAST(CAST(len * 8 AS BIGINT) AS VARCHAR), ',' ORDER BY substr(bin(k), 2) || '2') AS eighths FROM nodes WHERE k > 1 GROUP BY tree_id""")
def branch_length_list(nodes, spark, sf_dir):
    b = f.branch_lengths(nodes)
    return b.select("tree_id", F.array_join(F.transform("branch_lengths", lambda x: (x * 8).cast("long").cast("string")), ",").alias("eighths"))


@query("SELECT tree_id, string_agg(label, ',' ORDER BY substr(bin(k), 2)) AS tip_names FROM nodes WHERE tip GROUP BY tree_id")
def tip_names(nodes, spark, sf_dir):
    return f.tip_names(nodes)


def below_sql(x: str, a: str) -> str:
    """Whether node x.k is a.k or below it."""
    return f"{x}.k >> CAST(greatest(length(bin({x}.k)) - length(bin({a}.k)), 0) AS INTEGER) = {a}.k"


MRCA_SQL = """, hit AS (SELECT n.tree_id, n.k FROM nodes n JOIN named USING (tree_id, label) WHERE n.tip),
held AS (SELECT tree_id, count(*) AS c FROM hit GROUP BY tree_id),
cover AS (SELECT u.tree_id, u.a, count(*) AS c FROM hit h JOIN up u USING (tree_id, k) GROUP BY u.tree_id, u.a),
mrca AS (SELECT tree_id, max(a) AS k FROM cover JOIN held USING (tree_id, c) GROUP BY tree_id)
"""


@query(MRCA_SQL + "SELECT m.tree_id, m.k AS node_id, b.n AS n_tips FROM mrca m JOIN below b USING (tree_id, k)")
def mrca(nodes, spark, sf_dir):
    return whole(f.mrca(nodes, named_tips(spark, sf_dir)).select("tree_id", "node_id", "n_tips"), "node_id", "n_tips")


@query(MRCA_SQL + f"SELECT n.tree_id, n.label FROM nodes n JOIN mrca m USING (tree_id) WHERE tip AND {below_sql('n', 'm')}")
def clade_members(nodes, spark, sf_dir):
    return f.clade_members(nodes, named_tips(spark, sf_dir))


@query(""", out AS (SELECT tree_id, max(CAST(label AS BIGINT)) AS x, min(CAST(label AS BIGINT)) AS i FROM nodes WHERE tip GROUP BY tree_id),
t AS (SELECT o.tree_id, a.k AS ki, b.k AS kx FROM out o JOIN nodes a ON a.tree_id = o.tree_id AND a.tip AND a.label = CAST(i AS VARCHAR) JOIN nodes b ON b.tree_id = o.tree_id AND b.tip AND b.label = CAST(x AS VARCHAR)),
w AS (SELECT t.tree_id, min(u.a) AS k FROM t JOIN up u ON u.tree_id = t.tree_id AND u.k = t.ki
  WHERE NOT EXISTS (SELECT 1 FROM up v WHERE v.tree_id = t.tree_id AND v.k = t.kx AND v.a = u.a) GROUP BY t.tree_id)
SELECT w.tree_id, n.label FROM w JOIN up u ON u.tree_id = w.tree_id AND u.a = w.k JOIN nodes n ON n.tree_id = u.tree_id AND n.k = u.k AND n.tip""")
def clade_stem_members(nodes, spark, sf_dir):
    ends = f.tips(nodes).groupBy("tree_id").agg(F.min(F.col("label").cast("long")).cast("string").alias("i"), F.max(F.col("label").cast("long")).cast("string").alias("x"))
    return f.stem_clade_members(nodes, ends.select("tree_id", F.col("i").alias("label")), ends.select("tree_id", F.col("x").alias("label")))


@query(MRCA_SQL + "SELECT m.tree_id, b.n = h.c AS monophyletic FROM mrca m JOIN below b USING (tree_id, k) JOIN held h USING (tree_id)")
def is_monophyletic(nodes, spark, sf_dir):
    return f.is_monophyletic(nodes, named_tips(spark, sf_dir))


@query(""", size AS (SELECT tree_id, count(*) AS n FROM nodes WHERE tip GROUP BY tree_id),
hit AS (SELECT n.tree_id, n.k FROM nodes n JOIN named USING (tree_id, label) WHERE n.tip),
held AS (SELECT tree_id, count(*) AS c FROM hit GROUP BY tree_id),
inn AS (SELECT u.tree_id, u.a AS k, count(*) AS i FROM hit JOIN up u USING (tree_id, k) GROUP BY u.tree_id, u.a)
SELECT b.tree_id, bool_or((coalesce(i, 0) = c AND b.n = coalesce(i, 0)) OR (coalesce(i, 0) = 0 AND b.n = size.n - c)) AS present
FROM below b JOIN size USING (tree_id) JOIN held USING (tree_id) LEFT JOIN inn ON inn.tree_id = b.tree_id AND inn.k = b.k GROUP BY b.tree_id""")
def split_present(nodes, spark, sf_dir):
    return s.splits_present(nodes, named_tips(spark, sf_dir))


@query("SELECT n.tree_id, n.label FROM nodes n WHERE tip AND NOT EXISTS (SELECT 1 FROM named x WHERE x.tree_id = n.tree_id AND x.label = n.label)")
def taxa_complement(nodes, spark, sf_dir):
    return f.complement(nodes, named_tips(spark, sf_dir))


@query("SELECT n.tree_id, n.label FROM nodes n JOIN named USING (tree_id, label) WHERE tip")
def taxa_present(nodes, spark, sf_dir):
    return f.taxa_present(nodes, named_tips(spark, sf_dir))


@query("SELECT tree_id, count(*) FILTER (NOT tip AND TRY_CAST(label AS DOUBLE) > 50) AS n_supported FROM nodes GROUP BY tree_id")
def n_supported(nodes, spark, sf_dir):
    return f.n_supported(nodes, 50)


@query("SELECT tree_id, round(coalesce(sum(CASE WHEN NOT tip AND CAST(label AS DOUBLE) > 0 THEN ln(CAST(label AS DOUBLE)) END), 0), 6) AS log_credibility FROM nodes GROUP BY tree_id")
def log_clade_credibility(nodes, spark, sf_dir):
    return f.log_clade_credibility(nodes).withColumn("log_credibility", F.round("log_credibility", 6))


@query("""SELECT tree_id, sum(v) AS sum, round(avg(v), 6) AS mean, median(v) AS median, round(stddev_pop(v), 6) AS sd, count(*) FILTER (v > 50) AS n_above, max(v) AS max, min(v) AS min, count(*) AS n,
round(ln(greatest(product(v), 1e-300)), 6) AS log_product FROM (SELECT tree_id, CAST(label AS DOUBLE) AS v FROM nodes WHERE NOT tip) GROUP BY tree_id""")
def node_label_stats(nodes, spark, sf_dir):
    r = f.node_label_stats(nodes, 50)
    log = F.round(F.ln(F.greatest("product", F.lit(1e-300))), 6).alias("log_product")
    return r.select("tree_id", "sum", F.round("mean", 6).alias("mean"), "median", F.round("sd", 6).alias("sd"), "n_above", "max", "min", "n", log)


@query(""", root AS (SELECT tree_id, len AS own FROM nodes WHERE k = 1),
h AS (SELECT tree_id, d - own AS h, substr(bin(k), 2) AS p FROM nodes JOIN dist USING (tree_id, k) JOIN root USING (tree_id) WHERE NOT tip
  UNION ALL SELECT tree_id, max(d - own), '2' FROM nodes JOIN dist USING (tree_id, k) JOIN root USING (tree_id) WHERE tip GROUP BY tree_id),
g AS (SELECT tree_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY tree_id) AS n, h - lag(h) OVER w AS g FROM h WINDOW w AS (PARTITION BY tree_id ORDER BY h, p)),
c AS (SELECT tree_id, i, n, (i + 1) * g AS t, sum((i + 1) * g) OVER (PARTITION BY tree_id ORDER BY i) AS c FROM g WHERE i >= 1),
q AS (SELECT tree_id, sum(t) AS t, sum(CASE WHEN i <= n - 2 THEN c END) AS s, max(n) AS n FROM c GROUP BY tree_id)
SELECT tree_id, CASE WHEN n > 2 AND t > 0 THEN round((s / (n - 2) - t / 2) / (t * sqrt(1 / (12 * (n - 2)))), 6) END AS gamma FROM q""")
def gamma_stat(nodes, spark, sf_dir):
    return f.gamma_statistic(nodes).withColumn("gamma", F.round("gamma", 6))


@query("""SELECT tree_id, arg_max(k, (len, -depth, -rank)) AS node_id, max(len) AS branch_length FROM (
SELECT n.*, depth, row_number() OVER (PARTITION BY n.tree_id ORDER BY substr(bin(k), 2)) AS rank FROM nodes n JOIN dist USING (tree_id, k)) WHERE k > 1 GROUP BY tree_id""")
def longest_branch(nodes, spark, sf_dir):
    return whole(f.extreme_branch(nodes), "node_id")


@query("""SELECT tree_id, arg_min(k, (len, depth, rank)) AS node_id, min(len) AS branch_length FROM (
SELECT n.*, depth, row_number() OVER (PARTITION BY n.tree_id ORDER BY substr(bin(k), 2)) AS rank FROM nodes n JOIN dist USING (tree_id, k)) WHERE k > 1 GROUP BY tree_id""")
def shortest_branch(nodes, spark, sf_dir):
    return whole(f.extreme_branch(nodes, longest=False), "node_id")


@query(""", size AS (SELECT tree_id, count(*) AS big FROM nodes WHERE tip GROUP BY tree_id),
hit AS (SELECT n.tree_id, n.k FROM nodes n JOIN named USING (tree_id, label) WHERE n.tip),
held AS (SELECT tree_id, count(*) AS c FROM hit GROUP BY tree_id),
inn AS (SELECT u.tree_id, u.a AS k, count(*) AS i FROM hit JOIN up u USING (tree_id, k) GROUP BY u.tree_id, u.a),
sc AS (SELECT b.tree_id, b.k, (2 * coalesce(i, 0) - b.n) / c AS down, ((c - coalesce(i, 0)) - (big - c - b.n + coalesce(i, 0))) / c AS high, row_number() OVER (PARTITION BY b.tree_id ORDER BY substr(bin(b.k), 2)) AS rank
  FROM below b JOIN size USING (tree_id) JOIN held USING (tree_id) LEFT JOIN inn ON inn.tree_id = b.tree_id AND inn.k = b.k)
SELECT tree_id, arg_max(k, (greatest(down, high), -rank)) AS node_id, round(max(greatest(down, high)), 6) AS score, arg_max(down >= high, (greatest(down, high), -rank)) AS below FROM sc GROUP BY tree_id""")
def relaxed_outgroup(nodes, spark, sf_dir):
    return whole(f.relaxed_outgroup(nodes, named_tips(spark, sf_dir)), "node_id").withColumn("score", F.round("score", 6))


@query(""", e AS (SELECT u.tree_id, u.a AS k, sum(n.len * b.n) AS a, sum(n.len * b.n * b.n) AS c FROM up u JOIN nodes n ON n.tree_id = u.tree_id AND n.k = u.k JOIN below b ON b.tree_id = u.tree_id AND b.k = u.k GROUP BY u.tree_id, u.a),
s AS (SELECT e.tree_id, e.k, a / n AS m, c / (n * n) AS v FROM e JOIN below b USING (tree_id, k))
SELECT l.tree_id, CAST(l.k // 2 AS BIGINT) AS node_id, CASE WHEN l.v + r.v > 0 THEN round((l.m - r.m) / sqrt(l.v + r.v), 6) END AS z FROM s l JOIN s r ON r.tree_id = l.tree_id AND r.k = l.k + 1 WHERE l.k % 2 = 0""")
def clock_likeness(nodes, spark, sf_dir):
    return whole(f.clock_z(nodes), "node_id").withColumn("z", F.round("z", 6))


@query("SELECT tree_id, k AS node_id, row_number() OVER (PARTITION BY tree_id ORDER BY substr(bin(k), 2)) AS number FROM nodes WHERE NOT tip")
def branch_numbers(nodes, spark, sf_dir):
    return whole(f.branch_numbers(nodes), "node_id", "number")


@query("SELECT * FROM (SELECT tree_id, k AS node_id, label, row_number() OVER (PARTITION BY tree_id ORDER BY substr(bin(k), 2)) AS number FROM nodes WHERE k > 1 AND k <> 3) WHERE number = 4")
def branch_by_number(nodes, spark, sf_dir):
    return whole(f.node_by_number(nodes, 4, "branch"), "node_id", "number")


@query("SELECT tree_id, count(*) AS n_nodes FROM nodes WHERE tree_id BETWEEN 30 AND 3000 GROUP BY tree_id")
def tree_interval(nodes, spark, sf_dir):
    return f.node_count(f.tree_interval(nodes, 30, 3000))


#: Splits as sorted lists of tips: both sides, the one without the smallest label counts.
SPLIT_SQL = """, tipn AS (SELECT tree_id, count(*) AS n, min(label) AS first FROM nodes WHERE tip GROUP BY tree_id),
clade AS MATERIALIZED (SELECT u.tree_id, u.a AS k, list_sort(list(n.label)) AS side FROM up u JOIN nodes n ON n.tree_id = u.tree_id AND n.k = u.k AND n.tip WHERE u.a > 1 GROUP BY u.tree_id, u.a),
every AS (SELECT tree_id, list_sort(list(label)) AS labels FROM nodes WHERE tip GROUP BY tree_id),
split AS MATERIALIZED (SELECT c.tree_id, min(c.k) AS k, key FROM (
  SELECT c.tree_id, c.k, CASE WHEN list_contains(side, first) THEN list_sort(list_filter(labels, lambda x: NOT list_contains(side, x))) ELSE side END AS key
  FROM clade c JOIN tipn USING (tree_id) JOIN every USING (tree_id) WHERE len(side) BETWEEN 2 AND n - 2) c GROUP BY c.tree_id, key)
"""
RF_SQL = SPLIT_SQL + """, met AS (SELECT p.a, p.b, count(*) AS m FROM pairs p JOIN split x ON x.tree_id = p.a JOIN split y ON y.tree_id = p.b AND y.key = x.key GROUP BY p.a, p.b),
num AS (SELECT tree_id, count(*) AS c FROM split GROUP BY tree_id),
rf AS (SELECT p.a, p.b, t.n AS n_shared, CASE WHEN t.n >= 4 THEN coalesce(x.c, 0) + coalesce(y.c, 0) - 2 * coalesce(m, 0) END AS rf
  FROM pairs p JOIN tipn t ON t.tree_id = p.a LEFT JOIN num x ON x.tree_id = p.a LEFT JOIN num y ON y.tree_id = p.b LEFT JOIN met USING (a, b))
"""


@query(RF_SQL + "SELECT a, b, n_shared, CAST(rf AS BIGINT) AS rf, round(rf / (2 * (n_shared - 3)), 6) AS rf_norm FROM rf WHERE rf IS NOT NULL")
def rf_pairs(nodes, spark, sf_dir):
    return s.robinson_foulds(nodes, tree_pairs(spark, sf_dir), same_tips=True).where("rf IS NOT NULL").withColumn("rf_norm", F.round("rf_norm", 6))


@query(""", half AS (SELECT * FROM nodes WHERE tip AND (tree_id % 3 <> 1 OR CAST(label AS BIGINT) NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'))),
sh AS (SELECT p.a, p.b, list_sort(list(x.label)) AS labels, count(*) AS n_shared FROM pairs p JOIN half x ON x.tree_id = p.a JOIN half y ON y.tree_id = p.b AND y.label = x.label GROUP BY p.a, p.b),
two AS (SELECT a, b, labels, n_shared, UNNEST([a, b]) AS tree_id FROM sh),
side AS (SELECT w.a, w.b, w.tree_id, u.a AS k, list_sort(list(n.label)) AS side FROM two w JOIN up u ON u.tree_id = w.tree_id AND u.a > 1 JOIN nodes n ON n.tree_id = u.tree_id AND n.k = u.k AND n.tip AND list_contains(w.labels, n.label) GROUP BY w.a, w.b, w.tree_id, u.a),
keys AS (SELECT DISTINCT s.a, s.b, s.tree_id, CASE WHEN list_contains(side, labels[1]) THEN list_sort(list_filter(labels, lambda x: NOT list_contains(side, x))) ELSE side END AS key
  FROM side s JOIN sh USING (a, b) WHERE len(side) BETWEEN 2 AND n_shared - 2),
odd AS (SELECT a, b, key, count(*) AS c FROM keys GROUP BY a, b, key)
SELECT a, b, n_shared, count(*) FILTER (c = 1) AS rf
FROM sh LEFT JOIN odd USING (a, b) WHERE n_shared >= 4 GROUP BY a, b, n_shared""")
def rf_shared_tips(nodes, spark, sf_dir):
    """Pairs of trees of which one lacks some tips: compared on what they share."""
    return s.robinson_foulds(without_pending(nodes, spark, sf_dir), tree_pairs(spark, sf_dir)).where("rf IS NOT NULL").drop("rf_norm")


@query(RF_SQL + "SELECT a, count(*) AS n_trees, CAST(sum(rf) AS BIGINT) AS rf_sum, round(sum(rf / (2 * (n_shared - 3))), 6) AS rf_norm_sum FROM rf WHERE rf IS NOT NULL GROUP BY a")
def rf_sum(nodes, spark, sf_dir):
    return s.robinson_foulds_sum(s.robinson_foulds(nodes, tree_pairs(spark, sf_dir), same_tips=True)).withColumn("rf_norm_sum", F.round("rf_norm_sum", 6))


@query(RF_SQL + """, duo AS (SELECT x.tree_id AS a, y.tree_id AS b FROM m x JOIN m y ON x.tree_id // 3 = y.tree_id // 3 WHERE x.tree_id <> y.tree_id),
met3 AS (SELECT x.tree_id AS a, y.tree_id AS b, count(*) AS shared FROM split x JOIN split y ON y.tree_id // 3 = x.tree_id // 3 AND y.key = x.key WHERE x.tree_id <> y.tree_id GROUP BY x.tree_id, y.tree_id),
all3 AS (SELECT a, t.n, coalesce(x.c, 0) + coalesce(y.c, 0) - 2 * coalesce(shared, 0) AS rf
  FROM duo JOIN tipn t ON t.tree_id = a LEFT JOIN num x ON x.tree_id = a LEFT JOIN num y ON y.tree_id = b LEFT JOIN met3 USING (a, b))
SELECT a AS tree_id, count(*) AS n_trees, CAST(CASE WHEN n >= 4 THEN sum(rf) END AS BIGINT) AS rf_sum, round(CASE WHEN n >= 4 THEN sum(rf) / (2 * (n - 3)) END, 6) AS rf_norm_sum FROM all3 GROUP BY a, n""")
def rf_all(nodes, spark, sf_dir):
    """Each tree against all others with the same tips."""
    return s.robinson_foulds_total(nodes).withColumn("rf_norm_sum", F.round("rf_norm_sum", 6))


@query("""SELECT p.a, p.b, count(*) AS n_shared FROM pairs p JOIN nodes x ON x.tree_id = p.a AND x.tip JOIN nodes y ON y.tree_id = p.b AND y.tip AND y.label = x.label GROUP BY p.a, p.b""")
def shared_tips(nodes, spark, sf_dir):
    return s.shared_tips(nodes, tree_pairs(spark, sf_dir))


@query(""", half AS (SELECT * FROM nodes WHERE tip AND (tree_id % 3 <> 1 OR CAST(label AS BIGINT) NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')))
SELECT p.a, p.b, x.label FROM pairs p JOIN half x ON x.tree_id = p.a WHERE NOT EXISTS (SELECT 1 FROM half y WHERE y.tree_id = p.b AND y.label = x.label)""")
def tips_not_shared(nodes, spark, sf_dir):
    return s.tips_not_shared(without_pending(nodes, spark, sf_dir), tree_pairs(spark, sf_dir))


@query(SPLIT_SQL + """, seen AS (SELECT tree_id // 3 AS c, key, count(*) AS n FROM split GROUP BY 1, 2)
SELECT s.tree_id, s.k AS node_id, n, round(n / 3, 6) AS support FROM split s JOIN seen ON seen.c = s.tree_id // 3 AND seen.key = s.key WHERE s.tree_id % 3 = 0""")
def split_support(nodes, spark, sf_dir):
    g = _held(nodes.withColumn("customer", F.floor(F.col("tree_id") / 3)))
    r = s.split_support(g.where("tree_id % 3 = 0"), g, by="customer")
    return whole(r.select("tree_id", "node_id", "n", F.round("support", 6).alias("support")), "node_id", "n")


@query(SPLIT_SQL + f""", own AS MATERIALIZED (SELECT tree_id, list_sort(list(k)) AS ks FROM split GROUP BY tree_id)
SELECT label, n.tree_id, coalesce(array_to_string(list_transform(ks, lambda x: CASE WHEN {below_sql('n', 'z').replace('z.k', 'x')} THEN '1' ELSE '0' END), ''), '') AS characters
FROM nodes n LEFT JOIN own USING (tree_id) WHERE tip""")
def matrix_representation(nodes, spark, sf_dir):
    """A character for each split of a tree, in the order of their nodes."""
    return s.matrix_rows(nodes)


CONFLICT_SQL = SPLIT_SQL + """, good AS (SELECT c.tree_id, c.k, side FROM clade c JOIN nodes n ON n.tree_id = c.tree_id AND n.k = c.k WHERE NOT n.tip AND CAST(n.label AS DOUBLE) > 50),
first AS MATERIALIZED (SELECT a, b, k, side FROM pairs JOIN good ON tree_id = a),
clash AS MATERIALIZED (SELECT a, b, x.k AS node_id, y.k AS other_id, list_filter(y.side, lambda z: NOT list_contains(x.side, z)) AS added, len(list_intersect(x.side, y.side)) AS k, len(x.side) AS na, len(y.side) AS nb
  FROM first x JOIN good y ON y.tree_id = x.b)
"""


@query(CONFLICT_SQL + "SELECT a, b, node_id, other_id FROM clash WHERE k > 0 AND k < na AND k < nb")
def conflict_clades(nodes, spark, sf_dir):
    return whole(s.conflicts(nodes, tree_pairs(spark, sf_dir), 50), "node_id", "other_id")


@query(CONFLICT_SQL + "SELECT DISTINCT a, b, node_id, UNNEST(added) AS label FROM clash WHERE k > 0 AND k < na AND k < nb")
def conflict_tips(nodes, spark, sf_dir):
    return whole(s.conflict_tips(nodes, tree_pairs(spark, sf_dir), 50), "node_id")


#: One tree over all orders by their keys.
ALL_SQL = """
WITH r AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS r, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
m AS (SELECT count(*) AS m FROM orders),
nodes AS MATERIALIZED (SELECT CAST(m + r AS BIGINT) AS k, (cents % 80) / 8 AS len, TRUE AS tip FROM r, m UNION ALL SELECT CAST(r AS BIGINT), (cents % 56) / 8, FALSE FROM r WHERE r >= 1),
up AS MATERIALIZED (SELECT k, k >> CAST(h AS INTEGER) AS a FROM (SELECT k, UNNEST(range(length(bin(k)))) AS h FROM nodes)),
dist AS MATERIALIZED (SELECT u.k, sum(n.len) AS d, count(*) - 1 AS depth FROM up u JOIN nodes n ON n.k = u.a GROUP BY u.k),
own AS MATERIALIZED (SELECT n.k, n.tip, n.len, d, depth FROM nodes n JOIN dist USING (k)),
clade AS MATERIALIZED (SELECT u.a AS k, count(*) FILTER (tip) AS n_tips, min(d) FILTER (tip) AS near, max(d) FILTER (tip) AS far, sum(len) AS total FROM up u JOIN own USING (k) GROUP BY u.a)
SELECT o.k AS node_id, row_number() OVER (ORDER BY substr(bin(o.k), 2)) - 1 AS pre, depth, n_tips, d AS root_dist, near - d + len AS shortest, far - d + len AS furthest, total FROM own o JOIN clade USING (k)
"""


def whole_table_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree as large as ``orders``: its index, and over each clade its nearest and furthest tip and its length."""
    from cladeframe.operators.large import fold_large, index_large
    from cladeframe.schema import heap_forest
    from cladeframe.sources.newick import numbered

    orders = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rank = numbered(orders.select("o_orderkey", cents.alias("cents")).orderBy("o_orderkey"), "k").withColumn("rank", (F.col("k") - 1).cast("int"))
    rows = rank.select(F.lit(0).cast("long").alias("tree_id"), "rank", F.lit(orders.count()).cast("int").alias("m"), F.col("o_orderkey").cast("string").alias("label"), (F.col("cents") % 80 / 8).alias("tip_length"), (F.col("cents") % 56 / 8).alias("inner_length"), F.lit(None).cast("string").alias("inner_label"))
    nodes = _checkpoint(index_large(heap_forest(rows)))
    tip = F.when(F.col("is_tip"), F.col("root_dist"))
    r = fold_large(nodes, ["tree_id", "node_id", "depth", "n_tips", "root_dist", "branch_length"], block=4096, near=(tip, "min"), far=(tip, "max"), total=(F.col("branch_length"), "sum"))
    up = F.col("branch_length") - F.col("root_dist")
    own = nodes.select("node_id", "pre")
    return whole(r.join(own, "node_id").select("node_id", "pre", "depth", "n_tips", "root_dist", (F.col("near") + up).alias("shortest"), (F.col("far") + up).alias("furthest"), "total"), "node_id", "pre", "depth", "n_tips")


QUERIES["whole_table_tree"], ORACLES["whole_table_tree"] = whole_table_tree, ALL_SQL
