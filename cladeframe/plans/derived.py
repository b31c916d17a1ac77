"""Trees, sequences and taxonomies that the driver's plain tables hold.

Each is given twice: as a DataFrame and as the SQL of the same relation, so that any
engine can evaluate the queries.  Branch lengths are multiples of 1/8, so their sums
are exact in whatever order they are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cladeframe.schema import by_sorting, heap_forest, index_forest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three trees per customer over the customer's orders: by price, by date, by key.  One shuffle by customer."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    own = Window.partitionBy("o_custkey")
    rank = lambda *order: F.row_number().over(own.orderBy(*order)) - 1
    ranks = F.array(rank("o_totalprice", "o_orderkey"), rank("o_orderdate", "o_orderkey"), rank("o_orderkey"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", cents.alias("cents"), ranks.alias("ranks"), F.count("*").over(own).cast("int").alias("m"))
    o = o.select("o_custkey", "o_orderkey", "cents", "m", F.posexplode("ranks").alias("t", "rank"))
    return o.select((F.col("o_custkey") * 3 + F.col("t")).alias("tree_id"), "rank", "m", F.col("o_orderkey").cast("string").alias("label"), (F.col("cents") % 80 / 8).alias("tip_length"), (F.col("cents") % 56 / 8).alias("inner_length"), (F.col("cents") % 101).cast("string").alias("inner_label"))


def order_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table of those trees."""
    return index_forest(heap_forest(order_rows(spark, sf_dir)))


def tree_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): each customer's price tree with the date tree, and the date tree with the key tree."""
    c = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    return by_sorting(c.select(F.explode(F.array(*[F.struct((F.col("o_custkey") * 3 + i).alias("a"), (F.col("o_custkey") * 3 + i + 1).alias("b")) for i in (0, 1)])).alias("p")).select("p.*"))


def named_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree_id, label): in each tree, the orders with an urgent or high priority."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return by_sorting(o.select(F.explode(F.array(*[F.col("o_custkey") * 3 + t for t in range(3)])).alias("tree_id"), F.col("o_orderkey").cast("string").alias("label")))


#: nodes(tree_id, k, label, len, tip), up(tree_id, k, a): ancestors with the node itself, dist(tree_id, k, d, depth).
NODES_SQL = """
WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
r AS (
  SELECT o_custkey * 3 AS tree_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS r, o_orderkey, cents FROM o
  UNION ALL SELECT o_custkey * 3 + 1, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1, o_orderkey, cents FROM o
  UNION ALL SELECT o_custkey * 3 + 2, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, o_orderkey, cents FROM o),
m AS (SELECT tree_id, count(*) AS m FROM r GROUP BY tree_id),
nodes AS MATERIALIZED (
  SELECT tree_id, CAST(m + r AS BIGINT) AS k, CAST(o_orderkey AS VARCHAR) AS label, (cents % 80) / 8 AS len, TRUE AS tip FROM r JOIN m USING (tree_id)
  UNION ALL SELECT tree_id, CAST(r AS BIGINT), CAST(cents % 101 AS VARCHAR), (cents % 56) / 8, FALSE FROM r WHERE r >= 1),
up AS MATERIALIZED (SELECT tree_id, k, k >> CAST(h AS INTEGER) AS a FROM (SELECT tree_id, k, UNNEST(range(length(bin(k)))) AS h FROM nodes)),
dist AS MATERIALIZED (SELECT u.tree_id, u.k, sum(n.len) AS d, count(*) - 1 AS depth FROM up u JOIN nodes n ON n.tree_id = u.tree_id AND n.k = u.a GROUP BY u.tree_id, u.k),
below AS MATERIALIZED (SELECT u.tree_id, u.a AS k, count(*) AS n FROM up u JOIN nodes n ON n.tree_id = u.tree_id AND n.k = u.k WHERE n.tip GROUP BY u.tree_id, u.a),
pairs AS (SELECT DISTINCT o_custkey * 3 + i AS a, o_custkey * 3 + i + 1 AS b FROM o, (SELECT * FROM range(2) t(i))),
named AS (SELECT o_custkey * 3 + t AS tree_id, CAST(o_orderkey AS VARCHAR) AS label FROM o, (SELECT * FROM range(3) t(t)) WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
"""
#: The nodes' order from left to right: the path from the root as a string of 0 and 1 behind the leading 1.
PATH_SQL = "substr(bin(k), 2)"
