"""Queries on sequences, characters, clusters and built trees, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions import sequences as fn
from cladeframe.operators import build, clusters, generate, search
from cladeframe.operators import forest as f
from cladeframe.operators import sequences as q
from cladeframe.operators.components import _checkpoint, _held
from cladeframe.plans import transforms
from cladeframe.plans.derived import NODES_SQL, named_tips, order_forest, table
from cladeframe.schema import index_forest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: One base per kind of line: its total quantity modulo 4; - where a supplier sold none.
SEQS_SQL = """
WITH line AS MATERIALIZED (SELECT l_suppkey, p_type || '/' || l_returnflag || '/' || l_linestatus AS cell, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
cells AS MATERIALIZED (SELECT DISTINCT cell FROM line),
seqs AS MATERIALIZED (
  SELECT s_suppkey AS seq_id, any_value(r_name || ';' || n_name) AS taxonomy, any_value(r_name) AS region, any_value(n_name) AS nation, any_value(s_suppkey // 500) AS blk,
         string_agg(coalesce(substr('ACGT', CAST(n % 4 AS INTEGER) + 1, 1), '-'), '' ORDER BY c.cell) AS sequence
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey CROSS JOIN cells c LEFT JOIN line l ON l.l_suppkey = s_suppkey AND l.cell = c.cell
  WHERE s_suppkey IN (SELECT l_suppkey FROM line) GROUP BY s_suppkey),
pairs AS (SELECT a.seq_id AS seq_id_a, b.seq_id AS seq_id_b, a.taxonomy AS taxonomy_a, b.taxonomy AS taxonomy_b, a.region, a.sequence AS sa, b.sequence AS sb FROM seqs a JOIN seqs b ON a.region = b.region AND a.blk = b.blk AND a.seq_id < b.seq_id),
site AS (SELECT seq_id_a, seq_id_b, taxonomy_a, taxonomy_b, region, UNNEST(string_split(sa, '')) AS x, UNNEST(string_split(sb, '')) AS y FROM pairs),
cmp AS (SELECT seq_id_a, seq_id_b, taxonomy_a, taxonomy_b, region, count(*) FILTER (x <> '-' AND y <> '-') AS compared, count(*) FILTER (x <> '-' AND y <> '-' AND x <> y) AS differences FROM site GROUP BY ALL),
d AS MATERIALIZED (SELECT *, CASE WHEN compared = 0 THEN 1.0 ELSE 1 - differences / compared END AS similarity FROM cmp),
jc AS (SELECT *, CASE WHEN 1 - similarity < 0.75 THEN -0.75 * ln(1 - (1 - similarity) * 4 / 3) ELSE CAST('inf' AS DOUBLE) END AS jc FROM d)
"""


def supplier_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, taxonomy, region, nation, sequence): an aligned sequence for each supplier that sold something."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.select(F.col("l_suppkey").alias("seq_id"), F.concat_ws("/", "p_type", "l_returnflag", "l_linestatus").alias("cell"), "l_quantity")
    total = lines.groupBy("seq_id", "cell").agg(F.sum("l_quantity").cast("long").alias("n"))
    base = F.substring(F.lit("ACGT"), (F.col("n") % 4 + 1).cast("int"), 1)
    held = total.groupBy("seq_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", base.alias("base")))).alias("bases"))
    # one row for the whole table: as many members as there are kinds of lines
    kinds = total.agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    letters = F.transform("cells", lambda c: F.coalesce(F.element_at("bases", c), F.lit("-")))
    seqs = held.withColumn("cells", kinds.scalar()).select("seq_id", F.array_join(letters, "").alias("sequence"))
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    place = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    place = place.select(F.col("s_suppkey").alias("seq_id"), F.concat_ws(";", "r_name", "n_name").alias("taxonomy"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
    return seqs.join(place, "seq_id").select("seq_id", "taxonomy", "region", "nation", "sequence")


#: Suppliers whose keys follow each other are compared: groups of them grow in number with the table, not in size.
BLOCK = 500


def blocked(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("blk", F.floor(F.col("seq_id") / BLOCK))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a region's suppliers in a block with their distances."""
    seqs = blocked(supplier_sequences(spark, sf_dir)).withColumn("states", fn.encode(F.col("sequence"))).select("seq_id", "taxonomy", "region", "blk", "states")
    return q.distances(q.sequence_pairs(_checkpoint(seqs), ["region", "blk"]))


def query(sql: str | None = None, prefix: str = SEQS_SQL):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = prefix + sql
        return function

    return add


@query("SELECT seq_id, taxonomy, sequence FROM seqs")
def seq_encode(spark, sf_dir):
    """Sequences encoded as state sets and decoded again."""
    s = supplier_sequences(spark, sf_dir)
    return s.select("seq_id", "taxonomy", F.translate(fn.decode(fn.encode(F.col("sequence"))), "?", "-").alias("sequence"))


@query("SELECT seq_id_a, seq_id_b, compared, differences FROM d")
def seq_pairs_hamming(spark, sf_dir):
    return compared(spark, sf_dir).select("seq_id_a", "seq_id_b", F.col("compared").cast("long").alias("compared"), F.col("differences").cast("long").alias("differences"))


@query("SELECT seq_id_a, seq_id_b, round(similarity, 6) AS similarity FROM d")
def seq_similarity(spark, sf_dir):
    return compared(spark, sf_dir).select("seq_id_a", "seq_id_b", F.round("similarity", 6).alias("similarity"))


def rounded(name: str) -> Column:
    """As the SQL rounds: the distance of equal sequences is -3/4 ln(1), a negative zero that stays one."""
    return F.when(F.col(name) == 0, F.col(name)).otherwise(F.round(name, 6)).alias(name)


@query("SELECT seq_id_a, seq_id_b, round(jc, 6) AS jc FROM jc")
def jc_distance(spark, sf_dir):
    """Infinite from p = 3/4 on."""
    return compared(spark, sf_dir).select("seq_id_a", "seq_id_b", rounded("jc"))


@query("SELECT seq_id_a, seq_id_b, round(jc - (1 - similarity), 6) AS jc_minus_p FROM jc")
def jc_minus_p(spark, sf_dir):
    return compared(spark, sf_dir).select("seq_id_a", "seq_id_b", rounded("jc_minus_p"))


@query("SELECT seq_id, length(sequence) - 2 * length(regexp_replace(sequence, '[^-]', '', 'g')) AS completeness FROM seqs")
def completeness(spark, sf_dir):
    """What a supplier never sold counts as unknown (N)."""
    return supplier_sequences(spark, sf_dir).select("seq_id", q.completeness(F.translate("sequence", "-", "N")).cast("long").alias("completeness"))


CLUSTER_SQL = """, links AS (SELECT seq_id_a AS a, seq_id_b AS b FROM d WHERE similarity > 0.45 UNION SELECT seq_id_b, seq_id_a FROM d WHERE similarity > 0.45),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.seq_id AS member, least(s.seq_id, coalesce(min(r.b), s.seq_id)) AS lead FROM seqs s LEFT JOIN reach r ON r.a = s.seq_id GROUP BY s.seq_id"""


@query(CLUSTER_SQL, SEQS_SQL.replace("WITH line", "WITH RECURSIVE line", 1))
def seq_clusters(spark, sf_dir):
    """No sequence has an N, so all are as complete and the smallest id leads."""
    seqs = supplier_sequences(spark, sf_dir).select("seq_id", q.completeness(F.col("sequence")).alias("completeness"))
    return q.cluster(seqs, compared(spark, sf_dir), 0.45)


GENE_CUTS = {"AFRICA": 0.3, "ASIA": 0.4, "EUROPE": 0.5, "AMERICA": 0.6}


@query(CLUSTER_SQL.replace("similarity > 0.45", "similarity > CASE region " + " ".join(f"WHEN '{r}' THEN {c}" for r, c in GENE_CUTS.items()) + " ELSE 0.45 END"), SEQS_SQL.replace("WITH line", "WITH RECURSIVE line", 1))
def gene_clusters(spark, sf_dir):
    """A cut-off for each region; those without one take the general one."""
    seqs = supplier_sequences(spark, sf_dir).select("seq_id", q.completeness(F.col("sequence")).alias("completeness"))
    cuts = spark.createDataFrame(list(GENE_CUTS.items()), "region string, cut_off double")
    return q.cluster(seqs, compared(spark, sf_dir), 0.45, by="region", cut_offs=cuts)


@query("SELECT seq_id_a, seq_id_b, CASE WHEN taxonomy_a = taxonomy_b THEN taxonomy_a ELSE region END AS taxon FROM pairs")
def taxon_lca(spark, sf_dir):
    p = q.sequence_pairs(blocked(supplier_sequences(spark, sf_dir)).select("seq_id", "taxonomy", "region", "blk"), ["region", "blk"])
    return p.select("seq_id_a", "seq_id_b", F.array_join(q.common_taxon(F.col("taxonomy_a"), F.col("taxonomy_b")), ";").alias("taxon"))


MAD_SQL = """, v AS (SELECT region AS taxon, floor(least((jc - (1 - similarity)) * 1000, 1999)) AS bin FROM jc UNION ALL SELECT taxonomy_a, floor(least((jc - (1 - similarity)) * 1000, 1999)) FROM jc WHERE taxonomy_a = taxonomy_b),
med AS (SELECT taxon, quantile_disc(bin, 0.5) AS med, count(*) AS n FROM v GROUP BY taxon),
mad AS (SELECT taxon, any_value(n) AS n, quantile_disc(abs(bin - med), 0.5) * 1.4826 / 1000 AS mad FROM v JOIN med USING (taxon) GROUP BY taxon)
"""


@query(MAD_SQL + "SELECT taxon, n, round(mad, 6) AS mad FROM mad")
def mad_by_taxon(spark, sf_dir):
    return q.mad_by_taxon(compared(spark, sf_dir)).select("taxon", "n", F.round("mad", 6).alias("mad"))


@query(MAD_SQL + """SELECT taxon, CASE WHEN mad < 0.2 THEN 'A' ELSE 'T' END AS kind FROM mad m
WHERE (mad < 0.2 OR NOT EXISTS (SELECT 1 FROM mad x WHERE starts_with(x.taxon, m.taxon || ';')))
AND NOT EXISTS (SELECT 1 FROM mad u WHERE starts_with(m.taxon, u.taxon || ';') AND u.mad < 0.2)""")
def alignment_groups(spark, sf_dir):
    return q.alignment_groups(q.mad_by_taxon(compared(spark, sf_dir)), 0.2)


@query()
def align_pairs(spark, sf_dir):
    """Unaligned: the gaps taken out, suppliers of a nation against each other."""
    s = blocked(supplier_sequences(spark, sf_dir)).select("seq_id", "nation", "blk", F.translate("sequence", "-", "").alias("sequence"))
    return q.align_pairs(q.sequence_pairs(s, ["nation", "blk"]))


def nation_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distance matrix for each nation's suppliers of a block."""
    seqs = blocked(supplier_sequences(spark, sf_dir)).withColumn("states", fn.encode(F.col("sequence"))).select("seq_id", "nation", "blk", "states")
    d = q.distances(q.sequence_pairs(_checkpoint(seqs), ["nation", "blk"]))
    return d.select(F.xxhash64("nation", "blk").alias("matrix_id"), F.col("seq_id_a").alias("i"), F.col("seq_id_b").alias("j"), F.col("p").alias("d"))


@query()
def nj_tree(spark, sf_dir):
    return index_forest(build.neighbour_joining(nation_matrices(spark, sf_dir)))


@query(""", dn AS (SELECT a.nation, d.seq_id_a, d.seq_id_b FROM d JOIN seqs a ON a.seq_id = d.seq_id_a JOIN seqs b ON b.seq_id = d.seq_id_b WHERE a.nation = b.nation AND 1 - similarity < 0.74),
ends AS (SELECT nation, count(DISTINCT t) AS taxa FROM (SELECT nation, UNNEST([seq_id_a, seq_id_b]) AS t FROM dn) GROUP BY nation),
held AS (SELECT nation, count(*) AS rows FROM dn GROUP BY nation)
SELECT nation, rows, taxa FROM held JOIN ends USING (nation) WHERE rows <> taxa * (taxa - 1) / 2""", SEQS_SQL.replace(" AND a.blk = b.blk", ""))
def invalid_matrices(spark, sf_dir):
    """The whole nations' matrices without their far pairs: those that so don't hold each pair of their taxa."""
    seqs = supplier_sequences(spark, sf_dir).withColumn("states", fn.encode(F.col("sequence"))).select("seq_id", "region", "nation", "states")
    d = q.tiled_distances(_checkpoint(seqs), ["region", "nation"], below=0.74)
    dist = d.select(F.col("nation").alias("matrix_id"), F.col("seq_id_a").alias("i"), F.col("seq_id_b").alias("j"), F.col("p").alias("d"))
    return build.invalid_matrices(dist).select(F.col("matrix_id").alias("nation"), "rows", "taxa")


def order_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, states): of each order, its priority and its status as one-state sets."""
    o = table(spark, sf_dir, "orders")
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    s = F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")).cast("int")
    bit = lambda e: F.call_function("shiftleft", F.lit(1), e - 1)
    return o.select(F.col("o_orderkey").cast("string").alias("label"), F.array(F.coalesce(bit(p), F.lit(0)), F.when(s > 0, bit(s)).otherwise(0)).alias("states"))


#: States of the tips as sets, and the levels' template: children of node k are 2k and 2k + 1.
LEVELS = 16
TIP_SQL = """, st AS MATERIALIZED (SELECT n.tree_id, n.k, length(bin(n.k)) - 1 AS depth, n.len, n.tip, 1 << (CAST(substr(o2.o_orderpriority, 1, 1) AS INTEGER) - 1) AS s1,
  1 << (CASE o2.o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) AS s2 FROM nodes n LEFT JOIN orders o2 ON n.tip AND n.label = CAST(o2.o_orderkey AS VARCHAR))"""


def level_sql(tip: str, inner: str, suffix: str = "") -> str:
    """One relation for each level from the deepest up: the tips' columns, and the inner nodes' from their children a and b."""
    out = ""
    for d in range(LEVELS, -1, -1):
        out += f", lv{suffix}{d} AS MATERIALIZED (SELECT n.tree_id, n.k, {tip} FROM st{suffix} n WHERE n.tip AND n.depth = {d}"
        if d < LEVELS:
            out += f" UNION ALL SELECT n.tree_id, n.k, {inner} FROM st{suffix} n JOIN lv{suffix}{d + 1} a ON a.tree_id = n.tree_id AND a.k = 2 * n.k JOIN lv{suffix}{d + 1} b ON b.tree_id = n.tree_id AND b.k = 2 * n.k + 1 WHERE NOT n.tip AND n.depth = {d}"
        out += ")"
    return out


FITCH_SQL = TIP_SQL + level_sql(
    "n.s1, n.s2, 0 AS c",
    ", ".join(f"CASE WHEN a.s{i} & b.s{i} <> 0 THEN a.s{i} & b.s{i} ELSE a.s{i} | b.s{i} END AS s{i}" for i in (1, 2)) + ", a.c + b.c + CAST(a.s1 & b.s1 = 0 AS INTEGER) + CAST(a.s2 & b.s2 = 0 AS INTEGER) AS c",
)


@query(FITCH_SQL + " SELECT tree_id, CAST(c AS BIGINT) AS score FROM lv0", NODES_SQL)
def fitch_score(spark, sf_dir):
    return build.fitch_score(order_forest(spark, sf_dir), order_characters(spark, sf_dir))


@query(FITCH_SQL + " SELECT tree_id, CAST(c AS BIGINT) AS changes, CAST(2 * m - 1 AS BIGINT) AS n_nodes, TRUE AS in_first_sets FROM lv0 JOIN m USING (tree_id)", NODES_SQL)
def fitch_states(spark, sf_dir):
    """The second pass changes as often as the first one counts, and takes states of the first pass's sets."""
    nodes, chars = _held(order_forest(spark, sf_dir)), order_characters(spark, sf_dir)
    first = build.fitch(nodes, chars).select("tree_id", "node_id", F.col("states").alias("sets"))
    r = build.fitch_states(nodes, chars).join(first, ["tree_id", "node_id"])
    fits = F.forall(F.zip_with("states", "sets", lambda a, b: a.bitwiseAND(b) == a), lambda x: x)
    return r.groupBy("tree_id").agg(F.sum("changes").cast("long").alias("changes"), F.count("*").alias("n_nodes"), F.bool_and(fits).alias("in_first_sets"))


def nation_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = blocked(supplier_sequences(spark, sf_dir))
    return s.select(F.xxhash64("nation", "blk").alias("matrix_id"), F.col("seq_id").cast("string").alias("label"), fn.encode(F.col("sequence")).alias("states"))


@query()
def stepwise(spark, sf_dir):
    chars = nation_characters(spark, sf_dir)
    few = chars.groupBy("matrix_id").agg(F.count("*").alias("n")).where("n >= 3").select("matrix_id")
    return index_forest(build.stepwise_addition(chars.join(few, "matrix_id", "left_semi"), replicates=2))


def likelihood_sql(lengths: str = "", state: str = "s1", suffix: str = "") -> str:
    """Partials of five states that change into each other at one rate, level by level.

    ``lengths``: relations that end in one named t (tree_id, k, t), the lengths to use; ``state``: the
    character; ``suffix``: for the relations of a second one.
    e is (1 - x)^(2^20) with x = t / 2^20, by the series of ln(1 - x), as 1 - x itself
    keeps too few digits of a small x.
    """
    message = "list_transform(range(1, 6), lambda i: {c}.e * {c}.l[i] + (1 - {c}.e) * list_sum({c}.l) / 5)"
    both = f"list_transform(range(1, 6), lambda j: ({message.format(c='a')})[j] * ({message.format(c='b')})[j])"
    own = "" if suffix else lengths or ", t AS (SELECT tree_id, k, len AS t FROM nodes)"
    tips = TIP_SQL.replace(", st AS", f", st{suffix} AS").replace("n.len, n.tip", "exp(-t.t * (1 + t.t / 1048576 / 2 + pow(t.t / 1048576, 2) / 3 + pow(t.t / 1048576, 3) / 4)) AS e, n.tip").replace("FROM nodes n LEFT JOIN orders", "FROM nodes n JOIN t USING (tree_id, k) LEFT JOIN orders")
    return own + tips + level_sql("n.tip, n.e, list_transform(range(1, 6), lambda i: CAST((n.{state} >> CAST(i - 1 AS INTEGER)) & 1 AS DOUBLE)) AS l".replace("{state}", state), f"n.tip, n.e, {both} AS l", suffix)


TOTAL_SQL = " SELECT tree_id, CASE WHEN list_sum(l) > 0 THEN round(ln(list_sum(l) / 5), 4) ELSE CAST('-inf' AS DOUBLE) END AS log_likelihood FROM lv0"
FIVE = build.Model(5, frequencies=[0.2] * 5)


@query(likelihood_sql() + TOTAL_SQL, NODES_SQL)
def likelihood(spark, sf_dir):
    return build.log_likelihood(order_forest(spark, sf_dir), order_characters(spark, sf_dir), FIVE).withColumn("log_likelihood", F.round("log_likelihood", 4))


@query(likelihood_sql() + ", one AS MATERIALIZED (SELECT tree_id, list_sum(l) AS l FROM lv0)" + likelihood_sql(state="s2", suffix="z") + " SELECT tree_id, CASE WHEN one.l > 0 AND list_sum(z.l) > 0 THEN round(ln(one.l / 5) + ln(list_sum(z.l) / 5), 4) ELSE CAST('-inf' AS DOUBLE) END AS log_likelihood FROM one JOIN lvz0 z USING (tree_id)", NODES_SQL)
def likelihood_all(spark, sf_dir):
    """All characters of the orders: priority and status."""
    r = build.log_likelihood(order_forest(spark, sf_dir), order_characters(spark, sf_dir), FIVE, positions=None)
    return r.withColumn("log_likelihood", F.round("log_likelihood", 4))


@query(likelihood_sql() + TOTAL_SQL.replace("list_sum(l) / 5", "list_sum(l)"), NODES_SQL)
def likelihood_one_way(spark, sf_dir):
    """A model that is not reversible: the root is the plain sum of its states' likelihoods."""
    one = build.Model(5, rates=[0.2], classes=[[None if i == j else 0 for j in range(5)] for i in range(5)], reversible=False)
    return build.log_likelihood(order_forest(spark, sf_dir), order_characters(spark, sf_dir), one).withColumn("log_likelihood", F.round("log_likelihood", 4))


@query(likelihood_sql(transforms.ORACLES["skyline_scale"].removeprefix(NODES_SQL).replace("SELECT tree_id, k AS node_id, greatest", ", t AS (SELECT tree_id, k, greatest").replace(" AS branch_length FROM e", " AS t FROM e UNION ALL SELECT tree_id, k, len FROM nodes WHERE k = 1)")) + TOTAL_SQL, NODES_SQL)
def likelihood_skyline(spark, sf_dir):
    """Rates of change that hold by distance from the root."""
    r = build.log_likelihood(order_forest(spark, sf_dir), order_characters(spark, sf_dir), FIVE, cuts=[(5.0, 2.0), (12.5, 0.5)])
    return r.withColumn("log_likelihood", F.round("log_likelihood", 4))


@query(likelihood_sql(transforms.ORACLES["clade_scale"].removeprefix(NODES_SQL).replace("SELECT n.tree_id, n.k AS node_id, n.len", ", t AS (SELECT n.tree_id, n.k, n.len").replace(" AS branch_length\n", " AS t\n") + ")") + TOTAL_SQL, NODES_SQL)
def likelihood_clades(spark, sf_dir):
    """Three times the rate of change below the common ancestor of the urgent orders."""
    sets = named_tips(spark, sf_dir).select("tree_id", "label", F.lit("urgent").alias("set_id"), F.lit(3.0).alias("rate"))
    r = build.log_likelihood(order_forest(spark, sf_dir), order_characters(spark, sf_dir), FIVE, clades=sets)
    return r.withColumn("log_likelihood", F.round("log_likelihood", 4))


@query(likelihood_sql() + " SELECT tree_id, k AS node_id, " + ", ".join(f"round(l[{i}] / list_sum(l), 6) AS p{i}" for i in range(1, 6)) + " FROM (" + " UNION ALL ".join(f"SELECT * FROM lv{d} WHERE NOT tip" for d in range(LEVELS)) + ") WHERE list_sum(l) > 0", NODES_SQL)
def ancestral(spark, sf_dir):
    r = build.ancestral_states(order_forest(spark, sf_dir), order_characters(spark, sf_dir), FIVE)
    return r.where("likelihoods IS NOT NULL").select("tree_id", F.col("node_id").cast("long").alias("node_id"), *[F.round(F.col("likelihoods")[i], 6).alias(f"p{i + 1}") for i in range(5)])


@query()
def simulate_chars(spark, sf_dir):
    return build.simulate_characters(order_forest(spark, sf_dir), build.Model(4, rates=[0.05] * 6, frequencies=[0.25] * 4), 20, seed=1)


def customer_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("tree_id")).agg(F.count("*").cast("int").alias("n"))


DRAWN_SQL = "SELECT o_custkey AS tree_id, 2 * count(*) - 1 AS n_nodes, array_to_string(range(1, count(*) + 1), ',') AS labels, TRUE AS ultrametric, TRUE AS binary FROM orders GROUP BY o_custkey"


def drawn(raw: DataFrame) -> DataFrame:
    """What is certain of drawn trees: nodes, labels, whether all tips are as far from the root, and all nodes have two children or none."""
    r = index_forest(raw)
    kids = r.where("parent_id IS NOT NULL").groupBy("tree_id", "parent_id").agg(F.count("*").alias("k")).groupBy("tree_id").agg(F.bool_and(F.col("k") == 2).alias("binary"))
    tip = F.when(F.col("is_tip"), F.col("root_dist"))
    labels = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("is_tip"), F.col("label").cast("long")))), lambda x: x.cast("string")), ",")
    n = r.groupBy("tree_id").agg(F.count("*").alias("n_nodes"), labels.alias("labels"), (F.max(tip) - F.min(tip) < 1e-9).alias("ultrametric"))
    return n.join(kids, "tree_id", "left").withColumn("binary", F.coalesce("binary", F.lit(True)))


@query(DRAWN_SQL, "")
def random_trees(spark, sf_dir):
    """A coalescent tree with as many tips as a customer has orders."""
    return drawn(generate.random_trees(customer_sizes(spark, sf_dir), "coalescent", seed=3))


@query(DRAWN_SQL, "")
def yule_trees(spark, sf_dir):
    return drawn(generate.random_trees(customer_sizes(spark, sf_dir), "yule", seed=4))


@query("SELECT DISTINCT o_custkey AS tree_id, TRUE AS binary, TRUE AS in_time, TRUE AS named FROM orders", "")
def birth_death_trees(spark, sf_dir):
    """Trees grown for a time of 2: two children or none, no tip beyond that time, tips named Tip1, Tip2, ..."""
    r = index_forest(generate.birth_death_trees(customer_sizes(spark, sf_dir), 1.0, 0.3, 2.0, seed=3))
    kids = r.where("parent_id IS NOT NULL").groupBy("tree_id", "parent_id").agg(F.count("*").alias("k")).groupBy("tree_id").agg(F.bool_and(F.col("k") == 2).alias("two"))
    number = F.when(F.col("is_tip"), F.regexp_extract("label", "^Tip([0-9]+)$", 1).cast("long"))
    named = (F.min(number) == 1) & (F.max(number) == F.count_if("is_tip")) & (F.countDistinct(number) == F.count_if("is_tip"))
    n = r.groupBy("tree_id").agg((F.max("root_dist") < 2 + 1e-9).alias("in_time"), named.alias("named"))
    return n.join(kids, "tree_id", "left").select("tree_id", F.coalesce("two", F.lit(True)).alias("binary"), "in_time", "named")


@query("SELECT n.tree_id, n.label, d AS root_dist FROM nodes n JOIN dist USING (tree_id, k) WHERE tip", NODES_SQL)
def grafted_trees(spark, sf_dir):
    """Lineages born on branches leave the old tips where they were."""
    r = index_forest(generate.add_branches(order_forest(spark, sf_dir), 0.1, 0.05, seed=5))
    return r.where("is_tip AND NOT startswith(label, 'Tip')").select("tree_id", "label", F.round("root_dist", 6).alias("root_dist"))


@query(FITCH_SQL + " SELECT tree_id, CAST(c AS DOUBLE) AS changes, CAST(2 AS BIGINT) AS traits FROM lv0", NODES_SQL)
def fitch_trees(spark, sf_dir):
    """The second pass as trees: their lengths are the changes, as many as the first pass counts."""
    r = build.fitch_trees(_held(order_forest(spark, sf_dir)), order_characters(spark, sf_dir))
    return r.groupBy("tree_id").agg(F.sum("branch_length").alias("changes"), F.max(F.size("ann")).cast("long").alias("traits"))


@query()
def optimise_model(spark, sf_dir):
    """Rates, frequencies and a skyline's rate of largest likelihood for each nation's stepwise tree."""
    chars = nation_characters(spark, sf_dir)
    few = chars.groupBy("matrix_id").agg(F.count("*").alias("n")).where("n >= 3").select("matrix_id")
    chars = _checkpoint(chars.join(few, "matrix_id", "left_semi"))
    start = transforms.t.set_branch_lengths(index_forest(build.stepwise_addition(chars)), 0.1)
    by_tree = chars.select(F.col("matrix_id").alias("tree_id"), "label", "states")
    return build.optimise(start, by_tree, 4, positions=None, free_frequencies=True, cuts=[(0.3, 1.0)], rates=[1.0] * 2, frequencies=[0.25] * 4, classes=[[None, 0, 1, 1], [0, None, 1, 1], [1, 1, None, 0], [1, 1, 0, None]])


@query()
def decisive_random(spark, sf_dir):
    """Random topologies of each customer's orders: the shares of decisive ones and of distinguished branches."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    genes = lines.select(F.col("l_orderkey").cast("string").alias("taxon"), F.col("p_type").alias("gene")).distinct()
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").cast("string").alias("label"))
    r = _checkpoint(generate.random_decisiveness(orders.join(generate.gene_masks(genes), "label", "left"), seed=2))
    return generate.decisive_share(r)


DECISIVE_SQL = """, types AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS b FROM (SELECT DISTINCT p_type FROM part)),
mask AS (SELECT CAST(l_orderkey AS VARCHAR) AS label, bit_or(1 << CAST(b AS INTEGER)) AS mask FROM lineitem JOIN part ON l_partkey = p_partkey JOIN types USING (p_type) GROUP BY l_orderkey),
tipm AS (SELECT n.tree_id, n.k, coalesce(mask, 0) AS mask FROM nodes n LEFT JOIN mask USING (label) WHERE n.tip),
nm AS (SELECT u.tree_id, u.a AS k, bit_or(t.mask) AS mask FROM tipm t JOIN up u USING (tree_id, k) GROUP BY u.tree_id, u.a),
br AS (SELECT n.tree_id, n.k, l.mask & r.mask AS own, CASE WHEN n.k = 2 THEN s1.mask ELSE s.mask END AS c, s2.mask AS d2
  FROM nodes n JOIN nm l ON l.tree_id = n.tree_id AND l.k = 2 * n.k JOIN nm r ON r.tree_id = n.tree_id AND r.k = 2 * n.k + 1
  JOIN nm s ON s.tree_id = n.tree_id AND s.k = xor(n.k, 1) LEFT JOIN nm s1 ON s1.tree_id = n.tree_id AND s1.k = 6 LEFT JOIN nm s2 ON s2.tree_id = n.tree_id AND s2.k = 7
  WHERE NOT n.tip AND n.k > 1 AND n.k <> 3),
rest AS (SELECT b.tree_id, b.k, bit_or(t.mask) AS above FROM br b JOIN tipm t ON t.tree_id = b.tree_id
  WHERE NOT EXISTS (SELECT 1 FROM up u WHERE u.tree_id = t.tree_id AND u.k = t.k AND u.a = b.k // 2) GROUP BY b.tree_id, b.k),
full4 AS (SELECT b.tree_id, b.k, own, c, CASE WHEN b.k = 2 THEN d2 ELSE above END AS d FROM br b LEFT JOIN rest USING (tree_id, k))
SELECT tree_id, count(*) AS branches, count(*) FILTER (own & c & d <> 0) AS distinguished FROM full4 WHERE c IS NOT NULL AND d IS NOT NULL GROUP BY tree_id"""


@query(DECISIVE_SQL, NODES_SQL)
def decisive_branches(spark, sf_dir):
    """Genes are the part types that an order holds."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    genes = lines.select(F.col("l_orderkey").cast("string").alias("taxon"), F.col("p_type").alias("gene")).distinct()
    return generate.decisiveness(_held(order_forest(spark, sf_dir)), generate.gene_masks(genes))


@query(""", cutb AS (SELECT n.tree_id, n.k FROM nodes n JOIN nodes x ON x.tree_id = n.tree_id AND x.k = 2 JOIN nodes y ON y.tree_id = n.tree_id AND y.k = 3
  WHERE n.k > 1 AND CASE WHEN n.k = 2 THEN x.len + y.len > 6 WHEN n.k = 3 THEN FALSE ELSE n.len > 6 END),
c AS (SELECT tree_id, k FROM cutb UNION SELECT tree_id, 1 FROM nodes)
SELECT n.tree_id, max(u.a) AS cluster, n.label FROM nodes n JOIN up u USING (tree_id, k) JOIN c ON c.tree_id = u.tree_id AND c.k = u.a WHERE n.tip GROUP BY n.tree_id, n.label""", NODES_SQL)
def cluster_long_branch(spark, sf_dir):
    r = clusters.cluster_by_long_branch(order_forest(spark, sf_dir), 6.0)
    return r.select("tree_id", F.col("cluster").cast("long").alias("cluster"), "label")


#: What is below a good node is good, so a tip's cluster is the highest one on its way.
MAXIMAL_SQL = """, held AS MATERIALIZED (SELECT u.tree_id, u.k, min(u.a) AS cluster FROM up u JOIN good g ON g.tree_id = u.tree_id AND g.k = u.a GROUP BY u.tree_id, u.k)
SELECT n.tree_id, cluster, n.label FROM nodes n JOIN held USING (tree_id, k) WHERE n.tip"""


@query(""", val AS (SELECT n.tree_id, n.k, o_orderstatus AS v FROM nodes n JOIN orders o2 ON n.label = CAST(o2.o_orderkey AS VARCHAR) WHERE n.tip),
good AS (SELECT u.tree_id, u.a AS k FROM val JOIN up u USING (tree_id, k) GROUP BY u.tree_id, u.a HAVING count(DISTINCT v) = 1)""" + MAXIMAL_SQL, NODES_SQL)
def cluster_by_value(spark, sf_dir):
    """Clades of orders with the same status."""
    values = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("label"), F.col("o_orderstatus").alias("value"))
    r = clusters.cluster_by_value(order_forest(spark, sf_dir), values)
    return r.select("tree_id", F.col("cluster").cast("long").alias("cluster"), "label")


@query(""", near AS (SELECT u.tree_id, u.a AS k, min(x.d - y.d + n.len) AS s FROM up u JOIN nodes t ON t.tree_id = u.tree_id AND t.k = u.k AND t.tip JOIN dist x ON x.tree_id = u.tree_id AND x.k = u.k JOIN dist y ON y.tree_id = u.tree_id AND y.k = u.a JOIN nodes n ON n.tree_id = u.tree_id AND n.k = u.a GROUP BY u.tree_id, u.a),
bad AS (SELECT tree_id, k // 2 AS k FROM near WHERE k > 1 GROUP BY tree_id, k // 2 HAVING sum(s) >= 12),
good AS (SELECT tree_id, k FROM nodes EXCEPT SELECT u.tree_id, u.a FROM bad JOIN up u ON u.tree_id = bad.tree_id AND u.k = bad.k)""" + MAXIMAL_SQL, NODES_SQL)
def cluster_branch_length(spark, sf_dir):
    r = clusters.cluster_by_branch_length(_held(order_forest(spark, sf_dir)), 12.0)
    return r.select("tree_id", F.col("cluster").cast("long").alias("cluster"), "label")


@query(""", named2 AS (SELECT n.tree_id, n.k, split_part(o_orderpriority, '-', 2) AS v, o_orderpriority || '-' || n.label AS label FROM nodes n JOIN o ON n.label = CAST(o.o_orderkey AS VARCHAR) WHERE n.tip),
good AS (SELECT u.tree_id, u.a AS k FROM named2 JOIN up u USING (tree_id, k) GROUP BY u.tree_id, u.a HAVING count(DISTINCT v) = 1)""" + MAXIMAL_SQL.replace("n.label FROM nodes n", "n.label FROM named2 n").replace(" WHERE n.tip", ""), NODES_SQL)
def cluster_tip_name(spark, sf_dir):
    """Clades whose tips' names (priority-order) agree in the second field."""
    from cladeframe.operators.transform import rename_tips_by_table

    names = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("label"), F.concat_ws("-", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("new_label"))
    r = clusters.cluster_by_tip_name(_held(rename_tips_by_table(order_forest(spark, sf_dir), names)), "-", 2)
    return r.select("tree_id", F.col("cluster").cast("long").alias("cluster"), "label")


@query("""SELECT n.tree_id, n.label, tip AS is_tip, len AS branch_length, depth FROM nodes n JOIN dist USING (tree_id, k)""", NODES_SQL)
def newick_roundtrip(spark, sf_dir):
    """Trees written as Newick text and read again."""
    from cladeframe.sources import newick

    back = index_forest(newick.parse(newick.to_newick(order_forest(spark, sf_dir))))
    return back.select("tree_id", "label", "is_tip", "branch_length", F.col("depth").cast("long").alias("depth"))


@query()
def parsimony_search(spark, sf_dir):
    """Hill climbing by interchanges from a stepwise tree of each nation's suppliers, all nations at once."""
    chars = nation_characters(spark, sf_dir)
    few = chars.groupBy("matrix_id").agg(F.count("*").alias("n")).where("n >= 4").select("matrix_id")
    chars = _checkpoint(chars.join(few, "matrix_id", "left_semi"))
    start = index_forest(build.stepwise_addition(chars))
    by_tree = chars.select(F.col("matrix_id").alias("tree_id"), "label", "states")
    return search.improve(start, by_tree)


@query()
def parsimony_sets(spark, sf_dir):
    """For each order with four suppliers or more, how many equally best trees of them interchanges find, and their score."""
    who = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("matrix_id"), F.col("l_suppkey").alias("seq_id")).distinct()
    # sets of four bases take a byte: each round moves them
    s = supplier_sequences(spark, sf_dir).select("seq_id", F.col("seq_id").cast("string").alias("label"), fn.encode(F.col("sequence")).cast("array<tinyint>").alias("states"))
    many = who.groupBy("matrix_id").agg(F.count("*").alias("n")).where("n >= 4")
    chars = _checkpoint(who.join(many, "matrix_id").join(s, "seq_id").select("matrix_id", "label", "states"))
    start = index_forest(build.stepwise_addition(chars)).withColumn("search", F.col("tree_id"))
    r = search.best_sets(start, chars.withColumnRenamed("matrix_id", "search"))
    return r.where("parent_id IS NULL").groupBy("search").agg(F.count("*").alias("n_trees"), F.min("score").alias("score"), F.max("n_tips").alias("n_tips"))


@query()
def alignable_groups(spark, sf_dir):
    """Each nation's suppliers halved until their distances are alike."""
    s = blocked(supplier_sequences(spark, sf_dir)).withColumn("states", fn.encode(F.col("sequence"))).select("seq_id", F.concat_ws("/", "nation", "blk").alias("grp"), "states")
    s = _checkpoint(s)
    d = q.distances(q.sequence_pairs(s, ["grp"]))
    return q.alignable_groups(s, d, limit=0.2)


@query("""SELECT n.tree_id, string_agg(label, ',' ORDER BY substr(bin(n.k), 2)) FILTER (tip) AS names, count(*) - 1 AS n_branches,
  round(max(CASE WHEN tip THEN (count_tips * 12.0) END), 2) AS height FROM nodes n JOIN (SELECT tree_id, greatest(m, 100 / 12.0) AS count_tips FROM m) USING (tree_id) GROUP BY n.tree_id""", NODES_SQL)
def svg_trees(spark, sf_dir):
    """Drawn trees: the names from top to bottom, the branches drawn, and the height."""
    from cladeframe.sources import newick

    svg = newick.to_svg(_held(order_forest(spark, sf_dir)))
    names = F.array_join(F.regexp_extract_all("svg", F.lit(">([^<>]+)</text>"), F.lit(1)), ",")
    height = F.regexp_extract("svg", 'height="([0-9.]+)"', 1).cast("double")
    return svg.select("tree_id", names.alias("names"), (F.size(F.split("svg", "<path")) - 1).cast("long").alias("n_branches"), height.alias("height"))
