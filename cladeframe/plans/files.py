"""Queries that write the derived trees, sequences and matrices in each format and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cladeframe.functions.sequences import decode, encode
from cladeframe.operators import forest as f
from cladeframe.operators import sequences as q
from cladeframe.operators import transform as t
from cladeframe.operators.components import _held, shared_folder
from cladeframe.plans import sequences as s
from cladeframe.plans.derived import NODES_SQL, order_forest, table
from cladeframe.schema import heap_forest, index_forest
from cladeframe.sources import matrices, newick
from cladeframe.sources.newick_scan import read_texts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, prefix: str = s.SEQS_SQL):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = prefix + sql
        return function

    return add


def place(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def one_file_each(text: DataFrame, path: str) -> str:
    """Each row's text in a file of its own."""
    text.write.option("maxRecordsPerFile", 1).text(path)
    return path


def lines_of(rows: DataFrame, by: str, line: F.Column, head: F.Column, tail: str = "") -> DataFrame:
    """(text): for each group a head, its lines in order, and a tail."""
    listed = F.array_join(F.sort_array(F.collect_list(line)), "\n")
    return rows.groupBy(by).agg(listed.alias("body"), F.count("*").alias("n"), F.max(F.length("sequence")).alias("width")).select(F.concat(head, F.lit("\n"), "body", F.lit(tail)))


@query("SELECT CAST(seq_id AS VARCHAR) AS seq_id, taxonomy, replace(sequence, '-', 'N') AS sequence, length(regexp_replace(sequence, '[^-]', '', 'g')) AS n_unknown, length(replace(sequence, '-', '')) AS n_known FROM seqs")
def fasta_roundtrip(spark, sf_dir):
    """Headers hold the taxonomy; what a supplier never sold is an N."""
    rows = s.supplier_sequences(spark, sf_dir)
    path = place(spark)
    matrices.write_fasta(rows.select(F.concat_ws(" | ", F.col("seq_id").cast("string"), "taxonomy").alias("label"), F.translate("sequence", "-", "N").alias("sequence")), path)
    r = matrices.read_fasta(spark, path)
    return r.select("seq_id", "taxonomy", "sequence", F.col("n_unknown").cast("long").alias("n_unknown"), F.col("n_known").cast("long").alias("n_known"))


def as_letters(characters: DataFrame) -> DataFrame:
    return characters.select("label", F.translate(decode(F.col("states")), "?", "-").alias("sequence"))


LABELS_SQL = "SELECT CAST(seq_id AS VARCHAR) AS label, sequence FROM seqs"


@query(LABELS_SQL)
def fasta_characters(spark, sf_dir):
    path = place(spark)
    matrices.write_fasta(s.supplier_sequences(spark, sf_dir).select(F.col("seq_id").cast("string").alias("label"), "sequence"), path)
    return as_letters(matrices.read_fasta_characters(spark, path))


@query(LABELS_SQL)
def phylip_roundtrip(spark, sf_dir):
    """A file for each nation."""
    line = F.concat_ws(" ", F.col("seq_id").cast("string"), "sequence")
    text = lines_of(s.supplier_sequences(spark, sf_dir), "nation", line, F.concat_ws(" ", F.col("n").cast("string"), F.col("width").cast("string")))
    return as_letters(matrices.read_phylip(spark, one_file_each(text, place(spark))))


@query(LABELS_SQL)
def nexus_characters(spark, sf_dir):
    """A data block for each nation."""
    line = F.concat_ws(" ", F.col("seq_id").cast("string"), "sequence")
    head = F.format_string("#NEXUS\nbegin data;\ndimensions ntax=%d nchar=%d;\nformat datatype=dna gap=-;\nmatrix", "n", "width")
    text = lines_of(s.supplier_sequences(spark, sf_dir), "nation", line, head, ";\nend;\n")
    return as_letters(matrices.read_nexus_characters(spark, one_file_each(text, place(spark))))


NATION_TREE_SQL = """
WITH r AS (SELECT s_nationkey AS tree_id, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r, count(*) OVER (PARTITION BY s_nationkey) AS m, CAST(round(abs(s_acctbal) * 100) AS BIGINT) % 80 / 8 AS len FROM supplier),
every AS (SELECT tree_id, m + r AS k, CAST(s_suppkey AS VARCHAR) AS label, len FROM r UNION ALL SELECT tree_id, r, NULL, len FROM r WHERE r >= 1)
"""


@query("SELECT 'tree_' || tree_id AS title, label, len AS branch_length, row_number() OVER (PARTITION BY tree_id ORDER BY substr(bin(CAST(k AS BIGINT)), 2)) - 1 AS pre FROM every", NATION_TREE_SQL)
def nexus_roundtrip(spark, sf_dir):
    """A tree of each nation's suppliers in a NEXUS file with taxa and translate commands."""
    supplier = table(spark, sf_dir, "supplier")
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    length = F.round(F.abs("s_acctbal") * 100).cast("long") % 80 / 8
    rows = supplier.select(F.col("s_nationkey").cast("long").alias("tree_id"), rank.alias("rank"), F.col("s_suppkey").cast("string").alias("label"), length.alias("tip_length"), length.alias("inner_length"), F.lit(None).cast("string").alias("inner_label"))
    text = newick.to_nexus(index_forest(heap_forest(rows))).select("nexus")
    back = newick.read_nexus(spark, one_file_each(text, place(spark)))
    titles = back.select("tree_id", "title").distinct()
    return index_forest(back).join(titles, "tree_id").select("title", "label", "branch_length", F.col("pre").cast("long").alias("pre"))


@query("SELECT tree_id, label, tip AS is_tip, len AS branch_length, d AS root_dist, row_number() OVER (PARTITION BY tree_id ORDER BY substr(bin(k), 2)) - 1 AS pre FROM nodes JOIN dist USING (tree_id, k)", NODES_SQL)
def newick_file(spark, sf_dir):
    """Trees written as lines of text, a numbered one each, and read again."""
    path = place(spark)
    text = newick.to_newick(order_forest(spark, sf_dir))
    text.select(F.concat_ws("\t", F.col("tree_id").cast("string"), "newick")).write.text(path)
    line = F.split("value", "\t")
    back = index_forest(newick.parse(spark.read.text(path).select(line[0].cast("long").alias("tree_id"), line[1].alias("newick"))))
    return back.select("tree_id", "label", "is_tip", "branch_length", "root_dist", F.col("pre").cast("long").alias("pre"))


#: A name of every kind that ends no tree.
NAMES_SQL = "label || CASE WHEN tip THEN ';''s, (' || CAST(k % 7 AS VARCHAR) || ') [no; comment] \"x' ELSE '' END"


def odd_names(nodes: DataFrame, k: F.Column) -> DataFrame:
    """The trees with semicolons, quotes, brackets and commas in their tips' names."""
    name = F.concat("label", F.lit(";'s, ("), (k % 7).cast("string"), F.lit(') [no; comment] "x'))
    return nodes.withColumn("label", F.when(F.col("is_tip"), name).otherwise(F.col("label")))


@query(f"SELECT tree_id, {NAMES_SQL} AS label, tip AS is_tip, len AS branch_length, row_number() OVER (PARTITION BY tree_id ORDER BY substr(bin(k), 2)) - 1 AS pre FROM nodes", NODES_SQL)
def newick_names(spark, sf_dir):
    """Trees whose names and comments hold what ends a tree elsewhere, read in byte ranges; a comment tells each tree's number."""
    path = place(spark)
    text = newick.to_newick(odd_names(order_forest(spark, sf_dir), F.col("node_id")))
    text.select(F.concat(F.lit("[a 'comment; [of comments;]]\n"), F.regexp_replace("newick", ";$", ""), F.lit("[&tree="), F.col("tree_id").cast("string"), F.lit("];"))).write.text(path)
    raw = newick.read_newick(spark, path)
    known = raw.where("parent_id IS NULL").select("tree_id", F.col("ann")["tree"].cast("long").alias("written"))
    return index_forest(raw).join(known, "tree_id").select(F.col("written").alias("tree_id"), "label", "is_tip", "branch_length", F.col("pre").cast("long").alias("pre"))


@query("SELECT problem, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders), (VALUES (NULL), ('a closing bracket is missing'), ('a closing bracket too many'), ('nothing there'), ('no tree can be made of it')) v(problem) GROUP BY problem", "")
def newick_problems(spark, sf_dir):
    """Each customer's file lines hold one tree and four texts that are none: how many of each are reported."""
    c = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    name = F.col("o_custkey").cast("string")
    text = F.concat(F.lit("('"), name, F.lit(";',b);(("), name, F.lit(",'b)');"), name, F.lit(",(a,b));[none;];("), name, F.lit(":long,b);"))
    path = place(spark)
    c.select(text).write.text(path)
    return newick.read_newick(spark, path, problems=True).where("parent_id IS NULL").groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT k AS ordinal, label FROM (SELECT dense_rank() OVER (ORDER BY tree_id) AS k, * FROM nodes WHERE tip) WHERE k BETWEEN 20 AND 29", NODES_SQL)
def newick_interval(spark, sf_dir):
    """The tips of the twentieth to twenty-ninth tree of files: other ranges aren't opened."""
    path = place(spark)
    newick.to_newick(order_forest(spark, sf_dir)).repartitionByRange(4, "tree_id").sortWithinPartitions("tree_id").select("newick").write.text(path)
    texts = read_texts(spark, path, (20, 29))
    return index_forest(newick.parse(texts)).where("is_tip").select(F.col("tree_id").alias("ordinal"), "label")


@query("SELECT least(CAST(seq_id_a AS VARCHAR), CAST(seq_id_b AS VARCHAR)) AS i, greatest(CAST(seq_id_a AS VARCHAR), CAST(seq_id_b AS VARCHAR)) AS j, round(1 - similarity, 4) AS d FROM d JOIN seqs x ON x.seq_id = seq_id_a JOIN seqs y ON y.seq_id = seq_id_b WHERE x.nation = y.nation AND x.blk = y.blk")
def distance_file(spark, sf_dir):
    """A triangular matrix for each nation as a file."""
    dist = s.nation_matrices(spark, sf_dir).select("matrix_id", F.col("i").cast("string").alias("i"), F.col("j").cast("string").alias("j"), "d")
    lines = matrices.matrix_text(dist)
    text = lines.groupBy("matrix_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_number", "line"))), lambda e: e["line"]), "\n").alias("text")).select("text")
    back = matrices.read_distances(spark, one_file_each(text, place(spark)))
    return back.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.round("d", 4).alias("d"))


@query("SELECT CAST(seq_id AS VARCHAR) AS label, taxonomy FROM seqs")
def taxonomy_file(spark, sf_dir):
    path = place(spark)
    names = s.supplier_sequences(spark, sf_dir).groupBy("taxonomy").agg(F.array_join(F.sort_array(F.collect_list(F.col("seq_id").cast("string"))), ", ").alias("names"))
    names.select(F.concat_ws(" | ", "taxonomy", "names")).write.text(path)
    return matrices.read_taxonomy(spark, path)


@query("SELECT gene, count(*) AS n_taxa FROM (SELECT DISTINCT l_orderkey, replace(p_type, ' ', '_') AS gene FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY gene", "")
def gene_file(spark, sf_dir):
    """A line of genes for each order: how many taxa have each."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    genes = lines.groupBy("l_orderkey").agg(F.array_join(F.collect_set(F.replace("p_type", F.lit(" "), F.lit("_"))), ",").alias("genes"))
    path = place(spark)
    genes.select("genes").write.text(path)
    return matrices.read_gene_list(spark, path).distinct().groupBy("gene").agg(F.count("*").alias("n_taxa"))


@query("SELECT substr(r_name, 1, 2) AS symbol, bit_or(1 << n_nationkey % 24) AS mask FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "")
def alphabet_file(spark, sf_dir):
    """A symbol for each region, its nations being the states."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    states = F.array_join(F.collect_set((F.col("n_nationkey") % 24).cast("string")), " ")
    path = place(spark)
    rows.groupBy("r_name").agg(states.alias("states")).select(F.concat_ws(" ", F.substring("r_name", 1, 2), "states")).write.text(path)
    return matrices.read_alphabet(spark, path).select("symbol", F.col("mask").cast("long").alias("mask"))


LEADS_SQL = s.CLUSTER_SQL.replace("\nSELECT s.seq_id AS member", ",\nfound AS (SELECT s.seq_id AS member") + ")"


def clusters_in(spark: SparkSession, sf_dir: str) -> str:
    path = place(spark)
    matrices.write_clusters(s.seq_clusters(spark, sf_dir), path)
    return path


@query(LEADS_SQL + " SELECT member AS accno, CASE WHEN member = lead THEN 'lead' ELSE CAST(lead AS VARCHAR) END AS cluster FROM found", s.SEQS_SQL.replace("WITH line", "WITH RECURSIVE line", 1))
def cluster_table(spark, sf_dir):
    return spark.read.parquet(clusters_in(spark, sf_dir))


@query(LEADS_SQL + " SELECT member AS seq_id, replace(sequence, '-', '') AS sequence FROM found JOIN seqs ON seq_id = member WHERE member = lead AND length(replace(sequence, '-', '')) > 20", s.SEQS_SQL.replace("WITH line", "WITH RECURSIVE line", 1))
def sequence_table(spark, sf_dir):
    """The leads of clusters with more than 20 bases, out of a table of sequences."""
    found = spark.read.parquet(clusters_in(spark, sf_dir))
    bases = s.supplier_sequences(spark, sf_dir).select(F.col("seq_id").alias("accno"), F.translate("sequence", "-", "").alias("sequence"))
    path = place(spark)
    bases.join(found, "accno").write.parquet(path)
    return matrices.read_sequence_table(spark, path, min_length=20, only_leads=True).select("seq_id", "sequence")


@query(s.ORACLES["alignment_groups"].removeprefix(s.SEQS_SQL).replace("SELECT taxon, CASE WHEN mad < 0.2 THEN 'A' ELSE 'T' END AS kind FROM mad m", "SELECT 'lines' AS gene, taxon, mad < 0.2 AS alignable FROM mad m"))
def alignment_group_table(spark, sf_dir):
    path = place(spark)
    matrices.write_alignment_groups(s.alignment_groups(spark, sf_dir), "lines", path)
    return spark.read.parquet(path)


@query("SELECT seq_id_a, seq_id_b, compared, differences FROM d JOIN seqs x ON x.seq_id = seq_id_a JOIN seqs y ON y.seq_id = seq_id_b WHERE length(replace(x.sequence, '-', '')) > 20 AND length(replace(y.sequence, '-', '')) > 20")
def pairs_of_long(spark, sf_dir):
    """Pairs of a region's sequences with more than 20 bases."""
    rows = s.blocked(s.supplier_sequences(spark, sf_dir)).withColumn("states", encode(F.col("sequence"))).withColumn("sequence", F.translate("sequence", "-", ""))
    r = q.distances(q.sequence_pairs(rows.select("seq_id", "region", "blk", "sequence", "states"), ["region", "blk"], min_length=20))
    return r.select("seq_id_a", "seq_id_b", F.col("compared").cast("long").alias("compared"), F.col("differences").cast("long").alias("differences"))


def nation_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table of a tree of each nation's suppliers."""
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    length = F.round(F.abs("s_acctbal") * 100).cast("long") % 80 / 8
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("tree_id"), rank.alias("rank"), F.col("s_suppkey").cast("string").alias("label"), length.alias("tip_length"), length.alias("inner_length"), F.lit(None).cast("string").alias("inner_label"))
    return index_forest(heap_forest(rows))


@query(""", up AS MATERIALIZED (SELECT tree_id, k, k >> CAST(h AS INTEGER) AS a, label IS NOT NULL AS tip FROM (SELECT tree_id, k, label, UNNEST(range(length(bin(CAST(k AS BIGINT))))) AS h FROM every)),
dist AS MATERIALIZED (SELECT u.tree_id, u.k, sum(n.len) AS d, any_value(u.tip) AS tip FROM up u JOIN every n ON n.tree_id = u.tree_id AND n.k = u.a GROUP BY u.tree_id, u.k),
paths AS MATERIALIZED (SELECT u.tree_id, u.a AS k, sum(d.d) AS d, count(*) AS n FROM up u JOIN dist d USING (tree_id, k) WHERE d.tip GROUP BY u.tree_id, u.a),
mp AS MATERIALIZED (SELECT p.tree_id, p.k, (p.d - n * y.d) / n AS mean_path FROM paths p JOIN dist y USING (tree_id, k)),
top AS (SELECT tree_id, mean_path / 100.0 AS r FROM mp WHERE k = 1 AND mean_path > 0)
SELECT mp.tree_id, mp.k AS node_id, round(mean_path, 10) AS mean_path, round(mean_path / r, 10) AS age FROM mp JOIN top USING (tree_id)""", NATION_TREE_SQL)
def nexus_ages(spark, sf_dir):
    """Trees and their roots' age read from the same NEXUS files, the age as a set of taxa that a private block dates."""
    nodes = nation_trees(spark, sf_dir)
    names = nodes.where("is_tip").groupBy("tree_id").agg(F.array_join(F.sort_array(F.collect_list("label")), " ").alias("taxa"))
    text = newick.to_nexus(nodes).join(names, "tree_id")
    block = F.concat(F.lit("begin calibration;\nmrca half = "), F.split("taxa", " ")[0], F.lit(";\nmrca every = half "), "taxa", F.lit(";\nfixage taxon=every age=100;\nend;\n"))
    path = one_file_each(text.select(F.concat("nexus", block)), place(spark))
    back = newick.read_nexus(spark, path)
    known = back.select("path", "tree_id", F.regexp_extract("title", "([0-9]+)$", 1).cast("long").alias("nation")).distinct()
    trees = _held(index_forest(back))
    sets, ages = newick.read_node_ages(spark, path)
    dated = sets.join(ages, ["path", "set_id"]).join(known, "path")
    top = f.mrca(trees, dated.select("tree_id", "label", F.lit("every").alias("set_id")).distinct()).where("set_id = 'every'")
    given = top.join(dated.select("tree_id", "age").distinct(), "tree_id").select("tree_id", "node_id", "age")
    r = t.mean_path_ages(trees, given)
    k = heap_numbers(trees)
    return r.join(k, ["tree_id", "node_id"]).join(known, "tree_id").select(F.col("nation").alias("tree_id"), F.col("k").alias("node_id"), F.round("mean_path", 10).alias("mean_path"), F.round("age", 10).alias("age"))


def heap_numbers(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, k): nodes of binary trees numbered by their way from the root: 1, then 2 k and 2 k + 1."""
    up = nodes.alias("a").join(nodes.alias("x"), (F.col("a.tree_id") == F.col("x.tree_id")) & F.col("x.pre").between(F.col("a.pre"), F.col("a.last")))
    side = F.when(F.col("a.parent_id").isNull(), 1).otherwise(F.col("a.child_ord"))
    steps = up.groupBy("x.tree_id", "x.node_id").agg(F.sort_array(F.collect_list(F.struct(F.col("a.depth").alias("depth"), side.alias("side")))).alias("way"))
    return steps.select("tree_id", "node_id", F.aggregate("way", F.lit(0).cast("long"), lambda k, s: 2 * k + s["side"]).alias("k"))


@query(", found AS (SELECT 'fasta' AS format, count(*) AS n FROM (SELECT DISTINCT nation FROM seqs) UNION ALL SELECT 'phylip', count(*) FROM (SELECT DISTINCT nation FROM seqs UNION ALL SELECT CAST(s_nationkey AS VARCHAR) FROM supplier GROUP BY s_nationkey HAVING count(*) = 1) UNION ALL SELECT 'nexus', count(*) FROM (SELECT DISTINCT nation FROM seqs) UNION ALL SELECT 'newick', count(*) FROM (SELECT s_nationkey FROM supplier GROUP BY s_nationkey HAVING count(*) > 1)) SELECT * FROM found WHERE n > 0")
def file_formats(spark, sf_dir):
    """Each nation's sequences and tree in files of four formats: how many files are taken for which (a tree of one supplier is a number)."""
    rows, path = s.supplier_sequences(spark, sf_dir), place(spark)
    line = F.concat_ws(" ", F.col("seq_id").cast("string"), "sequence")
    record = F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit("\n"), "sequence")
    kinds = {
        "fasta": lines_of(rows, "nation", record, F.lit("")),
        "phylip": lines_of(rows, "nation", line, F.concat_ws(" ", F.col("n").cast("string"), F.col("width").cast("string"))),
        "nexus": lines_of(rows, "nation", line, F.lit("\n#NEXUS\nbegin data;\nmatrix"), ";\nend;\n"),
        "newick": newick.to_newick(nation_trees(spark, sf_dir)).select("newick"),
    }
    found = None
    for name, text in kinds.items():
        one = newick.sniff_files(spark, one_file_each(text, f"{path}/{name}"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("format").agg(F.count("*").alias("n"))


@query(", n AS (SELECT seq_id AS a, lead(seq_id) OVER w AS b, sequence AS x, lead(sequence) OVER w AS y FROM seqs WINDOW w AS (PARTITION BY nation ORDER BY seq_id)), c AS (SELECT a, b, UNNEST(string_split(x, '')) AS x, UNNEST(string_split(y, '')) AS y FROM n WHERE b IS NOT NULL) SELECT CAST(a AS VARCHAR) AS seq_id_a, CAST(b AS VARCHAR) AS seq_id_b, count(*) FILTER (x <> '-' AND y <> '-') AS compared, count(*) FILTER (x <> '-' AND y <> '-' AND x <> y) AS differences FROM c GROUP BY a, b")
def pair_file(spark, sf_dir):
    """Each supplier and the next one of its nation as two records that follow each other in a file of pairs."""
    own = Window.partitionBy("nation").orderBy("seq_id")
    both = s.supplier_sequences(spark, sf_dir).select(F.col("seq_id").alias("a"), F.col("sequence").alias("x"), F.lead("seq_id").over(own).alias("b"), F.lead("sequence").over(own).alias("y")).where("b IS NOT NULL")
    path = place(spark)
    record = lambda i, text: F.concat(F.lit(">"), F.col(i).cast("string"), F.lit("\n"), F.col(text))
    both.select(F.concat(record("a", "x"), F.lit("\n"), record("b", "y"))).write.text(path)
    pairs = matrices.read_pair_file(spark, path).select("seq_id_a", "seq_id_b", encode(F.col("sequence_a")).alias("states_a"), encode(F.col("sequence_b")).alias("states_b"))
    return q.distances(pairs).select("seq_id_a", "seq_id_b", F.col("compared").cast("long").alias("compared"), F.col("differences").cast("long").alias("differences"))
