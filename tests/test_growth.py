"""Queries on tables that are larger than Spark takes them for, and values at the edge of what their SQL says."""

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["clade_members", "likelihood_clades", "nni", "random_nni"])
def test_no_forest_goes_through_the_driver(spark, name):
    plan = __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_random_neighbour_makes_one_of_all_neighbours(spark):
    from pyspark.sql import functions as F

    from cladeframe.operators import transform as t
    from cladeframe.operators.components import _held
    from cladeframe.plans.derived import order_forest
    from cladeframe.schema import RAW_COLUMNS

    nodes = _held(order_forest(spark, SMALL).where("tree_id < 60"))
    one = t.random_neighbour(nodes, seed=7)
    assert "Broadcast" not in one._jdf.queryExecution().executedPlan().toString()
    every = t.nearest_neighbours(nodes)
    pick = every.select("tree_id", "alt").distinct().groupBy("tree_id").agg(F.min_by("alt", F.xxhash64(F.lit(7), "tree_id", "alt")).alias("alt"))
    want = every.join(pick, ["tree_id", "alt"]).select(RAW_COLUMNS)
    assert one.count() == want.count() > 0 and one.exceptAll(want).isEmpty()


def test_drawn_topologies_are_counted_as_trees(spark):
    """Sets of one to nine taxa, some without genes, of 70 genes: as by node tables of the same topologies."""
    from pyspark.sql import functions as F

    from cladeframe.operators import generate
    from cladeframe.schema import index_forest

    taxa = spark.range(45).select(F.expr("cast((sqrt(8 * id + 1) - 1) / 2 as int)").cast("long").alias("set_id"), F.col("id").cast("string").alias("label"))
    genes = taxa.select(F.col("label").alias("taxon"), F.explode(F.sequence(F.lit(0), F.lit(69))).alias("gene")).where("xxhash64(taxon, gene) % 5 = 0 AND taxon % 11 <> 5")
    masks = taxa.join(generate.gene_masks(genes), "label", "left")
    got = generate.random_decisiveness(masks, topologies=30, seed=2)
    assert "BuildLeft" not in got._jdf.queryExecution().executedPlan().toString()  # of genes only the names are broadcast
    number = F.expr("row_number() OVER (PARTITION BY set_id ORDER BY label)").cast("string")
    own = masks.select("set_id", number.alias("label"), "mask")
    draws = own.groupBy("set_id").agg(F.count("*").cast("int").alias("n")).select("set_id", "n", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("topology")).withColumn("tree_id", F.xxhash64("set_id", "topology"))
    of = draws.select("tree_id", "set_id", "topology")
    want = generate.decisiveness(index_forest(generate.random_trees(draws, seed=2)), of.join(own, "set_id").select("tree_id", "label", "mask"))
    want = want.join(of, "tree_id").select("set_id", "topology", "branches", "distinguished")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert 0 < got.where("distinguished > 0").count() and 0 < got.where("distinguished < branches").count()


def test_replicates_grow_in_batches(spark):
    """Stepwise trees of many matrices in one task, as bytes and as integers, each as if it were alone."""
    from pyspark.sql import functions as F

    from cladeframe.operators import build

    states = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.call_function("shiftleft", F.lit(1), F.pmod(F.xxhash64("id", i), F.lit(5)).cast("int")) % 16)
    rows = spark.range(120).select((F.col("id") % 17).alias("matrix_id"), F.col("id").cast("string").alias("label"), states.alias("states")).coalesce(1)
    got = build.stepwise_addition(rows.withColumn("states", F.col("states").cast("array<tinyint>")), replicates=3)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    alone = None
    for m in (0, 16):
        one = build.stepwise_addition(rows.where(F.col("matrix_id") == m), replicates=3)
        alone = one if alone is None else alone.unionByName(one)
    ids = alone.select("tree_id").distinct()
    assert got.join(ids, "tree_id", "left_semi").exceptAll(alone).isEmpty() and got.select("tree_id").distinct().count() == 51
    assert alone.exceptAll(got).isEmpty()


def test_matrices_of_a_batch_join_as_alone(spark):
    """Full matrices of equal size join side by side, ties and all; those with gaps go one by one."""
    import numpy as np
    import pandas as pd

    from cladeframe.operators import build

    rng, rows = np.random.default_rng(1), []
    for m in range(60):
        n = 2 + m % 7
        d = rng.integers(1, 4 if m % 2 else 100, (n, n)) / 4
        rows += [(m, f"t{i}", f"t{j}", np.inf if m % 10 == 9 and rng.random() < 0.4 else float(d[i, j])) for i in range(n) for j in range(i)]
    frame = pd.DataFrame(rows, columns=["matrix_id", "i", "j", "d"])
    key = lambda t: (t[0], t[1])
    got = sorted(map(tuple, build.neighbour_joining(spark.createDataFrame(frame).coalesce(1)).collect()), key=key)
    want = pd.concat([build._join_neighbours(g.reset_index(drop=True)) for _, g in frame.groupby("matrix_id")])
    want = sorted((tuple(None if v is pd.NA or v != v else v for v in r) for r in want.itertuples(index=False)), key=key)
    assert [tuple(None if v != v else v for v in r) for r in got] == want


def test_full_matrices_need_no_call_each(spark, monkeypatch):
    import pandas as pd

    from cladeframe.operators import build

    monkeypatch.setattr(build, "_join_neighbours", None)
    frame = pd.DataFrame([(m, a, b, d) for m in (1, 2) for a, b, d in (("x", "y", 3.0), ("x", "z", 4.0), ("y", "z", 5.0))], columns=["matrix_id", "i", "j", "d"])
    assert build._join_matrices(frame, [0, 3, 6])["branch_length"].sum() == 12.0


@pytest.mark.parametrize("column", ["jc", "jc_minus_p"])
def test_equal_sequences_have_the_zero_of_the_sql(spark, column):
    """Bit for bit: DuckDB's round keeps the sign of -3/4 ln(1), Spark's loses it."""
    import struct

    import duckdb
    from pyspark.sql import functions as F

    from cladeframe.operators import sequences as q
    from cladeframe.plans import sequences as plans

    pairs = spark.sql("SELECT * FROM VALUES (array(1, 2, 4, 8), array(1, 2, 4, 8)), (array(0, 1), array(1, 0)), (array(1, 2, 4, 8), array(1, 2, 4, 1)) AS t(states_a, states_b)")
    made = [r[0] for r in q.distances(pairs).orderBy(F.desc("compared"), "differences").select(plans.rounded(column)).collect()]
    less = "" if column == "jc" else " - (1 - s)"
    want = [r[0] for r in duckdb.sql(f"SELECT round(-0.75 * ln(1 - (1 - s) * 4 / 3){less}, 6) FROM (VALUES (0, CAST(1 AS DOUBLE)), (1, 0.75::DOUBLE), (2, 1::DOUBLE)) v(k, s) ORDER BY k").fetchall()]
    assert [struct.pack("d", x) for x in made] == [struct.pack("d", x) for x in want]
