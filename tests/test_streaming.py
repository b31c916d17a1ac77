"""Running support of target trees against the same counts over all trees at once."""

import random

import pytest
from pyspark.sql import functions as F
from test_trees import random_newick

from cladeframe.operators import splits
from cladeframe.schema import index_forest
from cladeframe.sources import newick
from cladeframe.streaming import trees as streams


def forest(spark, texts):
    return index_forest(newick.parse(spark.createDataFrame(list(enumerate(texts, 1)), "tree_id long, newick string")))


def test_split_keys_are_those_of_the_node_table(spark):
    rng = random.Random(1)
    texts = [random_newick(rng, n) for n in (2, 4, 9, 17)] + ["((ñ,'b c'),(日本,d),e);", "broken((", None, "(a,(b,(c,(d,e))));"]
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "tree_id long, newick string")
    for rooted in (False, True):
        got = {(r.tree_id, r.k1, r.k2) for r in streams.stream_splits(rows, rooted).where("k1 IS NOT NULL").collect()}
        assert got == {(r.tree_id, r.key.k1, r.key.k2) for r in splits.splits(forest(spark, [t for t in texts]), rooted).collect()}
    keys = {(r.tree_id, r.k1, r.k2, r.n, r.x1, r.x2) for r in splits.tree_keys(forest(spark, texts)).collect()}
    assert {tuple(r) for r in streams.stream_splits(rows).collect()} == keys


@pytest.mark.parametrize("rooted", [False, True])
def test_running_support_of_targets_and_a_restart(spark, tmp_path, rooted):
    rng = random.Random(4)
    target = forest(spark, [random_newick(rng, 6), random_newick(rng, 6)]).cache()
    (tmp_path / "in").mkdir()
    name, came = f"target_{rooted}".lower(), []

    def arrive(k):
        texts = [random_newick(rng, 6) for _ in range(25)]
        came.extend(texts)
        (tmp_path / "new").write_text("\n".join(texts) + "\n")
        (tmp_path / "new").rename(tmp_path / "in" / f"{k}.txt")

    def run():
        query = streams.target_support(target, streams.stream_trees(spark, f"{tmp_path}/in", 1), rooted).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").start()
        query.processAllAvailable()
        return query

    def agrees():
        want = {(r.tree_id, r.node_id): r.n for r in splits.split_support(target, forest(spark, came), rooted).collect() if r.n}
        got = {(r.tree_id, r.node_id): r.n for r in spark.table(name).collect()}
        assert got == want | {(1, None): len(came), (2, None): len(came)}

    arrive(0)
    query = run()
    agrees()
    arrive(1)
    query.processAllAvailable()
    agrees()
    query.stop()
    arrive(2)
    query = run()
    agrees()
    query.stop()
    assert any(k for k in spark.table(name).where(F.col("node_id").isNotNull()).collect())
