"""Searches by interchanges against making every neighbour, and against all trees there are."""

import random

import pytest
from pyspark.sql import functions as F
from test_trees import random_newick

from cladeframe.operators import build, generate, search, splits, transform
from cladeframe.schema import index_forest
from cladeframe.sources import newick


def characters(spark, rng, taxa, sites, states=(1, 2, 4, 8, 3, 0)):
    return spark.createDataFrame([(t, [rng.choice(states) for _ in range(sites)]) for t in taxa], "label string, states array<int>")


def shapes(nodes):
    """tree_id -> its splits."""
    out = {}
    for r in splits.splits(nodes).collect():
        out.setdefault(r.tree_id, set()).add((r.key.k1, r.key.k2))
    return {k: frozenset(v) for k, v in out.items()}


def test_scores_and_shapes_of_neighbours_without_making_them(spark):
    rng = random.Random(5)
    texts = [random_newick(rng, n) for n in (2, 3, 4, 5, 6, 9, 12)] + ["(((((t0,t1),t2),t3),t4),t5);", "(t0,(t1,(t2,(t3,t4))));"]
    t = index_forest(newick.parse(spark.createDataFrame(list(enumerate(texts, 1)), "tree_id long, newick string"))).cache()
    chars = characters(spark, rng, [f"t{i}" for i in range(12)], 7)
    got = search.interchange_scores(t.withColumn("search", F.lit(9).cast("long")), chars, every=True).collect()
    near = transform.nearest_neighbours(t).withColumn("tree_id", F.col("tree_id") * 1000 + F.col("alt"))
    near = index_forest(near.unionByName(t.withColumn("tree_id", F.col("tree_id") * 1000), allowMissingColumns=True).drop("alt")).cache()
    score = {r.tree_id: r.score for r in build.fitch_score(near, chars).collect()}
    assert {r.tree_id * 1000 + r.alt: r.score for r in got} == score
    assert {r.search for r in got} == {9}
    form = shapes(near)
    for tree in range(1, len(texts) + 1):
        mine = [(r.shape, form.get(r.tree_id * 1000 + r.alt, frozenset())) for r in got if r.tree_id == tree]
        assert len({a for a, _ in mine}) == len({b for _, b in mine}) == len(set(mine))
    some = search.interchange_scores(t.withColumn("search", F.lit(1).cast("long")), chars).collect()
    own = {r.tree_id: r.score for r in some if r.alt == 0}
    assert {(r.tree_id, r.alt) for r in some} == {(r.tree_id, r.alt) for r in got if r.alt == 0 or r.score <= own[r.tree_id]}
    with pytest.raises(Exception, match="binary"):
        search.interchange_scores(index_forest(newick.parse(spark.createDataFrame([(1, "(a,b,c);")], "tree_id long, newick string"))).withColumn("search", F.lit(1)), chars).collect()


def every_tree(taxa):
    """All unrooted binary trees, as texts with three branches at the root's side."""
    def with_tip(tree, tip):
        yield (tree, tip)
        if isinstance(tree, tuple):
            for left in with_tip(tree[0], tip):
                yield (left, tree[1])
            for right in with_tip(tree[1], tip):
                yield (tree[0], right)

    grown = [(taxa[1], taxa[2])]
    for tip in taxa[3:]:
        grown = [t for tree in grown for t in with_tip(tree, tip)]
    text = lambda t: f"({text(t[0])},{text(t[1])})" if isinstance(t, tuple) else t
    return [f"({taxa[0]},{text(t)});" for t in grown]


def test_the_equally_best_set_is_that_of_all_trees(spark):
    rng = random.Random(2)
    taxa = [f"t{i}" for i in range(6)]
    texts = every_tree(taxa)
    assert len(texts) == 105
    t = index_forest(newick.parse(spark.createDataFrame(list(enumerate(texts, 1)), "tree_id long, newick string"))).cache()
    form = shapes(t)
    assert len(set(form.values())) == 105
    chars = characters(spark, rng, taxa, 3, (1, 2)).select(F.lit(1).cast("long").alias("search"), "label", "states")
    flat = characters(spark, rng, taxa, 2, (1,)).select(F.lit(2).cast("long").alias("search"), "label", "states")
    score = {r.tree_id: r.score for r in build.fitch_score(t, chars.select("label", "states")).collect()}
    least = min(score.values())
    worst = max(score, key=lambda k: (score[k], k))
    start = t.where(F.col("tree_id") == worst)
    start = start.withColumn("search", F.lit(1).cast("long")).unionByName(start.withColumn("tree_id", F.lit(1000).cast("long")).withColumn("search", F.lit(2).cast("long")))
    found = search.best_sets(start, chars.unionByName(flat), plateau=None).cache()
    got = shapes(found)
    of = {r.tree_id: (r.search, r.score) for r in found.where("parent_id IS NULL").collect()}
    one = [k for k in of if of[k][0] == 1]
    assert {of[k][1] for k in one} == {least}
    assert {got[k] for k in one} == {form[k] for k in form if score[k] == least} and len(one) == len({got[k] for k in one})
    # a plateau of all trees there are, over a hundred: none is left out
    two = [k for k in of if of[k][0] == 2]
    assert len(two) == 105 and {of[k][1] for k in two} == {0}
    assert {got[k] for k in two} == set(form.values())
    step = search.best_sets(start, chars.unionByName(flat)).where("parent_id IS NULL").groupBy("search").count().collect()
    assert {r["search"]: r["count"] for r in step}[2] == 7
    assert search.hill_climb(t, chars.select("label", "states")).where("parent_id IS NULL").count() == len(one)


def test_stepwise_addition_takes_the_cheapest_branch(spark):
    rng = random.Random(3)
    chars = characters(spark, rng, [f"t{i}" for i in range(7)], 6)
    made = index_forest(build.stepwise_addition(chars.select(F.lit(4).cast("long").alias("matrix_id"), "label", "states")))
    got = build.fitch_score(made, chars).first().score
    # the same by scoring every place of every taxon in full
    rows = {r.label: r.states for r in chars.collect()}
    taxa = sorted(rows)
    trees, best = [(taxa[-2], taxa[-1])], None
    text = lambda t: f"({text(t[0])},{text(t[1])})" if isinstance(t, tuple) else t

    def places(tree, tip):
        yield (tree, tip)
        if isinstance(tree, tuple):
            yield from ((x, tree[1]) for x in places(tree[0], tip))
            yield from ((tree[0], x) for x in places(tree[1], tip))

    tree = trees[0]
    for tip in reversed(taxa[:-2]):
        options = list(places(tree, tip))
        forest = index_forest(newick.parse(spark.createDataFrame([(k, text(o) + ";") for k, o in enumerate(options)], "tree_id long, newick string")))
        scores = {r.tree_id: r.score for r in build.fitch_score(forest, chars).collect()}
        best = min(scores.values())
        tree = options[min(k for k in scores if scores[k] == best)]
    assert got == best


def test_signed_ids_draw_apart(spark):
    sizes = spark.createDataFrame([(5, 9), (-5, 9)], "tree_id long, n int")
    for t in (generate.random_trees(sizes, "yule", seed=1), generate.birth_death_trees(sizes, 1.0, 0.1, 2.0, seed=1)):
        rows = {k: [tuple(r)[1:] for r in t.where(F.col("tree_id") == k).orderBy("node_id").collect()] for k in (5, -5)}
        assert rows[5] != rows[-5]
    trees = index_forest(generate.random_trees(spark.createDataFrame([(5, 9)], "tree_id long, n int"), "yule"))
    both = trees.unionByName(trees.withColumn("tree_id", -F.col("tree_id")))
    model = build.Model(4, rates=[0.5] * 6, frequencies=[0.25] * 4)
    drawn = build.simulate_characters(both, model, 30, seed=1)
    assert drawn.drop("tree_id").distinct().count() > 9
