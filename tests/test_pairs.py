"""Comparisons of trees, matrix rows and clusters as passes, against sets of tips."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from test_trees import Tree, random_newick

from cladeframe.operators import clusters, splits
from cladeframe.schema import index_forest
from cladeframe.sources import newick


def forest(spark, *texts):
    return index_forest(newick.parse(spark.createDataFrame(list(enumerate(texts, 1)), "tree_id long, newick string")))


@pytest.fixture(scope="module")
def some(spark):
    """Trees of different tips, with supports on the inner nodes."""
    rng = random.Random(12)
    texts = [random_newick(rng, n) for n in (2, 3, 6, 9, 9, 12, 12)] + ["(((((t0,t1)9,t2)9,t3)9,t4)9,t5);", "(t0,(t5,(t2,(t4,(t3,t1)9)9)9)9);", "(x,y);"]
    t = forest(spark, *texts)
    return t.withColumn("label", F.when(F.col("is_tip"), F.col("label")).otherwise((F.pmod(F.xxhash64("tree_id", "node_id"), F.lit(10))).cast("string"))).cache()


def read(t):
    """tree -> (tips, {node: set of tips below}, {node: support})."""
    out = {}
    for r in t.collect():
        out.setdefault(r.tree_id, []).append(r)
    trees = {}
    for k, rows in out.items():
        below = {r.node_id: frozenset(x.label for x in rows if x.is_tip and r.pre <= x.pre <= r.last) for r in rows}
        trees[k] = frozenset(r.label for r in rows if r.is_tip), below, {r.node_id: float(r.label) for r in rows if not r.is_tip and r.parent_id is not None}
    return trees


def test_pairs_are_compared_on_what_they_share(spark, some):
    trees = read(some)
    pairs = [(a, b) for a in trees for b in trees] + [(1, 99), (99, 2)]
    got = splits.robinson_foulds(some, spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len(pairs)
    quick = {(r.a, r.b): r for r in splits.robinson_foulds(some, spark.createDataFrame(pairs, "a long, b long"), same_tips=True).collect()}

    def keys(k, shared):
        tips, below, _ = trees[k]
        return {min(s & shared, shared - s, key=lambda x: (len(x), sorted(x))) for s in below.values() if 2 <= len(s & shared) <= len(shared) - 2}

    for r in got:
        if 99 in (r.a, r.b):
            assert (r.n_shared, r.rf, r.rf_norm, quick[r.a, r.b].n_shared, quick[r.a, r.b].rf) == (0, None, None, None, None)
            continue
        shared = trees[r.a][0] & trees[r.b][0]
        want = len(keys(r.a, shared) ^ keys(r.b, shared)) if len(shared) >= 4 else None
        assert (r.n_shared, r.rf) == (len(shared), want)
        same = trees[r.a][0] == trees[r.b][0]
        assert (quick[r.a, r.b].n_shared, quick[r.a, r.b].rf) == ((len(shared), want) if same else (None, None))
    total = {r.tree_id: r for r in splits.robinson_foulds_total(some).collect()}
    for k in trees:
        others = [r for r in got if r.a == k and r.b not in (k, 99) and trees[r.b][0] == trees[k][0]]
        assert total[k].n_trees == len(others)
        assert total[k].rf_sum == (sum(r.rf for r in others) if len(trees[k][0]) >= 4 else None)


def test_conflicts_of_clades(spark, some):
    trees = read(some)
    pairs = [(a, b) for a in trees for b in trees]
    df = spark.createDataFrame(pairs, "a long, b long")
    clash, tips = set(), set()
    for a, b in pairs:
        shared = trees[a][0] & trees[b][0]
        for x, y in itertools.product(trees[a][2], trees[b][2]):
            p, q = trees[a][1][x] & shared, trees[b][1][y] & shared
            if trees[a][2][x] > 3 and trees[b][2][y] > 3 and p & q and p - q and q - p:
                clash.add((a, b, x, y))
                tips |= {(a, b, x, t) for t in q - p}
    assert len(clash) > 50
    got = [tuple(r) for r in splits.conflicts(some, df, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == clash
    got = [tuple(r) for r in splits.conflict_tips(some, df, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == tips


def test_matrix_rows_and_the_whole_matrix(spark, some):
    for rooted in (False, True):
        codes = {}
        for r in splits.matrix_representation(some, rooted).collect():
            codes.setdefault((r.label, r.tree_id), {})[r.node_id] = r.code
        rows = splits.matrix_rows(some, rooted).cache()
        got = {(r.label, r.tree_id): r.characters for r in rows.collect()}
        assert {k for k, v in got.items() if v} == set(codes)
        assert all("".join(codes[k][n] for n in sorted(codes[k])) == got[k] for k in codes)
        width = {t: len(c) for (_, t), c in got.items()}
        whole = {r.label: r.characters for r in splits.matrix_of(rows).collect()}
        assert whole == {x: "".join(got.get((x, t), "-" * width[t]) for t in sorted(width)) for x in {x for x, _ in got}}
    assert splits.matrix_of(splits.matrix_rows(some.where("false"))).collect() == []


def test_clusters_on_random_trees(spark):
    rng = random.Random(6)
    texts = [random_newick(rng, n) for n in (1, 2, 5, 11, 17)]
    t = forest(spark, *texts).cache()
    kind = {f"t{i}": rng.choice(["p", "q", None]) for i in range(17)}
    values = spark.createDataFrame([*kind.items(), ("t3", "z")], "label string, value string")
    kind["t3"] = None
    got = {(r.tree_id, r.label): r.cluster for r in clusters.cluster_by_value(t, values).collect()}
    near = {(r.tree_id, r.label): r.cluster for r in clusters.cluster_by_branch_length(t, 1.0).collect()}
    dist = {k: {r.node_id: r for r in t.where(F.col("tree_id") == k).collect()} for k in range(1, 6)}
    for k, (tips, below, _) in read(t.withColumn("label", F.when(F.col("is_tip"), F.col("label")).otherwise("0"))).items():
        rows = dist[k]
        closest = {n: min(x.root_dist for x in rows.values() if x.is_tip and r.pre <= x.pre <= r.last) - r.root_dist + (r.branch_length or 0) for n, r in rows.items()}
        kids = {n: [m for m in rows if rows[m].parent_id == n] for n in rows}

        def good(n, rows=rows, kids=kids, closest=closest):
            return rows[n].is_tip or sum(closest[m] for m in kids[n]) < 1.0 and all(good(m) for m in kids[n])

        for tip in tips:
            above = sorted((n for n in below if tip in below[n]), key=lambda n: rows[n].depth)
            same = next(n for n in above if len(below[n]) == 1 or len({kind[x] for x in below[n]}) == 1 and kind[tip] is not None)
            assert got[k, tip] == same
            assert near[k, tip] == next(n for n in above if good(n))
    assert Tree(texts[3]).tips
