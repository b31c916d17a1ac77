"""Trees against brute force on random small inputs, hand-worked values, and round trips."""

import itertools
import math
import random

import numpy as np
import pytest

from cladeframe.operators import build, clusters, forest, generate, search, splits, transform
from cladeframe.plans import sequences as plans
from cladeframe.schema import RAW, index_forest
from cladeframe.sources import newick


def trees(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts, 1)), "tree_id long, newick string")
    return index_forest(newick.parse(df)).cache()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def text(df, **options):
    return [r["newick"] for r in newick.to_newick(df, **options).orderBy("tree_id").collect()]


def random_newick(rng, n):
    names = [f"t{i}" for i in range(n)]
    parts = [f"{x}:{rng.randint(1, 40) / 8}" for x in names]
    while len(parts) > 1:
        a = parts.pop(rng.randrange(len(parts)))
        b = parts.pop(rng.randrange(len(parts)))
        parts.append(f"({a},{b}){rng.randint(0, 100)}:{rng.randint(1, 40) / 8}" if parts else f"({a},{b})")
    return parts[0] + ";"


class Tree:
    """Plain dictionaries of a parsed text: the brute force."""

    def __init__(self, newick_text):
        self.rows = {r[0]: r for r in newick.read_tree(newick_text)}
        self.parent = {k: r[1] for k, r in self.rows.items()}
        inner = set(self.parent.values())
        self.tips = {r[3]: k for k, r in self.rows.items() if k not in inner}

    def path(self, k):
        out = []
        while k is not None:
            out.append(k)
            k = self.parent[k]
        return out

    def length(self, k):
        return self.rows[k][4] or 0.0

    def distance(self, a, b):
        pa, pb = self.path(self.tips[a]), self.path(self.tips[b])
        return sum(self.length(k) for k in set(pa) ^ set(pb))

    def clade(self, k):
        return frozenset(t for t, i in self.tips.items() if k in self.path(i))

    def splits(self):
        every = frozenset(self.tips)
        found = {self.clade(k) for k in self.parent.values() if k is not None and self.parent[k] is not None}
        return {min(c, every - c, key=lambda s: (len(s), sorted(s))) for c in found if 2 <= len(c) <= len(every) - 2}


def distances(df):
    """Tip distances of each tree from its node table."""
    out = {}
    for r in df.collect():
        out.setdefault(r["tree_id"], {})[r["node_id"]] = r
    result = {}
    for t, nodes in out.items():
        path = {}
        for k in nodes:
            p, x = [], k
            while x is not None:
                p.append(x)
                x = nodes[x]["parent_id"]
            path[k] = p
        tips = {r["label"]: k for k, r in nodes.items() if r["is_tip"]}
        result[t] = {frozenset((a, b)): sum(nodes[x]["branch_length"] or 0 for x in set(path[tips[a]]) ^ set(path[tips[b]])) for a, b in itertools.combinations(tips, 2)}
    return result


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k])


def test_parser_and_round_trip(spark):
    t = trees(spark, "((a:1,b:2)90:0.5,(c:1,'d e':4):2)root;", "(a,b,c,d);", "(a,b));", "tip:3(b:1);", "((a[&rate=1.5,ci={1,2}]:1,b:1)[x[y]z]:1,\"q;r\":2);", "lone;", ";")
    assert sorted({r["tree_id"] for r in t.select("tree_id").collect()}) == [1, 2, 4, 5, 6]
    assert text(t)[0] == "((a:1.000000,b:2.000000)90:0.500000,(c:1.000000,'d e':4.000000):2.000000)root;"
    assert text(t, lengths=False, inner_labels=False)[1] == "(a,b,c,d);"
    rng = random.Random(1)
    texts = [random_newick(rng, n) for n in (2, 5, 17, 40)]
    u = trees(spark, *texts)
    again = trees(spark, *text(u))
    assert rows(u, "tree_id", "pre") == rows(again, "tree_id", "pre")


def test_index_columns(spark):
    rng = random.Random(2)
    texts = [random_newick(rng, n) for n in (3, 9, 30)]
    t = trees(spark, *texts).collect()
    for r in t:
        same_tree = [x for x in t if x["tree_id"] == r["tree_id"]]
        below = [x for x in same_tree if r["pre"] <= x["pre"] <= r["last"]]
        b = Tree(texts[r["tree_id"] - 1])
        assert {x["label"] for x in below if x["is_tip"]} == b.clade(r["node_id"])
        assert r["n_tips"] == len(b.clade(r["node_id"]))
        assert r["depth"] == len(b.path(r["node_id"])) - 1
        assert r["root_dist"] == pytest.approx(sum(b.length(k) for k in b.path(r["node_id"])))


def test_measures_by_hand(spark):
    t = trees(spark, "((a:1,b:2)90:1,(c:3,(d:1,e:1)40:2)70:1):0.5;")
    one = lambda df: df.first().asDict()
    assert one(forest.tree_length(t))["tree_length"] == 12.5
    assert one(forest.tree_depth(t))["tree_depth"] == 4.5
    assert one(forest.furthest_tip(t)) == {"tree_id": 1, "label": "e", "distance": 4.5}
    assert one(forest.n_supported(t, 70))["n_supported"] == 1
    assert one(forest.log_clade_credibility(t))["log_credibility"] == pytest.approx(math.log(90) + math.log(70) + math.log(40))
    assert one(forest.tip_names(t))["tip_names"] == "a,b,c,d,e"
    assert one(forest.branch_lengths(t))["branch_lengths"] == [1, 2, 1, 3, 1, 1, 2, 1]
    taxa = spark.createDataFrame([("d",), ("c",), ("zz",)], "label string")
    assert one(forest.is_monophyletic(t, taxa))["monophyletic"] is False
    assert {r["label"] for r in forest.clade_members(t, taxa).collect()} == {"c", "d", "e"}
    assert {r["label"] for r in forest.complement(t, taxa).collect()} == {"a", "b", "e"}
    assert one(splits.splits_present(t, spark.createDataFrame([("a",), ("b",)], "label string")))["present"] is True
    stem = forest.stem_clade_members(t, spark.createDataFrame([("d",)], "label string"), spark.createDataFrame([("a",)], "label string"))
    assert {r["label"] for r in stem.collect()} == {"c", "d", "e"}
    # heights 0, 1, 1, 3 of inner nodes and the tallest tip at 4
    g = forest.gamma_statistic(t).first()["gamma"]
    h = sorted([0, 1, 1, 3]) + [4]
    n = len(h)
    step = [0] + [h[i] - h[i - 1] for i in range(1, n)]
    total = sum((i + 1) * step[i] for i in range(1, n))
    run = sum(sum((k + 1) * step[k] for k in range(1, i + 1)) for i in range(1, n - 1))
    assert g == pytest.approx((run / (n - 2) - total / 2) / (total * math.sqrt(1 / (12 * (n - 2)))))


def test_patristic_and_pairs(spark):
    rng = random.Random(3)
    texts = [random_newick(rng, n) for n in (2, 8, 15)]
    t = trees(spark, *texts)
    for r in forest.patristic_sum(t).collect():
        b = Tree(texts[r["tree_id"] - 1])
        assert r["distance_sum"] == pytest.approx(sum(b.distance(r["label"], x) for x in b.tips if x != r["label"]))
    pairs = spark.createDataFrame([(2, "t0", "t5"), (3, "t1", "t2"), (3, "t9", "t9")], "tree_id long, a string, b string")
    for r in forest.pair_distance(t, pairs).collect():
        assert r["distance"] == pytest.approx(Tree(texts[r["tree_id"] - 1]).distance(r["a"], r["b"]) if r["a"] != r["b"] else 0)


def test_splits_and_robinson_foulds(spark):
    rng = random.Random(4)
    texts = [random_newick(rng, 9) for _ in range(6)] + ["((a,b),(c,d));", "((a,c),(b,d));", "((a,b),c);"]
    t = trees(spark, *texts)
    s = {}
    for r in splits.splits(t).collect():
        s.setdefault(r["tree_id"], 0)
        s[r["tree_id"]] += 1
    assert s == {i: len(Tree(x).splits()) for i, x in enumerate(texts, 1) if Tree(x).splits()}
    pairs = [(a, b) for a in range(1, 10) for b in range(a + 1, 10)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {(r["a"], r["b"]): r for r in splits.robinson_foulds(t, df).collect()}
    for a, b in pairs:
        x, y = Tree(texts[a - 1]), Tree(texts[b - 1])
        shared = set(x.tips) & set(y.tips)
        assert got[a, b]["n_shared"] == len(shared)
        assert got[a, b]["rf"] == (len(x.splits() ^ y.splits()) if len(shared) >= 4 else None)
    assert got[7, 8]["rf"] == 2 and got[7, 8]["rf_norm"] == 1.0
    six = t.where("tree_id <= 6")
    quick = splits.robinson_foulds(six, df.where("b <= 6"), same_tips=True).collect()
    assert {(r["a"], r["b"]): r["rf"] for r in quick} == {k: r["rf"] for k, r in got.items() if k[1] <= 6}
    for r in splits.split_support(six.where("tree_id = 1"), six).collect():
        clade = Tree(texts[0]).clade(r["node_id"])
        every = frozenset(Tree(texts[0]).tips)
        side = min(clade, every - clade, key=lambda z: (len(z), sorted(z)))
        assert r["n"] == sum(side in Tree(x).splits() for x in texts[:6])


def test_rerooting_keeps_distances_and_splits(spark):
    rng = random.Random(5)
    texts = [random_newick(rng, n) for n in (3, 6, 12, 12, 12)] + ["(a:1,b:2,(c:1,d:1)50:3);"]
    t = trees(spark, *texts)
    base = distances(t)
    for pick in range(3):
        target = spark.createDataFrame([(i, rng.choice(list(Tree(x).rows))) for i, x in enumerate(texts, 1)], "tree_id long, node_id int")
        r = index_forest(transform.reroot(t, target))
        after = distances(r)
        for k in base:
            same(base[k], after[k])
        assert splits.splits(r).count() == splits.splits(t).count(), pick
        # a label goes with its split; the two branches below a root of two children are one split
        by_key = {}
        for x in splits.splits(t).collect():
            by_key[x["tree_id"], x["key"]] = x["label"]
        at_root = {(x["tree_id"], x["label"]) for x in t.where("depth = 1 AND NOT is_tip").collect()}
        for x in splits.splits(r).collect():
            assert x["label"] == by_key[x["tree_id"], x["key"]] or (x["tree_id"], x["label"]) in at_root, pick
    mid = index_forest(transform.midpoint_root(t))
    for k, d in distances(mid).items():
        same(base[k], d)
    for k, deep in ((r["tree_id"], r["m"]) for r in forest.tip_root_distance(mid).groupBy("tree_id").agg({"distance": "max"}).toDF("tree_id", "m").collect()):
        assert deep == pytest.approx(max(base[k].values()) / 2)


def test_dropping_and_pruning(spark):
    rng = random.Random(6)
    texts = [random_newick(rng, n) for n in (4, 9, 20)]
    t = trees(spark, *texts)
    gone = spark.createDataFrame([("t1",), ("t3",), ("t7",)], "label string")
    left = index_forest(transform.drop_tips(t, gone))
    base, after = distances(t), distances(left)
    for k in after:
        same({p: d for p, d in base[k].items() if not p & {"t1", "t3", "t7"}}, after[k])
    inner = left.where("NOT is_tip").join(left.groupBy("tree_id", "parent_id").count().withColumnRenamed("parent_id", "node_id"), ["tree_id", "node_id"])
    assert inner.where("count < 2").count() == 0
    short = index_forest(transform.drop_tips_on_short_branches(t, 1.5))
    assert short.where("is_tip AND branch_length < 1.5 AND parent_id IS NOT NULL").count() == 0
    rest, clade = transform.prune_clade(t, forest.extreme_branch(t))
    tips = lambda d: {(r["tree_id"], r["label"]) for r in index_forest(d).where("is_tip").collect()}
    assert tips(rest) | tips(clade) == tips(t) and not tips(rest) & tips(clade)
    parts = transform.split_trees(t, 3)
    assert {(r["source"], r["label"]) for r in parts.where("is_tip").collect()} == tips(t)


def test_small_transforms(spark):
    t = trees(spark, "((a:1,b:2)90:1,(c:3,(d:1,e:1)40:2)70:1);", "(a:1,b:1,c:1,d:1);")
    assert text(index_forest(transform.ladderize(t)), lengths=False)[0] == "(((d,e)40,c)70,(a,b)90);"
    assert text(index_forest(transform.ladderize(t, larger_first=False)), lengths=False)[0] == "((a,b)90,(c,(d,e)40)70);"
    assert text(index_forest(transform.resolve_polytomies(t)))[1] == "(((a:1.000000,b:1.000000):0.000000,c:1.000000):0.000000,d:1.000000);"
    renamed = transform.rename_tips(t, [("a", "x"), ("x", "y"), ("b", "a")])
    assert forest.tip_names(renamed).orderBy("tree_id").first()["tip_names"] == "y,a,c,d,e"
    sky = {r["node_id"]: r["branch_length"] for r in transform.skyline_scale(t, [(1.5, 2.0), (3.0, 0.5)]).where("tree_id = 1").collect()}
    # node 3 is a, from 1 to 2: half at rate 2, half at 0.5
    assert sky[3] == pytest.approx(0.5 * 2 + 0.5 * 0.5)
    sets = spark.createDataFrame([("c", "s", 2.0), ("d", "s", 2.0), ("d", "u", 5.0), ("e", "u", 5.0)], "label string, set_id string, rate double")
    scaled = {r["label"]: r["branch_length"] for r in transform.clade_scale(t, sets).where("tree_id = 1").collect()}
    assert (scaled["a"], scaled["c"], scaled["d"], scaled["40"], scaled["70"]) == (1, 6, 5, 4, 1)
    near = transform.nearest_neighbours(t.where("tree_id = 1"))
    assert near.select("alt").distinct().count() == 4
    for alt in {r["alt"] for r in near.select("alt").collect()}:
        other = index_forest(near.where(f"alt = {alt}").withColumn("tree_id", near["tree_id"] + 100))
        both = other.unionByName(t.where("tree_id = 1"))
        pair = spark.createDataFrame([(1, 101)], "a long, b long")
        assert splits.robinson_foulds(both, pair, same_tips=True).first()["rf"] == 2
    ages = spark.createDataFrame([(1, 1, 10.0)], "tree_id long, node_id int, age double")
    a = {r["node_id"]: r for r in transform.mean_path_ages(t, ages).collect()}
    assert a[1]["age"] == pytest.approx(10.0) and a[3]["age"] == 0


def test_clusters(spark):
    t = trees(spark, "((a_x:1,b_x:2):1,(c_y:3,(d_y:1,e_x:1):2):9);")
    groups = lambda df: sorted("".join(sorted(r["label"][0] for r in g)) for _, g in itertools.groupby(sorted(df.collect(), key=lambda r: r["cluster"]), key=lambda r: r["cluster"]))
    assert groups(clusters.cluster_by_long_branch(t, 5)) == ["ab", "cde"]
    assert groups(clusters.cluster_by_tip_name(t, "_", 2)) == ["ab", "c", "d", "e"]
    assert groups(clusters.cluster_by_branch_length(t, 3.5)) == ["ab", "c", "de"]


def test_neighbour_joining_recovers_additive_trees(spark):
    rng = random.Random(7)
    texts = [random_newick(rng, n) for n in (2, 4, 5, 11)]
    rows_ = []
    for m, x in enumerate(texts, 1):
        b = Tree(x)
        rows_ += [(m, p, q, b.distance(p, q)) for p, q in itertools.combinations(sorted(b.tips), 2)]
    dist = spark.createDataFrame(rows_, "matrix_id long, i string, j string, d double")
    assert build.invalid_matrices(dist).count() == 0
    assert build.invalid_matrices(dist.where("NOT (matrix_id = 3 AND i = 't0' AND j = 't1')")).count() == 1
    got = distances(index_forest(build.neighbour_joining(dist)))
    for m, x in enumerate(texts, 1):
        b = Tree(x)
        same(got[m], {frozenset(p): b.distance(*p) for p in itertools.combinations(b.tips, 2)})


def test_matrices_with_a_pair_twice_are_invalid(spark):
    rows = [(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (2, "a", "b"), (2, "b", "a"), (2, "b", "c"), (3, "a", "b"), (3, "b", "a"), (4, "a", "b"), (None, "a", "b"), (None, "b", "c")]
    got = build.invalid_matrices(spark.createDataFrame(rows, "matrix_id long, i string, j string"))
    assert sorted(map(tuple, got.collect())) == [(2, 3, 3), (3, 2, 2)]


def test_infinite_distances_are_the_shortest_way_or_part_the_tree(spark):
    inf = float("inf")
    near = {("a", "b"): 1.0, ("b", "c"): 2.0, ("a", "c"): inf, ("d", "e"): 4.0}
    rows = [(1, x, y, near.get((x, y), None if y == "f" else inf)) for x, y in itertools.combinations("abcdef", 2)]
    t = index_forest(build.neighbour_joining(spark.createDataFrame(rows, "matrix_id long, i string, j string, d double")))
    top = t.where("depth = 1").orderBy("pre").collect()
    assert [(r.branch_length, r.n_tips) for r in top] == [(None, 3), (None, 2), (None, 1)]
    got = distances(t)[1]
    assert [got[frozenset(p)] for p in ("ab", "bc", "ac", "de")] == [1, 2, 3, 4]


def brute_parsimony(tree, states):
    """Fewest changes by trying every assignment of inner nodes, position by position."""
    inner = [k for k in tree.rows if k not in tree.tips.values()]
    total = 0
    for pos in range(len(next(iter(states.values())))):
        best = 99
        for pick in itertools.product(range(3), repeat=len(inner)):
            at = dict(zip(inner, pick, strict=True))
            cost = 0
            for k, p in tree.parent.items():
                if p is not None:
                    mask = 1 << at[k] if k in at else states[tree.rows[k][3]][pos] or 7
                    cost += not (mask >> at[p] & 1)
            best = min(best, cost)
        total += best
    return total


def test_parsimony_search_ends_by_itself(spark, monkeypatch):
    """Each site parts the first k suppliers from the others; the start has the first one at the far end."""
    n = 8
    rows = [(i, "", "", "N", "".join("A" if i < k else "C" for k in range(1, n))) for i in range(n)]
    start = "1"
    for i in [*range(2, n), 0]:
        start = f"({start},{i})"
    tree = newick.parse(spark.createDataFrame([(1, start + ";")], "tree_id long, newick string"))
    monkeypatch.setattr(plans, "supplier_sequences", lambda spark, sf_dir: spark.createDataFrame(rows, "seq_id long, taxonomy string, region string, nation string, sequence string"))
    monkeypatch.setattr(plans.build, "stepwise_addition", lambda chars: tree.drop("tree_id").join(chars.select(chars["matrix_id"].alias("tree_id")).distinct()).select(tree.columns))
    log = {r["round"]: r["score"] for r in plans.parsimony_search(spark, "").collect()}
    scores = [log[k] for k in range(len(log))]
    assert len(log) > 4 and all(a > b for a, b in itertools.pairwise(scores))
    assert scores[-1] == n - 1


def test_parsimony(spark):
    rng = random.Random(8)
    texts = [random_newick(rng, 6) for _ in range(4)]
    states = {f"t{i}": [rng.choice([0, 1, 2, 4, 3, 6]) for _ in range(5)] for i in range(6)}
    t = trees(spark, *texts)
    chars = spark.createDataFrame(list(states.items()), "label string, states array<int>")
    got = {r["tree_id"]: r["score"] for r in build.fitch_score(t, chars).collect()}
    assert got == {i: brute_parsimony(Tree(x), states) for i, x in enumerate(texts, 1)}
    second = build.fitch_states(t, chars, seed=3)
    assert {r["tree_id"]: r["s"] for r in second.groupBy("tree_id").agg({"changes": "sum"}).toDF("tree_id", "s").collect()} == got
    step = index_forest(build.stepwise_addition(chars.selectExpr("1L AS matrix_id", "label", "states"), replicates=3, seed=1)).cache()
    assert step.where("is_tip").groupBy("tree_id").count().where("count = 6").count() == 3
    start = {r["tree_id"]: r["score"] for r in build.fitch_score(step, chars).collect()}
    climbed = search.hill_climb(step, chars, rounds=3)
    assert climbed.first()["score"] <= min(start.values())
    own = step.select("tree_id").distinct().join(chars).select("tree_id", "label", "states")
    log = search.improve(step, own, rounds=3).collect()
    best = {t: min(r["score"] for r in log if r["tree_id"] == t) for t in start}
    assert {r["tree_id"]: r["score"] for r in log if r["round"] == 0} == start
    # an exhaustive look at the neighbours of the first tree agrees
    one = step.where(f"tree_id = {min(start)}")
    near = transform.nearest_neighbours(one)
    near = index_forest(near.withColumn("tree_id", near["alt"].cast("long")))
    least = min(r["score"] for r in build.fitch_score(near, chars).collect())
    first = [r["score"] for r in log if r["tree_id"] == min(start) and r["round"] == 1]
    assert first == ([least] if least < start[min(start)] else [])
    assert all(best[t] <= start[t] for t in start)


def test_likelihood(spark):
    t = trees(spark, "((a:0.3,b:0.2):0.1,c:0.5);")
    chars = spark.createDataFrame([("a", [1, 2]), ("b", [1, 1]), ("c", [2, 0])], "label string, states array<int>")
    m = build.Model(2, rates=[1.0], frequencies=[0.5, 0.5])
    p = lambda d: np.array([[0.5 + 0.5 * math.exp(-d), 0.5 - 0.5 * math.exp(-d)], [0.5 - 0.5 * math.exp(-d), 0.5 + 0.5 * math.exp(-d)]])
    assert np.allclose(m.transition(np.array([0.0, 0.7, 3.0])), [p(0), p(0.7), p(3.0)], atol=1e-6)

    def like(a, b, c):
        inner = (p(0.3) @ a) * (p(0.2) @ b)
        return float(np.log(0.5 * ((p(0.1) @ inner) * (p(0.5) @ c)).sum()))

    x, y, any_ = np.array([1.0, 0]), np.array([0, 1.0]), np.ones(2)
    assert build.log_likelihood(t, chars, m).first()["log_likelihood"] == pytest.approx(like(x, x, y), abs=1e-6)
    assert build.log_likelihood(t, chars, m, positions=None).first()["log_likelihood"] == pytest.approx(like(x, x, y) + like(y, x, any_), abs=1e-6)
    moved = index_forest(transform.reroot(t, spark.createDataFrame([(1, 3)], "tree_id long, node_id int")))
    assert build.log_likelihood(moved, chars, m).first()["log_likelihood"] == pytest.approx(like(x, x, y), abs=1e-6)
    up = build.ancestral_states(t, chars, m).where("node_id = 2").first()["likelihoods"]
    want = (p(0.3) @ x) * (p(0.2) @ x)
    assert up == pytest.approx((want / want.sum()).tolist(), abs=1e-6)
    best = build.optimise(t, chars, 2, frequencies=[0.5, 0.5]).first()
    assert best["log_likelihood"] >= like(x, x, y) - 1e-9
    with pytest.raises(ValueError):
        build.Model(2, classes=[[None, 0], [2, None]])
    sim = build.simulate_characters(t, build.Model(2, rates=[5.0], frequencies=[0.2, 0.8]), 4000, seed=2).collect()
    assert len(sim) == 3
    for r in sim:
        assert abs(np.mean(np.array(r["states"]) == 2) - 0.8) < 0.04


def test_generators(spark):
    sizes = spark.createDataFrame([(i, 8) for i in range(300)], "tree_id long, n int")
    for depths in (None, "yule", "coalescent"):
        t = index_forest(generate.random_trees(sizes, depths, seed=4)).cache()
        assert t.where("is_tip").groupBy("tree_id").count().where("count = 8").count() == 300
        if depths:
            spread = forest.tip_root_distance(t).groupBy("tree_id").agg({"distance": "stddev"}).toDF("tree_id", "s")
            assert spread.agg({"s": "max"}).first()[0] < 1e-9
    mean = forest.tree_depth(t).agg({"tree_depth": "avg"}).first()[0]
    assert abs(mean - sum(2 / (k * (k - 1)) for k in range(2, 9))) < 0.25
    same_again = index_forest(generate.random_trees(sizes, "coalescent", seed=4))
    assert same_again.exceptAll(t).count() == 0
    b = index_forest(generate.birth_death_trees(sizes, 1.0, 0.0, 2.0, seed=5)).cache()
    assert abs(b.where("is_tip").count() / 300 - math.exp(2)) < 1.2
    assert b.where("is_tip AND abs(root_dist - 2) > 1e-9").count() == 0
    more = index_forest(generate.add_branches(b, 0.5, seed=1))
    assert more.where("is_tip").count() > b.where("is_tip").count()


def test_decisiveness(spark):
    t = trees(spark, "((a,b),(c,d));", "(((a,b),c),(d,e));")
    genes = spark.createDataFrame([(x, "g1") for x in "abcd"] + [("e", "g2"), ("a", "g2")], "taxon string, gene string")
    got = {r["tree_id"]: (r["branches"], r["distinguished"]) for r in generate.decisiveness(t, generate.gene_masks(genes)).collect()}
    # tree 2: ab|c|de|... : a, b, c and (d, e) share g1; the branch above (ab)c has d and e, of which e lacks g1
    assert got == {1: (1, 1), 2: (2, 1)}
    share = generate.decisive_share(generate.decisiveness(t, generate.gene_masks(genes))).first()
    assert share["decisive_trees"] == 0.5 and share["distinguished_branches"] == pytest.approx(2 / 3)


def test_empty_forest(spark):
    t = index_forest(spark.createDataFrame([], RAW))
    assert forest.tree_length(t).collect() == [] and splits.splits(t).collect() == []
    assert newick.to_newick(t).collect() == []
