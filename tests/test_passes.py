"""Passes over whole trees, and what is built on them, against per-tree recursion."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.operators import build, generate, transform
from cladeframe.schema import fold_clades, index_forest
from cladeframe.sources import matrices, newick


def trees(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "tree_id long, newick string")
    return index_forest(newick.parse(rows))


def random_newick(rng, n, start=0):
    parts = [f"t{start + i}:{rng.randint(0, 24) / 8}" for i in range(n)]
    while len(parts) > 1:
        k = min(len(parts), 3 if rng.random() < 0.2 else 2)
        chosen = [parts.pop(rng.randrange(len(parts))) for _ in range(k)]
        parts.append(f"({','.join(chosen)}):{rng.randint(0, 24) / 8}")
    return parts[0] + ";"


def by_tree(nodes):
    out = {}
    for r in nodes.collect():
        out.setdefault(r["tree_id"], {})[r["node_id"]] = r
    return out


def below(tree, node):
    return [x for x in tree.values() if tree[node]["pre"] <= x["pre"] <= tree[node]["last"]]


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(3)
    nodes = trees(spark, *[random_newick(rng, n) for n in (1, 2, 3, 5, 8, 13, 40)], "(" * 60 + "a" + "".join(f",b{i}:1)" for i in range(60)) + ";").cache()
    return nodes


def test_folds(forest):
    value = F.when(F.col("is_tip"), F.col("root_dist"))
    got = fold_clades(forest, ["tree_id", "node_id"], s=(value, "sum"), lo=(value, "min"), hi=(value, "max"), x=(F.xxhash64("label"), "xor"), n=(F.lit(1), "sum")).collect()
    all_trees = by_tree(forest)
    hashes = {r["label"]: r["h"] for r in forest.select("label", F.xxhash64("label").alias("h")).distinct().collect()}
    assert len(got) == sum(map(len, all_trees.values()))
    for r in got:
        rows = below(all_trees[r["tree_id"]], r["node_id"])
        d = [x["root_dist"] for x in rows if x["is_tip"]]
        assert (r["s"], r["lo"], r["hi"], r["n"]) == (pytest.approx(sum(d)), min(d), max(d), len(rows))
        want = 0
        for x in rows:
            want ^= hashes[x["label"]]
        assert r["x"] == want


def test_fitch_both_passes(spark):
    rng = random.Random(4)
    texts = ["((a,b),(c,(d,e)));", "(((a,b),c),((d,e),(f,g)));"]
    nodes = trees(spark, *texts).cache()
    chars = [(x, [rng.choice([0, 1, 2, 4, 3, 6]) for _ in range(4)]) for x in "abcdefg" if x != "c"]
    frame = spark.createDataFrame(chars, "label string, states array<int>")
    score = {r["tree_id"]: r["score"] for r in build.fitch_score(nodes, frame).collect()}
    all_trees, have = by_tree(nodes), dict(chars)
    for t, tree in all_trees.items():
        inner = [k for k, r in tree.items() if not r["is_tip"]]
        want = 0
        for i in range(4):
            best = 99
            for states in itertools.product((1, 2, 4), repeat=len(inner)):
                of = dict(zip(inner, states, strict=True))
                cost = 0
                for k, r in tree.items():
                    if r["parent_id"] is not None:
                        own = of.get(k) or (have.get(r["label"], [0] * 4)[i] or 7)
                        cost += not (own & of[r["parent_id"]])
                best = min(best, cost)
            want += best
        assert score[t] == want
    states = {(r["tree_id"], r["node_id"]): r for r in build.fitch_states(nodes, frame, seed=9).collect()}
    for t, tree in all_trees.items():
        assert sum(states[t, k]["changes"] for k in tree) == score[t]
        for k, r in tree.items():
            assert all(bin(m).count("1") == 1 for m in states[t, k]["states"])
            known = have.get(r["label"]) if r["is_tip"] else None
            assert known is None or all(m == 0 or s & m for s, m in zip(states[t, k]["states"], known, strict=True))
    made = build.fitch_trees(nodes, frame, {"x": 1, "y": 2, "z": 4}, seed=9).collect()
    assert all(set(r["ann"]) == {"trait_0", "trait_1", "trait_2", "trait_3"} and set(r["ann"].values()) <= {"x", "y", "z"} | ({"!"} if r["label"] == "c" else set()) for r in made)
    assert sum(r["branch_length"] for r in made) == sum(score.values())


def likelihood_of(tree, states, q, n, length=lambda r: r["branch_length"] or 0.0):
    def p(t):
        m = np.eye(n) + q * t / 2**20
        for _ in range(20):
            m = m @ m
        return m

    def partial(k):
        kids = [r for r in tree.values() if r["parent_id"] == k]
        if not kids:
            mask = states.get(tree[k]["label"], 0) or 2**n - 1
            return np.array([(mask >> s) & 1 for s in range(n)], float)
        out = np.ones(n)
        for r in kids:
            out *= p(length(r)) @ partial(r["node_id"])
        return out

    (root,) = [k for k, r in tree.items() if r["parent_id"] is None]
    return math.log(partial(root).sum() / n) if partial(root).sum() > 0 else -math.inf


def test_likelihood_and_its_rates(spark):
    rng = random.Random(5)
    nodes = trees(spark, random_newick(rng, 6), random_newick(rng, 9), "(x:0,y:0);").cache()
    states = {f"t{i}": 1 << rng.randrange(3) for i in range(9)} | {"x": 1, "y": 2}
    frame = spark.createDataFrame([(k, [v]) for k, v in states.items()], "label string, states array<int>")
    model = build.Model(3, frequencies=[1 / 3] * 3)
    q, all_trees = model.rate_matrix(), by_tree(nodes)
    plain = {r["tree_id"]: r["log_likelihood"] for r in build.log_likelihood(nodes, frame, model).collect()}
    for t, tree in all_trees.items():
        assert plain[t] == pytest.approx(likelihood_of(tree, states, q, 3), abs=1e-7)
    assert plain[2] == -math.inf
    clades = spark.createDataFrame([("t0", "s", 2.5), ("t3", "s", 2.5)], "label string, set_id string, rate double")
    both = {r["tree_id"]: r["log_likelihood"] for r in build.log_likelihood(nodes, frame, model, cuts=[(1.0, 0.5), (2.5, 3.0)], clades=clades).collect()}
    for t in (0, 1):
        tree = all_trees[t]
        (root,) = [r for r in tree.values() if r["parent_id"] is None]
        spans = [r for r in tree.values() if {"t0", "t3"} <= {x["label"] for x in below(tree, r["node_id"])}]
        top = max(spans, key=lambda r: r["depth"])

        def length(r):
            hi = r["root_dist"] - (root["branch_length"] or 0)  # noqa: B023
            lo = hi - r["branch_length"]
            part = lambda a, b: max(0, min(hi, b) - max(lo, a))  # noqa: B023, E731
            rate = 2.5 if top["pre"] < r["pre"] <= top["last"] else 1.0  # noqa: B023
            return rate * (0.5 * part(0, 1) + 3 * part(1, 2.5) + part(2.5, 1e9))

        assert both[t] == pytest.approx(likelihood_of(tree, states, q, 3, length), abs=1e-7)
    best = build.optimise(nodes.where("tree_id < 2"), frame, 3, cuts=[(1.0, 1.0)], clades=clades, free_frequencies=True, free_cuts=True, frequencies=[1 / 3] * 3, rates=[1.0], classes=[[None, 0, 0], [0, None, 0], [0, 0, None]]).collect()
    for r in best:
        assert r["log_likelihood"] >= plain[r["tree_id"]] - 1e-6
        assert sum(r["frequencies"]) == pytest.approx(1) and set(r["clade_rates"]) == {"s"}
    held = build.optimise(nodes.where("tree_id = 0"), frame, 3, fixed=[0], cuts=[(1.0, 0.5), (2.5, 3.0)], fixed_cut_rates=[0, 1], clades=clades, fixed_clades=["s"], frequencies=[1 / 3] * 3, rates=[1.0], classes=[[None, 0, 0], [0, None, 0], [0, 0, None]]).first()
    assert held["log_likelihood"] == pytest.approx(both[0], abs=1e-7) and held["rates"] == [1.0]


def test_decisiveness_with_many_genes(spark):
    rng = random.Random(6)
    genes = [f"g{i:03d}" for i in range(150)]
    taxa = {f"t{i}": rng.sample(genes, rng.randint(20, 60)) for i in range(13)}
    masks = generate.gene_masks(spark.createDataFrame([(t, g) for t, gs in taxa.items() for g in gs], "taxon string, gene string"))
    assert len(masks.first()["mask"]) == 3
    nodes = trees(spark, *["".join(random_newick(rng, n).split("\n")) for n in (4, 6, 9, 13)], "((t0,t1),(t2,t3));", "((t0,t1,t2),t3,(t4,t5));").cache()
    got = {r["tree_id"]: (r["branches"], r["distinguished"]) for r in generate.decisiveness(nodes, masks).collect()}
    for t, tree in by_tree(nodes).items():
        kids = lambda k: sorted((r for r in tree.values() if r["parent_id"] == k), key=lambda r: r["pre"])  # noqa: B023, E731
        of = lambda rows: set().union(*[taxa[x["label"]] for r in rows for x in below(tree, r["node_id"]) if x["is_tip"]])  # noqa: B023, E731
        (root,) = [r for r in tree.values() if r["parent_id"] is None]
        n = hit = 0
        for r in tree.values():
            if r["parent_id"] is None or r["is_tip"]:
                continue
            own, beside = kids(r["node_id"]), [x for x in kids(r["parent_id"]) if x["node_id"] != r["node_id"]]
            outside = [x for x in tree.values() if x["is_tip"] and not tree[r["parent_id"]]["pre"] <= x["pre"] <= tree[r["parent_id"]]["last"]]
            if r["parent_id"] == root["node_id"] and len(kids(root["node_id"])) == 2:
                if kids(root["node_id"])[1]["node_id"] == r["node_id"]:
                    continue
                sides = [[x] for x in kids(beside[0]["node_id"])][:: max(1, len(kids(beside[0]["node_id"])) - 1)]
            else:
                sides = [[beside[0]], beside[1:] + outside]
            if len(sides) == 2 and all(sides):
                n += 1
                hit += bool(of([own[0]]) & of([own[-1]]) & of(sides[0]) & of(sides[1]))
        assert got.get(t, (0, 0)) == (n, hit), t
    sets = masks.withColumn("set_id", F.lit(7).cast("long"))
    drawn = generate.random_decisiveness(sets, topologies=12, seed=1).collect()
    assert len(drawn) == 12 and all(r["branches"] == 10 >= r["distinguished"] for r in drawn)


def test_calibrated_ages(spark):
    rng = random.Random(7)
    nodes = trees(spark, *[random_newick(rng, n) for n in (6, 12, 20)]).cache()
    all_trees, ages = by_tree(nodes), []
    for t, tree in all_trees.items():
        inner = [r for r in tree.values() if not r["is_tip"]]
        for r in inner:
            if (r["parent_id"] is None and t != 1) or (r["parent_id"] is not None and rng.random() < 0.35):
                ages.append((t, r["node_id"], float(60 - 4 * r["depth"] + rng.randint(0, 6))))
    frame = spark.createDataFrame(ages, "tree_id long, node_id int, age double")
    got = {(r["tree_id"], r["node_id"]): r for r in transform.mean_path_ages(nodes, frame, n_char=2.0).collect()}
    for t, tree in all_trees.items():
        given = {k: a for s, k, a in ages if s == t}
        kept, kids = {}, {}
        for k, r in sorted(tree.items(), key=lambda x: x[1]["pre"]):
            kids.setdefault(r["parent_id"], []).append(k)
            up = r["parent_id"]
            while up is not None and up not in kept:
                up = tree[up]["parent_id"]
            if k in given and (up is None or given[k] < kept[up]):
                kept[k] = given[k]

        def ends(k, far=0.0):
            for c in kids.get(k, []):  # noqa: B023
                d = far + tree[c]["branch_length"]  # noqa: B023
                if c in kept or c not in kids:  # noqa: B023
                    yield d, kept.get(c, 0.0), tree[c]["n_tips"]  # noqa: B023
                else:
                    yield from ends(c, d)

        rate = {k: sum(d * n * a / (a - e) for d, e, n in ends(k)) / tree[k]["n_tips"] / a for k, a in kept.items()}
        rate = {k: r for k, r in rate.items() if r > 0}
        middle = np.median(list(rate.values()))
        for k, r in tree.items():
            up = k
            while up is not None and up not in kept:
                up = tree[up]["parent_id"]
            own = rate.get(up, middle)
            want = kept.get(k, 0.0 if r["is_tip"] else sum(n * (d + own * e) for d, e, n in ends(k)) / r["n_tips"] / own)
            assert got[t, k]["age"] == pytest.approx(want, abs=1e-9)


def test_split_by_size_and_unrooted(spark):
    nodes = trees(spark, "((a:1,b:1):3,((c:1,d:1):2,(e:1,f:4):1):3);", "(a:9,b:1);").cache()
    parts = transform.split_trees(nodes, pieces=2, rooted=False).where("is_tip").collect()
    found = {frozenset(r["label"] for r in parts if r["source"] == 0 and r["part"] == p) for p in (0, 1)}
    assert found == {frozenset("ab"), frozenset("cdef")}  # 3 + 3 at the root is the longest
    rooted = transform.split_trees(nodes, pieces=2).where("is_tip").collect()
    assert {frozenset(r["label"] for r in rooted if r["source"] == 0 and r["part"] == p) for p in (0, 1)} == {frozenset("f"), frozenset("abcde")}
    small = transform.split_trees(nodes, max_tips=2, rooted=False).where("is_tip").collect()
    sizes = {}
    for r in small:
        sizes.setdefault((r["source"], r["part"]), []).append(r["label"])
    assert max(map(len, sizes.values())) <= 2 and sorted(x for (s, _), v in sizes.items() for x in v if s == 0) == list("abcdef")
    assert sizes[1, 0] == ["a", "b"]
    with pytest.raises(ValueError):
        transform.split_trees(nodes)


def cut_by_hand(tips_of, limit):
    """Tip sets after cutting a tree, {clade's tips: branch length}, at its longest branches; branches that meet add up."""
    whole = max(tips_of, key=len)
    if len(whole) <= limit:
        return [whole]
    cut = max((c for c in tips_of if c != whole), key=lambda c: tips_of[c])
    rest = {}
    for c, length in tips_of.items():
        if not c <= cut:
            rest[c - cut] = rest.get(c - cut, 0.0) + length
    return cut_by_hand({c: x for c, x in tips_of.items() if c <= cut}, limit) + cut_by_hand(rest, limit)


def test_split_by_size_against_recursion(spark):
    rng = random.Random(17)
    nodes = trees(spark, *[random_newick(rng, n) for n in (2, 9, 17, 30)])
    own = (F.xxhash64("tree_id", "node_id") % 9973 + 20_000) / 8  # no two branches alike
    nodes = index_forest(nodes.withColumn("branch_length", own)).cache()
    found = {}
    for r in transform.split_trees(nodes, max_tips=5).where("is_tip").collect():
        found.setdefault(r["source"], {}).setdefault(r["part"], set()).add(r["label"])
    for tree_id, tree in by_tree(nodes).items():
        clades = {frozenset(x["label"] for x in below(tree, i) if x["is_tip"]): r["branch_length"] for i, r in tree.items()}
        assert {frozenset(p) for p in found[tree_id].values()} == set(cut_by_hand(clades, 5))


def test_grafted_lineages_end_with_their_clade(spark):
    rng = random.Random(8)
    nodes = trees(spark, *[random_newick(rng, 12) for _ in range(5)]).cache()
    grown = index_forest(generate.add_branches(nodes, 0.6, 0.3, seed=2)).cache()
    old, new = by_tree(nodes), by_tree(grown)
    assert any(r["label"] and r["label"].startswith("Tip") for tree in new.values() for r in tree.values())
    for t, tree in new.items():
        assert len({r["node_id"] for r in tree.values()}) == len(tree)
        for k, r in old[t].items():
            assert tree[k]["root_dist"] == pytest.approx(r["root_dist"]) and tree[k]["label"] == r["label"]
        high = max(r["root_dist"] for r in old[t].values())
        assert max(r["root_dist"] for r in tree.values()) <= high + 1e-9


def test_fasta_headers_and_nexus_numbers(spark, tmp_path):
    (tmp_path / "a.fst").write_text(">x | one > two; three\nAC\nGT\n>y\nNNAC\n\n>z | >q\r\nA\r\n")
    rows = {r["seq_id"]: (r["taxonomy"], r["sequence"], r["n_unknown"]) for r in matrices.read_fasta(spark, str(tmp_path / "a.fst")).collect()}
    assert rows == {"x": ("one > two; three", "ACGT", 0), "y": (None, "NNAC", 2), "z": (">q", "A", 0)}
    nodes = trees(spark, "((3:1,1:2)2:1,2:4);")
    newick_text = newick.to_nexus(nodes).first()["nexus"]
    (tmp_path / "t.nex").write_text(newick_text)
    back = sorted((r["label"], r["branch_length"]) for r in newick.read_nexus(spark, str(tmp_path / "t.nex")).collect() if r["label"])
    assert back == [("1", 2.0), ("2", 1.0), ("2", 4.0), ("3", 1.0)]


def test_cut_offs_by_gene(spark):
    from cladeframe.operators import sequences as q

    seqs = spark.createDataFrame([(i, 5) for i in range(6)], "seq_id int, completeness int")
    pairs = spark.createDataFrame([(0, 1, "x", 0.6), (2, 3, "y", 0.6), (4, 5, "z", 0.6)], "seq_id_a int, seq_id_b int, gene string, similarity double")
    cuts = spark.createDataFrame([("x", 0.5), ("y", 0.7)], "gene string, cut_off double")
    got = {r["member"]: r["lead"] for r in q.cluster(seqs, pairs, 0.55, by="gene", cut_offs=cuts).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4}
