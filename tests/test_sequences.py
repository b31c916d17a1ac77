"""Sequences, files and streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import sequences as fn
from cladeframe.operators import sequences as q
from cladeframe.operators.components import connected_components
from cladeframe.plans import sequences as plans
from cladeframe.schema import index_forest
from cladeframe.sources import matrices, newick
from cladeframe.streaming import trees as streams


def test_distances_by_hand(spark):
    seqs = spark.createDataFrame([("a", "ACGTAC"), ("b", "ACGTRT"), ("c", "------"), ("d", "TTTTTT"), ("e", "ac-nAC")], "seq_id string, sequence string")
    seqs = seqs.withColumn("states", fn.encode(F.col("sequence")))
    d = {(r["seq_id_a"], r["seq_id_b"]): r for r in q.distances(q.sequence_pairs(seqs)).collect()}
    assert len(d) == 10
    assert (d["a", "b"]["compared"], d["a", "b"]["differences"]) == (6, 1)  # A fits R, C differs from T
    assert d["a", "c"]["compared"] == 0 and d["a", "c"]["similarity"] == 1.0
    assert d["a", "d"]["differences"] == 5 and d["a", "d"]["jc"] == float("inf")
    assert (d["a", "e"]["compared"], d["a", "e"]["differences"]) == (5, 0)
    assert d["a", "b"]["jc"] == pytest.approx(-0.75 * np.log(1 - 4 / 3 / 6))
    gaps = {(r["seq_id_a"], r["seq_id_b"]): r for r in q.distances(q.sequence_pairs(seqs), gaps=True).collect()}
    assert gaps["a", "e"]["differences"] == 1
    back = seqs.select("seq_id", fn.decode(F.col("states")).alias("s")).collect()
    assert dict(back) == {"a": "ACGTAC", "b": "ACGTRT", "c": "??????", "d": "TTTTTT", "e": "AC?NAC"}
    assert seqs.select(F.size(fn.encode(F.col("sequence"), skip_first=True))).first()[0] == 5


@pytest.mark.parametrize("tile", [1, 3, 512])
def test_tiles_give_the_distances_of_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(q, "TILE", tile)
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("ACGTACGTRNY-?") for _ in range(rng.choice([0, 5, 12, 12])))
    rows = [(f"s{k}", text() if k else None, rng.choice("xy") if k % 9 else None) for k in range(40)]
    seqs = spark.createDataFrame([*rows, (None, "ACGT", "x")], "seq_id string, sequence string, g string").withColumn("states", fn.encode(F.col("sequence")))
    full = {(r["g"], r["seq_id_a"], r["seq_id_b"]): r["p"] for r in q.distances(q.sequence_pairs(seqs, ["g"])).collect()}
    got = q.tiled_distances(seqs, ["g"]).collect()
    assert len(got) == len(full) > 200
    assert {tuple(r)[:3]: r["p"] for r in got} == full
    near = q.tiled_distances(seqs, ["g"], below=0.5).collect()
    assert {tuple(r)[:3]: r["p"] for r in near} == {k: d for k, d in full.items() if d < 0.5}


def test_matrices_are_of_whole_nations(spark, tmp_path):
    """Of suppliers in any blocks of keys: ONE lacks its far pair, TWO has all."""
    letters = {1: "AAAA", 700: "AACC", 1400: "CCCC", 2: "AAAA", 3: "AAAA", 1200: "AAAC"}
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("region", [(0, "R")], "r_regionkey int, r_name string")
    write("nation", [(0, "ONE", 0), (1, "TWO", 0)], "n_nationkey int, n_name string, n_regionkey int")
    write("supplier", [(k, int(k in (2, 3, 1200))) for k in letters], "s_suppkey long, s_nationkey int")
    write("part", [(k, f"T{k}") for k in range(4)], "p_partkey long, p_type string")
    write("lineitem", [(p, k, float("ACGT".index(c)), "R", "F") for k, s in letters.items() for p, c in enumerate(s)], "l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string")
    got = plans.QUERIES["invalid_matrices"](spark, str(tmp_path))
    assert [(r["nation"], r["rows"], r["taxa"]) for r in got.collect()] == [("ONE", 2, 3)]
    assert set(got.columns) == {"nation", "rows", "taxa"}


def brute_align(a, b):
    """Best score by plain recursion over the three states."""
    low = -(10**9)
    n, m = len(a), len(b)
    best = np.zeros((n + 1, m + 1))
    up, left = np.full((n + 1, m + 1), low), np.full((n + 1, m + 1), low)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            up[i, j] = max(best[i - 1, j] - 15, up[i - 1, j] - 1)
            left[i, j] = max(best[i, j - 1] - 15, left[i, j - 1] - 1)
            best[i, j] = max(best[i - 1, j - 1] + (7 if a[i - 1] == b[j - 1] else -5), up[i, j], left[i, j])
    return max(best[n].max(), best[:, m].max())


def test_alignment_is_optimal():
    rng = random.Random(1)
    for _ in range(60):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 30)))
        b = a[rng.randint(0, 5) :] + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 8)))
        b = b[:9] + b[9 + rng.randint(0, 3) :] or "A"
        x, y, score = q._align(a, b)
        assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)
        assert score == brute_align(a, b)
        # the score of what was returned, end gaps free
        inner = [k for k in range(len(x)) if x[k] != "-" and y[k] != "-"]
        total, gap = 0, ""
        for k in range(inner[0], inner[-1] + 1) if inner else []:
            kind = "a" if x[k] == "-" else "b" if y[k] == "-" else ""
            total += (7 if x[k] == y[k] else -5) if not kind else (-1 if kind == gap else -15)
            gap = kind
        assert total == score


def test_many_alignments_at_once_are_those_of_each_alone():
    rng = random.Random(5)
    pairs = [("", ""), ("ACG", ""), ("", "ACG"), ("A", "A"), ("ACGT", "TTTT"), ("NNNN", "ACGT")]
    for _ in range(80):
        a = "".join(rng.choice("ACGTRN-") for _ in range(rng.randint(1, 60)))
        pairs.append((a, "".join(rng.choice("ACGT") if rng.random() < 0.2 else c for c in a[rng.randint(0, 9) :])))
    alone = [q._align(*p) for p in pairs]
    assert q.align_many(pairs) == alone
    buckets = list(q._buckets(pairs))
    assert sorted(k for b in buckets for k in b) == list(range(len(pairs))) and 1 < len(buckets) < len(pairs)
    rows = q.pd.DataFrame({"seq_id_a": range(len(pairs)), "seq_id_b": "x", "sequence_a": [a for a, _ in pairs], "sequence_b": [b or None for _, b in pairs]})
    got = next(q._align_batches(iter([rows])))
    assert list(zip(got["aligned_a"], got["aligned_b"], got["score"], strict=True)) == alone
    for (a, b), (x, y, score) in zip(pairs, alone, strict=True):
        if a and b and not set(a + b) & set("RN-"):
            assert score == brute_align(a, b)
        assert len(x) == len(y) and (not set(a + b) & set("-")) <= (x.replace("-", "") == a and y.replace("-", "") == b)


def test_memory_of_a_long_alignment_is_bounded():
    import tracemalloc

    rng = random.Random(6)
    a = "".join(rng.choice("ACGT") for _ in range(3000))
    b = a[100:1400] + "".join(rng.choice("ACGT") if rng.random() < 0.1 else c for c in a[1430:])
    tracemalloc.start()
    x, y, score = q._align(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12_000_000  # three matrices of 64-bit numbers take 216 MB
    assert x.replace("-", "") == a and y.replace("-", "") == b and x.startswith(a[:100]) and y.startswith("-" * 100)
    assert score > 6 * 2500


def test_align_pairs_and_clusters(spark):
    seqs = spark.createDataFrame([("a", "ACGTACGTAC", 1), ("b", "CGTACGTACG", 1), ("c", "TTTTTTGGGG", 1), ("d", "ACGTACGTAN", 1)], "seq_id string, sequence string, g int")
    got = q.align_pairs(q.sequence_pairs(seqs, ["g"])).collect()
    assert len(got) == 6
    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "d", 0.9995), ("a", "c", 0.999)], "seq_id_a string, seq_id_b string, similarity double")
    full = seqs.select("seq_id", q.completeness(F.col("sequence")).alias("completeness"))
    assert {tuple(r) for r in q.cluster(full, pairs).collect()} == {("a", "a"), ("b", "a"), ("d", "a"), ("c", "c")}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 3), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_taxon_mad_and_groups(spark):
    values = {"F;G1": [0.010, 0.0121, 0.013, 0.2], "F;G2": [0.5, 1.5, 2.7]}
    rows = [(t, t, v) for t, vs in values.items() for v in vs] + [("F;G1", "F;G2", 0.9)]
    mads = q.mad_by_taxon(spark.createDataFrame(rows, "taxonomy_a string, taxonomy_b string, jc_minus_p double"))
    got = {r["taxon"]: (r["n"], r["mad"]) for r in mads.collect()}

    def mad(vs):
        b = sorted(min(1999, int(v * 1000 + 1e-9)) for v in vs)
        med = b[(len(b) + 1) // 2 - 1]
        return 1.4826 / 1000 * sorted(abs(x - med) for x in b)[(len(b) + 1) // 2 - 1]

    every = [v for vs in values.values() for v in vs] + [0.9]
    for t, vs in {**values, "F": every}.items():
        assert got[t] == (len(vs), pytest.approx(mad(vs)))
    assert {tuple(r) for r in q.alignment_groups(mads).collect()} == {("F;G1", "A"), ("F;G2", "T")}
    assert {tuple(r) for r in q.alignment_groups(mads, 9).collect()} == {("F", "A")}


def test_alignable_groups(spark):
    rng = random.Random(3)
    base = {"x": "".join(rng.choice("ACGT") for _ in range(200)), "y": "".join(rng.choice("ACGT") for _ in range(200))}
    rows = []
    for i in range(8):
        s = list(base["x" if i < 4 else "y"])
        for _ in range(3):
            s[rng.randrange(200)] = rng.choice("ACGT")
        rows.append((f"s{i}", "".join(s), 1))
    seqs = spark.createDataFrame(rows, "seq_id string, sequence string, grp int").withColumn("states", fn.encode(F.col("sequence")))
    d = q.distances(q.sequence_pairs(seqs, ["grp"]))
    got = dict(q.alignable_groups(seqs, d, limit=0.0, rounds=1).collect())
    assert len({got[f"s{i}"] for i in range(4)}) == len({got[f"s{i}"] for i in range(4, 8)}) == 1 and got["s0"] != got["s7"]
    assert set(dict(q.alignable_groups(seqs, d, limit=9.0).collect()).values()) == {"1"}


def test_groups_that_only_infinite_distances_hold_are_cut_there(spark):
    inf = float("inf")
    part = {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "f": 2}
    near = {("a", "b"): 0.1, ("b", "c"): 0.9, ("d", "e"): 0.2}
    rows = [(x, y, near.get((x, y), inf)) for x in part for y in part if x < y]
    pairs = spark.createDataFrame([(x, y, 1, v, v) for x, y, v in rows], "seq_id_a string, seq_id_b string, grp int, jc_minus_p double, jc double")
    seqs = spark.createDataFrame([(x, 1) for x in part], "seq_id string, grp int")
    got = dict(q.alignable_groups(seqs, pairs, limit=0.0, rounds=1).collect())
    assert all((got[x] == got[y]) == (part[x] == part[y]) for x in part for y in part)
    got = dict(q.alignable_groups(seqs, pairs, limit=0.0).collect())
    assert got["d"] == got["e"] and len({got[x] for x in "abc"}) == 2


def test_alignable_groups_until_none_can_be_split(spark, monkeypatch):
    """Sequence i agrees with each later one in a share of its sites: every halving takes off one or a few."""
    rng = random.Random(4)
    base = [rng.choice("ACGT") for _ in range(600)]
    rows = []
    for i, share in enumerate(0.03 * 1.5**k for k in range(8)):
        s = [b if k < share * 600 else rng.choice("ACGT") for k, b in enumerate(base)]
        rows.append((i, "R;N", "R", "N", "".join(s)))
    monkeypatch.setattr(plans, "supplier_sequences", lambda spark, sf_dir: spark.createDataFrame(rows, "seq_id long, taxonomy string, region string, nation string, sequence string"))
    got = dict(plans.alignable_groups(spark, "").select("seq_id", "grp").collect())
    assert sorted(got) == list(range(8))
    text = {r[0]: r[4] for r in rows}

    def mad(ids):
        bins = []
        for a in ids:
            for b in ids:
                if a < b:
                    p = sum(x != y for x, y in zip(text[a], text[b], strict=True)) / 600
                    bins.append(min(1999, int(1000 * min(2, -0.75 * np.log(1 - p * 4 / 3) - p if p < 0.75 else 2))))
        middle = lambda v: sorted(v)[(len(v) + 1) // 2 - 1]
        return 1.4826 / 1000 * middle([abs(x - middle(bins)) for x in bins])

    groups = {}
    for i, g in got.items():
        groups.setdefault(g, []).append(i)
    assert all(len(ids) <= 2 or mad(ids) < 0.2 for ids in groups.values())
    assert max(g.count(".") for g in groups) > 2


def test_files(spark, tmp_path):
    p = lambda name, text: ((tmp_path / name).write_text(text), str(tmp_path / name))[1]
    fasta = p("x.fst", ">one | F; G\nACGT\nNN\n>two\nac-t\n>\nA\n>last|F\n")
    got = {r["record"]: r for r in matrices.read_fasta(spark, fasta).collect()}
    assert (got[1]["seq_id"], got[1]["taxonomy"], got[1]["sequence"], got[1]["n_unknown"], got[1]["n_known"]) == ("one", "F; G", "ACGTNN", 2, 4)
    assert (got[2]["seq_id"], got[2]["taxonomy"], got[3]["seq_id"], got[4]["sequence"]) == ("two", None, "3", "")
    pairs = matrices.read_pair_file(spark, fasta).orderBy("pair").collect()
    assert [(r["seq_id_a"], r["seq_id_b"]) for r in pairs] == [("one", "two"), ("3", "last")]
    assert dict(matrices.read_fasta_characters(spark, p("c.fst", ">a b\nAC\n>c\n-Y\n")).collect()) == {"a b": [1, 4], "c": [0, 12]}
    assert dict(matrices.read_phylip(spark, p("x.phy", "2 4\na AC\nGT\nb ACGA\n")).collect()) == {"a": [1, 4, 2, 8], "b": [1, 4, 2, 1]}
    nex = "#NEXUS\nbegin data;\ndimensions ntax=2 nchar=2;\nmatrix\n a AC [note]\n'b' GT\n;\nend;\n"
    assert dict(matrices.read_nexus_characters(spark, p("x.nex", nex)).collect()) == {"a": [1, 4], "b": [2, 8]}
    alphabet = matrices.alphabet_map(matrices.read_alphabet(spark, p("a.txt", "a 0\nc 1\nm 0 1\n- 0 1 2 3\n")))
    assert alphabet == {"A": 1, "C": 2, "M": 3, "-": 15}
    dist = matrices.read_distances(spark, p("d.txt", "a 1 2 3\nb 4 5\nc 6\nd\n"))
    assert {(r["i"], r["j"]): r["d"] for r in dist.collect()} == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("b", "c"): 4, ("b", "d"): 5, ("c", "d"): 6}
    assert [r["line"] for r in matrices.matrix_text(dist).orderBy("line_number").collect()] == ["a 1.000000 2.000000 3.000000", "b 4.000000 5.000000", "c 6.000000", "d"]
    assert {(r["i"], r["j"]) for r in matrices.read_distances(spark, p("u.txt", "1 2\n3\n"), labels=False).collect()} == {("1", "2"), ("1", "3"), ("2", "3")}
    assert dict(matrices.read_taxonomy(spark, p("t.txt", "F;G|a, b\nF;H|c\nnothing\n")).collect()) == {"a": "F;G", "b": "F;G", "c": "F;H"}
    genes = matrices.read_gene_list(spark, p("g.txt", "x,y\nx\n"))
    assert sorted(tuple(r) for r in genes.collect()) == [(1, "x"), (1, "y"), (2, "x")]
    for name, kind in (("x.fst", "fasta"), ("x.phy", "phylip"), ("x.nex", "nexus"), ("g.txt", "unknown"), (p("t.tree", " (a,b);").rsplit("/", 1)[1], "newick")):
        assert newick.sniff(spark, str(tmp_path / name)) == kind
    matrices.write_fasta(spark.createDataFrame([("a", "AC")], "label string, sequence string"), f"{tmp_path}/out")
    assert matrices.read_fasta(spark, f"{tmp_path}/out").first()["sequence"] == "AC"


def test_tree_files(spark, tmp_path):
    (tmp_path / "t.tree").write_text("((a:1,b:1):1,c:2);\n(a,\n(b,c));\n")
    t = index_forest(newick.read_newick(spark, str(tmp_path / "t.tree"))).cache()
    assert [r["newick"] for r in newick.to_newick(t, lengths=False).orderBy("tree_id").collect()] == ["((a,b),c);", "(a,(b,c));"]
    (tmp_path / "t.nex").write_text("#NEXUS\nbegin trees;\ntranslate 1 alpha, 2 'be ta', 3 c;\ntree x = [&R] ((1:1,2:1)[&p=0.9]:1,3:2);\nend;\nbegin calibration;\nmrca root = alpha c;\nfixage taxon=root age=12.5;\nend;\n")
    n = newick.read_nexus(spark, str(tmp_path / "t.nex"))
    assert {r["label"] for r in n.where("label IS NOT NULL").collect()} == {"alpha", "be ta", "c"}
    assert [r["ann"] for r in n.where("ann IS NOT NULL AND ann['p'] IS NOT NULL").collect()] == [{"p": "0.9"}]
    sets, ages = newick.read_node_ages(spark, str(tmp_path / "t.nex"))
    assert {(r["set_id"], r["label"]) for r in sets.collect()} == {("root", "alpha"), ("root", "c")} and ages.first()["age"] == 12.5
    assert {r["path"] for r in sets.collect()} == {r["path"] for r in ages.collect()} == {r["path"] for r in n.collect()}
    kinds = {r["path"].rsplit("/", 1)[1]: r["format"] for r in newick.sniff_files(spark, str(tmp_path / "t.*")).collect()}
    assert kinds == {"t.tree": "newick", "t.nex": "nexus"} and newick.sniff(spark, str(tmp_path / "t.nex")) == "nexus"
    text = newick.to_nexus(t.where("tree_id = 1")).first()["nexus"]
    (tmp_path / "back.nex").write_text(text)
    assert newick.read_nexus(spark, str(tmp_path / "back.nex")).where("label IS NOT NULL").count() == 3
    svg = newick.to_svg(t).first()["svg"]
    assert svg.startswith("<svg") and svg.count("<text") == 3 and svg.rstrip().endswith("</svg>")
    newick.write_newick(t, f"{tmp_path}/out")
    assert newick.read_newick(spark, f"{tmp_path}/out").select("tree_id").distinct().count() == 2


def test_stream_of_trees(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text("((a,b),(c,d));\n((a,b),c,d);\n" if k else "((a,c),(b,d));\n")
    run = streams.running_support(streams.stream_trees(spark, f"{tmp_path}/in", 1)).writeStream.outputMode("complete").format("memory").queryName("support").option("checkpointLocation", f"{tmp_path}/cp").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r["n"] for r in spark.table("support").collect()) == [1, 4]
