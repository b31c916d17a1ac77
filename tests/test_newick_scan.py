"""Newick files in byte ranges: nothing is lost wherever names, comments and ranges lie."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladeframe.sources import newick, newick_scan
from cladeframe.sources.newick_scan import BARE, COMMENT, DOUBLE, OUTSIDE, SINGLE, NewickReader, commands, problem_of, read_texts, tokens, tree_ends


def brute_ends(data, state=OUTSIDE):
    """One character after the other."""
    ends = []
    for i, c in enumerate(data.decode("latin-1")):
        if state >= COMMENT:
            state += (c == "[") - (c == "]")
            if state < COMMENT:
                state = OUTSIDE
        elif state == SINGLE:
            state = OUTSIDE if c == "'" else state
        elif state == DOUBLE:
            state = OUTSIDE if c == '"' else state
        elif c == "[":
            state = COMMENT
        elif c in "'\"" and state == OUTSIDE:
            state = SINGLE if c == "'" else DOUBLE
        else:
            if c == ";":
                ends.append(i)
            state = OUTSIDE if c in " \t\r\n\f\v()],:;" else BARE
    return ends, state


@settings(max_examples=500, deadline=None)
@given(st.text("(),:;[]'\" ab\n&", max_size=40), st.sampled_from([OUTSIDE, BARE, SINGLE, DOUBLE, COMMENT, COMMENT + 1]))
def test_ends_from_every_state(text, state):
    ends, after = tree_ends(text.encode(), state)
    assert (ends.tolist(), after) == brute_ends(text.encode(), state)


NASTY = [
    ("(a,b);", ["a", "b"]), ("('A;x',c:1)r;", ["A;x", "c"]), ("[&c=1;2](a[x;[;]y],b);", ["a", "b"]), ("(O'Brien,\"d;'e\");", ["O'Brien", "d;'e"]),
    ("('it''s; (','[not]');", ["it's; (", "[not]"]), ("[a;'](x,y);", ["x", "y"]), ("(ñ'é;", None), ("(p,q));", None), ("\n(  s\n,\tt )\n;", ["s", "t"]), (";", None), ("[only a comment];", None), ("(a:x,b);", None),
]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 20, 1000])
def test_trees_in_equal_trees_and_problems_out(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(newick_scan, "RANGE_BYTES", size)
    rng, files, want = random.Random(size), {}, []
    for f in range(3 if size > 3 else 1):
        trees = rng.sample(NASTY, len(NASTY))
        text = "\n".join(t for t, _ in trees) + ["\n[end; of it]\n", "", "\n(un,finished"][f]
        files[f"{f}.tree"] = text
        want += [tips for _, tips in trees] + [None] * (f == 2)
    folder = tmp_path / f"s {size}"
    folder.mkdir()
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8")
    got = newick.read_newick(spark, str(folder), problems=True).collect()
    assert {r.tree_id for r in got} == set(range(1, len(want) + 1))
    for k, tips in enumerate(want, 1):
        rows = [r for r in got if r.tree_id == k]
        parents = {r.parent_id for r in rows}
        if tips is None:
            assert [(r.node_id, r.problem is None) for r in rows] == [(None, False)]
        else:
            assert [r.label for r in sorted(rows, key=lambda r: r.node_id) if r.node_id not in parents] == tips
            assert all(r.problem is None for r in rows)
    assert newick.read_newick(spark, str(folder)).select("tree_id").distinct().count() == sum(t is not None for t in want)


def test_an_interval_skips_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(newick_scan, "RANGE_BYTES", 64)
    (tmp_path / "t.tree").write_text("".join(f"(a{i},b{i});\n" for i in range(1, 101)))
    rows = read_texts(spark, str(tmp_path), (40, 43))
    assert [r.newick for r in rows.orderBy("tree_id").collect()] == [f"(a{i},b{i});" for i in range(40, 44)]
    assert (rows.where("tree_id = 41").count(), rows.count()) == (1, 4)
    assert read_texts(spark, str(tmp_path), (101, 200)).count() == 0
    assert read_texts(spark, str(tmp_path), (-5, 2)).count() == 2
    index = newick_scan.index_newick(spark, str(tmp_path))
    assert len(NewickReader(index, 1, 100).partitions()) > 15
    parts = NewickReader(index, 40, 43).partitions()
    assert len(parts) <= 2
    assert [r[0] for p in parts for r in NewickReader(index, 40, 43).read(p)] == [40, 41, 42, 43]


def test_files_that_only_spark_opens_are_read_whole(spark, tmp_path, monkeypatch):
    for f, text in enumerate(["('A;x',b);(c,d);\n", "(e,f)", "\n"]):
        (tmp_path / f"{f}.tree").write_text(text)
    split = sorted(map(tuple, read_texts(spark, str(tmp_path)).collect()))

    def refuse(path):
        raise newick_scan.pa.ArrowInvalid("no such scheme")

    monkeypatch.setattr(newick_scan, "opened", refuse)
    assert sorted(map(tuple, read_texts(spark, str(tmp_path)).collect())) == split
    assert [(r[0], r[2], r[3]) for r in split] == [(1, "('A;x',b);", None), (2, "(c,d);", None), (3, "(e,f)", "the file ends before the tree")]


def test_an_empty_folder_and_blank_files(spark, tmp_path):
    (tmp_path / "a").write_text("")
    (tmp_path / "b").write_text(" \n[x;]\n")
    assert newick.read_newick(spark, str(tmp_path), problems=True).collect() == []


def test_texts():
    assert list(tokens("('it''s',\"a\"[x[y]z]O'B:1)]")) == ["(", "'it''s'", ",", '"a"', "[x[y]z]", "O'B", ":", "1", ")"]
    assert [problem_of(t) is None for t in (b"(a,b)", b"a", b"(a", b"a)", b"('(')", b"[(](a)", b" [x]")] == [True, True, False, False, True, True, False]
    assert commands("a 'x;y' [;] b; c;d") == ["a 'x;y' [;] b", " c"]


def test_nexus_with_semicolons_in_names_and_comments(spark, tmp_path):
    text = "#NEXUS\n[a; comment]\nBegin taxa; taxlabels x 'end;'; end;\nbegin TREES;\ntranslate 1 'al;pha', 2 \"be, ta\", 3 c [; [;]];\ntree 'the end;' = [&R] ((1:1,2:1)[&p=0.9]:1,3:2);\nutree two = (1,'end;');\nEnd;\nbegin other; tree no = (1,2); end;\n"
    (tmp_path / "t.nex").write_text(text)
    rows = newick.read_nexus(spark, str(tmp_path / "t.nex")).orderBy("ordinal", "node_id")
    assert [r.label for r in rows.where("ordinal = 1").collect() if r.label] == ["al;pha", "be, ta", "c"]
    assert [r.label for r in rows.where("ordinal = 2").collect() if r.label] == ["al;pha", "end;"]
    assert rows.select("ordinal", F.col("title")).distinct().orderBy("ordinal").collect()[0].title == "the end;"
