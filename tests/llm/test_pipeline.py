"""The pipeline's stages on a small corpus."""

import random

import corpus_pipeline
import __spark_entry__

from cladeframe.llm.common import words_of


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "w" + str(rng.randint(0, 4000))
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(600)]
    labels = []
    for i in range(0, 600, 2):
        if i % 4 == 0:
            rows[i] = (i, rows[i][1] + " horrorword nastyword horrorword dreadword")
        labels.append((i, 1, int(i % 4 == 0)))
    base = rows[1][1].split()
    rows += [(700, "  ".join(base)), (701, " ".join([*base[:-1], "changed"])), (702, None), (703, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, columns = docs, docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns, name
        seen.append({r["doc_id"] for r in kept.select("doc_id").collect()})
    clean = {i for i, t in rows if b"horrorword" not in words_of(t)}
    assert len(seen[0] - clean) <= 5 and clean <= seen[0]
    assert seen[0] - seen[1] == {1, 703}  # 700 is longer than 1; 702 and 703 are empty
    assert seen[1] - seen[2] == {701}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == seen[2]


def test_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(12)
    prose = [" ".join("w" + str(rng.randint(0, 4000)) for _ in range(60)) for _ in range(12)]
    near = lambda k: prose[k].rsplit(" ", 1)[0] + " changed"
    stay = [
        (None, prose[0]), (None, prose[1]), (2, prose[2]), (3, prose[3]), (3, prose[4]), (5, prose[5]),
        (None, prose[6]), (7, prose[7]), (8, prose[8]), (None, None),
    ]
    copies = [(None, prose[1]), (2, prose[2]), (2, prose[2]), (5, prose[4]), (None, prose[7]), (None, "")]
    alike = [(None, near(6)), (8, near(8)), (9, near(8) + " again"), (None, near(3))]
    rows = [*stay, *copies, *alike]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def shown(df):
        return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())

    want = lambda rs: sorted((i is None, i or 0, t or "") for i, t in rs)
    unique = corpus_pipeline.drop_copies(spark, docs, str(tmp_path))
    # prose[4] goes to the smaller id, 3; the empty texts are one group
    assert unique.columns == docs.columns and shown(unique) == want([*stay, *alike])
    different = shown(corpus_pipeline.drop_near_copies(spark, unique, str(tmp_path)))
    # of (8, ...) twice, either text may stay
    texts = {8: {prose[8], near(8), near(8) + " again"}, None: {prose[6], near(6)}}
    assert len(different) == len(stay)
    assert sum(t in texts[8] for _, _, t in different) == sum(t in texts[None] for _, _, t in different) == 1
    others = lambda rs: [r for r in rs if r[2] not in texts[8] | texts[None]]
    assert others(different) == others(want(stay))


def test_other_columns_and_empty_tables(spark, tmp_path):
    """Columns named like those that stages and operators use come through; an empty table stays empty."""
    rng = random.Random(14)
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, row_key string, SCORE_ string, kept int, component_id int, fp long, toxic int, rep int, set_key string, family int, bytes int"
    rows = []
    for i in range(30):
        t = " ".join("w" + str(rng.randint(0, 4000)) for _ in range(30))
        rows.append((i, t, "en", "s", len(t), i / 9, f"k{i}", f"s{i}", i, i, i, i, i, f"x{i}", i, i))
    rows.append((99, rows[3][1], *rows[3][2:]))
    docs = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(20)], "doc_id long, quality int, toxic int")
    for name, table in (("full", docs), ("empty", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        kept = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, f"{tmp_path}/{name}")
            assert kept.columns == docs.columns
            assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
        assert kept.count() == (30 if name == "full" else 0)
        packed = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert {r["doc_id"] for r in packed.collect()} == ({*range(30)} if name == "full" else set())


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
