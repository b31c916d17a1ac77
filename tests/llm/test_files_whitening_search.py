"""Token files, whitening and lexical search against brute force, with their defined cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cladeframe.llm import lexical_search, token_files, whitening
from cladeframe.llm.lexical_search import search, terms_of, vocabulary_tiles
from cladeframe.llm.queries import vocabulary
from cladeframe.llm.token_files import Corpus, read_corpus, write_corpus
from cladeframe.llm.whitening import cholesky, deviations, off_mean, solve, whiten

TEXTS = [
    (7, "the quick brown fox"), (3, None), (5, ""), (1, "Straße 日本 😀 <|endoftext|>"), (None, "no id"), (None, None), (2, "fox " * 3000),
    (4, "the fox"), (4, "another text of the same id"), (4, "the fox"), (-9, "a\x00b \n\t c"), (2**62, "far"),
]


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "k") for i, t in rows], "doc_id long, text string, tie int, row int, n int, key string")


def reference_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(vocabulary("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, 0]


def test_token_files_hold_the_library_ids_in_order(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 1000)
    monkeypatch.setattr(token_files, "READ_IDS", 50)
    corpus = write_corpus(clashing(spark, TEXTS), vocabulary("byte_bpe_50k.json"))
    rows = read_corpus(spark, corpus).collect()
    ids = {r.start: r.ids for r in read_corpus(spark, corpus, ids=True).collect()}
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, *sorted(i for i, _ in TEXTS if i is not None)]
    left = [(i, reference_ids(t)) for i, t in TEXTS]
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        left.remove((r.doc_id, list(ids[r.start])))
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start], "<u4").tobytes())
    assert not left
    assert (corpus.n_ids, corpus.n_docs, corpus.width) == (at, len(TEXTS), "<u2")
    assert len(corpus.bases) > 2
    again = Corpus.open(corpus.folder)
    flat = [x for r in rows for x in ids[r.start]]
    assert again.ids(0, at).tolist() == flat
    for a, b in [(3, 40), (at - 5, at + 5), (at, at), (0, 0)]:
        assert again.ids(a, b).tolist() == flat[a:b]
    assert [again.document(i).tolist() for i in range(len(rows))] == [list(ids[r.start]) for r in rows]
    with pytest.raises(IndexError):
        again.document(len(rows))
    corpus.remove()


def test_token_files_of_an_empty_table(spark):
    corpus = write_corpus(clashing(spark, []), vocabulary("byte_bpe_50k.json"))
    assert read_corpus(spark, corpus).collect() == []
    assert (corpus.n_docs, corpus.n_ids, corpus.ids(0, 9).tolist()) == (0, 0, [])


def test_a_frequent_doc_id_goes_to_several_shards(spark):
    corpus = write_corpus(clashing(spark, [(1, "one and the same")] * 400 + [(0, "first"), (2, "last")]), vocabulary("byte_bpe_50k.json"))
    rows = sorted(read_corpus(spark, corpus).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [0] + [1] * 400 + [2]
    assert np.diff(corpus.bases[:, 2]).max() < 300


def brute_whitening(rows, k):
    x = {i: [math.floor(64 * c) + 1000000 for c in v] for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted({tuple(v) for v in x.values()}), object)
    n, sums = len(fit), fit.sum(axis=0)
    a = ((n * fit - sums) / n).astype(float)
    _, s, right = np.linalg.svd(a, full_matrices=False)
    e = s**2 / n
    return n, {i: sum((n * c - t) ** 2 for c, t in zip(v, sums.tolist(), strict=True)) for i, v in x.items()}, e, right[:k], {i: ((n * np.array(v, object) - sums) / n).astype(float) for i, v in x.items()}


@pytest.mark.parametrize("kind", ["plain", "nearly dependent", "large"])
def test_whitening_equals_a_decomposition_of_the_rows(spark, kind, monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 20)) * np.linspace(1, 4, 20)
    if kind == "nearly dependent":
        data[:, 7] = data[:, 3] * 50_000
        data[:, 3] *= 50_000
        data[0, 7] += 1 / 64
        data[5, 7] -= 2 / 64
        k = 20
    elif kind == "large":
        data *= 1e5
        k = 16
    else:
        k = 16
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(1000, rows[0][1]), (1001, None), (1002, [None] + rows[1][1][1:]), (1003, [float("nan")] + rows[1][1][1:]), (1004, [float("inf")] * 20), (1000, rows[2][1]), (None, rows[4][1]), (1005, [1.0])]
    monkeypatch.setattr(whitening, "CHUNK", 64)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    out = whiten(spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, x int, d string"), components=k).collect()
    usable = [(i, v) for i, v in rows if v is not None and i not in (1002, 1003, 1004, 1005)]
    n, deviation, e, right, centred = brute_whitening([(j, v) for j, (_, v) in enumerate(usable)], k)
    assert len(out) == len(usable) * k
    assert {r.n for r in out} == {n} == {300}
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-6
    for r in out:
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-6)
    want = Counter((i, c + 1, deviation[j] if deviation[j] < 2**63 else None, round(abs(float(centred[j] @ right[c])) / math.sqrt(e[c]), 4)) for j, (i, _) in enumerate(usable) for c in range(k))
    got = Counter((r.vec_id, r.component, r.deviation, round(abs(r.whitened), 4)) for r in out)
    assert sum((want - got).values()) <= 6  # values that lie on the edge of rounding
    signs = {c: {np.sign(r.whitened) * np.sign(centred[r.vec_id] @ right[c - 1]) for r in out if r.component == c and r.vec_id is not None and r.vec_id < 300 and abs(r.whitened) > 1e-3} for c in range(1, k + 1)}
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_without_full_rank(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(-300, 300, size=(80, 2)) / 64
    rows = [(i, [v[0], v[1], v[0], 2.0, v[0] + v[1]]) for i, v in enumerate(a.tolist())]
    out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(out) == 80 * 5
    for r in out:
        assert (r.whitened is None) == (r.component > 2)
        assert (r.explained == 0) == (r.component > 2)
    assert out[0].identity_error < 1e-9
    same = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(same)] == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    assert whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")).collect() == []


def test_whole_numbers_stay_exact_at_any_size():
    x = np.array([[2**53 - 1, -(2**53)], [1000000, 1000001]], np.int64)
    n, sums = 10**9, [5 * 10**24, -7]
    assert off_mean(x, n, sums).tolist() == [[n * a - s for a, s in zip(row, sums, strict=True)] for row in x.tolist()]
    assert deviations(x, n, sums) == [None, None]
    assert deviations(np.array([[1000003, 1000000]]), 5, [5000000, 5000001]) == [15**2 + 1]


def test_triangular_solve_and_shifted_factor():
    rng = np.random.default_rng(1)
    r = np.triu(rng.normal(size=(70, 70))) + 9 * np.eye(70)
    a = rng.normal(size=(33, 70))
    assert np.allclose(solve(a, r) @ r, a)
    flat = np.ones((6, 6))
    f = cholesky(flat, shift=False)
    assert np.allclose(f.T @ f, flat, atol=1e-9)


def brute_search(docs, items, k=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = {i: i + 32 for i in range(65, 91)}
    split = lambda t: pattern.findall((t or "").translate(lower))
    words = [(i, split(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        asked = Counter(split(text))
        scored = []
        for i, w in words:
            tf, score = Counter(w), 0
            for t, times in asked.items():
                if tf[t]:
                    m = 100 - 75 + (75 * len(w) * n_docs) // n_terms
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    word = lambda: rng.choice(["fox", "Fox", "ñandú", "日本", "x1", "the", "THE", "Ñ", "a-b", "tail_end", *(f"w{i}" for i in range(60))])
    docs = [(i, " ".join(word() for _ in range(rng.integers(1, 60)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "..."), (None, docs[0][1]), (203, docs[0][1]), (3, docs[3][1]), (204, "fox " * 5000), (205, docs[7][1].upper())]
    items = [(i, " ".join(word() for _ in range(rng.integers(1, 15)))) for i in range(25)]
    items += [(50, None), (51, ""), (52, "zzz unseen"), (None, items[0][1]), (7, items[0][1]), (7, "the the the " * 40), (53, "fox!fox?FOX")]
    columns = "long, text string, key string, n int, score double, rank int"
    d = spark.createDataFrame([(i, t, "k", 1, 0.5, 1) for i, t in docs], f"doc_id {columns}").repartition(5)
    q = spark.createDataFrame([(i, t, "k", 1, 0.5, 1) for i, t in items], f"item_id {columns}")
    want = Counter(brute_search(docs, items))
    out = search(d, q)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, out.collect())) == want
    monkeypatch.setattr(lexical_search, "BATCH_BYTES", 300)
    monkeypatch.setattr(lexical_search, "TILE_CELLS", 12)
    monkeypatch.setattr(lexical_search, "TILE_DOCS", 7)
    assert Counter(map(tuple, search(d, q).collect())) == want
    assert Counter(map(tuple, search(d, q, k=1).collect())) == Counter(brute_search(docs, items, 1))
    none = q.where("false")
    assert search(d, none).collect() == search(d.where("false"), q).collect() == search(d.where("text IS NULL"), q).collect() == []
    assert [(f.name, f.dataType.simpleString()) for f in search(d, none).schema] == [(f.name, f.dataType.simpleString()) for f in out.schema]


def test_no_tile_can_leave_what_a_double_holds():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 4, size=(5, 40))
    counts[2, 7] = 900
    weights = rng.integers(0, 30, size=40)
    most = 100 * 10**6
    tiles = vocabulary_tiles(counts, weights, most)
    total = np.zeros_like(counts)
    for columns, block in tiles:
        assert ((block * weights[columns] * 10**6).sum(axis=1) < most).all()
        total[:, columns] += block.astype(int)
    assert len(tiles) > 10 and (total == counts).all()


def test_terms():
    assert terms_of("Año_2024: ÑU-x\x7fy '日本'") == ["Año".encode().lower(), b"2024", "ÑU".encode().replace(b"U", b"u"), b"x", b"y", "日本".encode()]
    assert terms_of(None) == []
