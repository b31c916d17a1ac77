"""The training-data operators against brute force, on small fixtures with every defined case."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Row

from cladeframe.llm import bloom, cover_tree, exact_dedup, kneser_ney, packing, sharding, sp_codec, superminhash, token_counts, toxicity, url_filter
from cladeframe.llm.common import WordHashes, shingle_set, words_of
from cladeframe.llm.queries import SHARDS, URL_RULES, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, cell int"
PROSE = ["alpha", "beta", "gamma", "delta", "one", "two", "three", "Straße", "été", "日本", "red", "green"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, None, None, None) for i, t in rows], DOCS)


def prose(rng, n):
    return [rng.choice(PROSE) + str(rng.randint(0, 40)) for _ in range(n)]


def corpus(seed=1):
    """(doc_id, text): prose with copies, near copies, repeated rows, nulls, blanks, one long text."""
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        rows.append((i, " ".join(prose(rng, rng.choice([1, 2, 3, 20, 60])))))
    base = prose(rng, 80)
    for i in range(40, 70):
        w = base[:]
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "x" + str(rng.randint(0, 999))
        rows.append((i, " ".join(w)))
    rows += [(70, None), (71, ""), (72, " \n\t"), (73, rows[3][1].upper()), (74, rows[5][1] + "  "), (75, " ".join(prose(rng, 9000)))]
    rows += [(5, rows[5][1]), (None, rows[5][1]), (76, "Strasse strasse"), (77, "a\x00b <s> <|endoftext|> 're"), (78, "日本語 テキスト 😀 é ▁x")]
    return rows


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
@pytest.mark.parametrize("limit", [1024, 8])
def test_near_duplicates(spark, monkeypatch, width, percent, limit):
    monkeypatch.setattr(superminhash, "FAMILY_CLASSES", limit)
    monkeypatch.setattr(superminhash, "LEFT_BLOCK", 3)
    monkeypatch.setattr(superminhash, "RIGHT_BLOCK", 5 if percent == 85 else 2048)
    monkeypatch.setattr(superminhash, "RIGHT_SHINGLES", 400)
    monkeypatch.setattr(superminhash, "LEFT_SHINGLES", 200)
    rows = corpus()
    got = superminhash.near_duplicates(frame(spark, rows), width, percent).collect()
    assert len(got) == len(rows)
    sets = {}
    for i, t in rows:
        w = words_of(t)
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    some = [i for i in sets if i is not None and sets[i]]
    links = [(a, b) for a in some for b in some if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components([i for i in sets if i is not None], links)
    assert any(links)
    for r in got:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]
            assert r["kept"] == (want[r["doc_id"]] == r["doc_id"])
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [want[5]]


def test_near_duplicates_empty(spark):
    assert superminhash.near_duplicates(frame(spark, [])).collect() == []


def test_superminhash_estimates_similarity():
    a = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sig = superminhash.signatures([a[:1500], a[500:], a[:1500], a[:1]], 256)
    assert (sig[0] == sig[2]).all()
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.12
    assert np.isfinite(sig).all()


def test_signature_of_a_long_set_is_the_minimum_of_its_parts(monkeypatch):
    a = np.random.default_rng(1).integers(1, 2**63, 5000).astype(np.uint64)
    whole = superminhash.signatures([a, a[:10]], 64)
    monkeypatch.setattr(superminhash, "_SLICE", 700)
    assert (superminhash.signatures([a, a[:10]], 64) == whole).all()


def test_bands_hardly_miss_at_the_threshold():
    for t in (0.8, 0.85):
        bands, rows = superminhash.bands_for(t)
        assert (1 - t**rows) ** bands <= 1e-5 and bands * rows <= 256


def test_family_links_span_the_components():
    rng = random.Random(4)
    h = WordHashes()
    sets = [shingle_set(h.of(words_of(" ".join(prose(rng, 1)) + " " + " ".join("w%d" % rng.randint(0, 3) for _ in range(6)))), 1) for _ in range(60)]
    share = Fraction(3, 5)
    pairs = [(i, j) for i in range(60) for j in range(i) if share * len(set(sets[i]) | set(sets[j])) <= len(set(sets[i]) & set(sets[j]))]
    assert components(range(60), superminhash.family_links(sets, share)) == components(range(60), pairs)


def test_exact_duplicates(spark):
    rows = corpus()
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\v\f\r")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    want = Counter()
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want[Row(doc_id=i, keep_id=keep, group_size=len(g), kept=i == keep, text_sha256=hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    assert Counter(got) == want
    assert exact_dedup.exact_duplicates(frame(spark, [])).collect() == []


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(2)
    cqf = exact_dedup.CountingQuotientFilter
    for ranges in (3, 12, 20):
        bits = exact_dedup.remainder_bits(ranges)
        low = rng.integers(0, 2 ** (64 - ranges), 3000).astype(np.uint64)
        low[:100] = low[100:200]
        low[200:500] = low[500]
        parts = [np.unique(p, return_counts=True) for p in np.array_split(low, 7)]
        filters = [cqf.from_bytes(cqf.build(v, n, bits).to_bytes()) for v, n in parts]
        merged = cqf.merge(filters)
        value, count = np.unique(low, return_counts=True)
        assert (merged.fingerprints() == value).all() and (merged.counts == count).all()
        assert len(cqf.build(value, count, bits).to_bytes()) < len(value) * (8 + bits // 8 + 8) + 100
    assert [exact_dedup.range_bits(n) for n in (0, 1, 500_000 * 8, 500_000 * 8 + 1, 500_000 << 20)] == [3, 3, 3, 4, 20]


def test_exact_duplicates_at_the_ends_of_the_ids(spark):
    high, low = 2**63 - 1, -(2**63)
    rows = [(high, "a b"), (high, "ab"), (low, "c"), (0, "c "), (5, "c "), (None, "d"), (None, "d"), (low, "e"), (high, "e"), (None, "e")]
    got = Counter(tuple(r)[:4] for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect())
    assert got == Counter([(high, high, 2, True)] * 2 + [(low, 0, 3, False), (0, 0, 3, True), (5, 0, 3, False)] + [(None, None, 2, True)] * 2 + [(low, low, 3, True), (high, low, 3, False), (None, low, 3, False)])


def test_repeated_fingerprints(spark):
    fps = [1, 1, 2, -5, -5, -5, 9]
    got = exact_dedup.repeated_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)).collect()
    assert {(r["fp"], r["n"]) for r in got} == {(1, 2), (-5, 3)}


def test_toxicity(spark):
    rng = random.Random(3)
    bad = ["grumbleskunk", "zotface", "blortish", "vexmonger"]
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randint(20, 90))
        toxic = i % 3 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    rows += [(900, None), (901, ""), (902, " ".join(w if k % 9 else rng.choice(bad) for k, w in enumerate(prose(rng, 20000)))), (0, rows[0][1])]
    labels += [(None, 0, 1), (0, 0, 0), (1, None, None), (5000, 0, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame(spark, rows), lab).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) >= 0.97 * len(held)
    assert by[900]["score"] == by[901]["score"] < 0.5 <= by[902]["score"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    none = toxicity.toxicity(frame(spark, rows[:3]), lab.where("toxic = 0")).collect()
    assert [r["score"] for r in none] == [0, 0, 0]
    assert toxicity.toxicity(frame(spark, []), lab).collect() == []


def test_toxicity_scores_by_hand():
    """Dictionaries, window distances and weights against their definitions."""
    import zstandard

    rng = random.Random(5)
    texts, kinds = [], []
    for i in range(400):
        words = prose(rng, 40) + ([rng.choice(["vile", "crude", "nasty"]) for _ in range(3)] if i % 2 else [rng.choice(["nice", "kind", "calm"])])
        rng.shuffle(words)
        texts.append(" ".join(words))
        kinds.append(i % 2)
    model, weights = toxicity.fit(texts, kinds)
    # which words tell the classes apart
    seen = {0: defaultdict(set), 1: defaultdict(set)}
    for k, (t, y) in enumerate(zip(texts, kinds, strict=True)):
        if k % 3 != 2:
            words = [w.encode() for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t).split()]
            words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
            for a, b in zip([b"", *words], words, strict=False):
                seen[y][b].add(a)
    nt, no = (sum(len(x) for x in seen[y].values()) for y in (1, 0))
    toxic, plain = set(), set()
    for w in {*seen[0], *seen[1]}:
        a, b = len(seen[1].get(w, ())), len(seen[0].get(w, ()))
        if a + b < toxicity.CONTEXTS:
            continue
        p = (a + b) / (nt + no)
        z = (a / nt - b / no) / math.sqrt(p * (1 - p) * (1 / nt + 1 / no))
        if z >= toxicity.DEVIATION and a >= toxicity.CONTEXTS and a / nt >= toxicity.RATIO * (b + 1) / no:
            toxic.add(w)
        if z <= -toxicity.DEVIATION and b >= toxicity.CONTEXTS and b / no >= toxicity.RATIO * (a + 1) / nt:
            plain.add(w)
    assert set(model.parts[0]) == toxic >= {b"vile", b"crude", b"nasty"}
    assert set(model.parts[1]) == plain >= {b"nice", b"kind", b"calm"}

    def length(window, content):
        d = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    def by_hand(text):
        words, out = toxicity.plain_words(text), []
        for spell in (lambda ws: b"".join(toxicity.xxhash.xxh64_digest(w) for w in ws), lambda ws: b" " + b" ".join(ws) + b" "):
            t, o, c = map(spell, model.parts)
            far = [length(spell(words[i : i + 8]), o + c) - length(spell(words[i : i + 8]), t + c) for i in range(0, len(words), 8)] or [0]
            out += [max(0, *far, 0), math.log1p(sum(v for v in far if v > 0) / len(far))]
        return out

    for t in [*texts[:12], "", "vile", " ".join(texts[:4])]:
        assert model.features(toxicity.plain_words(t)) == pytest.approx(by_hand(t), abs=1e-9)
    # the weights are where the penalised likelihood is flat
    x = np.array([[*model.features(toxicity.plain_words(t)), 1.0] for t in texts[2::3]])
    p = 1 / (1 + np.exp(-x @ weights))
    slope = x.T @ (np.array(kinds[2::3]) - p) - 1e-2 * np.array([1, 1, 1, 1, 1e-3]) * weights
    assert np.abs(slope).max() < 1e-5


def test_toxicity_leaves_other_columns_alone(spark):
    docs = spark.createDataFrame([(1, "vile words", 0.9, "t1", 7)], "doc_id long, body string, Score double, text string, id int")
    model = toxicity.fit(["vile crude words here"] * 3 + ["calm kind words here"] * 3, [1, 1, 1, 0, 0, 0])
    one = toxicity.score_column(docs, model, text_col="body", into="p").first()
    assert tuple(one)[:5] == tuple(docs.first())
    assert one["p"] == toxicity.score_column(docs.select(docs.body.alias("text")), model).first()["score"]
    assert toxicity.score_column(docs, model, text_col="body").columns == ["doc_id", "body", "text", "id", "score"]


def url_row(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def test_url_filter(spark):
    rng = random.Random(6)
    hosts = ["a.example.com", "EXAMPLE.com", "example.net", "x.y.example.net", "foo.org", "org", "notexample.com", "xexample.net", "com", "b.c.com", "é.COM", ""]
    paths = ["/en/", "/en/7", "/en/71", "/de/8", "/de/9/", "/es/", "/es", "", "/", "/EN/", "//en/", "/de"]
    urls = [f"{rng.choice(['http', 'https'])}://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=/en/", "#x://y/es/")]
    urls += [None, "", "no scheme", "://", "a://b://c/en/", "x\n://foo.com/en/\n1"]
    listed = ["foo.org/de/9", "notexample.com", "absent.example/x", None, "com/en", "foo.org/de/9"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'z' AS host", "1 AS block")
    got = url_filter.judge_urls(pages, URL_RULES, spark.createDataFrame([(u,) for u in listed], "u string")).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = url_row(urls[r["page_id"]])
        fits = [(len(rule), rule, v) for v, rule in URL_RULES for h, s, p in [rule.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
        best = max(fits, default=None)
        verdict = best[2] if best else "block" if host and host + path.rstrip("/") in listed else "allow"
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best and best[1], verdict)
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}
    none = url_filter.judge_urls(pages, [], spark.createDataFrame([], "u string")).select("verdict").distinct().collect()
    assert [r[0] for r in none] == ["allow"]


def test_bloom_filter_loses_nothing_and_passes_few(spark):
    keys = spark.range(4000).selectExpr("concat('k', id) AS k")
    others = spark.range(4000).selectExpr("concat('other', id) AS k")
    blocks = 4000 * 16 // 256
    made = bloom.bloom_filter(keys, "k", blocks)
    assert bloom.possible_hits(keys, "k", made, blocks).count() == 4000
    assert bloom.possible_hits(others, "k", made, blocks).count() < 100
    rows = others.unionAll(keys.limit(7)).unionAll(spark.createDataFrame([(None,)], "k string"))
    flagged = bloom.marked(rows, "k", made, blocks, "block")
    assert flagged.columns == ["k", "block"] and flagged.count() == 4008
    assert flagged.where("k IS NULL AND NOT block").count() == 1
    assert 7 <= bloom.narrowed(rows, "k", keys.withColumnRenamed("k", "other")).count() < 107
    assert bloom.narrowed(rows, "k", keys.where("false")).count() == 0


def test_native_plans_have_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string").repartition(2)
    placed = sharding.place(spark.range(5).repartition(2), "id", ["a", "b"], 11)
    for df in (url_filter.judge_urls(pages, URL_RULES, pages.select("url")), placed):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


MODEL = "piece_bpe_32k.model"


def test_sentencepiece(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary(MODEL))
    rows = corpus() + [(200, "  lead and  double "), (201, "x" * 3000), (202, " " * 50), (203, "\ufeff\u200b \ud7ff \U0010ffff"), (204, "ﬁ ½ Å")]
    got = sp_codec.encode_digests(frame(spark, rows), vocabulary(MODEL)).collect()
    want = Counter()
    for i, t in rows:
        ids = lib.encode(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want
    assert sp_codec.encode_digests(frame(spark, []), vocabulary(MODEL)).collect() == []


def test_sentencepiece_agenda_and_decoder():
    c = sp_codec.codec(vocabulary(MODEL))
    rng = random.Random(8)
    signs = ["a", "e", "th", "ing", " ", "  ", "é", "日", "😀", "▁", "\n", "1", ".", "ß"]
    for _ in range(400):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))
        ids = c.lib.encode(t)
        assert c.encode(t) == ids
        assert c.decode(ids) == c.lib.decode(ids)
    for _ in range(300):
        ids = [rng.choice([*c.byte_of, *range(3, 300), 29871, 29871]) for _ in range(rng.randint(0, 9))]
        assert c.decode(ids) == c.lib.decode(ids), ids
    borders, c.borders = c.borders, None
    try:
        assert c.encode("one  two ▁x") == c.lib.encode("one  two ▁x")
    finally:
        c.borders = borders


def test_sentencepiece_units_never_part_neighbours_of_a_piece(monkeypatch):
    c = sp_codec.codec(vocabulary(MODEL))
    pairs = {p[i : i + 2] for p in c.id_of for i in range(len(p) - 1)}
    rng = random.Random(10)
    for _ in range(200):
        t = "".join(rng.choice(["a", "E", "q", "ß", ".", ",", "7", "  ", "\n", "日", "😀", "▁"]) for _ in range(rng.randint(1, 40)))
        whole, units = sp_codec.MARK + t.replace(" ", sp_codec.MARK), c.units(t)
        assert "".join(units) == whole
        borders, at = set(), 0
        for u in units:
            at += len(u)
            borders.add(at)
        assert borders - {len(whole)} == {i for i in range(1, len(whole)) if whole[i - 1 : i + 1] not in pairs}
    monkeypatch.setattr(c.borders, "table", None)  # the way for vocabularies of very many characters
    assert c.encode("Straße, 日本 7.x") == c.lib.encode("Straße, 日本 7.x")


def test_sentencepiece_slices(spark, monkeypatch):
    import pyarrow as pa

    path = vocabulary(MODEL)
    texts = [None, "", "x y", "z" * 40, "", "a. b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["doc_id", "text"])
    want = [b.to_pydict() for b in sp_codec._digest(iter([batch]), path)]
    assert len(want) == 1
    monkeypatch.setattr(sp_codec, "CHUNK_BYTES", 8)
    monkeypatch.setattr(sp_codec, "CHUNK_ROWS", 2)
    got = [b.to_pydict() for b in sp_codec._digest(iter([batch.slice(0, 3), batch.slice(3)]), path)]
    assert len(got) > 3 and {c: [x for g in got for x in g[c]] for c in want[0]} == want[0]


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + rng.normal(scale=0.09 * (i % 4), size=8)).tolist(), i % 3 if i % 11 else 1) for i in range(260)]
    rows += [(300 + i, rows[1][1], 1) for i in range(40)] + [(350, [2 * x for x in rows[1][1]], 1)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] * 8, 1), (403, [None] + [1.0] * 7, 1), (404, [], 1), (405, rows[1][1], None), (406, [float("inf")] * 8, 1), (407, rows[1][1][:4], 1), (408, rows[1][1][:4], 1)]
    return rows + [rows[0], (500, [1e200] * 8, 2), (501, [1e-200] * 8, 2)]


@pytest.mark.parametrize(("block", "pivots"), [(2048, 64), (16, 64), (16, 3)])
def test_near_vectors(spark, block, pivots):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'q' AS cell", "1 AS n")
    got = cover_tree.near_vectors(df, 0.98, block=block, pivots=pivots).collect()
    assert len(got) == len(rows)

    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v) / np.abs(v).max()
        return x / np.sqrt(x @ x)

    units = [unit(v) for _, v, _ in rows]
    links, degree = [], Counter()
    for i, (a, _, la) in enumerate(rows):
        for j, (b, _, lb) in enumerate(rows):
            if i != j and la is not None and la == lb and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98:
                links.append((a, b))
                degree[i] += 1
    want = components({r[0] for r in rows}, links)
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == Counter((a, degree[i], want[a], want[a] == a) for i, (a, *_) in enumerate(rows))


def test_near_vectors_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert cover_tree.near_vectors(df).collect() == []
    with pytest.raises(ValueError):
        cover_tree.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label string"))


def test_cover_tree_covers_and_nests():
    x = np.random.default_rng(3).normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = cover_tree.CoverTree(x)

    def below(n):
        return [*t.points[n].tolist(), *[p for c in t.children[n] for p in below(c)]]

    assert sorted(below(0)) == list(range(300))
    for n in range(len(t.centre)):
        d = np.linalg.norm(x[below(n)] - x[t.centre[n]], axis=1)
        assert d.max() <= t.radius[n] + 1e-6
        assert not t.children[n] or t.centre[t.children[n][0]] == t.centre[n]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [r for r in corpus() if r[0] is not None] + [(90, "<|endoftext|> x <|endoftext|>")]
    got = packing.pack(frame(spark, rows), path).collect()
    ids = Counter()
    for i, t in rows:
        full = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(full) % 2048 or 2048
        edges = [0, *range(first, len(full) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            ids[(i, k, a, b - a, zlib.crc32(full[a:b].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == ids
    check_layout([(r["sequence_id"], r["offset"], r["length"]) for r in got], 2048)
    assert packing.pack(frame(spark, []), path).collect() == []


def check_layout(places, size):
    seq = defaultdict(list)
    for s, o, n in places:
        seq[s].append((o, n))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    return len(seq)


def test_sum_of_squares_is_near_the_bound():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 2049, 4000), rng.integers(1, 400, 3000), np.full(500, 1025), np.array([2048, 2048, 1]), np.array([1])):
        lengths = np.sort(lengths)[::-1]
        bins = packing.sum_of_squares(lengths, 2048)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert max(lengths[b].sum() for b in bins) <= 2048
        large = int((lengths > 1024).sum())
        bound = max(-(-int(lengths.sum()) // 2048), large)
        assert len(bins) <= bound * 1.03 + 1


def test_sum_of_squares_places_by_the_rule():
    """Against the sum counted anew for every bin a piece could take."""
    rng = random.Random(13)
    for size in (12, 40):
        lengths = sorted((rng.randint(1, size - 1) for _ in range(150)), reverse=True)
        bins, gaps = packing.Bins(size), []
        total = lambda g: sum(n * n for x, n in Counter(g).items() if x)
        for i, s in enumerate(lengths):
            bins.put(i, s)
            change = [(total([*gaps[:k], gaps[k] - s, *gaps[k + 1 :]]), gaps[k], k) for k in range(len(gaps)) if gaps[k] >= s]
            fresh = total([*gaps, size - s])
            if not change or fresh < min(change)[0]:
                gaps.append(size - s)
            else:
                gaps[min(change)[2]] -= s
            assert Counter(g for g in gaps if g) == Counter({g: int(n) for g, n in enumerate(bins.count) if n and g})
        for i, s in enumerate(lengths[:20]):  # no new bin: the rule among the open ones, or nothing
            change = [(total([*gaps[:k], gaps[k] - s, *gaps[k + 1 :]]), gaps[k], k) for k in range(len(gaps)) if gaps[k] >= s]
            assert bins.put(1000 + i, s, new=False) == bool(change)
            if change:
                gaps[min(change)[2]] -= s
            assert Counter(g for g in gaps if g) == Counter({g: int(n) for g, n in enumerate(bins.count) if n and g})


def test_sharding(spark):
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 211)
    share = Counter(table)
    assert max(share.values()) - min(share.values()) <= 1
    # the turns, by the definition
    order = [[(sharding._hash(f"{s}/offset") % 211 + j * (sharding._hash(f"{s}/skip") % 210 + 1)) % 211 for j in range(211)] for s in shards]
    want, k = {}, 0
    while len(want) < 211:
        slot = next(x for x in order[k % 7] if x not in want)
        want[slot] = k % 7
        k += 1
    assert [want[i] for i in range(211)] == table
    fewer = sharding.lookup_table(shards[:-1], 211)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 211 * 0.2
    rows = [(1, "a"), (None, "b"), (1, "c"), (2, "")]
    got = sharding.place(spark.createDataFrame(rows, "doc_id long, shard string"), "doc_id", shards, 211).collect()
    assert len(got) == 4 and {r["doc_id"]: r["shard"] for r in got} == {i: shards[table[sharding._hash("" if i is None else str(i)) % 211]] for i, _ in rows}
    assert sharding.place(spark.createDataFrame([], "doc_id long"), "doc_id", shards, 211).collect() == []
    clash = spark.createDataFrame([(1, "s", "t", 5, 6)], "doc_id long, _slot string, _shard string, slot int, n int")
    assert tuple(sharding.place(clash, "doc_id", shards, 211).first()) == (1, "s", "t", 5, 6, shards[table[sharding._hash("1") % 211]])
    assert sharding.place(clash, "doc_id", shards, 211, into="_SLOT").columns == ["doc_id", "_shard", "slot", "n", "_SLOT"]
    # the query's own table: turn by turn, each shard's preferences walked from their start
    names, size = SHARDS, sharding.TABLE_SIZE
    order = [iter([(sharding._hash(f"{s}/offset") % size + j * (sharding._hash(f"{s}/skip") % (size - 1) + 1)) % size for j in range(size)]) for s in names]
    owner = [None] * size
    for k in range(size):
        owner[next(x for x in order[k % len(names)] if owner[x] is None)] = k % len(names)
    assert owner == sharding.lookup_table(names, size)
    many = sharding.place(spark.range(500).withColumnRenamed("id", "doc_id"), "doc_id", names).collect()
    assert len(many) == 500 and all(r["shard"] == names[owner[sharding._hash(str(r["doc_id"])) % size]] for r in many)
    for bad in (([], 11), (["a", "a"], 11), (["a"], 12), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_write_shards(spark, tmp_path):
    shards = ["a", "b", "c"]
    sharding.write_shards(spark.range(100).withColumnRenamed("id", "doc_id"), "doc_id", shards, f"{tmp_path}/out", 31, files=2)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100
    sharding.write_shards(spark.range(9).selectExpr("id AS doc_id", "'x' AS _salt"), "doc_id", shards, f"{tmp_path}/named", 31)
    assert set(spark.read.parquet(f"{tmp_path}/named").columns) == {"doc_id", "_salt", "shard"}


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_scores(spark, monkeypatch, order):
    monkeypatch.setattr(kneser_ney, "SHARD_CHARS", 2000)
    monkeypatch.setattr(kneser_ney, "CHUNK", 500)
    rows = corpus()
    got = kneser_ney.lm_scores(frame(spark, rows), order=order).collect()
    assert len(got) == len(rows)
    key = lambda i: b"" if i is None else str(i).encode()
    tok = lambda t: [*words_of(t), b" end"]
    grams = lambda x: zip(*[[*[b" start"] * (order - 1), *x][k:] for k in range(order)], strict=False)
    c1, level = Counter(), {k: Counter() for k in range(1, order + 1)}
    for i, t in rows:
        if zlib.crc32(key(i)) % 10:
            x = tok(t)
            c1.update(x)
            level[order].update(grams(x))
    for k in range(order, 1, -1):
        level[k - 1].update(g[1:] for g in level[k])
    n, v = sum(c1.values()), len(c1)
    of, few, cuts = Counter(), defaultdict(lambda: [0, 0, 0]), {}
    for k, counts in level.items():
        cuts[k] = kneser_ney.discounts(*[sum(x == j for x in counts.values()) for j in (1, 2, 3, 4)])
        for g, c in counts.items():
            of[k, g[:-1]] += c
            few[k, g[:-1]][min(c, 3) - 1] += 1

    def p(g):
        if not g:
            return 1 / (v + 1)
        k, c = len(g), level[len(g)][g]
        if not of[k, g[:-1]]:
            return p(g[1:])
        free = sum(x * y for x, y in zip(cuts[k], few[k, g[:-1]], strict=True))
        return (c - (cuts[k][min(c, 3) - 1] if c else 0) + free * p(g[1:])) / of[k, g[:-1]]

    before = next(g[:-1] for g in level[order] if g[-2] == b"one1")
    assert abs(sum(p((*before, w)) for w in c1) + p((*before, b"?")) - 1) < 1e-9
    text = defaultdict(set)
    for i, t in rows:
        text[i].add(t)
    for r in got:
        (t,) = text[r["doc_id"]]
        x = tok(t)
        score = sum(math.log10(p(g)) for g in grams(x))
        base = sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)
        assert abs(r["score"] - score) < 1e-6 * (1 + abs(score)) and abs(r["base_score"] - base) < 1e-6 * (1 + abs(base))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(key(r["doc_id"])) % 10 == 0, len(x), sum(c1[w] > 0 for w in x), n)


def test_lm_frequent_contexts_are_split_and_summed(spark):
    """A pair of words that makes up most of the text goes to several shards; its figures are whole again when read."""
    texts = [(" ".join(f"the big w{i % 37}" for i in range(k, k + 60)),) for k in range(50)]
    model = kneser_ney.train(spark.createDataFrame(texts, "text string"), 8, order=3)
    hashes = WordHashes()
    the, big = (hashes.of([w]) for w in (b"the", b"big"))
    assert model.frequent.parts([big, the])[0] > 1
    total, left = kneser_ney.context_figures(model, [big, the])
    assert total[0] == 50 * 60
    assert left[0] == pytest.approx(model.cuts[2][2] * 37 / total[0])


def test_lm_scores_without_training_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    got = kneser_ney.lm_scores(frame(spark, [(held[0], "a b"), (held[1], None)])).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in sorted(got)] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert kneser_ney.lm_scores(frame(spark, [])).collect() == []


def test_lm_file_that_is_lost_is_an_error(spark, tmp_path):
    model = kneser_ney.train(spark.createDataFrame([("a b a",), ("b c",)], "text string"), 8)
    words = np.sort(WordHashes().of([b"a", b"b", b"zzz"]))
    count, _ = kneser_ney.word_figures(model, words)
    assert sorted(count) == [0, 2, 2]
    kneser_ney._map.cache_clear()
    with pytest.raises(FileNotFoundError):
        kneser_ney.word_figures(model._replace(folder=str(tmp_path)), words)


BPE = "byte_bpe_50k.json"


def test_edits_match_a_new_count():
    count = token_counts.counter(vocabulary(BPE))
    rng = random.Random(9)
    signs = ["'", "s", "r", "e", " ", "  ", "\n", "a", "b", "1", ".", "ll", "é", "\t", "'re", "日", "<|endoftext|>"]
    for _ in range(250):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 900)))
        tree = token_counts.tree_of(t, count)
        for _ in range(4):
            at, gone, new = rng.randint(0, len(t)), rng.choice([0, 1, 3, 50, 900]), "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 2, 400])))
            want = t[:at] + new + t[at + gone :]
            t, _ = token_counts.edit(t, tree, at, gone, new, count)
            assert t == want
            assert [n for p, _ in tree.blocks for n in p] == list(map(len, count.pattern.findall(t)))
            assert (tree.characters, tree.tokens) == (len(t), len(count.core.encode_ordinary(t)))


def test_pre_tokens_that_tiktoken_refuses(monkeypatch):
    count = token_counts.Counter(vocabulary(BPE))
    want = [len(count.core.encode_ordinary(p)) for p in (" hello", "日本語")]

    class Refusing:
        _encode_single_piece = count.core._encode_single_piece

        def encode_ordinary(self, piece):
            class Panic(BaseException):
                pass

            raise Panic

    monkeypatch.setattr(count, "core", Refusing())
    assert [count[p] for p in (" hello", "日本語")] == want


def test_apply_edits(spark):
    path = vocabulary(BPE)
    rows = corpus()
    state = token_counts.build(frame(spark, rows), path)
    table = spark.createDataFrame([(3, 2, 0, 1, "Z "), (3, 1, 4, 0, "mid"), (75, 1, 50000, 3, "'s"), (70, 1, -5, None, "new"), (999, 1, 0, 0, "x"), (71, 1, None, None, None)], "doc_id long, seq int, start long, length long, insert string")
    got = token_counts.apply_edits(token_counts.with_edits(state, table), path).collect()
    assert len(got) == len(rows)
    core = token_counts.counter(path).core
    text = {i: t or "" for i, t in rows}
    before = dict(text)
    text[3] = "Z " + (text[3][:4] + "mid" + text[3][4:])[1:]
    text[75] = text[75][:50000] + "'s" + text[75][50003:]
    text[70] = "new"
    for r in got:
        assert r["text"] == text[r["doc_id"]]
        assert r["n_tokens"] == len(core.encode_ordinary(r["text"])) and r["n_tokens_before"] == len(core.encode_ordinary(before[r["doc_id"]]))
    (long,) = [r for r in got if r["doc_id"] == 75]
    assert long["encoded_chars"] < 40
    again = token_counts.apply_edits(spark.createDataFrame([r.asDict() | {"edits": [Row(start=0, length=0, insert="A")]} for r in got if r["doc_id"] == 3], "doc_id long, text string, n_tokens long, n_pre_tokens long, tree binary, edits array<struct<start:long,length:long,insert:string>>"), path).first()
    assert again["n_tokens"] == len(core.encode_ordinary("A" + text[3]))
    assert token_counts.build(frame(spark, []), path).collect() == []
