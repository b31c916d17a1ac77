"""The queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm.common import table
from cladeframe.llm.cover_tree import near_vectors
from cladeframe.llm.exact_dedup import exact_duplicates
from cladeframe.llm.kneser_ney import lm_scores
from cladeframe.llm.lexical_search import search
from cladeframe.llm.packing import pack
from cladeframe.llm.sharding import place
from cladeframe.llm.sp_codec import encode_digests
from cladeframe.llm.superminhash import near_duplicates
from cladeframe.llm.token_counts import apply_edits, build, sample_edits
from cladeframe.llm.token_files import read_corpus, write_corpus
from cladeframe.llm.toxicity import toxicity
from cladeframe.llm.url_filter import canonical, host_of, judge_urls, path_of
from cladeframe.llm.whitening import whiten


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


#: The rules of the contract, in any order: the longest that fits wins.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: First host labels whose pages make up the list of unwanted URLs.
LISTED_LABELS = ["adult-x", "free-bets"]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list stands in for a published one: the URLs in ``pages`` of two unwanted sites' hosts."""
    pages = table(spark, sf_dir, "pages")
    host = host_of(F.col("url"))
    listed = pages.where(F.substring_index(host, ".", 1).isin(LISTED_LABELS)).select(canonical(host, path_of(F.col("url"))).alias("listed"))
    return judge_urls(pages, URL_RULES, listed)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


#: Shards of the sharding query; its table has the default size.
SHARDS = [f"shard-{i:02d}" for i in range(32)]


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", SHARDS)


#: A table that SQL can fill turn by turn.
SMALL_TABLE = 2053


def sharding_small_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same placement by a small table."""
    return place(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", SHARDS, SMALL_TABLE)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits made from its id and length."""
    path = vocabulary("byte_bpe_50k.json")
    state = build(table(spark, sf_dir, "documents"), path)
    edited = apply_edits(state.withColumn("edits", sample_edits()), path)
    return edited.select("doc_id", "n_tokens_before", "n_edits", "n_tokens", "n_pre_tokens", "encoded_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_corpus(spark, write_corpus(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_sharding": op8_sharding,
    "sharding_small_table": sharding_small_table,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_token_counts": op10_token_counts,
    "op11_token_files": op11_token_files,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM t),
classes AS MATERIALIZED (SELECT s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s),
e AS MATERIALIZED (SELECT rep, len(s) AS n, UNNEST(s) AS g FROM classes),
near AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
named AS (SELECT s, least(rep, coalesce(m, rep)) AS component FROM classes LEFT JOIN least_of ON a = rep)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM sets LEFT JOIN named USING (s)
""",
    "op3_url_filter": r"""
WITH rules(verdict, rule, rhost, rpath) AS (VALUES
  ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'),
  ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
s AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') END AS site FROM p),
listed AS (SELECT DISTINCT site FROM s WHERE split_part(host, '.', 1) IN ('adult-x', 'free-bets')),
best AS (
  SELECT s.*, r.rule, r.verdict AS own, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM s LEFT JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN site IN (SELECT site FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM best WHERE k = 1
""",
    "op4_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
    "op6_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
""",
    "sharding_small_table": f"""
WITH RECURSIVE shards AS (SELECT i, printf('shard-%02d', i) AS shard FROM range({len(SHARDS)}) t(i)),
prefs AS (
  SELECT i, shard, CAST('0x' || substr(md5(shard || '/offset'), 1, 15) AS BIGINT) % {SMALL_TABLE} AS o,
         CAST('0x' || substr(md5(shard || '/skip'), 1, 15) AS BIGINT) % {SMALL_TABLE - 1} + 1 AS k FROM shards),
turn(n, taken, slot, shard) AS (
  SELECT 0, [o], o, shard FROM prefs WHERE i = 0
  UNION ALL
  SELECT n + 1, list_append(taken, s), s, shard FROM (
    SELECT t.n, t.taken, p.shard,
           list_filter(list_transform(range({SMALL_TABLE}), lambda j: (p.o + j * p.k) % {SMALL_TABLE}), lambda x: NOT list_contains(t.taken, x))[1] AS s
    FROM turn t JOIN prefs p ON p.i = (t.n + 1) % {len(SHARDS)} WHERE t.n + 1 < {SMALL_TABLE}))
SELECT d.doc_id, d.source, t.shard
FROM documents d JOIN turn t ON t.slot = CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {SMALL_TABLE}
""",
    "op13_lexical_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, UNNEST(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY item_id, term),
total AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
e AS (SELECT doc_id, len(w) AS n, UNNEST(w) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
impact AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))) AS impact
  FROM tf JOIN weight USING (term), total),
scores AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN impact USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM scores WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM ranked WHERE k <= 10
""",
}
