"""URL filter: rules first, then a list of URLs behind a blocked Bloom filter.

Only DataFrame functions run here.  A url's host and path are cut out with
string functions.  Rules are matched by equality, not by trying each rule on each
url: a rule fits if its host is one of the url's host suffixes and its path is
the start of the url's path of the rule's length, so every url makes a candidate
key for each (suffix, occurring rule path length) and the longest that the rule
table has wins.

Where no rule fits, the method decides: block the urls whose canonical form
(host, path without a closing slash) is on the list, allow the rest.  The list is
condensed to a blocked Bloom filter (see ``bloom``) that the pass which cuts and judges
the urls reads as well; its rows are written.  Only possible hits go on to the exact
hash join with the list, which removes the false positives; the other rows are never
shuffled.

Size bounds: the rules are a list given by the caller.  The filter has 16 bits for each
listed url; it is broadcast if it has at most ``BROADCAST_BLOCKS`` blocks (32 bytes each),
which is checked on the count, and joined by its block number otherwise.  The list itself
is never broadcast by us.

Defined cases: a null url, or one without ``://``, has an empty host and path
and is allowed.  Two rules of the same length can't both fit one host and path
unless they are the same rule; of repeated rules with different verdicts block
wins.  Null entries of the list count for nothing, repeated ones once.  Extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.bloom import blocks_for, bloom_filter, marked
from cladeframe.llm.common import cut

def host_of(url: Column) -> Column:
    """A-Z lower-cased text between the first ``://`` and the next ``/``, ``?``, ``#`` or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host and path without closing slashes; null where there is no host."""
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", "")))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``rules`` are (verdict, host + path), such as ("block", "com/en/").
    """
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("site", canonical(F.col("host"), F.col("path")))
    parts = [(v, *r.partition("/")) for v, r in rules]
    lengths = sorted({len(slash + path) for _, _, slash, path in parts})
    depth = max([len(host.split(".")) for _, host, _, _ in parts], default=0)
    known = F.create_map(*[x for r in sorted({r for _, r in rules}) for x in (F.lit(r), F.lit("block" if ("block", r) in rules else "allow"))]) if rules else None
    if known is None:
        judged = base.withColumn("rule", F.lit(None).cast("string")).withColumn("own", F.lit(None).cast("string"))
    else:
        label = F.split(F.col("host"), r"\.")
        fits = []
        for n in range(1, depth + 1):  # host suffixes of as many labels as rules have
            suffix = F.when(F.size(label) >= n, F.array_join(F.slice(label, F.greatest(F.size(label) - n + 1, F.lit(1)), n), "."))
            for m in lengths:
                key = F.when((F.length("path") >= m) & (F.col("host") != ""), F.concat(suffix, F.substring("path", 1, m)))
                fits.append(F.when(F.element_at(known, key).isNotNull(), F.struct(F.length(key).alias("n"), key.alias("rule"))))
        best = fits[0] if len(fits) == 1 else F.greatest(*fits)
        judged = base.withColumn("rule", best["rule"]).withColumn("own", F.element_at(known, F.col("rule")))
    keys = cut(listed.select(F.col(listed.columns[0]).alias("site")).where("site IS NOT NULL").distinct(), "listed")
    blocks = blocks_for(keys.count())
    # rows that a rule judges have no key to look up
    asked = judged.withColumn("site", F.when(F.col("own").isNull(), F.col("site")))
    seen = cut(marked(asked, "site", bloom_filter(keys, "site", blocks), blocks, "possible"), "judged")
    hits = seen.where("possible").join(keys.withColumn("on_list", F.lit(True)), "site", "left")
    done = seen.where("NOT possible").withColumn("on_list", F.lit(None).cast("boolean"))
    verdict = F.coalesce("own", F.when(F.col("on_list"), F.lit("block")).otherwise(F.lit("allow")))
    return done.unionByName(hits).select("page_id", "host", "path", "rule", verdict.alias("verdict"))
