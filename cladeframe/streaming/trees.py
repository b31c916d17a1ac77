"""Trees that keep arriving: parsed as they come, their splits counted as a stream.

A tree is complete in one row, so parsing needs no state; the only state is a count
per split, of all trees or of those of known targets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators.splits import splits
from cladeframe.sources.newick import parse, read_tree


def stream_trees(spark: SparkSession, folder: str, files_at_once: int = 16) -> DataFrame:
    """(tree_id, newick) from text files put into a folder, a tree a line; ids are hashes of file and text."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder)
    return lines.where(F.trim("value") != "").select(F.xxhash64(F.col("_metadata.file_path"), "value").alias("tree_id"), F.col("value").alias("newick"))


SPLITS = "tree_id long, k1 long, k2 long, n long, x1 long, x2 long"


def _hashes(label: str) -> tuple[int, int]:
    """The two 64-bit hashes that ``splits`` takes of a name."""
    first = xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), 42)
    return first, xxhash.xxh64_intdigest((17).to_bytes(4, "little"), first)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tree_splits(batches: Iterator[pd.DataFrame], rooted: bool) -> Iterator[pd.DataFrame]:
    """The splits of each text by folds over its rows, which are in preorder: linear in the tree."""
    for batch in batches:
        out = []
        for tree, text in zip(batch["tree_id"], batch["newick"], strict=True):
            rows = read_tree(text) if text else None
            if not rows:
                continue
            size, a, b = ([0] * (len(rows) + 1) for _ in range(3))
            inner = {r[1] for r in rows}
            for node, parent, _, label, *_ in reversed(rows):
                if node not in inner and label is not None:
                    size[node], (a[node], b[node]) = 1, _hashes(label)
                if parent is not None:
                    size[parent] += size[node]
                    a[parent] ^= a[node]
                    b[parent] ^= b[node]
            total = (size[1], _signed(a[1]), _signed(b[1]))
            keys = set()
            for node, parent, *_ in rows:
                if node in inner and parent is not None and 2 <= size[node] <= size[1] - (1 if rooted else 2):
                    here, there = (_signed(a[node]), _signed(b[node])), (_signed(a[node] ^ a[1]), _signed(b[node] ^ b[1]))
                    keys.add(here if rooted else min(here, there))
            out.append((tree, None, None, *total))
            out += [(tree, *k, *total) for k in keys]
        yield pd.DataFrame(out, columns=["tree_id", "k1", "k2", "n", "x1", "x2"], dtype=object).astype("Int64")  # never doubles, which round


def stream_splits(trees: DataFrame, rooted: bool = False) -> DataFrame:
    """(tree_id, k1, k2, n, x1, x2) of each arriving tree: its splits, keyed as ``operators.splits`` keys them, and a row of nulls for the tree.

    Made inside the batch that brings the tree, so the stream is stateless up to here.
    """
    return trees.mapInPandas(partial(_tree_splits, rooted=rooted), SPLITS)


def running_support(trees: DataFrame) -> DataFrame:
    """(k1, k2, n): how many trees so far have each split; for a sink in complete or update mode.

    The state has a row for each split that was ever seen; ``target_support`` bounds it.
    """
    return stream_splits(trees).where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.count("*").alias("n"))


def target_support(targets: DataFrame, trees: DataFrame, rooted: bool = False) -> DataFrame:
    """(tree_id, node_id, n): how many arrived trees have each split of the ``targets`` (a node table); for update or complete mode.

    Only splits of targets are counted, so the state has one row for each and never grows.  A row
    without a node_id counts all arrived trees: n over that is the support.  Splits that
    no tree has had yet have no row.
    """
    want = splits(targets, rooted).select("tree_id", "node_id", F.col("key.k1").alias("k1"), F.col("key.k2").alias("k2"))
    every = targets.select("tree_id").distinct().select("tree_id", F.lit(None).cast("int").alias("node_id"), F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"))
    want = want.unionByName(every)
    came = stream_splits(trees, rooted).select("k1", "k2")
    met = came.join(want, came["k1"].eqNullSafe(want["k1"]) & came["k2"].eqNullSafe(want["k2"]))
    return met.groupBy("tree_id", "node_id").agg(F.count("*").alias("n"))


def stream_nodes(trees: DataFrame) -> DataFrame:
    """Raw node rows of arriving trees, in append mode."""
    return parse(trees)
