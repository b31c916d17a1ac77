"""A corpus pipeline over ``documents``: toxicity, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
between stages the rows are written as Parquet to the shared folder and read again.
All stages but the last return the columns of ``documents``.

A doc_id may be null or repeated.  The stages that drop copies write their input
with a key of its own for each row and decide by that key: exactly one row of each
group stays, the one with the smallest doc_id among equals (a null one last).
A null text counts as empty: it is never toxic or a near copy, one exact copy of
it stays, and it packs as its end id alone.  An empty table stays empty.  Extra
columns of ``documents`` go through all stages but the last unchanged, whatever
their names; the stages' own columns take names that are free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm.common import cut, fresh, table
from cladeframe.llm.exact_dedup import exact_duplicates
from cladeframe.llm.packing import pack
from cladeframe.llm.queries import vocabulary
from cladeframe.llm.superminhash import near_duplicates
from cladeframe.llm.toxicity import score_column, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    score = fresh("score", docs)
    scored = score_column(docs, train(docs, table(spark, sf_dir, "labels")), into=score)
    return scored.where(F.col(score) < 0.5).drop(score)


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key (the last column) that no two share; written, so that it stays the same wherever it is read."""
    return cut(docs.withColumn(fresh("row_key", docs), F.monotonically_increasing_id()), "keyed")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest row of each group of equal texts."""
    rows = keyed(docs)
    key = rows.columns[-1]
    kept = exact_duplicates(rows, key_col=key).where("kept").select(F.col("row_key").alias(key))
    return rows.join(kept, key, "left_semi").drop(key)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    rows = keyed(docs)
    key = rows.columns[-1]
    group = near_duplicates(rows, width=5, percent=80, id_col=key).select(F.col("doc_id").alias(key), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", key))
    kept = rows.select(key, "doc_id").join(group, key).groupBy("component_id").agg(first.alias("first")).select(f"first.{key}")
    return rows.join(kept, key, "left_semi").drop(key)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 2048 tokens."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("minhash_near_dedup", drop_near_copies), ("best_fit_packing", pack_sequences)]

#: A classifier's score, shingle components and a tokenizer are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = cut(stage(spark, rows, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, rows, sf_dir)
