"""Sequences, characters and distances as text, in and out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions.sequences import ALPHABETS, decode, encode
from cladeframe.sources.newick import nexus_commands, numbered


def _records(spark: SparkSession, path: str) -> DataFrame:
    """The text of each record: one begins at a > at the start of a line, other ones belong to the record."""
    text = spark.read.option("lineSep", "\n>").text(path)
    return text.select(F.regexp_replace(F.translate("value", "\r", ""), r"^\s*>", "").alias("value")).where(F.trim(F.translate("value", "\r\n\t", "   ")) != "")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(record, seq_id, taxonomy, sequence, n_unknown, n_known): headers are ``accession | taxonomy``.

    Records without a name get their number as one.
    """
    rows = numbered(_records(spark, path), "record")
    head = F.substring_index("value", "\n", 1)
    name = F.regexp_replace(F.substring_index(head, "|", 1), r"\s", "")
    taxonomy = F.when(F.contains(head, F.lit("|")), F.trim(F.expr("substring(substring_index(value, '\n', 1), instr(substring_index(value, '\n', 1), '|') + 1)")))
    body = F.when(F.contains(F.col("value"), F.lit("\n")), F.regexp_replace(F.expr("substring(value, instr(value, '\n'))"), r"\s", "")).otherwise("")
    seq = rows.select("record", F.when(name == "", F.col("record").cast("string")).otherwise(name).alias("seq_id"), taxonomy.alias("taxonomy"), body.alias("sequence"))
    unknown = F.length(F.regexp_replace("sequence", "[^Nn]", ""))
    return seq.withColumn("n_unknown", unknown).withColumn("n_known", F.length("sequence") - unknown)


def read_fasta_characters(spark: SparkSession, path: str, alphabet: str | dict[str, int] = "dna") -> DataFrame:
    """(label, states) of an aligned file: the whole header is the taxon, unknown characters are empty sets."""
    rows = _records(spark, path)
    body = F.when(F.contains(F.col("value"), F.lit("\n")), F.expr("substring(value, instr(value, '\n'))")).otherwise("")
    return rows.select(F.trim(F.translate(F.substring_index("value", "\n", 1), "\r", "")).alias("label"), encode(body, _alphabet(alphabet)).alias("states"))


def _alphabet(alphabet: str | dict[str, int]) -> dict[str, int]:
    return ALPHABETS[alphabet] if isinstance(alphabet, str) else alphabet


def write_fasta(rows: DataFrame, path: str, label: str = "label", sequence: str = "sequence") -> None:
    """One record per row."""
    rows.select(F.concat(F.lit(">"), F.col(label), F.lit("\n"), F.col(sequence))).write.text(path)


def characters_as_text(characters: DataFrame, alphabet: str | dict[str, int] = "dna") -> DataFrame:
    return characters.select("label", decode(F.col("states"), _alphabet(alphabet)).alias("sequence"))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value")


def _lines(function, schema: str, columns: list[str], files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for text in batch["value"] for r in function(text)], columns=columns)

    return files.mapInPandas(run, schema)


def phylip_rows(text: str) -> list[list]:
    """[label, sequence] of relaxed sequential PHYLIP: ``taxa characters``, then names and characters."""
    words = text.split()
    if len(words) < 2 or not words[1].isdigit():
        return []
    width, out, i = int(words[1]), [], 2
    while i < len(words):
        name, i, body = words[i], i + 1, ""
        while i < len(words) and len(body) < width:
            body, i = body + words[i], i + 1
        out.append([name, body])
    return out


def read_phylip(spark: SparkSession, path: str, alphabet: str | dict[str, int] = "dna") -> DataFrame:
    """(label, states) of relaxed sequential PHYLIP files."""
    rows = _lines(phylip_rows, "label string, sequence string", ["label", "sequence"], _whole(spark, path))
    return rows.select("label", encode(F.col("sequence"), _alphabet(alphabet)).alias("states"))


def nexus_rows(text: str) -> list[list]:
    """[label, sequence] of a sequential data or characters block."""
    for block in ("data", "characters"):
        for command, rest in nexus_commands(text, block):
            if command == "matrix":
                pairs = [line.split(None, 1) for line in re.sub(r"\[[^\]]*\]", "", rest).splitlines() if line.strip()]
                return [[p[0].strip("'"), re.sub(r"\s", "", p[1])] for p in pairs if len(p) == 2]
    return []


def read_nexus_characters(spark: SparkSession, path: str, alphabet: str | dict[str, int] = "dna") -> DataFrame:
    rows = _lines(nexus_rows, "label string, sequence string", ["label", "sequence"], _whole(spark, path))
    return rows.select("label", encode(F.col("sequence"), _alphabet(alphabet)).alias("states"))


def read_alphabet(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, mask): lines of a character and its states, below 24 each."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.get(words, F.lit(0)).alias("symbol"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("states"))
    bit = F.transform("states", lambda s: F.call_function("shiftleft", F.lit(1), s.cast("int")))
    return rows.where(F.forall("states", lambda s: s.cast("int").between(0, 23))).select("symbol", F.aggregate(bit, F.lit(0), lambda a, b: a.bitwiseOR(b)).alias("mask"))


def alphabet_map(rows: DataFrame) -> dict[str, int]:
    """The table as a map, on the driver: an alphabet has a few dozen symbols."""
    return {r["symbol"].upper(): r["mask"] for r in rows.select(F.upper("symbol").alias("symbol"), "mask").distinct().collect()}


def read_distances(spark: SparkSession, path: str, labels: bool = True) -> DataFrame:
    """(matrix_id, i, j, d) of upper triangular matrices: row k holds the distances to later rows."""

    def rows(text: str) -> list[list]:
        lines = [line.split() for line in text.splitlines() if line.strip()]
        names = [line[0] for line in lines] if labels else [str(k + 1) for k in range(len(lines))]
        values = [line[1:] if labels else line for line in lines]
        if not labels:
            names += [str(len(lines) + 1)] if values and len(values[-1]) == 1 else []
        return [[names[k], names[k + 1 + m], float(v)] for k, row in enumerate(values) for m, v in enumerate(row) if k + 1 + m < len(names)]

    files = spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("matrix_id"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([[m, *r] for m, text in zip(batch["matrix_id"], batch["value"], strict=True) for r in rows(text)], columns=["matrix_id", "i", "j", "d"])

    return files.mapInPandas(run, "matrix_id long, i string, j string, d double")


def matrix_text(dist: DataFrame) -> DataFrame:
    """(matrix_id, line_number, line): the triangular text, a row per taxon."""
    taxa = dist.select("matrix_id", F.explode(F.array("i", "j")).alias("i")).distinct()
    both = dist.select("matrix_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d")
    row = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", "d"))), lambda e: F.format_number(e["d"], 6)), " ")
    lines = taxa.join(both.groupBy("matrix_id", "i").agg(row.alias("row")), ["matrix_id", "i"], "left")
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("matrix_id").orderBy("i"))
    return lines.select("matrix_id", k.alias("line_number"), F.trim(F.concat_ws(" ", F.col("i").cast("string"), "row")).alias("line"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(label, taxonomy): lines of ``taxonomy | name, name, ...``."""
    p = F.split("value", r"\|", 2)
    rows = spark.read.text(path).where(F.contains(F.col("value"), F.lit("|")))
    return rows.select(F.trim(p[0]).alias("taxonomy"), F.explode(F.split(p[1], ",")).alias("label")).select(F.trim("label").alias("label"), "taxonomy").where("label <> ''")


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(taxon, gene): one taxon for each white-space separated list of genes."""
    lines = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"[\s|]+")).alias("genes")).where("genes <> ''")
    return numbered(lines, "taxon").select("taxon", F.explode(F.split("genes", ",")).alias("gene")).where("gene <> ''")


def read_pair_file(spark: SparkSession, path: str) -> DataFrame:
    """Records 1 and 2, 3 and 4, ... of a FASTA file as pairs."""
    from cladeframe.operators.sequences import consecutive_pairs

    rows = read_fasta(spark, path).withColumn("k", F.col("record") - 1)
    return consecutive_pairs(rows.select("k", "seq_id", "taxonomy", "sequence"), "k")


def read_sequence_table(spark: SparkSession, source: str | dict, min_length: int = 0, only_leads: bool = False) -> DataFrame:
    """(seq_id, sequence, cluster) of a Parquet path or JDBC options with columns accno, sequence, cluster."""
    rows = spark.read.parquet(source) if isinstance(source, str) else spark.read.format("jdbc").options(**source).load()
    rows = rows.where(F.length("sequence") > min_length)
    rows = rows.where("cluster IS NULL OR cluster IN ('lead', 'empty')") if only_leads else rows
    return rows.select(F.col("accno").alias("seq_id"), "sequence", "cluster")


def write_clusters(clusters: DataFrame, path: str) -> None:
    """(accno, cluster): a member's lead, or ``lead`` for the leads themselves."""
    clusters.select(F.col("member").alias("accno"), F.when(F.col("member") == F.col("lead"), "lead").otherwise(F.col("lead").cast("string")).alias("cluster")).write.parquet(path)


def write_alignment_groups(groups: DataFrame, gene: str, path: str) -> None:
    """(gene, taxon, alignable)."""
    groups.select(F.lit(gene).alias("gene"), "taxon", (F.col("kind") == "A").alias("alignable")).write.parquet(path)
