"""Trees as text: Newick and NEXUS, in and out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cladeframe.operators.components import _checkpoint
from cladeframe.schema import RAW, RAW_COLUMNS, per_tree
from cladeframe.sources.newick_scan import commands, read_texts, tokens, without_comments

PARSED = f"{RAW}, ann map<string,string>"


def annotation(comment: str) -> dict[str, str] | None:
    """[&k=v,k={a,b}] as a map; other comments are none."""
    if not comment.startswith("[&"):
        return None
    return {k.strip(): v for k, v in re.findall(r"([^=,\[\]&]+)=(\{[^}]*\}|[^,\]]*)", comment[2:-1])}


def read_tree(text: str) -> list[list] | None:
    """Rows (node_id, parent_id, child_ord, label, branch_length, ann) in preorder; None if brackets don't match.

    A root with one child and a name is a tip there: it gets a second child with its
    name and length.
    """
    rows: list[list] = [[1, None, 0, None, None, None]]
    kids = [0]
    path, at, length_next = [], 0, False

    def child(parent: int) -> int:
        rows.append([len(rows) + 1, rows[parent][0], kids[parent], None, None, None])
        kids[parent] += 1
        kids.append(0)
        return len(rows) - 1

    for token in tokens(text):
        if token == "(":
            path.append(at)
            at = child(at)
        elif token == ",":
            if not path:
                return None
            at = child(path[-1])
        elif token == ")":
            if not path:
                return None
            at = path.pop()
        elif token == ":":
            length_next = True
            continue
        elif token == ";":
            break
        elif token[0] == "[":
            if (found := annotation(token)) is not None:
                rows[at][5] = {**(rows[at][5] or {}), **found}
            continue
        elif length_next:
            try:
                rows[at][4] = float(token)
            except ValueError:
                return None
        else:
            name = token[1:-1].replace("''", "'") if token[0] == "'" else token[1:-1] if token[0] == '"' else token
            rows[at][3] = name if rows[at][3] is None else rows[at][3] + name
        length_next = False
    if path:
        return None
    if kids[0] == 1 and rows[0][3] is not None:
        k = child(0)
        rows[k][3], rows[k][4] = rows[0][3], rows[0][4]
        rows[0][3] = rows[0][4] = None
    return rows


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        known = batch["problem"] if "problem" in batch else [None] * len(batch)
        for tree, text, problem in zip(batch["tree_id"], batch["newick"], known, strict=True):
            rows = read_tree(text) if text and problem is None else None
            if rows and (len(rows) > 1 or rows[0][3] is not None):
                out += [[tree, *r, None] for r in rows]
            else:
                out.append([tree, None, None, None, None, None, None, problem or ("no tree can be made of it" if text and text.strip(" \t\r\n;") else "nothing there")])
        made = pd.DataFrame(out, columns=[*RAW_COLUMNS, "ann", "problem"])
        yield made.astype({"tree_id": "int64", "node_id": "Int32", "parent_id": "Int32", "child_ord": "Int32", "branch_length": "float64"})


def parse(trees: DataFrame, problems: bool = False) -> DataFrame:
    """Raw nodes (and ann) of (tree_id, newick).

    Texts that are no tree have no nodes; with ``problems`` they have one row without
    a node_id, whose ``problem`` says why.
    """
    columns = ["newick", *(["problem"] if "problem" in trees.columns else [])]
    rows = trees.select(F.col("tree_id").cast("long").alias("tree_id"), *columns).mapInPandas(_parse, f"{PARSED}, problem string")
    return rows if problems else rows.where("node_id IS NOT NULL").drop("problem")


def numbered(rows: DataFrame, name: str = "tree_id") -> DataFrame:
    """Rows numbered 1, 2, ... in the order they were read, without a sort: offsets by partition.

    The rows are checkpointed, as counting and numbering have to see the same partitions.
    """
    spark = rows.sparkSession
    part = _checkpoint(rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    counts = sorted((r["_part"], r["count"]) for r in part.groupBy("_part").count().collect())
    starts, n = [], 1
    for p, c in counts:
        starts.append((p, n))
        n += c
    offset = spark.createDataFrame(starts or [(0, 1)], "_part int, _start long")
    k = F.col("_start") + F.col("_row").bitwiseAND((1 << 33) - 1)
    return part.join(F.broadcast(offset), "_part").withColumn(name, k).drop("_part", "_row", "_start")


def read_newick(spark: SparkSession, path: str, problems: bool = False) -> DataFrame:
    """Raw nodes of the trees in text files, numbered in file order, whatever their names and comments hold.

    Each tree keeps its number where others are no trees; with ``problems`` those have a row that says why.
    """
    return parse(read_texts(spark, path), problems)


def format_of(head: Column) -> Column:
    """newick, nexus, fasta, phylip or unknown by the first characters of a text."""
    first = F.lower(F.regexp_extract(head, r"^\s*(\S{1,6})", 1))
    return F.when(first == "#nexus", "nexus").when(F.startswith(first, F.lit(">")), "fasta").when(F.startswith(first, F.lit("(")), "newick").when(F.rlike(first, F.lit("^[0-9]")), "phylip").otherwise("unknown")


def sniff_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, format) of each file, by its first line that isn't blank."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value").where(F.trim(F.translate("value", "\t\r", "  ")) != "")
    return lines.groupBy("path").agg(F.min_by("value", F.struct("block", "row")).alias("head")).select("path", format_of(F.col("head")).alias("format"))


def sniff(spark: SparkSession, path: str) -> str:
    """The format of one file, or of the first one of a folder."""
    found = sniff_files(spark, path).orderBy("path").first()
    return found["format"] if found else "unknown"


def nexus_commands(text: str, block: str) -> list[tuple[str, str]]:
    """(command, rest) of the blocks of that name in a NEXUS text, without comments; quotes keep their semicolons."""
    out, inside = [], False
    for part in commands(re.sub(r"\A\s*#nexus", "", text, flags=re.I)):
        words = without_comments(part).strip().split(None, 1)
        if not words:
            continue
        command, rest = words[0].lower(), words[1] if len(words) > 1 else ""
        if command == "begin":
            inside = rest.strip().lower() == block.lower()
        elif command in ("end", "endblock"):
            inside = False
        elif inside:
            out.append((command, rest))
    return out


def translate_table(rest: str) -> dict[str, str]:
    """key -> name of a TRANSLATE command."""
    out, words = {}, []
    for token in [*tokens(rest), ","]:
        if token == ",":
            if len(words) > 1:
                out[words[0]] = "".join(words[1:])
            words = []
        elif token[0] != "[":
            words.append(token[1:-1].replace("''", "'") if token[0] == "'" else token[1:-1] if token[0] == '"' else token)
    return out


def _nexus(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, text in zip(batch["path"], batch["value"], strict=True):
            names, k = {}, 0
            for command, rest in nexus_commands(text, "trees"):
                if command == "translate":
                    names = translate_table(rest)
                elif command in ("tree", "utree") and "=" in rest:
                    k += 1
                    title, tree = rest.split("=", 1)
                    rows = read_tree(tree + ";") or []
                    inner = {r[1] for r in rows}
                    for r in rows:
                        if r[0] not in inner:  # the table is of taxa; inner labels are no keys
                            r[3] = names.get(r[3], r[3])
                        out.append([path, k, title.strip(" *'"), *r])
        yield pd.DataFrame(out, columns=["path", "ordinal", "title", *RAW_COLUMNS[1:], "ann"]).astype({"node_id": "int32", "parent_id": "Int32", "child_ord": "int32", "branch_length": "float64", "ordinal": "int64"})


def read_nexus(spark: SparkSession, path: str) -> DataFrame:
    """Raw nodes (and ann, title) of the trees blocks; a file is read whole, files in parallel."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    rows = files.mapInPandas(_nexus, f"path string, ordinal long, title string, {RAW.split(', ', 1)[1]}, ann map<string,string>")
    return rows.withColumn("tree_id", F.xxhash64("path", "ordinal")).select(*RAW_COLUMNS, "ann", "title", "path", "ordinal")


def read_node_ages(spark: SparkSession, path: str, block: str = "calibration") -> tuple[DataFrame, DataFrame]:
    """(sets, ages) of each file's private block: mrca commands name sets of taxa (path, set_id, label), fixage gives a set's age (path, set_id, age)."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, text in zip(batch["path"], batch["value"], strict=True):
                sets: dict[str, list[str]] = {}
                for command, rest in nexus_commands(text, block):
                    if command in ("mrca", "taxset") and "=" in rest:
                        name, members = rest.split("=", 1)
                        sets[name.strip()] = [t for m in members.split() for t in sets.get(m, [m])]
                        out += [[file, name.strip(), t, None] for t in sets[name.strip()]]
                    elif command == "fixage":
                        got = dict(re.findall(r"(\w+)\s*=\s*(\S+)", rest))
                        out.append([file, got.get("taxon"), None, float(got["age"])])
            yield pd.DataFrame(out, columns=["path", "set_id", "label", "age"]).astype({"age": "float64"})

    rows = files.mapInPandas(run, "path string, set_id string, label string, age double")
    return rows.where("label IS NOT NULL").select("path", "set_id", "label"), rows.where("label IS NULL").select("path", "set_id", "age")


def _quoted(name: str | None) -> str:
    if not name:
        return ""
    return name if re.fullmatch(r"[^\s()\[\]{}/\\,;:=*'\"`+<>-]+", name) or re.fullmatch(r"-?[\d.]+(e-?\d+)?", name) else "'" + name.replace("'", "''") + "'"


def write_tree(rows: pd.DataFrame, lengths: bool = True, inner_labels: bool = True) -> str:
    """Newick of one tree's rows in preorder, lengths with six decimals."""
    depth, out = -1, []
    after: list[str] = []
    for d, label, length, tip in zip(rows["depth"], rows["label"], rows["branch_length"], rows["is_tip"], strict=True):
        while len(after) > d:
            out.append(after.pop())
        if out and out[-1] != "(":
            out.append(",")
        end = (_quoted(label) if tip or inner_labels else "") + (f":{length:.6f}" if lengths and length == length and length is not None else "")
        if tip:
            out.append(end)
            after.append("")
        else:
            out.append("(")
            after.append(")" + end)
        depth = d
    del depth
    while after:
        out.append(after.pop())
    return "".join(out) + ";"


def to_newick(nodes: DataFrame, lengths: bool = True, inner_labels: bool = True) -> DataFrame:
    """(tree_id, newick): one line of text per tree."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree_id": [rows["tree_id"].iloc[0]], "newick": [write_tree(rows, lengths, inner_labels)]})

    return per_tree(nodes.select("tree_id", "pre", "depth", "label", "branch_length", "is_tip"), run, "tree_id long, newick string")


def write_newick(nodes: DataFrame, path: str, **options) -> None:
    to_newick(nodes, **options).select("newick").write.text(path)


def to_nexus(nodes: DataFrame, **options) -> DataFrame:
    """(tree_id, nexus): a whole NEXUS text per tree, with taxa and translate commands; the tree has their numbers."""
    taxa = F.transform(F.sort_array(F.collect_list(F.when(F.col("is_tip"), F.struct("pre", "label")))), lambda x: x["label"])
    names = nodes.groupBy("tree_id").agg(taxa.alias("taxa"))
    number = F.row_number().over(Window.partitionBy("tree_id", "is_tip").orderBy("pre")).cast("string")
    t = to_newick(nodes.withColumn("label", F.when(F.col("is_tip"), number).otherwise(F.col("label"))), **options).join(names, "tree_id")
    quote = lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    table = F.array_join(F.transform("taxa", lambda x, i: F.concat((i + 1).cast("string"), F.lit(" "), quote(x))), ",\n")
    text = F.concat(F.lit("#NEXUS\nbegin taxa;\ndimensions ntax="), F.size("taxa").cast("string"), F.lit(";\ntaxlabels "), F.array_join(F.transform("taxa", quote), " "), F.lit(";\nend;\nbegin trees;\ntranslate\n"), table, F.lit(";\ntree tree_"), F.col("tree_id").cast("string"), F.lit(" = "), F.col("newick"), F.lit("\nend;\n"))
    return t.select("tree_id", text.alias("nexus"))


def to_svg(nodes: DataFrame, width: float = 0, height: float = 0, font: float = 12, stroke: float = 1) -> DataFrame:
    """(tree_id, svg): drawn trees; without sizes, a line of text per tip (100 at least) and the golden ratio."""
    size = nodes.groupBy("tree_id").agg(F.count_if("is_tip").alias("tips"), F.max("root_dist").alias("deep"), F.max("depth").alias("levels"))
    high = F.lit(float(height)) if height else F.greatest(F.col("tips") * float(font), F.lit(100.0))
    tips = nodes.where("is_tip").select("tree_id", "pre")
    rank = nodes.alias("a").join(tips.alias("x"), (F.col("a.tree_id") == F.col("x.tree_id")) & (F.col("x.pre") < F.col("a.pre")), "left").groupBy("a.tree_id", "a.node_id").agg(F.count("x.pre").alias("before"))
    n = nodes.join(rank, ["tree_id", "node_id"]).join(size, "tree_id").withColumn("high", high).withColumn("wide", F.lit(float(width)) if width else F.col("high") / 1.618)
    along = F.when(F.col("deep") > 0, F.col("root_dist") / F.col("deep")).otherwise((F.col("depth") + 1) / (F.col("levels") + 1))
    n = n.withColumn("x", F.round(along * F.col("wide"), 2)).withColumn("y", F.round((F.col("before") + F.col("n_tips") / 2) / F.col("tips") * F.col("high"), 2))
    up = n.select("tree_id", F.col("node_id").alias("parent_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    n = n.join(up, ["tree_id", "parent_id"], "left")
    path = F.when(F.col("px").isNotNull(), F.format_string(f'<path d="M%.2f %.2fV%.2fH%.2f" fill="none" stroke="black" stroke-width="{stroke}"/>', "px", "py", "y", "x")).otherwise("")
    safe = F.replace(F.replace(F.coalesce("label", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    name = F.when(F.col("is_tip"), F.format_string(f'<text x="%.2f" y="%.2f" font-size="{font}">%s</text>', F.col("x") + 2, F.col("y") + font / 3, safe)).otherwise("")
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", F.concat(path, name).alias("s")))), lambda e: e["s"]), "\n")
    drawn = n.groupBy("tree_id").agg(F.max("wide").alias("w"), F.max("high").alias("h"), parts.alias("body"))
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%.0f" height="%.0f">\n', F.col("w") * 1.5, F.col("h"))
    return drawn.select("tree_id", F.concat(head, "body", F.lit("\n</svg>")).alias("svg"))
