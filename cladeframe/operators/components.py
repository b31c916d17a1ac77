"""Connected components of a graph that is held as an edge table.

Each round hooks every vertex to the smallest vertex next to it (by a hash
order, so that chains stay short), jumps twice along those pointers and then
contracts the edges to the vertices that are left.  Only the edges shrink from
round to round; no component, link list or label ever comes to the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.schema import by_sorting


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the session's checkpoint folder.

    Where neither is set, a local session (as in tests) gets a folder of its own; on a
    cluster that is an error, as a machine's own folder is lost with the machine.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        import tempfile

        path = "file://" + tempfile.mkdtemp(prefix="cladeframe-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def _checkpoint(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _held(df: DataFrame) -> DataFrame:
    """A checkpoint of rows by tree, which joins sort: it keeps its plan's estimated size, and so loses the hint but not the need of it."""
    return by_sorting(_checkpoint(df))


def _written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back, for loops of any number of rounds.

    A checkpoint keeps its plan's estimated size, a product over all joins before it: carried
    from round to round that number grows until planning hangs. Files have a size of their own.
    """
    path = f"{shared_folder(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one partition of a shrinking edge table holds.
PARTITION_ROWS = 100_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): the smallest id that each vertex of ``edges`` can reach.

    Vertices without an edge are not returned.  Null ends and loops are left
    out, repeated edges count once.  Ids may be of any ordered, hashable type.
    """
    key = lambda c: F.struct(F.xxhash64(F.col(c)).alias("h"), F.col(c).alias("v"))
    live = (
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(key(src).alias("a"), key(dst).alias("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    live = _checkpoint(live)
    steps: list[DataFrame] = []
    while n := live.count():
        # as the table shrinks, so does the number of tasks and files
        fewer = lambda df: df.coalesce(-(-2 * n // PARTITION_ROWS))  # noqa: B023, E731
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("p"))
        hook = _checkpoint(fewer(hook))
        for _ in range(2):
            up = hook.select(F.col("x").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p").select("x", F.col("pp").alias("p"))
        hook = _checkpoint(fewer(hook))
        steps.append(hook)
        a = hook.select(F.col("x").alias("a"), F.col("p").alias("pa"))
        b = hook.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        live = (
            live.join(a, "a").join(b, "b").where(F.col("pa") != F.col("pb"))
            .select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct()
        )
        live = _checkpoint(fewer(live))
    if not steps:
        kind = edges.schema[src].dataType
        return edges.sparkSession.createDataFrame([], "id long").select(F.lit(None).cast(kind).alias("id"), F.lit(None).cast(kind).alias("component"))
    labels = steps[0]
    for hook in steps[1:]:
        up = hook.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        labels = labels.join(up, "p", "left").select("x", F.coalesce("pp", "p").alias("p"))
    labels = _checkpoint(labels)
    least = labels.groupBy("p").agg(F.min("x.v").alias("component"))
    return labels.join(least, "p").select(F.col("x.v").alias("id"), "component")
