"""Near-duplicate vectors by dual traversal of cover trees; exact threshold links.

Vectors count as points on the unit sphere, where cosine >= c means a distance of
at most sqrt(2 - 2c).  Equal vectors of a label are one class with a count, so a
vector that fills a third of the table is one point.

1. Cells.  A label with more classes than a block holds gets pivots (chosen by a
   hash, ``PIVOTS`` in all, so their broadcast is bounded); each class joins its
   nearest pivot's cell, and a cell's covering radius is the largest such distance.
   Two cells whose pivots are further apart than both radii and the threshold hold
   no link.  A cell of many classes is dealt into blocks of about ``BLOCK`` classes.
2. Each pair of blocks that is left is one unit of work: a cover tree per block,
   whose levels are nested nets with halving radii, and a traversal of both trees
   that drops a pair of nodes once the distance of their centres exceeds the
   threshold and both covering radii.  Pairs of leaves are decided by the cosine in
   double precision.
3. A unit returns one row per class with a link: the number of vectors linked and
   one edge of the unit's union-find forest.  Sums and components follow in Spark.

In data without clusters (random directions in many dimensions) no bound can prune
much, and the number of block pairs of a label grows with the square of its size:
that is the price of exact links.

Defined cases: rows whose label is null, or whose vector is null, empty, zero, or
has null or non-finite components, link with nothing; vectors of different lengths
aren't compared.  Rows that repeat a vec_id count each and share a component.
Labels are whole numbers; a label column of another type raises an error.  Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cladeframe.llm.common import cut, runs_of
from cladeframe.operators.components import connected_components

BLOCK, PIVOTS = 2048, 1024
_LEAF, _WIDE, _CHUNK = 4, 4096, 100_000


class CoverTree:
    """Nested nets over unit vectors; ``radius`` covers all points below a node."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.points: list[np.ndarray] = []
        everyone = np.arange(len(x))
        d = self._far(0, everyone)
        self._node(0, everyone, d)
        todo = [(0, everyone, d, float(d.max()) if len(d) else 0.0)]
        while todo:
            node, members, d, reach = todo.pop()
            if len(members) <= _LEAF or self.radius[node] == 0.0:
                continue
            step = reach / 2
            inside = d <= step
            parts = [(self.centre[node], members[inside], d[inside])]
            rest = members[~inside]
            while len(rest):
                far = self._far(rest[0], rest)
                near = far <= step
                near[0] = True
                parts.append((int(rest[0]), rest[near], far[near]))
                rest = rest[~near]
            if len(parts) == 1:
                todo.append((node, members, d, step))
                continue
            for c, m, f in parts:
                child = self._node(c, m, f)
                self.children[node].append(child)
                todo.append((child, m, f, step))
            self.points[node] = everyone[:0]

    def _far(self, i: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (self.x[members] @ self.x[i])))

    def _node(self, centre: int, members: np.ndarray, d: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(float(d.max()) if len(d) else 0.0)
        self.children.append([])
        self.points.append(members)
        return len(self.centre) - 1

    def top(self) -> list[int]:
        """Nodes that cover everything: the levels down to the first wide one."""
        level = [0]
        while len(level) < _WIDE // 8 and any(self.children[n] for n in level):
            level = [c for n in level for c in (self.children[n] or [n])]
        return level


def dual_pairs(a: CoverTree, b: CoverTree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Point pairs (of a, of b) with at least this cosine, in chunks; for one tree with itself both orders and i = i too."""
    limit = float(np.sqrt(2 - 2 * cosine)) + 1e-7
    ca, cb = np.array(a.centre), np.array(b.centre)
    ra, rb = np.array(a.radius), np.array(b.radius)
    na, nb = np.array(a.top()), np.array(b.top())
    stack: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(0, len(na), 512):
        part = na[k : k + 512]
        d2 = 2 - 2 * (a.x[ca[part]] @ b.x[cb[nb]].T)
        i, j = np.nonzero(d2 <= (limit + ra[part][:, None] + rb[nb][None, :]) ** 2)
        stack.append((part[i], nb[j]))
    leaf_a, leaf_b = np.array([not c for c in a.children]), np.array([not c for c in b.children])
    while stack:
        i, j = stack.pop()
        if len(i) > _CHUNK:
            stack += [(i[k : k + _CHUNK], j[k : k + _CHUNK]) for k in range(0, len(i), _CHUNK)]
            continue
        d2 = 2 - 2 * np.einsum("ij,ij->i", a.x[ca[i]], b.x[cb[j]])
        near = d2 <= (limit + ra[i] + rb[j]) ** 2
        i, j = i[near], j[near]
        done = leaf_a[i] & leaf_b[j]
        if done.any():
            p, q = _spread([a.points[n] for n in i[done]], [b.points[n] for n in j[done]])
            ok = np.einsum("ij,ij->i", a.x[p], b.x[q]) >= cosine
            yield p[ok], q[ok]
        i, j = i[~done], j[~done]
        left = ~leaf_a[i] & (leaf_b[j] | (ra[i] >= rb[j]))
        if left.any():
            kids = [a.children[n] for n in i[left]]
            stack.append((np.array([c for k in kids for c in k]), np.repeat(j[left], [len(k) for k in kids])))
        if (~left).any():
            kids = [b.children[n] for n in j[~left]]
            stack.append((np.repeat(i[~left], [len(k) for k in kids]), np.array([c for k in kids for c in k])))


def _spread(ps: list[np.ndarray], qs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of each two leaves' points (a leaf that isn't a point holds few or equal ones)."""
    return np.concatenate([np.repeat(p, len(q)) for p, q in zip(ps, qs, strict=True)]), np.concatenate([np.tile(q, len(p)) for p, q in zip(ps, qs, strict=True)])


def _units(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    for run in runs_of(batches, "unit"):
        cid, n, side = (np.array(run[c], np.int64) for c in ("cid", "n", "side"))
        x = np.array([np.frombuffer(v) for v in run["x"]])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right):
            continue
        a = CoverTree(x[left])
        b = a if side[0] == 2 else CoverTree(x[right])
        links = np.zeros(len(cid), np.int64)
        parent = np.arange(len(cid))
        for p, q in dual_pairs(a, b, cosine):
            p, q = left[p], right[q]
            p, q = p[p != q], q[p != q]
            np.add.at(links, p, n[q])
            if b is not a:
                np.add.at(links, q, n[p])
            _join(parent, p, q)
        some = np.flatnonzero(links)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(links[some]), pa.array(cid[_flat(parent)[some]])], ["cid", "links", "root"])


def _flat(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _join(parent: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Union by smallest position, in place, for many pairs at once."""
    while len(p):
        parent[:] = _flat(parent)
        a, b = parent[p], parent[q]
        apart = a != b
        if not apart.any():
            return
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _cells(batches: Iterator[pa.RecordBatch], pivots: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vecs = batch.column("embedding").to_pylist()
        keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
        cell, dist, out = np.zeros(len(vecs), np.int32), np.full(len(vecs), 2.0), []
        for i, (v, key) in enumerate(zip(vecs, keys, strict=True)):
            x = np.array(v, np.float64)
            x = x / np.abs(x).max()
            x /= np.sqrt(x @ x)
            out.append(x.tobytes())
            if (p := pivots.get(key)) is not None:
                d = np.sqrt(np.maximum(0.0, 2 - 2 * (p @ x)))
                cell[i] = d.argmin()
                dist[i] = d[cell[i]]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("cid", "n", "label", "dim")] + [pa.array(cell), pa.array(dist), pa.array(out, pa.binary())], ["cid", "n", "label", "dim", "cell", "dist", "x"])


def _pivots(classes: DataFrame, block: int, most: int) -> dict:
    """(label, dim) -> unit pivots, for the labels of more than one block; ``most`` in all."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("size"))
    large = sizes.where(F.col("size") > block).orderBy(F.desc("size"), "label", "dim").limit(most).collect()
    total = sum(r["size"] for r in large)
    wanted = [(r["label"], r["dim"], r["size"], min(-(-r["size"] // block), max(1, most * r["size"] // total))) for r in large]
    if not wanted:
        return {}
    spark = classes.sparkSession
    want = spark.createDataFrame(wanted, "label long, dim int, size long, k int")
    # the rows of smallest hash: about twice as many as wanted pass the cut, so no window holds a whole label
    place = F.pmod(F.xxhash64("cid"), F.lit(1 << 40))
    rank = F.row_number().over(Window.partitionBy("label", "dim").orderBy("place", "cid"))
    few = classes.join(F.broadcast(want), ["label", "dim"]).withColumn("place", place).where(F.col("place") < (2 * F.col("k") + 64) / F.col("size") * float(1 << 40))
    rows = few.withColumn("r", rank).where("r <= k").select("label", "dim", "embedding").collect()
    out: dict = {}
    for r in rows:
        x = np.array(r["embedding"], np.float64)
        x = x / np.abs(x).max()
        out.setdefault((r["label"], r["dim"]), []).append(x / np.sqrt(x @ x))
    return {k: np.array(v) for k, v in out.items()}


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    if not isinstance(vectors.schema[label_col].dataType, T.IntegralType):
        raise ValueError(f"labels have to be whole numbers, {label_col} is {vectors.schema[label_col].dataType.simpleString()}")
    v = F.col("embedding")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("embedding"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    good = F.coalesce(F.col("label").isNotNull() & v.isNotNull() & fine, F.lit(False))
    base = base.withColumn("cid", F.when(good, F.xxhash64("label", "embedding")))
    classes = base.where("cid IS NOT NULL").groupBy("cid", "label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("rep")).withColumn("dim", F.size("embedding"))
    classes = cut(classes, "vectors")
    chosen = _pivots(classes, block, pivots)
    cells = cut(classes.select("cid", "n", "label", "dim", "embedding").mapInArrow(partial(_cells, pivots=chosen), "cid long, n long, label long, dim int, cell int, dist double, x binary"), "cells")
    stats = cells.groupBy("label", "dim", "cell").agg(F.count("*").alias("size"), F.max("dist").alias("r")).withColumn("nb", F.ceil(F.col("size") / block).cast("int"))
    here = stats.select("label", "dim", "cell", F.col("nb").alias("own"), F.col("cell").alias("other"), F.col("nb").alias("nb"))
    if chosen:
        here = here.unionByName(_near_cells(stats, chosen, cosine))
    rows = cells.join(here, ["label", "dim", "cell"])
    rows = rows.withColumn("i", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("own")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    me, you = F.struct("cell", "i"), F.struct(F.col("other").alias("cell"), F.col("j").alias("i"))
    side = F.when(me == you, 2).when(me < you, 0).otherwise(1)
    unit = F.concat_ws("/", "label", "dim", F.least(me, you).cast("string"), F.greatest(me, you).cast("string"))
    units = rows.select(unit.alias("unit"), side.alias("side"), "cid", "n", "x")
    found = cut(units.repartition("unit").sortWithinPartitions("unit").mapInArrow(partial(_units, cosine=cosine), "cid long, links long, root long"), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = connected_components(found, "cid", "root").withColumnRenamed("id", "cid")
    by_class = classes.select("cid", "n", "rep").join(links, "cid", "left").join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = by_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = by_class.join(least, "component").select("cid", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = base.select("vec_id", "cid").join(by_class, "cid", "left")
    comp_id = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.col("vec_id").eqNullSafe(comp_id).alias("kept"))


def _near_cells(stats: DataFrame, chosen: dict, cosine: float) -> DataFrame:
    """Ordered pairs of different cells that covering radii don't keep apart.

    Only pivots' cells, at most ``pivots`` in all: each row finds its partners among them.
    """
    names = stats.sparkSession.createDataFrame([(a, b) for a, b in chosen], "label long, dim int")
    mine = cut(stats.join(F.broadcast(names), ["label", "dim"]), "cells-of-pivots")
    held: dict = {}
    for r in mine.collect():
        held.setdefault((r["label"], r["dim"]), []).append((r["cell"], r["r"], r["nb"]))
    held = {k: (np.array([c for c, _, _ in v]), np.array([x for _, x, _ in v]), np.array([n for _, _, n in v])) for k, v in held.items()}
    limit = float(np.sqrt(2 - 2 * cosine)) + 1e-7

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, dim, cell, r, nb in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "cell", "r", "nb")), strict=True):
                p, (cells, radii, blocks) = chosen[label, dim], held[label, dim]
                d = np.sqrt(np.maximum(0.0, 2 - 2 * (p[cells] @ p[cell])))
                at = np.flatnonzero((cells != cell) & (d <= radii + r + limit))
                columns = [[label] * len(at), [dim] * len(at), [cell] * len(at), [nb] * len(at), cells[at], blocks[at]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), *[pa.int32()] * 5), strict=True)], ["label", "dim", "cell", "own", "other", "nb"])

    return mine.select("label", "dim", "cell", "r", "nb").mapInArrow(near, "label long, dim int, cell int, own int, other int, nb int")
