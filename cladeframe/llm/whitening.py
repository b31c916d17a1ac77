"""Whitening of embeddings by shifted CholeskyQR.

Entries become integers x; the fit list holds each distinct x vector once.  Its n rows,
centred, are the tall matrix A.  V = A'A / n is never decomposed itself, as that would
square A's condition number.  Instead

1. a pass over the rows sums the Gram matrix A'A; a small shift on its diagonal
   makes its Cholesky factor R1 exist whatever the rank;
2. further passes map each row to its row of Q = A R1^-1 ... by triangular solves and
   sum Q'Q, whose Cholesky factor makes Q closer to orthonormal, until it is;
3. the factors compose to R with A = Q R.  The singular values of R (d x d) are those
   of A: e = s**2 / n, and its right singular vectors are the components.

Centred rows are (n * x - S) / n with n * x - S in whole numbers, so nothing is lost to
the size of x.  Sums of tasks are added in a tree of tasks; only one d x d matrix comes back.

Defined cases: a vector that is null or holds null, infinite or not-a-number entries is
left out, as are vectors of another length than the commonest one (the longer one of two
that are equally common).  Entries beyond 2**53 / 64 count as that much.  A component
without variance (s at most 4 d times the machine's rounding, relative to the largest) has
null as whitened; explained is 0 for it, or null if no component has variance.
identity_error is over the components that have variance, null if none has.  A deviation
beyond 64 bits is null.  Each row gets its rows, repeated and null vec_ids too.  An empty
table gives none.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import cut

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Rows that a task handles at once.
CHUNK = 4096
#: Sums that one task adds up.
FAN_IN = 32
#: Passes at most that make Q orthonormal, and how far its Gram matrix may be from the identity.
PASSES, NEAR = 8, 1e-11
EPS = np.finfo(np.float64).eps
LARGEST = float(1 << 53)


def integer_rows(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and x of each usable vector."""
    entries = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), entries.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    scaled = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))) + OFFSET)
    return rows.select("vec_id", scaled.alias("x"))


def _chunks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for k in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(k, CHUNK)
            yield batch, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def off_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: 64-bit integers where they do, else Python's."""
    if n * max(int(x.max(initial=0)), -int(x.min(initial=0))) < 1 << 61 and max(map(abs, sums)) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (off_mean(x, n, sums) / n).astype(np.float64)


def solve(a: np.ndarray, r: np.ndarray, block: int = 32) -> np.ndarray:
    """Q with Q R = A for an upper triangular R, block of columns by block."""
    q = np.array(a, np.float64, order="F")
    for i in range(0, len(r), block):
        end = min(i + block, len(r))
        if i:
            q[:, i:end] -= q[:, :i] @ r[:i, i:end]
        for j in range(i, end):
            if j > i:
                q[:, j] -= q[:, i:j] @ r[i:j, j]
            q[:, j] /= r[j, j]
    return q


def _row(values: np.ndarray | list[int]) -> pa.RecordBatch:
    """One row of a task's sums: doubles as they are, whole numbers of any size in halves of 32 bits."""
    if isinstance(values, list):
        values = np.array([[v >> 32, v & 0xFFFFFFFF] for v in values], np.int64).reshape(-1)
    return pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], ["sums"])


def _whole(raw: bytes) -> list[int]:
    return [(a << 32) + b for a, b in np.frombuffer(raw, np.int64).reshape(-1, 2).tolist()]


def _totals(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """n and the sums of all dimensions."""
    total = [0] * (d + 1)
    for _, x in _chunks(batches, d):
        high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
        total = [total[0] + len(x), *(t + (a << 32) + b for t, a, b in zip(total[1:], high, low, strict=True))]
    if total[0]:
        yield _row(total)


def _gram(batches: Iterator[pa.RecordBatch], d: int, n: int, sums: list[int], live: np.ndarray, factors: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Q'Q of the rows after the triangular solves so far."""
    total = np.zeros((len(live), len(live)))
    for _, x in _chunks(batches, d):
        q = _centred(x, n, sums)[:, live]
        for r in factors:
            q = solve(q, r)
        total += q.T @ q
    yield _row(total)


def _moments(batches: Iterator[pa.RecordBatch], d: int, n: int, sums: list[int], to: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums and sums of products of the whitened rows."""
    total = np.zeros((to.shape[1] + 1, to.shape[1]))
    for _, x in _chunks(batches, d):
        w = _centred(x, n, sums) @ to
        total += np.vstack([w.sum(axis=0), w.T @ w])
    yield _row(total)


def _add(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch.column("sums"):
            part = _whole(raw.as_py()) if whole else np.frombuffer(raw.as_py())
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)] if whole else total + part
    if total is not None:
        yield _row(total)


def tree_sum(rows: DataFrame, of: Callable, whole: bool = False) -> list[int] | np.ndarray | None:
    """Every task's sums added up in Spark, FAN_IN at a time; the one row that is left."""
    parts, tasks = rows.mapInArrow(of, "sums binary"), rows.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("to", F.spark_partition_id() % tasks).repartition(tasks, "to").select("sums").mapInArrow(partial(_add, whole=whole), "sums binary")
    left = [r.sums for r in parts.collect()]
    if not left:
        return None
    return [sum(v) for v in zip(*map(_whole, left), strict=True)] if whole else np.sum([np.frombuffer(x) for x in left], axis=0)


def cholesky(g: np.ndarray, shift: bool) -> np.ndarray:
    """The upper factor of a Gram matrix, with the shift that rounding asks for, or first without one."""
    d = len(g)
    s = 11 * (CHUNK * d + d * (d + 1)) * EPS / 2 * np.linalg.norm(g)
    step = s if shift else 0.0
    while True:
        try:
            return np.linalg.cholesky(g + step * np.eye(d)).T
        except np.linalg.LinAlgError:
            step = 100 * step or s


@dataclass(frozen=True)
class Whitening:
    """n, sums, components (columns), eigenvalues by falling size, and the trace of V."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def projection(self) -> np.ndarray:
        """What centred rows are multiplied by; zero for components without variance."""
        live = self.eigenvalues > 0
        return self.components * np.where(live, 1 / np.sqrt(np.where(live, self.eigenvalues, 1)), 0)


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of a table of distinct ``x`` (written, as it is read again and again); None if it is empty."""
    d = x.select(F.size("x")).first()
    if d is None or not d[0]:
        return None
    d = d[0]
    n, *sums = tree_sum(x, partial(_totals, d=d), whole=True)
    live = np.arange(d)
    g = tree_sum(x, partial(_gram, d=d, n=n, sums=sums, live=live, factors=[])).reshape(d, d)
    live = np.flatnonzero(np.diag(g) > 0)
    k = min(components, d)
    if not len(live):
        return Whitening(n, sums, np.zeros((d, k)), np.zeros(k), 0.0)
    g = g[np.ix_(live, live)]
    factors, far = [], np.inf
    for _ in range(PASSES):
        factors.append(cholesky(g, shift=not factors))
        g = tree_sum(x, partial(_gram, d=d, n=n, sums=sums, live=live, factors=factors)).reshape(len(live), len(live))
        before, far = far, np.abs(g - np.eye(len(live))).max()
        if far <= NEAR or far > before / 2 and far < 1e-8:
            break
    # what Q still lacks: the symmetric root of its Gram matrix, which may be singular
    values, vectors = np.linalg.eigh(g)
    r = vectors * np.sqrt(np.maximum(values, 0)) @ vectors.T
    for factor in reversed(factors):
        r = r @ factor
    _, s, right = np.linalg.svd(r)
    s = np.where(s > 4 * d * EPS * s[0], s, 0)
    found = np.zeros((d, k))
    found[live, : min(k, len(live))] = right[:k].T
    e = np.zeros(k)
    e[: min(k, len(live))] = (s[:k] / np.sqrt(n)) ** 2
    fitted = Whitening(n, sums, found, e, float(((s / np.sqrt(n)) ** 2).sum()))
    m = tree_sum(x, partial(_moments, d=d, n=n, sums=sums, to=fitted.projection)).reshape(k + 1, k)
    covariance = m[1:] / n - np.outer(m[0] / n, m[0] / n)
    alive = np.flatnonzero(e > 0)
    return Whitening(n, sums, found, e, fitted.trace, float(np.abs(covariance - np.eye(k))[np.ix_(alive, alive)].max()))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - S)**2 of each row; None beyond 64 bits."""
    off = off_mean(x, n, sums)
    if off.dtype != object and (off.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
        return (off * off).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in off.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def _whitened(batches: Iterator[pa.RecordBatch], d: int, w: Whitening) -> Iterator[pa.RecordBatch]:
    k = len(w.eigenvalues)
    live, to = w.eigenvalues > 0, w.projection
    explained = pa.array(w.eigenvalues / w.trace) if w.trace else pa.nulls(k, pa.float64())
    for batch, x in _chunks(batches, d):
        rows = len(x)
        each, per = np.repeat(np.arange(rows), k), np.tile(np.arange(k), rows)
        columns = [batch.column("vec_id").take(pa.array(each)), pa.array(per + 1, pa.int32()), pa.array(np.full(rows * k, w.n))]
        columns += [pa.array(deviations(x, w.n, w.sums), pa.int64()).take(pa.array(each))]
        columns += [pa.array((_centred(x, w.n, w.sums) @ to).reshape(-1), mask=np.tile(~live, rows)), explained.take(pa.array(per))]
        columns += [pa.array([w.identity_error] * (rows * k), pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = integer_rows(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths.d if lengths else 0
    rows = rows.where(F.size("x") == d)
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(cut(rows.select("x").distinct(), "fit"), components) if d else None
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], kind)
    return rows.mapInArrow(partial(_whitened, d=d, w=fitted), kind)
