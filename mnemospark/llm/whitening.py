"""Embedding whitening by cyclic Jacobi rotations of an exact covariance.

An entry c, as double, becomes the integer x = floor(1024 c) + 100000. One pass over the vectors sums x for each dimension,
a second one sums the products of x less its rounded mean, both in integers, and what rounding the mean
left is taken off in integers as well. So the covariance is the double next to the true value, whatever the order of rows, files or
tasks. Partial sums are added by Spark, cell by cell; the driver gets only the sums, whose number depends on
the dimension alone.

The driver turns the symmetric covariance by Jacobi's rotations, all disjoint pairs of a round at once, sweep by
sweep, until no entry off the diagonal is above the rounding of the geometric mean of its two diagonal entries. That
rule, and not a bound against the largest entry, keeps the relative accuracy of small eigenvalues. Eigenvectors are
sorted by falling eigenvalue, divided by its root and sent to the tasks. A third pass measures the covariance of what comes out.

A vector that is null, or holds a null or an entry that isn't finite, is dropped, and so is one with an entry of 2^52 and more, whose x comes near the end
of a long. Vectors must have one length: if lengths differ, the length of most vectors counts (of
equally many the greatest) and others are dropped; empty vectors have no components. Equal vectors and repeated ids are
rows like others. A component without variance (one vector, equal vectors, fewer vectors than components) has a
null ``whitened`` and explains 0; identity_error leaves it out. No vectors at all give no rows. Equal eigenvalues: the
rotations' order decides, the same for every row. Columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.llm.common import cut_lineage, one_thread

SCALE, SHIFT, LARGEST = 1024.0, 100_000, 2.0**52
#: Rows of an Arrow batch that are worked on at once.
ROWS = 2048
EXACT = T.DecimalType(38, 0)
EPS = float(np.finfo(np.float64).eps)


def integers(column: pa.ListArray, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for each length, or for ``size`` only: the places of the usable vectors, and their integers as a matrix."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    with np.errstate(invalid="ignore", over="ignore"):
        usable = np.isfinite(flat) & (np.abs(flat) < LARGEST)
    wrong = np.concatenate([[0], np.cumsum(~usable)])
    fine = (lengths > 0) & (wrong[begins[1:]] == wrong[begins[:-1]])
    for d in [size] if size else np.unique(lengths[fine]).tolist():
        rows = np.flatnonzero(fine & (lengths == d))
        if len(rows):
            yield rows, np.floor(SCALE * flat[begins[rows][:, None] + np.arange(d)]).astype(np.int64) + SHIFT


def parts(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, rows, x) of all batches in parts of ``ROWS`` rows; the vectors are the last column."""
    one_thread()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            for rows, x in integers(part.column(part.num_columns - 1), size):
                yield part, rows, x


def products(y: np.ndarray) -> np.ndarray:
    """y'y of integers, exactly, as Python integers."""
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < 1 << 53:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def column_sums(x: np.ndarray) -> np.ndarray:
    return (x if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else x.astype(object)).sum(axis=0).astype(object)


def sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """(dimension, n, the sums of x) of the vectors of the commonest length; dimension 0 if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for _, rows, x in parts(batches):
            own = found.setdefault(x.shape[1], [0, 0])
            own[0] += len(rows)
            own[1] = own[1] + column_sums(x)
        for d, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), decimals(s)], names=["size", "dim", "n", "s"])

    partial = vectors.mapInArrow(run, T.StructType([T.StructField("size", T.IntegerType()), T.StructField("dim", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", EXACT)]))
    totals = cut_lineage(partial.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    most = totals.where("dim = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return 0, 0, []
    rows = totals.where(F.col("size") == most["size"]).orderBy("dim").collect()
    return most["size"], most["n"], [int(r["s"]) for r in rows]


def decimals(values) -> pa.Array:
    """Whole numbers as decimal(38, 0); null where one has more digits."""
    values = np.asarray(values)
    if values.dtype == np.int64:
        return pa.array(values).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(int(v)) if abs(v) < 10**38 else None for v in values], pa.decimal128(38, 0))


def covariance(vectors: DataFrame, d: int, n: int, s: list[int]) -> np.ndarray:
    """The covariance of x (divisor n): each entry the double next to its true value."""
    mean = [(2 * v + n) // (2 * n) for v in s]
    shift = np.array(mean, np.int64)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, _, x in parts(batches, d):
            got = products(x - shift)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), decimals(total[upper])], names=["cell", "v"])

    partial = vectors.mapInArrow(run, T.StructType([T.StructField("cell", T.LongType()), T.StructField("v", EXACT)]))
    cells = {r["cell"]: r["v"] for r in partial.groupBy("cell").agg(F.sum("v").alias("v")).collect()}
    rest = [v - n * m for v, m in zip(s, mean)]
    out = np.zeros((d, d))
    for k, (i, j) in enumerate(zip(upper[0].tolist(), upper[1].tolist())):
        if cells[k] is None:
            raise OverflowError("a sum of products has more than 38 digits")
        out[i, j] = out[j, i] = (n * int(cells[k]) - rest[i] * rest[j]) / (n * n)
    return out


def jacobi(matrix: np.ndarray, sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix without negative eigenvalues."""
    d = len(matrix)
    a, q = matrix.astype(np.float64).copy(), np.eye(d)
    ring = list(range(d + d % 2))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(min(x, y), max(x, y)) for x, y in zip(ring[:half], reversed(ring[half:])) if max(x, y) < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            i, j = np.array(pairs, int).reshape(-1, 2).T
            off = a[i, j]
            far = np.abs(off) > EPS * np.sqrt(np.abs(a[i, i] * a[j, j]))
            if not far.any():
                continue
            turned = True
            i, j, off = i[far], j[far], off[far]
            with np.errstate(over="ignore"):
                theta = (a[j, j] - a[i, i]) / (2 * off)
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            sine = t * c
            for m in (a, q):
                left, right = m[:, i].copy(), m[:, j].copy()
                m[:, i], m[:, j] = c * left - sine * right, sine * left + c * right
            top, low = a[i].copy(), a[j].copy()
            a[i], a[j] = c[:, None] * top - sine[:, None] * low, sine[:, None] * top + c[:, None] * low
            a[i, j] = a[j, i] = 0.0
        if not turned:
            break
    values = np.maximum(np.diag(a), 0.0)
    order = np.argsort(-values, kind="stable")
    q = q[:, order]
    return values[order], q / np.linalg.norm(q, axis=0)


def centred(x: np.ndarray, n: int, mean: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """n x - S as integers: int64 where all fit, else Python's."""
    y = x - mean
    if (int(np.abs(y).max(initial=0)) + 1) * n < 1 << 62:
        return y * n - rest.astype(np.int64)
    return y.astype(object) * n - rest


def projected(y: np.ndarray, n: int, turn: np.ndarray) -> np.ndarray:
    """The whitened values of n x - S. Not a BLAS product, whose last bit depends on a row's place in the block."""
    return np.einsum("ij,jk->ik", y.astype(np.float64) / n, turn)


def identity_error(vectors: DataFrame, d: int, n: int, mean: np.ndarray, rest: np.ndarray, turn: np.ndarray) -> float:
    """The largest absolute entry of the covariance of the whitened values, less the identity, over all rows."""
    k = turn.shape[1]
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, seen = np.zeros(k), np.zeros((k, k)), False
        for _, _, x in parts(batches, d):
            w = projected(centred(x, n, mean, rest), n, turn)
            first, second, seen = first + w.sum(axis=0), second + w.T @ w, True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.concatenate([second.ravel(), first]))], names=["cell", "v"])

    partial = vectors.mapInArrow(run, "cell long, v double")
    cells = {r["cell"]: r["v"] for r in partial.groupBy("cell").agg(F.sum("v").alias("v")).collect()}
    flat = np.array([cells[c] for c in range(k * k + k)]) / n
    # the values are centred already; what rounding left of their mean is taken off
    return float(np.abs(flat[: k * k].reshape(k, k) - np.outer(flat[k * k :], flat[k * k :]) - np.eye(k)).max())


def whiten(df: DataFrame, vector: str, keep: list[str], components: int = 8) -> DataFrame:
    """A row for each usable vector and component (from 1): ``keep``, component, n, deviation, whitened, explained, identity_error.

    deviation is the exact sum over dimensions of (n x - S)^2, as decimal(38, 0) (null if it has more digits). ``df`` is read
    four times and must give the same rows each time, as a table scan does.
    """
    made = {"component", "n", "deviation", "whitened", "explained", "identity_error"}
    keep = [c for c in keep if c.lower() not in made]
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", EXACT), *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    only = df.select(F.col(f"`{vector}`").alias("v"))
    d, n, s = sums(only)
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    matrix = covariance(only, d, n, s)
    values, turn = jacobi(matrix)
    k = min(components, d)
    shares = [float(v / np.trace(matrix)) if values[0] > 0 else 0.0 for v in values[:k]]
    varied = values[:k] > d * EPS * values[0]
    whole = [(2 * v + n) // (2 * n) for v in s]
    mean, rest = np.array(whole, np.int64), np.array([v - n * m for v, m in zip(s, whole)], object)
    turn = np.where(varied, turn[:, :k] / np.sqrt(np.where(varied, values[:k], 1.0)), 0.0)
    error = identity_error(only, d, n, mean, rest, turn[:, varied])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, x in parts(batches, d):
            y = centred(x, n, mean, rest)
            w = projected(y, n, turn)
            top = int(np.abs(y).max(initial=0))
            z = y if top * top * d < 1 << 62 else y.astype(object)
            deviation = decimals((z * z).sum(axis=1))
            at = np.repeat(np.arange(len(rows)), k)
            own = [part.column(c).take(pa.array(rows[at])) for c in range(len(keep))]
            which = np.tile(np.arange(k), len(rows))
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array((which + 1).astype(np.int32)), pa.array(np.full(len(at), n)), deviation.take(pa.array(at)), pa.array(w.ravel(), mask=~varied[which]), pa.array(np.array(shares)[which]), pa.array(np.full(len(at), error))],
                names=schema.names,
            )

    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{vector}`").alias("_vector")).mapInArrow(run, schema)
