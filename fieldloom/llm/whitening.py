"""Whitening of embeddings by cyclic Jacobi rotations.

Entries become integers, x = floor(scale * c) + shift, so counts and sums are exact. The fit list is each distinct x once: equal
vectors are met in a map-side aggregate before the shuffle, so a vector that a third of the rows share costs a row a
task. Sums per dimension give the centre; the centred scatter is added up by tasks with one matrix product a
batch, and their parts meet in two rounds, cut into stripes of rows, so no task receives the matrices of all tasks. The driver gets
one D x D matrix and rotates it until its off-diagonals vanish: each sweep is a tournament of D - 1 rounds of
disjoint rotations, done at once. A rotation is left out only when the entry is negligible against the square root of the product of
its two diagonal entries, which keeps small eigenvalues accurate. The eigenvectors, sorted by falling eigenvalue, are broadcast: D x D
doubles, a size fixed by the dimension. Whitening is then a map without a shuffle.

Defined cases: null and empty vectors and vectors with null, NaN or infinite entries are dropped; vectors of different dimensions are
fitted apart; components whose eigenvalue is zero to double precision (constant tables, fewer vectors than
dimensions) can't be whitened and are left out; ``deviation`` is null where it doesn't fit a long, and entries beyond 2^53 / scale,
which have no exact integer, drop their row like infinite ones; null identifiers and repeated rows are kept; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.storage import cleared

from .common import bounded_batches, written

#: Rows of a matrix that travel together, and groups into which tasks' parts are added up first.
STRIPE, GROUPS = 32, 64
#: Beyond this an integer is not exact as a double.
EXACT = float(1 << 53)
_EPS = float(np.finfo(float).eps)


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix."""
    a = np.array(matrix, float)
    n = len(a)
    vectors = np.eye(n)
    seats = np.arange(n + n % 2)
    for _ in range(sweeps):
        rotated = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (p < n) & (q < n)  # an odd dimension leaves one out
            p, q = np.minimum(p, q)[real], np.maximum(p, q)[real]
            some = np.abs(a[p, q]) > _EPS * np.sqrt(np.abs(a[p, p] * a[q, q]))
            p, q = p[some], q[some]
            if len(p):
                rotated = True
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(1, theta))
                c = 1 / np.hypot(1, t)
                s = t * c
                for m in (a, vectors):
                    left, right = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * left - s * right, s * left + c * right
                left, right = a[p].copy(), a[q].copy()
                a[p], a[q] = c[:, None] * left - s[:, None] * right, s[:, None] * left + c[:, None] * right
                a[p, q] = a[q, p] = 0.0
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not rotated:
            break
    values = a.diagonal()
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, from the exact integer n x - S where it fits."""
    if n * float(np.abs(x).max(initial=0)) < 2.0**62 and float(np.abs(sums).max(initial=0)) < 2.0**62:
        return (n * x - sums.astype(np.int64)) / n
    whole, rest = sums // n, sums % n
    return (x - whole.astype(np.int64)) - rest.astype(float) / n


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - S)^2; None beyond a long."""
    most = max(int(x.max(initial=0)) * n - int(min(sums)), int(max(sums)) - int(x.min(initial=0)) * n, 1)
    if most * most * x.shape[1] < 1 << 63:
        y = n * x - sums.astype(np.int64)
        return (y * y).sum(1).tolist()
    out = [sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist())) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def _added(parts: DataFrame) -> np.ndarray:
    """The sum of tasks' matrices: rows (stripe, part, matrix of doubles)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, part = None, None, 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["stripe", "part", "matrix"])
        for b in batches:
            for stripe, group, raw in zip(*(b.column(c).to_pylist() for c in ("stripe", "part", "matrix"))):
                if now is not None and (stripe, group) != (now, part):
                    yield give()
                    total = None
                now, part = stripe, group
                total = np.frombuffer(raw) if total is None else total + np.frombuffer(raw)
        if now is not None:
            yield give()

    schema = "stripe int, part int, matrix binary"
    once = parts.withColumn("part", F.pmod("part", F.lit(GROUPS))).repartition("stripe", "part").sortWithinPartitions("stripe", "part").mapInArrow(add, schema)
    rows = once.withColumn("part", F.lit(0)).repartition("stripe").sortWithinPartitions("stripe").mapInArrow(add, schema).collect()  # one D x D matrix
    return np.concatenate([np.frombuffer(r["matrix"]) for r in sorted(rows, key=lambda r: r["stripe"])]) if rows else np.empty(0)


def _scatter(fit: DataFrame, dimension: int, project) -> np.ndarray:
    """Sum over the fit list of y y' with y = project(x), and below it the sums of y."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            y = project(_matrix(b.column("x"), dimension))
            some = np.vstack([y.T @ y, y.sum(0)])
            total = some if total is None else total + some
        if total is not None:
            part = TaskContext.get().partitionId()
            for i in range(0, len(total), STRIPE):
                yield pa.RecordBatch.from_arrays([pa.array([i // STRIPE], pa.int32()), pa.array([part], pa.int32()), pa.array([total[i : i + STRIPE].tobytes()], pa.binary())], ["stripe", "part", "matrix"])

    return _added(fit.mapInArrow(scan, "stripe int, part int, matrix binary"))


def integers(vector: Column, scale: float, shift: int) -> Column:
    """floor(scale * c) + shift of each entry; null for a vector that is dropped."""
    fits = lambda c: F.coalesce((F.abs(c.cast("double")) * scale < EXACT) & ~F.isnan(c.cast("double")), F.lit(False))
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(shift).cast("long"))
    return F.when((F.size(vector) > 0) & F.forall(vector, fits), whole)


def whitened(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 16, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """For each row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), integers(F.col(f"`{vector}`"), scale, shift).alias("x")).where("x IS NOT NULL")
    outputs = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    bounded_batches(spark)
    with cleared(spark) as keep:
        rows = written(own, "white-rows")
        fit = written(rows.select("x").distinct(), "white-fit")
        parts = []
        for dimension, n in sorted(tuple(r) for r in fit.groupBy(F.size("x")).agg(F.count(F.lit(1))).collect()):  # a row for each dimension
            mine = fit.where(F.size("x") == dimension)
            parts.append(_of_dimension(rows.where(F.size("x") == dimension), mine, dimension, n, components, outputs))
        if not parts:
            return keep(spark.createDataFrame([], T.StructType([rows.schema["vec_id"], *T.StructType.fromDDL(outputs).fields])), "whitened")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return keep(out, "whitened")


def _of_dimension(rows: DataFrame, fit: DataFrame, dimension: int, n: int, components: int, outputs: str) -> DataFrame:
    spark = rows.sparkSession

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dimension, object)
        for b in batches:
            low = _matrix(b.column("x"), dimension)
            total += (low >> 20).sum(0).astype(object) * (1 << 20) + (low & ((1 << 20) - 1)).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(dimension), pa.int32()), pa.array([str(v) for v in total], pa.string())], ["i", "s"])

    sums = fit.mapInArrow(add, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # one row for each dimension
    sums = np.array([int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])], object)
    scatter = _scatter(fit, dimension, lambda x: centred(x, n, sums)).reshape(-1, dimension)
    covariance = (scatter[:-1] + scatter[:-1].T) / (2 * n)
    values, axes = jacobi(covariance)
    trace = float(covariance.trace())
    kept = min(components, dimension, int((values > trace * dimension * _EPS).sum()))
    unit = axes[:, :kept] / np.sqrt(values[:kept]) if kept else np.empty((dimension, 0))
    error, explained = 0.0, (values[:kept] / trace if kept else np.empty(0))
    if kept:
        mean = scatter[-1] / n @ unit  # of the projections: only what rounding leaves
        again = _scatter(fit, dimension, lambda x: centred(x, n, sums) @ unit - mean).reshape(-1, kept)[:-1] / n
        error = float(np.abs(again - np.eye(kept)).max())
    shared = spark.sparkContext.broadcast((unit, sums))
    schema = T.StructType([rows.schema["vec_id"], *T.StructType.fromDDL(outputs).fields])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sums = shared.value
        for b in batches:
            m = b.num_rows
            if not m or not kept:
                continue
            x = _matrix(b.column("x"), dimension)
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(pa.array(np.repeat(np.arange(m), kept))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n)),
                pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), kept))), pa.array((centred(x, n, sums) @ unit).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error)),
            ], schema.names)

    return rows.mapInArrow(project, schema)
