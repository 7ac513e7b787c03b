"""PCA whitening of embeddings by block subspace iteration, without the covariance as a matrix.

Every pass over the vectors multiplies the centred ones by a block Q of orthonormal
columns and the products back: V Q = Xᵀ(X Q) / n. What a task has summed leaves it
as one row for each dimension, and these rows are added up by dimension, in order
of their tasks, so the driver gets a block's size, whatever the number of tasks.
There Rayleigh-Ritz turns the block into Ritz vectors, whose residuals need no
further pass, and QR of their products is the next block. A component is certified
when its residual is below ``TOLERANCE`` times the gap to its neighbours (then it is
that near to the true one) or at the level of rounding. A block that would need
many more passes grows by new columns, at most to all dimensions, where one pass
is exact, so the passes are few whatever the spectrum.

Entries become integers first: x = floor(64 c) + 1,000,000. Sums are exact, and
n x - S is centred before anything is multiplied.

Defined cases: vectors that are null, hold null or non-finite entries or have another
length than most (of lengths equally frequent the largest counts) are left out;
repeated rows count as often as they occur; null ids are ids like others; entries
beyond 2**50 count as 2**50; components with an eigenvalue of rounding size cannot
be whitened and are left out, so one vector, or none, has no components; a deviation
beyond 64 bits is null; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounded_batches, materialize

SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 50
COMPONENTS = 32
#: Columns of a block beyond the components asked for.
EXTRA = 8
#: Angle to the true component, in radians, that residual and gap must prove.
TOLERANCE = 1e-10
#: A block that would need more passes than this is doubled.
PATIENCE = 6
SEED = 42
#: Rows that are multiplied at once.
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """What a fit found: components in rows, their eigenvalues and residuals, falling."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    residuals: np.ndarray
    trace: float
    passes: int


def entries(vector: Column) -> Column:
    """The integers of a vector, null if it has entries that are null or no numbers."""
    c = vector.cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    most = F.lit(LARGEST / SCALE)
    small = lambda e: F.greatest(-most, F.least(most, e))
    return F.when(F.size(c) > 0, F.when(~F.exists(c, bad), F.transform(c, lambda e: F.floor(small(e) * SCALE) + SHIFT)))


def prepared(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x: the vectors that are fitted and whitened, as a table."""
    rows = materialize(vectors.select(F.col(key).alias("key"), entries(F.col(vector)).alias("x")).where("x is not null"))
    length = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == (length["d"] if length else 0))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n; the difference is exact before it is divided where 64 bits hold it."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62 and int(np.abs(sums).max(initial=0)) < 1 << 62:
        return (n * x - sums.astype(np.int64)) / n
    return ((n * x.astype(object) - sums) / n).astype(np.float64)


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """The vectors of each name added up, in order of their parts. parts: name, part, values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total = None, None
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(v, np.float64)
                if i == name:
                    total = total + v
                    continue
                if name is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["name", "value"])
                name, total = i, v
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["name", "value"])

    rows = parts.repartition("name").sortWithinPartitions("name", "part").select("name", "value").mapInArrow(run, "name int, value binary")
    return {r["name"]: np.frombuffer(r["value"], np.float64) for r in rows.collect()}


def _parts(rows: DataFrame, summed) -> DataFrame:
    """name, part, value: what ``summed`` makes of each task's batches, as vectors by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = summed(batches)
        if found:
            part = TaskContext.get().partitionId()
            columns = [pa.array(list(found), pa.int32()), pa.array([part] * len(found), pa.int32()), pa.array([np.ascontiguousarray(v, np.float64).tobytes() for v in found.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["name", "part", "value"])

    return rows.select("x").mapInArrow(run, "name int, part int, value binary")


def totals(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """(number of vectors, exact sum of each dimension): each task's own sums, added up as 128-bit decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if len(b):
                n += len(b)
                x = _matrix(b, len(b.column(0)[0]))
                own = sum((x[lo : lo + ROWS].sum(axis=0).astype(object) for lo in range(0, len(x), ROWS)), np.zeros(x.shape[1], object))
                total = own if total is None else total + own
        if n:
            values = [Decimal(int(v)) for v in (n, *total)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["name", "total"])

    sums = rows.select("x").mapInArrow(run, "name int, total decimal(38,0)").groupBy("name").agg(F.sum("total").alias("total"))
    found = {r["name"]: int(r["total"]) for r in sums.collect()}
    return found.pop(-1, 0), tuple(found[i] for i in range(len(found)))


def product(rows: DataFrame, n: int, sums: tuple[int, ...], q: np.ndarray) -> tuple[np.ndarray, float]:
    """(V q, trace of V): one pass over the vectors."""
    s = np.array(sums, object)
    d = len(sums)

    def summed(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        y, trace, any_ = np.zeros((d, q.shape[1])), 0.0, False
        for b in batches:
            x = _matrix(b, d)
            for lo in range(0, len(x), ROWS):
                c = centred(x[lo : lo + ROWS], n, s)
                y += c.T @ (c @ q)
                trace += float(np.einsum("ij,ij->", c, c))
                any_ = True
        return {i: y[i] for i in range(d)} | {d: np.array([trace])} if any_ else {}

    found = _added(_parts(rows, summed))
    return np.stack([found[i] for i in range(d)]) / n, float(found[d][0]) / n


def ritz(q: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, products and residuals' lengths of the block q with products y), values falling."""
    h = q.T @ y
    values, u = np.linalg.eigh((h + h.T) / 2)
    u = u[:, ::-1]
    values, vectors, products = values[::-1], q @ u, y @ u
    return values, vectors, products, np.linalg.norm(products - vectors * values, axis=0)


def uncertified(values: np.ndarray, residuals: np.ndarray, k: int, d: int) -> np.ndarray:
    """By how much the residuals of the first k exceed what certifies them (1 or less: certified)."""
    theta = np.concatenate([[np.inf], values, [-np.inf if len(values) == d else values[-1]]])
    # What lies below a component may be larger than its Ritz value by the residual.
    below = theta[2:] + np.append(residuals[1:], 0.0)
    gap = np.maximum(np.minimum(theta[:k] - theta[1 : k + 1], theta[1 : k + 1] - below[:k]), 0.0)
    rounding = 16 * np.finfo(float).eps * max(values[0], 0.0) * math.sqrt(d)
    return residuals[:k] / np.maximum(np.maximum(TOLERANCE * gap, rounding), np.finfo(float).tiny)


def fit(rows: DataFrame, k: int = COMPONENTS, extra: int = EXTRA) -> Whitening:
    """The first k components of the prepared vectors."""
    bounded_batches(rows.sparkSession, ROWS)
    n, sums = totals(rows)
    d = len(sums)
    k = min(k, d)
    none = Whitening(n, sums, np.zeros((0, d)), np.zeros(0), np.zeros(0), 0.0, 0)
    if not k:
        return none
    rng = np.random.default_rng(SEED)
    width, passes, before, alike = min(d, k + extra), 0, None, 0
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    while True:
        y, trace = product(rows, n, sums, q)
        passes += 1
        values, vectors, products, residuals = ritz(q, y)
        over = float(uncertified(values, residuals, k, d).max())
        if over <= 1 or width == d:
            break
        alike += 1
        left = math.inf if before is None or over >= before else math.log(over) / math.log(before / over)
        # The first passes of a block tell little of its rate.
        if alike >= 3 and left > PATIENCE:
            width, alike = min(d, 2 * width), 0
        before = over
        block = np.hstack([products, rng.standard_normal((d, width - products.shape[1]))])
        q = np.linalg.qr(block / np.maximum(np.linalg.norm(block, axis=0), np.finfo(float).tiny))[0]
    sound = values[:k] > max(values[0], 0.0) * d * np.finfo(float).eps
    keep = np.flatnonzero(sound & (values[:k] > 0))
    return Whitening(n, sums, np.ascontiguousarray(vectors[:, keep].T), values[keep], residuals[keep], trace, passes)


def whitened_rows(c: np.ndarray, model: Whitening) -> np.ndarray:
    return (c @ model.components.T) / np.sqrt(model.eigenvalues)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity: two passes, for their mean and about it."""
    s, d, k = np.array(model.sums, object), len(model.sums), len(model.eigenvalues)
    if not k:
        return 0.0

    def mean(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = np.zeros(k)
        for b in batches:
            total += whitened_rows(centred(_matrix(b, d), model.n, s), model).sum(axis=0)
        return {0: total}

    about = _added(_parts(rows, mean))[0] / model.n

    def products(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = np.zeros((k, k))
        for b in batches:
            w = whitened_rows(centred(_matrix(b, d), model.n, s), model) - about
            total += w.T @ w
        return dict(enumerate(total))

    found = _added(_parts(rows, products))
    return float(np.abs(np.stack([found[i] for i in range(k)]) / model.n - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, s: np.ndarray) -> list[int | None]:
    """The sum of (n x - S)**2 of each row, exact; None beyond 64 bits."""
    rough = np.abs(n * x.astype(np.float64) - s.astype(np.float64)).max(initial=0.0)
    if rough * rough * max(1, x.shape[1]) < 2**62:
        # n x and S may pass 64 bits, their small difference does not.
        small = x - np.array([int(t) // n for t in s], np.int64)
        t = n * small - np.array([int(t) % n for t in s], np.int64)
        return np.einsum("ij,ij->i", t, t).tolist()
    exact = ((n * x.astype(object) - s) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """key, deviation, whitened: one row per prepared vector, one entry per component."""
    s, d = np.array(model.sums, object), len(model.sums)
    shape = rows.select("key", F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, d)
            w = whitened_rows(centred(x, model.n, s), model)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_deviations(x, model.n, s), pa.int64()), lists], ["key", "deviation", "whitened"])

    return rows.mapInArrow(run, shape)
