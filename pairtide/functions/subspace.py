"""Leading principal components of a table of vectors by a seeded randomized range finder.

A random subspace is multiplied with the centred table and its transpose a few times and made orthonormal in between; each pass is one job whose
tasks send sums in runs of rows.  The last product is reduced by a tall-skinny QR: each task folds its rows into one small triangle,
triangles are merged in a tree, and the singular vectors of the last one turn the subspace into components.  Only (columns x width) numbers reach the driver, never a covariance.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the largest matrix (columns x width) that the driver and each worker hold.
MOST_BYTES = 256 << 20
#: Runs of a matrix's rows that a task sends as one record each; triangles that are left for the driver.
RUNS, TRIANGLES = 32, 16


class Components(NamedTuple):
    mean: np.ndarray
    vectors: np.ndarray
    values: np.ndarray


def _rows(batch, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The batch's vectors as a matrix without those that are null or not finite, and the flags of the others; a vector of another length is an error."""
    column = batch.column(0)
    there = np.asarray(column.is_valid())
    column = column.filter(pa.array(there))
    if len(column) and not np.all(np.asarray(column.value_lengths()) == columns):
        raise ValueError(f"vectors must have {columns} entries")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, columns)
    fine = np.isfinite(x).all(axis=1)
    there[there] = fine
    return x[fine], there


def _summed(df: DataFrame, shape: tuple[int, int], product) -> np.ndarray:
    """The sum of ``product(rows)`` over all batches, a matrix of ``shape``: tasks send runs of its rows, which are summed apart."""
    runs = range(0, shape[0], -(-shape[0] // RUNS))
    schema, columns = "run int, numbers binary", product.columns

    def partial(batches):
        total = np.zeros(shape)
        for batch in batches:
            x, _ = _rows(batch, columns)
            total += product(x).reshape(shape)
        yield pa.RecordBatch.from_pydict({"run": pa.array(runs, pa.int32()), "numbers": [total[a : a + runs.step].tobytes() for a in runs]})

    def merged(batches):
        totals = {}
        for batch in batches:
            for run, numbers in zip(batch.column("run").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
                totals[run] = totals.get(run, 0) + np.frombuffer(numbers)
        if totals:
            yield pa.RecordBatch.from_pydict({"run": pa.array(list(totals), pa.int32()), "numbers": [v.tobytes() for v in totals.values()]})

    out = np.zeros(shape)
    for run, numbers in df.mapInArrow(partial, schema).repartition("run").mapInArrow(merged, schema).collect():
        out[run : run + runs.step] = np.frombuffer(numbers).reshape(-1, shape[1])
    return out


class _Sums:
    """Column sums and the number of rows behind them."""

    def __init__(self, columns: int):
        self.columns = columns

    def __call__(self, x):
        return np.append(x.sum(axis=0), len(x))


class _Power:
    """The centred rows' transpose times their product with a subspace."""

    def __init__(self, mean, basis):
        self.columns, self.mean, self.basis = len(mean), mean, basis

    def __call__(self, x):
        x = x - self.mean
        return x.T @ (x @ self.basis)


def _triangle(df: DataFrame, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of the centred table times ``basis``."""
    width, columns = basis.shape[1], len(mean)
    fold = lambda r, rows: np.linalg.qr(np.vstack([r, rows]), mode="r")

    def partial(batches):
        r = np.zeros((0, width))
        for batch in batches:
            r = fold(r, (_rows(batch, columns)[0] - mean) @ basis)
        yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId() % TRIANGLES], pa.int32()), "r": [r.tobytes()]})

    def merged(batches):
        r = np.zeros((0, width))
        for batch in batches:
            for own in batch.column("r").to_pylist():
                r = fold(r, np.frombuffer(own).reshape(-1, width))
        if len(r):
            yield pa.RecordBatch.from_pydict({"slot": pa.array([0], pa.int32()), "r": [r.tobytes()]})

    schema, r = "slot int, r binary", np.zeros((0, width))
    for row in df.mapInArrow(partial, schema).repartition(TRIANGLES, "slot").mapInArrow(merged, schema).collect():
        r = fold(r, np.frombuffer(row.r).reshape(-1, width))
    return r


def components(df: DataFrame, vector: str, k: int, *, oversample: int = 64, iterations: int = 4, seed: int = 42) -> Components:
    """Mean, first k components (columns x k) and singular values of the centred table; fewer if it has fewer rows or columns.

    Exact where k + ``oversample`` reaches the number of rows or columns.  Vectors that are null or hold values that are not finite count in nothing.  The sign of a component makes its largest entry positive."""
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    first = rows.select(F.size("v")).first()
    columns = first[0] if first else 0
    totals = _summed(rows, (columns + 1, 1), _Sums(columns)).ravel() if columns else np.zeros(1)
    n = int(totals[-1])
    width = min(k + oversample, columns, n)
    if columns * width * 8 > MOST_BYTES:
        raise ValueError("columns x (k + oversample) is too large")
    if not width:
        return Components(np.zeros(columns), np.zeros((columns, 0)), np.zeros(0))
    mean = totals[:-1] / n
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(columns, width)))[0]
    for _ in range(iterations if width < columns else 0):
        basis = np.linalg.qr(_summed(rows, (columns, width), _Power(mean, basis)))[0]
    _, values, turned = np.linalg.svd(_triangle(rows, mean, basis), full_matrices=False)
    found = basis @ turned[: min(k, width)].T
    found = found * np.where(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])] < 0, -1.0, 1.0)
    return Components(mean, found, values[: min(k, width)])


def projected(df: DataFrame, vector: str, found: Components) -> DataFrame:
    """``df`` with ``vector`` replaced by its centred projection on the components; NULL where it is null or not finite."""
    own = df.withColumn("_v", F.col(vector).cast("array<double>"))
    columns = len(found.mean)

    def run(batches):
        for batch in batches:
            x, fine = _rows(batch.select(["_v"]), columns)
            low = iter((x - found.mean) @ found.vectors)
            values = pa.array([next(low) if ok else None for ok in fine], pa.list_(pa.float64()))
            yield batch.set_column(batch.schema.get_field_index("_v"), pa.field("_v", pa.list_(pa.float64())), values)

    return own.mapInArrow(run, own.schema).withColumn(vector, F.col("_v")).drop("_v")
