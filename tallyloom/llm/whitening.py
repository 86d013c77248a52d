"""Whitening of embeddings by Chan's merging of covariances.

Each task takes the count, the mean (as exact sums) and the centred scatter of its
vectors, batch by batch; treeReduce merges them pairwise (those of two lists give
those of both), so nothing is ever summed as squares of uncentred numbers and the
driver gets one d x d matrix.  eigh of the covariance there gives the components.  A second
pass whitens all vectors and takes their covariance in the same way: its distance
from the identity is the error that is reported.  A third one returns the rows.

Vectors are worked on as whole numbers, floor(SCALE * c); OFFSET is added only where
a formula names it, as it changes neither deviations nor covariances.  Sums are exact.

Left out: null vectors, those with null or non-finite entries, and those of another
length than the most frequent one (of equally frequent ones, the longest).  Numbers
beyond 2^62 count as 2^62.  Repeated rows and rows of null id count each.  Other
columns are not looked at.  An empty table, or one without usable vectors, gives no
rows.  A component without variance (one vector, equal vectors, dimensions that
follow from others) has no whitened values (null), and identity_error leaves it out;
without any variance explained is 0 and identity_error null.  A deviation beyond
2^63 - 1 is null.  Memory: a few d x d matrices in each task and on the driver.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import pick

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
CELLS = 2_000_000  # numbers of a matrix worked on at a time
MOST = 2.0**62
EXACT = 2.0**62  # whole numbers are summed in 64 bits while they stay under this


def moments_of(rows: np.ndarray) -> tuple:
    """Count, exact sums (n times the mean) and centred scatter of a matrix of at least one row."""
    n = len(rows)
    if rows.dtype == np.int64 and np.abs(rows).max(initial=0) >= EXACT / n:
        sums = [sum(column.tolist()) for column in rows.T]
    else:
        sums = rows.sum(axis=0).tolist()
    centred = rows - np.array([s / n for s in sums])
    left = centred.sum(axis=0)  # what rounding has left of the mean
    return n, sums, centred.T @ centred - np.outer(left, left) / n


def merge(a: tuple | None, b: tuple | None) -> tuple | None:
    """The moments of two lists of vectors together."""
    if a is None or b is None:
        return a or b
    (n_a, sums_a, scatter_a), (n_b, sums_b, scatter_b) = a, b
    apart = np.array([(y * n_a - x * n_b) / (n_a * n_b) for x, y in zip(sums_a, sums_b, strict=True)])  # of the two means
    return n_a + n_b, [x + y for x, y in zip(sums_a, sums_b, strict=True)], scatter_a + scatter_b + np.outer(apart, apart) * (n_a * (n_b / (n_a + n_b)))


def moments(matrices: DataFrame, rows_of) -> tuple | None:
    """The moments of all rows; rows_of gives the matrices of a batch.  None without rows."""

    def run(batches):
        total = None
        for batch in batches:
            for rows in rows_of(batch):
                if len(rows):
                    total = merge(total, moments_of(rows))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["state"])

    states = matrices.mapInArrow(run, "state binary").rdd
    if not states.getNumPartitions():
        return None
    return states.map(lambda r: pickle.loads(r.state)).treeReduce(merge)


def whole(batch: pa.RecordBatch, dims: int, scale: int):
    """The places and the scaled vectors of the usable rows of a batch, some at a time."""
    step = max(1, CELLS // dims)
    for low in range(0, batch.num_rows, step):
        column = batch.column("embedding").slice(low, step)
        at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
        if not len(at):
            continue
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # null entries become NaN
        good = np.isfinite(flat).all(axis=1)
        yield at[good] + low, np.clip(np.floor(scale * flat[good]), -MOST, MOST).astype(np.int64)


@dataclass
class Whitening:
    """What a fit has found: n vectors, their exact sums (without OFFSET), eigenvalues and unit eigenvectors (columns) by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    scale: int

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def real(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > self.values.max(initial=0.0) * self.dims * np.finfo(float).eps

    def apply(self, rows: np.ndarray) -> np.ndarray:
        """The whitened vectors: projections over the root of the eigenvalue; NaN for components without variance."""
        mean = np.array([s / self.n for s in self.sums])
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.real, (rows - mean) @ self.vectors / np.sqrt(np.where(self.real, self.values, 1.0)), np.nan)

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n * x - S)^2 of each row."""
        bound = self.n * float(np.abs(rows).max(initial=0)) + float(max(map(abs, self.sums), default=0))
        if bound**2 * self.dims < EXACT:
            gap = rows * np.int64(self.n) - np.array(self.sums, np.int64)
            return (gap * gap).sum(axis=1).tolist()
        out = [sum((self.n * x - s) ** 2 for x, s in zip(row, self.sums, strict=True)) for row in rows.tolist()]
        return [x if x < 1 << 63 else None for x in out]


def usable(vectors: DataFrame) -> DataFrame:
    return pick(vectors, "vec_id", "embedding")


def fit(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """The whitening of all usable vectors; None if there is none.  vectors has embedding, an array of numbers."""
    lengths = vectors.select(F.size("embedding").alias("d")).where("d > 0").groupBy("d").count()
    most = lengths.orderBy(F.col("count").desc(), F.col("d").desc()).first()
    if most is None:
        return None
    dims = most["d"]
    total = moments(vectors.select("embedding"), lambda batch: (rows for _, rows in whole(batch, dims, scale)))
    if total is None:
        return None
    n, sums, scatter = total
    values, axes = np.linalg.eigh(scatter / n)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(scatter)) / n
    kept = np.maximum(values[order], 0.0)
    return Whitening(n, sums, kept, axes[:, order], kept / trace if trace > 0 else np.zeros(len(order)), scale)


def identity_error(vectors: DataFrame, found: Whitening) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    if not found.real.any():
        return None
    n, _, scatter = moments(vectors.select("embedding"), lambda batch: (found.apply(rows)[:, found.real] for _, rows in whole(batch, found.dims, found.scale)))
    return float(np.abs(scatter / n - np.eye(len(scatter))).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    vectors = usable(vectors)
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(vectors, components)
    if found is None:
        return vectors.sparkSession.createDataFrame([], kinds)
    error, k = identity_error(vectors, found), len(found.values)

    def run(batches):
        for batch in batches:
            for at, rows in whole(batch, found.dims, found.scale):
                for low in range(0, len(rows), 4_000):
                    some, who = rows[low : low + 4_000], at[low : low + 4_000]
                    m = len(some)
                    values = found.apply(some).ravel()
                    columns = [
                        batch.column("vec_id").take(pa.array(np.repeat(who, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, found.n)),
                        pa.array(found.deviations(some), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(values, mask=np.isnan(values)),
                        pa.array(np.tile(found.explained, m)),
                        pa.array(np.full(m * k, np.nan if error is None else error), mask=np.full(m * k, error is None)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, kinds)
