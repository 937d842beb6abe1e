"""Whitening of embeddings by shifted CholeskyQR.

The centred rows Y of the table, one row a vector, are never gathered. A *Gram pass* over them
adds up ``Q'Q`` of ``Q = Y R^-1`` by triangular solves inside the tasks, where R is the product of
the factors found so far. The first Gram matrix is shifted before its Cholesky factorisation, so
that rounding cannot make it indefinite; each further pass orthogonalises what the last one left,
until ``Q'Q`` is the identity to rounding. Then ``Y = Q R`` with orthonormal Q, so the singular
values of the small matrix R are those of Y, and its right singular vectors the components.

* A task gives one matrix of ``d`` by ``d`` numbers. They are added in ``PARTIALS`` tasks, and only
  those sums come to the driver, whatever the number of rows or partitions.
* Sums and deviations are whole numbers and exact: entries are scaled and rounded down first, and
  centring multiplies by ``n`` instead of dividing.
* Passes read the source again rather than a cache, so a lost executor costs its tasks only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCALE, OFFSET = 64, 1_000_000
#: Larger entries count as this, so that scaled values stay exact in doubles and longs.
LARGEST = float(1 << 44)
COMPONENTS = 32
#: Tasks that add up the matrices of all others.
PARTIALS = 8
#: Gram passes at most, and the distance of ``Q'Q`` from the identity that ends them.
MOST_PASSES, ORTHONORMAL = 6, 1e-12
#: Directions with less than this share of the largest eigenvalue are rounding, not data.
RANK = 1e-14
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """A fit: ``n`` rows with per-dimension ``sums``, ``components`` in columns, their eigenvalues."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int

    @property
    def dimension(self) -> int:
        return len(self.sums)


def finite_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and holds neither null nor non-finite entries."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(F.coalesce(fine, F.lit(False)))


def scaled(values: np.ndarray) -> np.ndarray:
    """``floor(64 * c) + 1000000`` as longs."""
    return np.floor(np.clip(values.astype(np.float64), -LARGEST, LARGEST) * SCALE).astype(np.int64) + OFFSET


def _matrix(batch, column: str, d: int) -> np.ndarray:
    return scaled(batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums``, exact: longs where they suffice, whole numbers of any size beyond."""
    if max(n * (int(np.abs(x).max(initial=0)) + 1), *map(abs, sums.tolist())) < 1 << 62:
        return n * x - np.array(sums.tolist(), np.int64)
    return n * x.astype(object) - sums


def _add(rows: DataFrame, part, d: int) -> np.ndarray:
    """Sum over all rows of the matrices that ``part`` makes of the batches of a task."""

    def of_task(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                found = part(batch.slice(at, ROWS))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def of_partial(batches):
        total = None
        for batch in batches:
            for m in batch.column("m").to_pylist():
                found = np.frombuffer(m)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    found = rows.mapInArrow(of_task, "m binary").repartition(PARTIALS).mapInArrow(of_partial, "m binary")
    return sum(np.frombuffer(bytes(row["m"])) for row in found.collect()).reshape(-1, d)


def _sums(rows: DataFrame, column: str, d: int) -> tuple[int, np.ndarray]:
    """Row count and exact sums of the scaled entries, as whole numbers of any size."""
    low = (1 << 31) - 1

    def part(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.slice(at, ROWS), column, d)
                # Two halves of 31 bits, so that Spark's long sums cannot overflow.
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(d)), pa.array((x >> 31).sum(0)), pa.array((x & low).sum(0)), pa.array(np.full(d, len(x)))],
                    ["at", "high", "low", "n"],
                )

    found = rows.mapInArrow(part, "at long, high long, low long, n long")
    totals = found.groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).orderBy("at").collect()
    if not totals:
        return 0, np.zeros(d, object)
    return totals[0]["n"], np.array([(int(r["high"]) << 31) + int(r["low"]) for r in totals], object)


def _below(upper: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``rows @ inv(upper)`` by forward substitution, column by column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor of the Gram matrix plus a shift, which grows until the factor exists."""
    eye = np.eye(len(gram))
    while True:
        try:
            return np.linalg.cholesky(gram + shift * eye).T
        except np.linalg.LinAlgError:
            shift = max(shift * 10, np.finfo(float).eps * np.trace(gram))


def fit(rows: DataFrame, column: str, d: int) -> Whitening | None:
    """Fit on all ``rows`` (vectors of ``d`` finite entries); None without spread in any direction."""
    n, sums = _sums(rows, column, d)
    if n == 0:
        return None
    eps = np.finfo(float).eps
    r, passes = np.eye(d), 0
    for passes in range(1, MOST_PASSES + 1):

        def part(batch, r=r, first=passes == 1):
            y = centred(_matrix(batch, column, d), n, sums).astype(np.float64) / n
            q = y if first else _below(r, y)
            return (q.T @ q).ravel()

        gram = _add(rows, part, d)
        if passes == 1:
            size = np.linalg.norm(gram, 2)
            if size == 0:
                return None
            # The shift of shifted CholeskyQR: above the rounding of the Gram matrix.
            shift = min(11 * (n * d + d * (d + 1)) * eps, 1e-8) * size
        else:
            # Directions without data stay near zero; the others are orthonormal or become so.
            live = np.linalg.eigvalsh(gram)
            near = np.abs(live - 1) < ORTHONORMAL
            if passes == MOST_PASSES or (near | (live < RANK)).all():
                break
            shift = eps
        r = np.triu(_cholesky(gram, shift)) @ r
    # The last Gram matrix takes away what shifts added: R'(Q'Q)R = Y'Y.
    low, basis = np.linalg.eigh(gram)
    root = (np.sqrt(np.clip(low, 0, None))[:, None] * basis.T) @ r
    _, values, right = np.linalg.svd(root)
    e = values**2 / n
    rank = int((e > RANK * e[0]).sum())
    return Whitening(n, sums, right[:rank].T.copy(), e[:rank], float(e.sum()), passes)


def _whitened(x: np.ndarray, w: Whitening, k: int) -> np.ndarray:
    y = centred(x, w.n, w.sums).astype(np.float64) / w.n
    return y @ (w.components[:, :k] / np.sqrt(w.eigenvalues[:k]))


def identity_error(rows: DataFrame, column: str, w: Whitening, k: int) -> float:
    """Largest entry of the covariance of the whitened values minus the identity, by one pass."""

    def part(batch):
        z = _whitened(_matrix(batch, column, w.dimension), w, k)
        return np.vstack([z.T @ z, z.sum(0)]).ravel()

    total = _add(rows, part, k)
    mean = total[k] / w.n
    return float(np.abs(total[:k] / w.n - np.outer(mean, mean) - np.eye(k)).max())


OUTPUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: ``key, component, n, deviation, whitened, explained, identity_error``.

    Components are numbered from 1 by falling eigenvalue; ``explained`` is the eigenvalue over the
    trace, ``deviation`` the exact sum over dimensions of ``(n * x - sums)**2`` (null where a long
    cannot hold it), ``identity_error`` one value for the table.

    Defined cases: vectors that are null or hold null or non-finite entries are left out, and so
    are vectors whose length is not the most common one (the smaller on a tie) or is 0. Entries
    beyond 2**44 count as 2**44. There are as many components as directions with spread, so equal
    vectors, a single one or an empty table give no rows. Null and repeated keys are rows like any
    other; other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    names = f"`{key}` {kind}, {OUTPUT}"
    fine = finite_vectors(vectors.select(F.col(key), F.col(column).alias("_v")), "_v").where(F.size("_v") > 0)
    common = fine.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], names)
    d = common["d"]
    rows = fine.where(F.size("_v") == d)
    w = fit(rows.select("_v"), "_v", d)
    if w is None:
        return spark.createDataFrame([], names)
    k = min(components, len(w.eigenvalues))
    error = identity_error(rows.select("_v"), "_v", w, k)
    explained = w.eigenvalues[:k] / w.trace

    def give(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part, "_v", d)
                far = centred(x, w.n, w.sums)
                if far.dtype != object and np.abs(far).max(initial=0) < 1 << 28 and d < 1 << 6:
                    far = (far * far).sum(1).tolist()
                else:
                    far = (far.astype(object) ** 2).sum(1).tolist()
                far = pa.array([v if v < 1 << 63 else None for v in far], pa.int64())
                z = _whitened(x, w, k)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                rest = len(x) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(rest, w.n)),
                        far.take(each),
                        pa.array(z.ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(rest, error)),
                    ],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(give, names)
