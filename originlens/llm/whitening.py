"""Whitening of embeddings by a covariance that is recovered from variances alone (polarisation)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originlens.llm.common import slices
from originlens.session import materialise

#: A scaled entry of this size or more can't be told from its neighbours as a double.
MOST = 1 << 53
#: Least eigenvalue, as a share of their sum, of a component that can be scaled to variance 1.
LEAST_SHARE = 1e-12


def scaled(embeddings: DataFrame, scale: int = 256, keep: tuple[str, ...] = ("vec_id",), vec_col: str = "embedding") -> DataFrame:
    """The columns ``keep`` and x (array of long, floor of ``scale`` times each entry) of the usable rows.

    Rows whose vector is NULL, or holds a NULL, non-finite or scaled beyond 2^53 entry are left out."""
    v = F.col(vec_col).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < float(MOST // scale)))
    rows = embeddings.filter(F.coalesce(good, F.lit(False)))
    return rows.select(*keep, F.transform(v, lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def padded(rows: DataFrame, dims: int) -> DataFrame:
    """Vectors shorter than ``dims`` end with zeros."""
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))


def matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _squares(z: np.ndarray) -> list[int]:
    """Sums of squares of the columns, exact."""
    most = int(np.abs(z).max(initial=0))
    if most * most * max(1, len(z)) < 1 << 62:
        return np.einsum("ij,ij->j", z, z).tolist()
    return [sum(int(v) ** 2 for v in c) for c in z.T]


def _totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""

    def run(batches: Iterable):
        import pyarrow as pa

        n, total = 0, [0] * dims
        for b in slices(batches):
            x = matrix(b.column(0), dims)
            n += len(x)
            # two halves of 32 bits, whose sums over a batch can't overflow
            high = (x >> 32).sum(axis=0).tolist()
            low = (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + v for t, h, v in zip(total, high, low)]
        yield pa.RecordBatch.from_pydict({"pos": list(range(-1, dims)), "total": [str(v) for v in (n, *total)]})

    rows = fit.mapInArrow(run, "pos bigint, total string")
    sums = {r.pos: int(r.t) for r in rows.groupBy("pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("t")).collect()}
    return sums.get(-1, 0), [sums.get(i, 0) for i in range(dims)]


def _centred_squares(fit: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """(i, i): sum of the squared centred values of dimension i; (i, j): of the sums of dimensions i and j.

    Tasks return one row for each dimension and pair, so what the driver gets depends on the dimensions alone."""
    dims = len(centre)
    first, second = np.triu_indices(dims, 1)
    block = max(1, (1 << 21) // max(1, len(first)))

    def run(batches: Iterable):
        import pyarrow as pa

        alone, pairs = [0] * dims, [0] * len(first)
        for b in slices(batches, block):
            z = matrix(b.column(0), dims) - np.array(centre, np.int64)
            alone = [t + v for t, v in zip(alone, _squares(z))]
            pairs = [t + v for t, v in zip(pairs, _squares(z[:, first] + z[:, second]))]
        yield pa.RecordBatch.from_pydict(
            {
                "i": pa.array([*range(dims), *first.tolist()], pa.int32()),
                "j": pa.array([*range(dims), *second.tolist()], pa.int32()),
                "total": pa.array([str(v) for v in (*alone, *pairs)], pa.string()),
            }
        )

    rows = fit.mapInArrow(run, "i int, j int, total string")
    return {(r.i, r.j): int(r.t) for r in rows.groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("t")).collect()}


def covariance(n: int, rest: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance, divisor ``n``, from exact integers.

    ``squares`` are sums of squares about whole numbers near the means, ``rest`` the sums of what is left of
    each dimension there; n times a sum of squares less the square of the sum is n^2 times the variance.
    A pair's covariance is half of what the variance of the sum exceeds the two variances by."""
    dims = len(rest)
    var = [n * squares[i, i] - rest[i] ** 2 for i in range(dims)]
    v = np.zeros((dims, dims))
    for i in range(dims):
        v[i, i] = var[i] / n**2
        for j in range(i + 1, dims):
            both = n * squares[i, j] - (rest[i] + rest[j]) ** 2
            v[i, j] = v[j, i] = (both - var[i] - var[j]) / (2 * n**2)
    return v


@dataclass(frozen=True)
class Whitening:
    """Directions (rows, unit length) with their eigenvalues, and the statistics of the fit list."""

    n: int
    sums: list[int]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.directions.T / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)^2, exact; None where a long can't hold it."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(1, x.shape[1]) < 1 << 62:
            y = self.n * x - np.array(self.sums, np.int64)
            return np.einsum("ij,ij->i", y, y).tolist()
        exact = (sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist())
        return [v if v < 1 << 63 else None for v in exact]


def _identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity, measured over all of it."""
    k, dims = w.directions.shape

    def run(batches: Iterable):
        import pyarrow as pa

        total, square = np.zeros(k), np.zeros((k, k))
        for b in slices(batches):
            y = w.project(matrix(b.column(0), dims))
            total += y.sum(axis=0)
            square += y.T @ y
        yield pa.RecordBatch.from_pydict({"pos": list(range(k + k * k)), "v": [*total.tolist(), *square.ravel().tolist()]})

    rows = fit.mapInArrow(run, "pos bigint, v double").groupBy("pos").agg(F.sum("v").alias("v")).orderBy("pos").collect()
    v = np.array([r.v for r in rows]) / w.n
    mean, square = v[:k], v[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def fit_whitening(rows: DataFrame, dims: int, components: int = 4) -> Whitening | None:
    """The first directions of the covariance of all distinct vectors of ``rows`` (x, each of ``dims`` entries).

    None if there is no vector, no dimension or no variance. Directions whose eigenvalue is below 1e-12 of their sum
    are left out. The entry of a direction that is largest in size is positive."""
    fit = materialise(rows.select("x").distinct(), "fit-list")
    n, sums = _totals(fit, dims)
    if not n or not dims:
        return None
    centre = [(2 * s + n) // (2 * n) for s in sums]
    squares = _centred_squares(fit, centre)
    v = covariance(n, [s - n * c for s, c in zip(sums, centre)], squares)
    e, u = np.linalg.eigh(v)
    e, u, trace = e[::-1], u.T[::-1], float(np.trace(v))
    keep = np.flatnonzero(e > LEAST_SHARE * trace)[:components]
    if not len(keep):
        return None
    e, u = e[keep], u[keep]
    u = u * np.sign(u[np.arange(len(u)), np.abs(u).argmax(axis=1)])[:, None]
    w = Whitening(n, sums, u, e, trace)
    return Whitening(n, sums, u, e, trace, _identity_error(fit, w))


def whiten(embeddings: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """One row for each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``embeddings``: vec_id, embedding; other columns are not read. NULL vectors, NULL and non-finite entries drop the
    row (see :func:`scaled`); shorter vectors count as if they ended with zeros; a NULL vec_id is kept. Repeated rows
    give rows each, but count once in the statistics. No usable row, or no variance, gives no rows. ``deviation`` is
    NULL where it exceeds a long. Vectors are shuffled once, to find the distinct ones; all else moves one
    row for each pair of dimensions and task.
    """
    rows = scaled(embeddings, scale)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    least, dims = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if dims and least < dims:
        rows = padded(rows, dims)
    w = fit_whitening(rows, dims, components) if dims else None
    if w is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    share = (w.eigenvalues / w.trace).tolist()
    k = len(share)

    def run(batches: Iterable):
        import pyarrow as pa

        for b in slices(batches):
            x = matrix(b.column(1), dims)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), w.n, np.int64)),
                    pa.array(w.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(w.project(x).ravel()),
                    pa.array(np.tile(share, len(x))),
                    pa.array(np.full(len(each), w.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
