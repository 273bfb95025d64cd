"""Embedding whitening: distributed covariance, float32 eigenvectors refined in higher precision by matrix products."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries become whole numbers floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries from here on do not fit a long when scaled; their rows are dropped like non-finite ones.
LARGEST = 2.0**55
_LONG = 2**63
MOST_ROUNDS = 12


@dataclass
class Whitening:
    """What all rows share: the fit's sums, its components and how well they whiten."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors as columns
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole and fractional part of each dimension's mean, so that centring loses no digits."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])

    def weights(self, components: int) -> np.ndarray:
        """Columns that map centred rows to whitened components; NaN where a component has no variance."""
        k = min(components, len(self.values))
        floor = len(self.values) * np.finfo(float).eps * max(self.values[0], 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values[:k] > floor, self.vectors[:, :k] / np.sqrt(self.values[:k]), np.nan)


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(``id``, ``v``) of rows whose vector is there and holds finite entries only."""
    fits = lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False))  # noqa: E731  false for NaN: it is the largest
    rows = table.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v"))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(F.forall("v", fits))


def whole(column: pa.Array, d: int) -> np.ndarray:
    """A list column of ``d`` entries each as rows of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, d) + OFFSET


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums that never overflow."""
    top = int(np.abs(x).max()) if x.size else 0
    if top * len(x) < _LONG:
        return x.sum(axis=0).tolist()
    return x.astype(object).sum(axis=0).tolist()


def column_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension: one row per task and dimension is added up by Spark."""

    def per_task(batches):
        from decimal import Decimal

        n, total = 0, [0] * d
        for batch in batches:
            n += batch.num_rows
            total = [a + b for a, b in zip(total, exact_sums(whole(batch.column("v"), d)))]
        if n:
            sums = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), sums], ["i", "n", "s"])

    parts = rows.select("v").mapInArrow(per_task, "i int, n bigint, s decimal(38,0)")
    found = sorted(parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect(), key=lambda r: r["i"])
    return (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [])


def second_moments(rows: DataFrame, d: int, fit: Whitening, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and mean outer product of centred rows, or of centred rows times ``weights``; divisor n.

    A task keeps one matrix, and Spark adds them up entry by entry, so what
    comes back has the square of the dimension however many rows or tasks there are.
    """
    n, (base, rest) = fit.n, fit.mean
    size = d if weights is None else weights.shape[1]

    def per_task(batches):
        gram, total = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            y = (whole(batch.column("v"), d) - base).astype(np.float64) - rest
            if weights is not None:
                y = y @ weights
            gram += y.T @ y
            total += y.sum(axis=0)
        i, j = np.triu_indices(size)
        i, j = np.concatenate([i, np.arange(size)]), np.concatenate([j, np.full(size, -1)])
        held = np.concatenate([gram[np.triu_indices(size)], total])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(held)], ["i", "j", "x"])

    parts = rows.select("v").mapInArrow(per_task, "i int, j int, x double")
    found = parts.groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    i, j, x = (found[c].to_numpy() for c in ("i", "j", "x"))
    out, mean = np.zeros((size, size)), np.zeros(size)
    cell = j >= 0
    out[i[cell], j[cell]] = x[cell] / n
    out = np.triu(out) + np.triu(out, 1).T
    mean[i[~cell]] = x[~cell] / n
    return mean, out


def clusters(near: np.ndarray) -> list[np.ndarray]:
    """Runs of two or more neighbours, in order of eigenvalue, that are too close to be told apart."""
    cuts = np.flatnonzero(~np.diagonal(near, 1)) + 1
    return [c for c in np.split(np.arange(len(near)), cuts) if len(c) > 1]


def refined(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, to the precision of a double.

    float32 eigenvectors X are corrected in extended precision by Ogita and
    Aishima's iteration: R = I - X'X measures how far X is from orthonormal,
    S = X'AX how far from diagonal, and X + XE with E from both doubles the number
    of right digits, by matrix products only. Pairs of eigenvalues closer
    than the error bound get no correction from their gap; each run of such is
    a sub-solve: the matrix is projected on the run's vectors, shifted by
    their mean eigenvalue, so that the small gaps are its leading digits, solved
    and turned back into X. Equal eigenvalues keep an orthonormal basis.
    """
    scale = np.abs(matrix).max()
    if not scale:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    a = matrix.astype(np.longdouble) / np.longdouble(scale)
    _, x = np.linalg.eigh((matrix / scale).astype(np.float32))
    x = x.astype(np.longdouble)
    one = np.eye(len(a), dtype=np.longdouble)
    norm = np.sqrt((a * a).sum())
    for _ in range(MOST_ROUNDS):
        r, s = one - x.T @ x, x.T @ a @ x
        s = (s + s.T) / 2  # else rounding over a small gap would turn X out of orthonormal
        value = np.diagonal(s) / (1 - np.diagonal(r))
        order = np.argsort(-value, kind="stable")
        x, value, r, s = x[:, order], value[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = s - np.diag(value)
        bound = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        gap = value[None, :] - value[:, None]
        near = np.abs(gap) <= bound
        e = np.where(near, r / 2, (s + value[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ e
        runs = clusters(near)
        for run in runs:
            own = x[:, run]
            middle = value[run].mean()
            inner = own.T @ (a @ own) - middle * (own.T @ own)
            span = np.abs(inner).max()
            if span > 0:
                x[:, run] = own @ np.linalg.eigh((inner / span).astype(np.float64))[1][:, ::-1].astype(np.longdouble)
        if np.abs(e).max() < np.finfo(np.float64).eps / 8:
            break
    x = x + x @ (one - x.T @ x) / 2
    value = ((a @ x) * x).sum(axis=0)
    order = np.argsort(-value, kind="stable")
    x, value = x[:, order], value[order] * np.longdouble(scale)
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(x))] < 0, -1, 1)
    return value.astype(np.float64), x.astype(np.float64)


def fitted(rows: DataFrame, d: int, components: int) -> Whitening:
    """The whitening of all ``rows``, with the largest error of its own covariance."""
    n, sums = column_sums(rows, d)
    fit = Whitening(n, sums, np.zeros(d), np.eye(d), 0.0)
    mean, second = second_moments(rows, d, fit)
    covariance = second - np.outer(mean, mean)
    fit.values, fit.vectors = refined(covariance)
    fit.trace = float(np.trace(covariance))
    weights = fit.weights(components)
    weights = weights[:, ~np.isnan(weights).any(axis=0)]
    if weights.shape[1]:
        mean, second = second_moments(rows, d, fit, weights)
        fit.identity_error = float(np.abs(second - np.outer(mean, mean) - np.eye(weights.shape[1])).max())
    return fit


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sums of squares of n*x - S, exact; null beyond a long."""
    top = max((abs(s) for s in sums), default=0) + n * int(np.abs(x).max(initial=0))
    if top * top * len(sums) < _LONG:
        y = n * x - np.array(sums, np.int64)
        return pa.array((y * y).sum(axis=1))
    y = n * x.astype(object) - np.array(sums, object)
    totals = (y * y).sum(axis=1).tolist()
    return pa.array([t if t < _LONG else None for t in totals], pa.int64())


def whitened(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 32) -> DataFrame:
    """One row per usable vector and component: id, ``component`` from 1, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Vectors that are null or hold null, NaN or infinite entries are dropped, and
    entries beyond ``LARGEST``, which no long holds when scaled. Vectors of any
    other length than the most frequent one (of equals the longest) are
    dropped too; empty ones are no vectors. Repeated rows count and come back as
    often as they are there; null ids are ids. A component without variance
    has a null ``whitened`` and 0 ``explained``; ``identity_error`` is over the others, null
    if there are none. A ``deviation`` that no long holds is null. An empty table, or
    one without usable vectors, gives no rows. No other column is read.
    """
    kind = dict(table.dtypes)[id_column]
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = usable(table, id_column, vector_column)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return table.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    d = length["d"]
    rows = rows.where(F.size("v") == d)
    fit = fitted(rows, d, components)
    weights, (base, rest), n = fit.weights(components), fit.mean, fit.n
    k = weights.shape[1]
    explained = fit.values[:k] / fit.trace if fit.trace > 0 else np.zeros(k)
    explained[np.isnan(weights).any(axis=0)] = 0
    error, sums = fit.identity_error, fit.sums

    def per_batch(batches):
        step = max(1, (1 << 17) // k)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                m = part.num_rows
                x = whole(part.column("v"), d)
                y = ((x - base).astype(np.float64) - rest) @ weights
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)),
                        deviations(x, n, sums).take(each),
                        pa.array(y.ravel(), from_pandas=True),  # NaN is null
                        pa.array(np.tile(explained, m)),
                        pa.array([error] * (m * k), pa.float64()),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(per_batch, schema).withColumnRenamed("id", id_column)
