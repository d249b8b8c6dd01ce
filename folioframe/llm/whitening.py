"""Whitening of embeddings by shifted CholeskyQR.

The centred rows are made orthogonal again and again: a pass over the rows adds up the Gram matrix of
the rows as they are by then, its Cholesky factor (of the matrix with a small shift on its diagonal, so
that it exists however close to each other the columns are) is the next R, and the rows are taken
through a triangular solve with all of the factors so far. When the Gram matrix is the identity, the
product of the factors is the R of the centred rows, and its singular value decomposition gives the
components to full precision, which an eigenvalue decomposition of the covariance does not.

Only sums of one number a dimension and Gram matrices come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, in_batches, stash

_LOW = (1 << 32) - 1
#: Passes of CholeskyQR at most, and how far from the identity the Gram matrix may be when they end.
PASSES, CLOSE = 8, 1e-12
_EPS = float(np.finfo(np.float64).eps)
_MAX = (1 << 63) - 1


def scaled(embedding: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component; null unless all components are finite numbers."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * factor).cast("long")))


@dataclass(frozen=True)
class Whitening:
    """Of the n distinct vectors of d dimensions: their sums, eigenvalues of their covariance (falling) and components (rows)."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, each from whole numbers, so that nothing is lost where x is close to the mean."""
        return _centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first k components of each row; NaN for a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values[:k] > 0, 1 / np.sqrt(self.values[:k]), np.nan)
        return self.centred(x) @ self.components[:k].T * scale

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S)^2 of each row, exact; beyond 64 bits the largest number of 64 bits."""
        sums = np.array([float(s) for s in self.sums])
        off = np.abs(x.astype(np.float64) * self.n) + np.abs(sums)
        out = np.zeros(len(x), np.int64)
        small = (off * off).sum(axis=1) < float(1 << 62)
        if small.any():
            part = x[small] * np.int64(self.n) - np.array([s if abs(s) <= _MAX else 0 for s in self.sums], np.int64)
            out[small] = (part * part).sum(axis=1)
        for i in np.flatnonzero(~small).tolist():
            out[i] = min(_MAX, sum((self.n * v - s) ** 2 for v, s in zip(x[i].tolist(), self.sums)))
        return out


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    whole = np.array([s // n for s in sums], np.float64)
    rest = np.array([s % n / n for s in sums])
    return (x.astype(np.float64) - whole) - rest


def _rows(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[np.ndarray]:
    """Batches of arrays of one length as matrices."""
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
            yield flat.reshape(batch.num_rows, -1)


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length of the vectors their number and sums by dimension, exact whatever their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _rows(batches):
            high, low = x >> 32, x & _LOW  # sums of parts fit in 64 bits
            d = x.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d)), pa.array(np.full(d, len(x))), pa.array(high.sum(axis=0)), pa.array(low.sum(axis=0))], ["i", "n", "high", "low"]
            )

    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = {}
    for (d,) in fit.select(F.size("x")).distinct().collect():
        if d:
            rows = in_batches(fit.where(F.size("x") == d).select("x"), run, "i long, n long, high long, low long")
            found = sorted(rows.groupBy("i").agg(F.sum("n").alias("n"), big("high"), big("low")).collect())
            out[d] = (found[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in found])
    return out


def _gram(fit: DataFrame, prepare, d: int) -> np.ndarray:  # noqa: ANN001
    """Sum over all rows of the outer products of what ``prepare`` makes of them: a task's sum, then the sum of those."""
    i, j = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _rows(batches):
            q = prepare(x)
            total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(i * d + j), pa.array(total[i, j])], ["at", "value"])

    summed = in_batches(fit.select("x"), run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    gram = np.zeros(d * d)
    gram[summed["at"].to_numpy()] = summed["value"].to_numpy()
    gram = gram.reshape(d, d)
    return gram + np.triu(gram, 1).T


def _factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor; with a shift from the first on, or as soon as there is none without."""
    d = len(gram)
    norm = float(np.linalg.norm(gram, 2))
    shift = 11 * (n * d + d * (d + 1)) * _EPS * norm if shifted else 0.0
    shift = min(shift, 1e-8 * norm)  # the bound grows with n; sums of whole numbers are better than it says
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, 100 * d * _EPS * norm)


def _solve(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """q times the inverse of the upper triangular r, column by column."""
    out = np.empty_like(q)
    for j in range(len(r)):
        out[:, j] = (q[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _fit(fit: DataFrame, n: int, sums: list[int], k: int) -> Whitening:
    d, known = len(sums), tuple(sums)
    # Columns of very different size would make the shift large for the small ones.
    squares = np.diag(_gram(fit, lambda x: _centred(x, n, known), d))
    size = np.sqrt(np.where(squares > 0, squares, 1.0))
    varied = np.flatnonzero(squares > 0)
    if not len(varied):
        return Whitening(n, known, np.zeros(d), np.eye(d), 0.0)
    factors: list[np.ndarray] = []

    def prepare(x: np.ndarray) -> np.ndarray:
        q = _centred(x, n, known)[:, varied] / size[varied]
        for r in factors:
            q = _solve(q, r)
        return q

    for turn in range(PASSES):
        gram = _gram(fit, prepare, len(varied))
        factors.append(_factor(gram, n, shifted=turn == 0))
        if np.abs(gram - np.eye(len(varied))).max() < CLOSE:
            break
    whole = np.zeros((d, d))
    product = np.diag(size[varied])
    for r in factors:
        product = r @ product
    whole[: len(varied), varied] = product
    _, s, components = np.linalg.svd(whole)
    s[s <= max(n, d) * _EPS * s[0]] = 0.0
    values = s * s / n
    found = Whitening(n, known, values, components, float(values.sum()))
    there = int(np.count_nonzero(values[:k]))
    # A row of whitened numbers with a one behind gives the mean, too.
    one = _gram(fit, lambda x: np.hstack([found.whitened(x, there), np.ones((len(x), 1))]), there + 1)
    mean = one[:there, there] / n
    covariance = one[:there, :there] / n - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(there)).max())
    return Whitening(n, known, values, components, found.trace, error)


def fit_whitening(vectors: DataFrame, k: int = 4) -> dict[int, Whitening]:
    """Whitenings of ``vectors`` (column ``x``, arrays of whole numbers), by their length.

    Each distinct vector counts once. Vectors of different lengths have whitenings of their own; null
    ones, and those without components, take no part. ``identity_error`` is measured over the first k
    components, by a pass over the rows. Rows are written once to the shared folder; each pass reads them.
    """
    distinct = stash(vectors.where("x IS NOT NULL").select("x").distinct(), "distinct-vectors")
    found = {d: _fit(distinct.where(F.size("x") == d), n, sums, k) for d, (n, sums) in _sums(distinct).items()}
    discard(distinct)
    return found


def whiten(vectors: DataFrame, fitted: dict[int, Whitening], k: int = 4, id_col: str = "vec_id") -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error`` of each row and component up to k.

    Components are numbered from 1 by falling variance. One without variance (to double precision) has a
    null ``whitened`` and explains 0, or null if no component has any; ``identity_error`` leaves such
    components out. Rows whose vector is null, empty, or of a length that was not fitted give nothing;
    null and repeated ids each come out; an empty table gives no rows. Other columns are not looked at.
    """
    kind = vectors.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), T.StructField("component", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("n", "deviation")],
              *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]]
    names = [f.name for f in fields]
    shared = vectors.sparkSession.sparkContext.broadcast(fitted)  # a matrix for each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                if d not in shared.value:
                    continue
                w, part = shared.value[d], batch.take(pa.array(np.flatnonzero(lengths == d)))
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)
                m = min(k, d)
                scores = w.whitened(x, m)
                explained = w.values[:m] / w.trace if w.trace else np.full(m, np.nan)
                same = np.repeat(np.arange(part.num_rows), m)
                none = lambda a: pa.array(a, mask=np.isnan(a))
                error = np.nan if w.identity_error is None else w.identity_error
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(same)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), part.num_rows)), pa.array(np.full(len(same), w.n)),
                     pa.array(w.deviation(x)[same]), none(scores.ravel()), none(np.tile(explained, part.num_rows)), none(np.full(len(same), error))],
                    names,
                )

    return in_batches(vectors.where("x IS NOT NULL").select(id_col, "x"), run, T.StructType(fields))
