"""Embedding whitening by shifted CholeskyQR: no covariance matrix is ever split into eigenvectors.

Vectors become whole numbers, floor(256 * entry); the fit list holds each distinct one once. Its rows, centred and each
dimension divided by its widest deviation, are a tall matrix A. One distributed pass adds up the Gram matrix of A, the
Cholesky factor of that matrix (shifted, as A may be nearly singular) is the first R; every later pass solves the rows
through all factors found so far, adds up their Gram matrix again and gives the next factor, until the rows are orthonormal.
The product of the factors is the R of A = QR, exact to rounding even where the covariance is far beyond double precision.
The singular value decomposition of R gives variances and components; a row whitened is its row of Q turned by
the left singular vectors, which is its projection on the component over the component's deviation.

Only matrices of dimensions x dimensions come to the driver or go to the tasks.

Defined results: a vector that is null, empty or has a null or non-finite entry is left out; so are vectors of another length
than that of most (of equally many, the longer). Whole numbers beyond 2^61 count as 2^61, with their sign. Equal vectors are
one row of the fit list, and each of their rows is whitened. Components whose deviation is below 1e-12 of the first one's
(constant or dependent dimensions, fewer vectors than components) are not returned; a table without two distinct vectors has
no components, and its result is empty. A ``deviation`` beyond 64 bits is null. Rows with a null id stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.llm.tables import written

SCALE = 256
LARGEST = 1 << 61
#: Passes of the factorisation, at most; four are usual.
PASSES = 12
#: Deviation of a component, as a share of the first one's, below which it counts as none.
LEAST_DEVIATION = 1e-12
#: Tasks that add up the matrices of all others, before one adds up theirs.
ADDERS = 16
_UNIT = float(np.finfo(float).eps) / 2


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors of ``dims`` entries. ``base`` + ``rest`` / n is the mean, in whole numbers and exact."""

    dims: int = 0
    n: int = 0
    base: tuple[int, ...] = ()
    rest: tuple[int, ...] = ()
    widest: int = 0
    active: tuple[int, ...] = ()
    spans: tuple[float, ...] = ()
    factors: tuple[np.ndarray, ...] = ()
    turn: np.ndarray | None = None
    #: Unit eigenvectors of the covariance in columns, their eigenvalues, and the covariance's trace.
    components: np.ndarray | None = None
    variances: tuple[float, ...] = ()
    trace: float = 0.0
    identity_error: float | None = None

    def offsets(self, rows: np.ndarray) -> np.ndarray:
        return rows - np.array(self.base, dtype=np.int64)

    def orthogonal(self, rows: np.ndarray) -> np.ndarray:
        """Centred and scaled rows, solved through the factors found so far."""
        at = list(self.active)
        out = (self.offsets(rows)[:, at] - np.array([self.rest[k] / self.n for k in at])) / np.array(self.spans)
        for factor in self.factors:
            out = solved(out, factor)
        return out

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        return self.orthogonal(rows) @ self.turn

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - S)^2, in whole numbers."""
        off, rest = self.offsets(rows), list(self.rest)
        if self.dims * (2 * self.n * (self.widest + 1)) ** 2 < 1 << 63:
            return ((self.n * off - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        sums = [sum((self.n * x - r) ** 2 for x, r in zip(row, rest, strict=True)) for row in off.tolist()]
        return [s if s < 1 << 63 else None for s in sums]


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangular matrix, by substitution column after column."""
    out = np.empty_like(rows)
    for k in range(upper.shape[1]):
        out[:, k] = (rows[:, k] - out[:, :k] @ upper[:k, k]) / upper[k, k]
    return out


def whole_numbers(frame: DataFrame, vector: str, name: str) -> DataFrame:
    """``frame`` with ``name``, its vectors as whole numbers, less the rows whose vector does not count."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    limit = F.lit(float(LARGEST))
    entry = lambda c: F.floor(F.least(limit, F.greatest(-limit, c.cast("double") * SCALE))).cast("long")
    return frame.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(finite).withColumn(name, F.transform(vector, entry))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _ranges(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each dimension: number, sum, least and greatest of the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, [0] * dims, [LARGEST] * dims, [-LARGEST] * dims
        for batch in batches:
            rows = matrix(batch.column("x"), dims)
            if not len(rows):
                continue
            n, low, high = n + len(rows), np.minimum(low, rows.min(axis=0)), np.maximum(high, rows.max(axis=0))
            # Halves of 31 bits, so that a sum of a batch stays within 64.
            upper = rows >> 31
            sums = zip(upper.sum(axis=0).tolist(), (rows - (upper << 31)).sum(axis=0).tolist(), strict=True)
            total = [t + (u << 31) + v for t, (u, v) in zip(total, sums, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([
                pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()),
                pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
            ], names=["dim", "n", "total", "low", "high"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for held in batch.column(0):
            one = np.frombuffer(held.as_py())
            total = one if total is None else total + one
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["gram"])


def gram(fit_list: DataFrame, dims: int, rows_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The Gram matrix of ``rows_of`` all rows: one matrix of each task, added up in two more steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = rows_of(matrix(batch.column("x"), dims))
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["gram"])

    parts = fit_list.mapInArrow(run, "gram binary").repartition(ADDERS).mapInArrow(_added, "gram binary")
    found = parts.coalesce(1).mapInArrow(_added, "gram binary").first()
    return np.frombuffer(found.gram).reshape(width, width) if found else np.zeros((width, width))


def _factor(found: np.ndarray, n: int, first: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix, shifted where rounding could make it indefinite."""
    width = len(found)
    values = np.linalg.eigvalsh(found)
    shift = 11 * (n * width + width * (width + 1)) * _UNIT * values[-1]
    near = first or values[0] <= 100 * shift
    while True:
        try:
            return np.linalg.cholesky(found + (shift if near else 0) * np.eye(width)).T
        except np.linalg.LinAlgError:
            near, shift = True, 10 * max(shift, _UNIT)


def _with_factors(model: Whitening, fit_list: DataFrame) -> Whitening:
    width, before = len(model.active), np.inf
    for k in range(PASSES):
        found = gram(fit_list, model.dims, model.orthogonal, width)
        off = float(np.abs(found - np.eye(width)).max())
        if off <= 16 * width * _UNIT or (k > 3 and off > before / 2):
            break
        model, before = replace(model, factors=(*model.factors, _factor(found, model.n, k == 0))), off
    return model


def fit(frame: DataFrame, most: int, vector: str = "embedding") -> Whitening:
    """The whitening of at most ``most`` components, by all vectors of ``frame``."""
    rows = whole_numbers(frame, vector, "x").select("x")
    usual = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if usual is None:
        return Whitening()
    dims = usual.dims
    fit_list = written(rows.filter(F.size("x") == dims).distinct(), "fit-list")
    ranges = (
        fit_list.mapInArrow(_ranges(dims), "dim int, n long, total decimal(38,0), low long, high long")
        .groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
        .orderBy("dim").collect()
    )
    n, totals = ranges[0].n, [int(r.total) for r in ranges]
    base = [(2 * t + n) // (2 * n) for t in totals]
    spans = [max(r.high - b, b - r.low) for r, b in zip(ranges, base, strict=True)]
    active = tuple(k for k, r in enumerate(ranges) if r.high > r.low)
    model = Whitening(
        dims, n, tuple(base), tuple(t - n * b for t, b in zip(totals, base, strict=True)), max(spans), active,
        tuple(float(spans[k]) for k in active),
    )
    if not active:
        return model
    model = _with_factors(model, fit_list)
    whole = np.diag(model.spans)
    for factor in model.factors:
        whole = factor @ whole
    left, deviations, right = np.linalg.svd(whole)
    kept = int((deviations > LEAST_DEVIATION * deviations[0]).sum())
    kept = min(most, kept)
    components = np.zeros((dims, kept))
    components[list(active)] = right[:kept].T
    # Of either sign the one whose largest entry is positive.
    sign = np.sign(components[np.abs(components).argmax(axis=0), np.arange(kept)])
    model = replace(
        model, turn=left[:, :kept] * sign * np.sqrt(n), components=components * sign,
        variances=tuple((deviations[:kept] ** 2 / n).tolist()), trace=float((deviations**2).sum() / n),
    )
    held = gram(fit_list, dims, lambda x: np.column_stack([model.whitened(x), np.ones(len(x))]), kept + 1)
    means = held[-1, :-1] / n
    covariance = held[:-1, :-1] / n - np.outer(means, means)
    return replace(model, identity_error=float(np.abs(covariance - np.eye(kept)).max()))


def whiten(frame: DataFrame, model: Whitening, vector: str = "embedding", keep: Sequence[str] = ("vec_id",)) -> DataFrame:
    """A row for each vector that counts and each component: the columns ``keep``, which do not bear a name given here, then
    ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    own = [frame.schema[c] for c in keep]
    schema = T.StructType([*own, *T._parse_datatype_string(
        "component int, n long, deviation long, whitened double, explained double, identity_error double"
    )])
    count = len(model.variances)
    share = [v / model.trace for v in model.variances]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(batch.num_columns - 1), model.dims)
            if not len(rows) or not count:
                continue
            at = np.repeat(np.arange(len(rows)), count)
            held = pa.array(model.deviations(rows), pa.int64()).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([
                *(batch.column(k).take(pa.array(at)) for k in range(batch.num_columns - 1)),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(at), model.n, dtype=np.int64)),
                held, pa.array(model.whitened(rows).ravel()), pa.array(np.tile(share, len(rows))), pa.array(np.full(len(at), model.identity_error)),
            ], names=schema.names)

    rows = whole_numbers(frame.select(*keep, F.col(vector).alias("whole numbers")), "whole numbers", "whole numbers")
    return rows.filter(F.size("whole numbers") == model.dims).mapInArrow(run, schema)
