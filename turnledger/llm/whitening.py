"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Vectors are turned to integers, so that their sums are exact, and centred before they are multiplied.
Each task adds up the scatter of its own rows; only sums per pair of dimensions are shuffled and
reach the driver. There the centred scatter is factored with pivoting, largest remaining variance
first, and the columns of the triangular factor are rotated in pairs until all are orthogonal: their
squared norms are the eigenvalues and the columns of unit length the components. The factor is never
multiplied out again, so small eigenvalues keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.session import staged

SCALE, SHIFT = 64, 1_000_000  # an entry c counts as floor(SCALE * c) + SHIFT
LARGEST = 2.0**51  # magnitude of SCALE * c from which that is no exact double
LOW = 26  # bits of the lower half of an integer, so that halves add up without overflow
SWEEPS = 60

SUMS = "at int, high long, low long, n long"
SCATTER = "i int, j int, value double"
WHITE = "vec_id long, deviation decimal(38,0), whitened array<double>"


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order): ``factor @ factor.T`` is ``a`` with rows and columns in ``order``.

    The factor is lower triangular with as many columns as ``a`` has rank in double precision.
    """
    size = len(a)
    order, rest = np.arange(size), a.diagonal().astype(float).copy()
    factor = np.zeros((size, size))
    least = 8 * size * np.finfo(float).eps * rest.max(initial=0)
    for k in range(size):
        best = k + int(rest[order[k:]].argmax())
        if rest[order[best]] <= least:
            return factor[:, :k], order
        order[[k, best]], factor[[k, best]] = order[[best, k]], factor[[best, k]]
        factor[k, k] = np.sqrt(rest[order[k]])
        below = order[k + 1 :]
        factor[k + 1 :, k] = (a[below, order[k]] - factor[k + 1 :, :k] @ factor[k, :k]) / factor[k, k]
        rest[below] -= factor[k + 1 :, k] ** 2
    return factor, order


def _rounds(columns: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of columns, in rounds of pairs that share none."""
    seats = list(range(columns + columns % 2))
    half, out = len(seats) // 2, []
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:]), strict=True) if max(a, b) < columns]
        out.append((np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def orthogonal_columns(factor: np.ndarray) -> np.ndarray:
    """Rotate pairs of columns until each pair is orthogonal in double precision."""
    turned, exact = factor.copy(), 4 * np.finfo(float).eps
    rounds = _rounds(factor.shape[1]) if factor.shape[1] > 1 else []
    for _ in range(SWEEPS):
        moved = False
        for p, q in rounds:
            one, two = turned[:, p], turned[:, q]
            first, second, mixed = (one * one).sum(axis=0), (two * two).sum(axis=0), (one * two).sum(axis=0)
            open_ = np.abs(mixed) > exact * np.sqrt(first * second)
            if not open_.any():
                continue
            moved = True
            ratio = (second - first) / (2 * np.where(open_, mixed, 1))
            tangent = np.where(open_, np.where(ratio < 0, -1, 1) / (np.abs(ratio) + np.hypot(1, ratio)), 0)
            cosine = 1 / np.hypot(1, tangent)
            turned[:, p], turned[:, q] = cosine * (one - tangent * two), cosine * (tangent * one + two)
        if not moved:
            break
    return turned


def principal(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors as columns, with their largest entry positive."""
    factor, order = pivoted_cholesky(covariance)
    turned = orthogonal_columns(factor)
    values = (turned**2).sum(axis=0)
    by_size = np.argsort(-values, kind="stable")
    axes = np.zeros_like(turned)
    axes[order] = turned[:, by_size] / np.sqrt(values[by_size])
    if axes.size:
        axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return values[by_size], axes


@dataclass
class Whitening:
    """What ``fit`` learns. ``sums`` are exact; ``scatter`` is over the fit list, centred."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray  # dimension x components
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else self.values


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(float).reshape(len(column), -1)


def _integers(column: pa.Array) -> np.ndarray:
    return np.floor(SCALE * _matrix(column)).astype(np.int64) + SHIFT


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    high, low, n = 0, 0, 0
    for batch in batches:
        if len(batch):
            x = _integers(batch["embedding"])
            high, low, n = high + (x >> LOW).sum(axis=0), low + (x & (1 << LOW) - 1).sum(axis=0), n + len(x)
    if n:
        columns = [np.arange(len(high), dtype=np.int32), high, low, np.full(len(high), n)]
        yield pa.record_batch([pa.array(c) for c in columns], names=["at", "high", "low", "n"])


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """floor(sums / n), and what is left of the sums."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)


def _centred(column: pa.Array, n: int, sums: list[int]) -> np.ndarray:
    whole, left = _centre(n, sums)
    return (_integers(column) - whole).astype(float) - left / n


def scatter(rows: DataFrame, centred: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum of the products of all pairs of columns of ``centred``, which are so many; (size, size) on the driver."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = centred(batch)
                total = x.T @ x if total is None else total + x.T @ x
        for i in range(0 if total is None else size):
            j = np.arange(i, size, dtype=np.int32)
            yield pa.record_batch([pa.array(c) for c in (np.full(len(j), i, np.int32), j, total[i, i:])], names=["i", "j", "value"])

    found = rows.mapInArrow(multiply, SCATTER).groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((size, size))
    i, j, value = (found[name].to_numpy() for name in ("i", "j", "value"))
    out[i, j] = out[j, i] = value
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows whose vector is finite, not empty, and as long as most are."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST / SCALE))
    sound = given.filter((F.size("embedding") > 0) & ~bad)
    most = sound.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return sound.filter(F.size("embedding") == (most["d"] if most else 0))


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """Sums, covariance and principal components of all ``rows`` of ``usable``; None if there are none."""
    totals = rows.mapInArrow(_add_up, SUMS).groupBy("at").agg(F.sum("high"), F.sum("low"), F.sum("n")).orderBy("at").collect()
    if not totals:
        return None
    n, sums = totals[0][3], [(row[1] << LOW) + row[2] for row in totals]
    covariance = scatter(rows, lambda batch: _centred(batch["embedding"], n, sums), len(sums)) / n
    values, axes = principal(covariance)
    return Whitening(n, sums, values[:components], axes[:, :components], float(covariance.trace()))


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums of (n * x - sums)^2: in 64 bits where they fit, else in unbounded integers."""
    whole, left = _centre(n, sums)
    apart = x - whole
    if (float(np.abs(apart).max(initial=0)) + 1) * n * np.sqrt(len(sums)) < 2.0**31:
        return pa.array(((n * apart - left) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = ((n * apart.astype(object) - left.astype(object)) ** 2).sum(axis=1)
    return pa.array([value if value < 10**38 else None for value in exact], pa.decimal128(38, 0))


def _whiten(model: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        onto = model.axes / np.sqrt(model.values)
        for batch in batches:
            if len(batch):
                white = _centred(batch["embedding"], model.n, model.sums) @ onto
                ends = pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1])
                columns = [batch["vec_id"], _deviation(_integers(batch["embedding"]), model.n, model.sums),
                           pa.ListArray.from_arrays(ends, pa.array(white.ravel()))]
                yield pa.record_batch(columns, names=["vec_id", "deviation", "whitened"])

    return whiten


def whitened(vectors: DataFrame, components: int = 32) -> tuple[DataFrame, Whitening | None]:
    """(vec_id, deviation, whitened) of each usable row, and the fitted model.

    ``whitened`` holds the row's coordinates on the components, each of variance one over all rows;
    ``deviation`` is the exact sum over dimensions of (n * x - sum)^2, null beyond 38 digits.
    Rows whose vector is null, empty, or holds null or non-finite entries are left out, as are those
    of another length than most (the longer, in a tie) and those with a magnitude of 2^45 or more.
    Repeated rows and ids count each for itself, null ids too. There are as many components as
    the covariance has rank, so constant vectors or a single row give none, and an empty table
    gives an empty result without a model. Other columns are ignored.
    """
    rows = usable(vectors)
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], WHITE), None
    return staged(rows.mapInArrow(_whiten(model), WHITE), "whitened"), model


def identity_error(table: DataFrame, size: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity."""
    entry = table.select(F.posexplode("whitened")).groupBy("pos").agg(F.avg("col"), F.count("*"))
    means = {row[0]: row for row in entry.collect()}  # one per component
    if not means:
        return 0.0
    mean = np.array([means[k][1] for k in range(size)])
    covariance = scatter(table, lambda batch: _matrix(batch["whitened"]) - mean, size) / means[0][2]
    return float(np.abs(covariance - np.eye(size)).max())


def whitened_entries(vectors: DataFrame, components: int = 32) -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is null where it does not fit a long. See ``whitened`` for rows that take no part.
    """
    table, model = whitened(vectors, components)
    size = len(model.values) if model else 0
    error = identity_error(table, size)
    shares = F.array(*[F.lit(float(share)) for share in model.explained]) if size else F.array().cast("array<double>")
    entries = table.select("vec_id", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return entries.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
