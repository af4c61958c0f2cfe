"""Centroid clustering of integer vectors, filtered by n-simplex projection.

A few centroids serve as pivots. The distances of a vector to the pivots are measured once and
stored as the apex of a simplex over the pivots: its coordinates follow from the distances alone.
For two apexes the Euclidean distance is a lower bound of the true distance; with the last
coordinate of one turned over it is an upper bound. A centroid whose lower bound lies above the
smallest upper bound of all centroids cannot be nearest, and only the others are compared, in
exact integers.

The driver holds the centroids and one sum per centroid and dimension. Vectors stay where they are:
each round shuffles one partial sum per task, centroid and dimension, whatever their number.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.session import discard, staged

SCALE = 64  # a component x counts as floor(SCALE * x)
PIVOTS = 12
#: A pivot must stand this far above the simplex of the earlier ones, as a share of the largest distance.
ALTITUDE = 0.05
#: Rounding of squared bounds, as a share of the squared distances that they come from.
SLACK = 1e-5
CELLS = 2_000_000  # bounds held at once

PREPARED = "vec_id long, x array<int>, apex array<double>"
ASSIGNED = "vec_id long, cluster int, distance long"
SUMS = "cluster int, at int, total long, n long"


def largest(dimension: int) -> int:
    """Magnitude of an integer component from which squared distances need not fit a long."""
    return math.isqrt(2**61 // dimension)


def squared(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one point."""
    apart = x - point
    return np.einsum("ij,ij->i", apart, apart)


@dataclass
class Simplex:
    """Pivots and the coordinates of the simplex they span: pivot i + 1 is row i of ``base``."""

    pivots: np.ndarray
    base: np.ndarray

    def apexes(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of rows over the base, then the height above it, from distances to the pivots."""
        return self.placed(np.stack([squared(x, p) for p in self.pivots], axis=1).astype(float))

    def placed(self, far: np.ndarray) -> np.ndarray:
        """The same from squared distances, one column per pivot."""
        first = far[:, :1]
        if not len(self.base):
            return np.sqrt(first)
        against = (first - far[:, 1:] + (self.base**2).sum(axis=1)) / 2
        along = np.linalg.solve(self.base, against.T).T
        height = np.sqrt(np.maximum(0, first[:, 0] - (along**2).sum(axis=1)))
        return np.column_stack([along, height])


def span(points: np.ndarray, most: int = PIVOTS) -> Simplex:
    """Take pivots among ``points``, each the highest above the simplex of those before it."""
    simplex = Simplex(points[:1], np.zeros((0, 0)))
    while len(simplex.pivots) < most:
        apexes = simplex.apexes(points)
        farthest = np.sqrt((apexes**2).sum(axis=1).max())
        best = int(apexes[:, -1].argmax())
        if apexes[best, -1] <= ALTITUDE * farthest or apexes[best, -1] == 0:
            break
        size = len(simplex.base)
        base = np.zeros((size + 1, size + 1))
        base[:size, :size], base[size] = simplex.base, apexes[best]
        simplex = Simplex(np.vstack([simplex.pivots, points[best]]), base)
    return simplex


def candidates(apexes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """rows x centroids: whether a centroid may be nearest, by the bounds of their apexes."""
    lower = np.empty((len(apexes), len(centroids)))
    least = np.full(len(apexes), np.inf)
    size = (apexes**2).sum(axis=1)
    for number, centroid in enumerate(centroids):
        along = ((apexes[:, :-1] - centroid[:-1]) ** 2).sum(axis=1)
        slack = SLACK * (size + (centroid**2).sum())
        lower[:, number] = along + (apexes[:, -1] - centroid[-1]) ** 2 - slack
        least = np.minimum(least, along + (apexes[:, -1] + centroid[-1]) ** 2 + slack)
    return lower <= least[:, None]


def nearest(x: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centroid_apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row, the smaller one in a tie, and its squared distance."""
    cluster, distance = np.zeros(len(x), np.int32), np.full(len(x), np.iinfo(np.int64).max)
    step = max(1, CELLS // len(centroids))
    for start in range(0, len(x), step):
        part = slice(start, start + step)
        may = candidates(apexes[part], centroid_apexes)
        for number, centroid in enumerate(centroids):
            rows = np.flatnonzero(may[:, number]) + start
            exact = squared(x[rows], centroid)
            nearer = exact < distance[rows]
            cluster[rows[nearer]], distance[rows[nearer]] = number, exact[nearer]
    return cluster, distance


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind).reshape(len(column), -1)


def _integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors).astype(np.int64)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel(), kind))


def _prepare(simplex: Simplex) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _integers(_matrix(batch["embedding"], float))
                columns = [batch["vec_id"], _lists(x, pa.int32()), _lists(simplex.apexes(x), pa.float64())]
                yield pa.record_batch(columns, names=["vec_id", "x", "apex"])

    return prepare


def _assign(simplex: Simplex, centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apexes = simplex.apexes(centroids)
        for batch in batches:
            if len(batch):
                found = nearest(_matrix(batch["x"], np.int64), _matrix(batch["apex"], float), centroids, apexes)
                yield pa.record_batch([batch["vec_id"], *map(pa.array, found)], names=["vec_id", "cluster", "distance"])

    return assign


def _sum(simplex: Simplex, centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apexes = simplex.apexes(centroids)
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if len(batch):
                x = _matrix(batch["x"], np.int64)
                cluster, _ = nearest(x, _matrix(batch["apex"], float), centroids, apexes)
                np.add.at(total, cluster, x)
                n += np.bincount(cluster, minlength=len(n))
        for number in np.flatnonzero(n):
            size = centroids.shape[1]
            columns = [np.full(size, number, np.int32), np.arange(size, dtype=np.int32), total[number], np.full(size, n[number])]
            yield pa.record_batch([pa.array(c) for c in columns], names=["cluster", "at", "total", "n"])

    return add_up


def usable(vectors: DataFrame, dimension: int = 64) -> DataFrame:
    """(vec_id, embedding) of the rows with ``dimension`` components, all finite and below ``largest / SCALE``."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= largest(dimension) / SCALE))
    return given.filter((F.size("embedding") == dimension) & ~bad)


def _first(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The start: ``k`` rows by the hash of seed and id. Null ids come last; equal ids by their vectors."""
    named = rows.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    taken = named.orderBy(F.asc_nulls_last("hash"), "embedding").limit(k).collect()
    return _integers(np.array([row["embedding"] for row in taken], float))


def _moved(rows: DataFrame, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """Each centroid with vectors goes to their componentwise floor(sum / count); the others stay."""
    sums = rows.mapInArrow(_sum(simplex, centroids), SUMS).groupBy("cluster", "at")
    out = centroids.copy()
    for row in sums.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[row["cluster"], row["at"]] = int(row["total"]) // row["n"]
    return out


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dimension: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each usable row of ``vectors``.

    Rows whose vector is null, of another length, or holds null or non-finite components take no
    part, nor do those with a component of ``largest / 64`` or more, whose distances need not fit a long.
    Repeated rows and repeated ids count each for itself; null ids are clustered too. Fewer rows
    than ``k`` give as many centroids as rows; equal centroids leave the later ones empty, and
    empty ones stay where they are. An empty table gives an empty result. Other columns are ignored.
    A sum of distances that does not fit a long is null.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, dimension)
    centroids = _first(rows, k, seed)
    result = ASSIGNED + ", cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], result)
    simplex = span(centroids)
    prepared = staged(rows.mapInArrow(_prepare(simplex), PREPARED), "apexes")
    for _ in range(rounds):
        centroids = _moved(prepared, simplex, centroids)
    assigned = staged(prepared.mapInArrow(_assign(simplex, centroids), ASSIGNED), "assigned")
    discard(prepared)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()  # k rows
    inertia = {row["cluster"]: int(row["sum"]) for row in sums}
    total = sum(inertia.values())
    long = lambda value: value if value < 2**63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    of_cluster = [(number, long(value), long(total), digest(centroids[number])) for number, value in sorted(inertia.items())]
    found = spark.createDataFrame(of_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(found), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustered_sql(k: int = 16, rounds: int = 3, dimension: int = 64, seed: int = 1) -> str:
    """The same by comparing every vector with every centroid, as DuckDB SQL."""
    apart = "list_sum(list_transform(list_zip(kept.v, c{0}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        f"""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY hash) - 1 AS cluster, v
    FROM (SELECT v, sha256('{seed}:' || vec_id) AS hash FROM kept ORDER BY hash LIMIT {k}))""",
    ]
    for step in range(rounds + 1):
        parts.append(f"""a{step} AS MATERIALIZED (
    SELECT row, vec_id, v, best.c AS cluster, best.d AS distance FROM (
        SELECT kept.row, any_value(vec_id) AS vec_id, any_value(kept.v) AS v, min({{'d': {apart.format(step)}, 'c': cluster}}) AS best
        FROM kept CROSS JOIN c{step} GROUP BY kept.row))""")
        if step < rounds:
            parts.append(f"""m{step} AS (
    SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM (
        SELECT cluster, i, sum(v[i]) AS total, count(*) AS n FROM a{step}, (SELECT unnest(range(1, {dimension + 1})) AS i) GROUP BY cluster, i)
    GROUP BY cluster),
c{step + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{step}.v, c{step}.v) AS v FROM c{step} LEFT JOIN m{step} USING (cluster))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""
