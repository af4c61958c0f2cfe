"""Nearest neighbours by multi-index hashing of learned binary codes.

A rotation is learned on a bounded sample so that the signs of the rotated vectors keep nearness
(iterative quantisation). A code is cut into short substrings, each indexed by value. Two codes
within a Hamming radius agree in some substring up to the radius divided by the number of
substrings (pigeonhole), so probing the values that near in every substring finds all of them; their
vectors are then ranked by the true cosine. The radius is set on the sample so that it covers the
true neighbours, and grows for a query that finds too few.

Every row is indexed. Rows are dealt into shards of bounded size and queries into blocks; each
(shard, block) pair is one task's work, and only the best few per query and shard leave it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.session import staged

SAMPLE = 20_000  # rows the rotation is learned on, at most about
TRIALS = 400  # of them, rows whose true neighbours set the radius
SHARD = 131_072  # rows of an index shard
BLOCK = 65_536  # queries handled together
SUBSTRING = 8  # bits
BITS = 64

RESULT = "query_id long, vec_id long, score double"


@dataclass
class Codes:
    """A learned rotation and the radius that goes with it."""

    mean: np.ndarray
    turn: np.ndarray  # dimension x bits
    radius: int

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """One row of bytes per vector; a byte is a substring."""
        return np.packbits((_unit(vectors) - self.mean) @ self.turn > 0, axis=1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _apart(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ many).sum(axis=1, dtype=np.int64)


def learn(sample: np.ndarray, k: int, rounds: int = 40, covered: float = 0.98) -> Codes:
    """Principal axes turned so that signs lose least; the radius covers that share of true neighbours."""
    unit = _unit(sample)
    mean = unit.mean(axis=0)
    bits = min(BITS, sample.shape[1])
    axes = np.linalg.svd(np.cov((unit - mean).T, bias=True).reshape(len(mean), len(mean)))[0][:, :bits]
    low = (unit - mean) @ axes
    turn = np.linalg.qr(np.random.Generator(np.random.PCG64(7)).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
        turn = (left @ right).T
    codes = Codes(mean, axes @ turn, bits)
    each, seen = codes.of(sample), []
    for i in range(0, len(sample), max(1, len(sample) // TRIALS)):
        score = unit @ unit[i]
        score[i] = -2
        near = np.argsort(-score)[: min(k, len(sample) - 1)]
        seen.append(_apart(each[i], each[near]))
    distances = np.concatenate(seen) if seen else np.zeros(0)
    codes.radius = int(np.quantile(distances, covered, method="higher")) if len(distances) else bits
    return codes


def probes(radius: int) -> np.ndarray:
    """Substring values within ``radius`` bits of zero; a query's own are these, turned by its value."""
    values = np.arange(1 << SUBSTRING, dtype=np.uint8)
    return values[np.bitwise_count(values) <= radius]


class Index:
    """The rows of one shard by each substring's value."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.order = [np.argsort(column, kind="stable") for column in codes.T]
        self.start = [np.searchsorted(column[order], np.arange((1 << SUBSTRING) + 1)) for column, order in zip(codes.T, self.order, strict=True)]

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Numbers of all rows whose code differs from ``query`` in ``radius`` bits or fewer."""
        parts = len(self.order)
        each, more = divmod(radius, parts)
        found = np.zeros(len(self.codes), bool)
        for j in range(parts):
            # If the first ``more + 1`` substrings all differ in over ``each`` bits, another is closer than that.
            reach = each if j <= more else each - 1
            if reach < 0:
                continue
            start, order = self.start[j], self.order[j]
            for value in probes(reach) ^ query[j]:
                found[order[start[value] : start[int(value) + 1]]] = True
        at = np.flatnonzero(found)
        return at[_apart(query, self.codes[at]) <= radius]


def _search(codes: Codes, k: int) -> Callable[[pa.Table], pa.Table]:
    def search(group: pa.Table) -> pa.Table:
        rows = group.combine_chunks()
        vectors = np.asarray(rows["embedding"].combine_chunks().flatten(), np.float64).reshape(len(rows), -1)
        ids, asks = np.asarray(rows["vec_id"]), np.asarray(rows["asks"])
        known, known_ids = vectors[~asks], ids[~asks]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(known) and asks.any():
            index = Index(codes.of(known))
            norms = np.sqrt((known * known).sum(axis=1))
            for query_id, vector, code in zip(ids[asks], vectors[asks], codes.of(vectors[asks]), strict=True):
                radius = codes.radius
                at = index.within(code, radius)
                at = at[known_ids[at] != query_id]
                while len(at) < k and radius < codes.bits:
                    radius = min(codes.bits, radius + len(code))
                    at = index.within(code, radius)
                    at = at[known_ids[at] != query_id]
                score = (known[at] * vector).sum(axis=1) / (norms[at] * np.sqrt((vector * vector).sum()))
                if len(at) > k:
                    best = np.flatnonzero(score >= np.partition(score, -k)[-k])
                    at, score = at[best], score[best]
                top = np.lexsort((known_ids[at], -score))[:k]
                out.append((np.full(len(top), query_id), known_ids[at][top], score[top]))
        columns = zip(*out, strict=True) if out else ([], [], [])
        arrays = [np.concatenate([np.zeros(0, kind), *c]) for c, kind in zip(columns, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), arrays, strict=True)))

    return search


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that can be compared, one per id.

    Out are null ids, vectors that are null, zero, or hold null or non-finite components, and
    vectors not as long as most are. Of rows that share an id the smallest vector counts.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = given.filter(F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))
    one = staged(sound.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    sizes = one.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return one.filter(F.size("embedding") == (sizes["d"] if sizes else 0))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each id divisible by ``every``.

    ``score`` is the cosine of the original vectors in double precision; ties go to the smaller id;
    rows with the query's own id are no candidates; with fewer candidates than ``k`` all are
    given. See ``usable`` for rows that take no part. An empty table gives an empty result.
    """
    rows = usable(vectors)
    total = rows.count()
    asked = F.col("vec_id") % every == 0
    asking = rows.filter(asked).count()
    share = max(1, total // SAMPLE)
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(drawn):
        drawn = rows.limit(1).select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(drawn):
        return rows.selectExpr("vec_id AS query_id", "0 AS rank", "vec_id", "0D AS score")
    codes = learn(np.asarray(drawn.flatten()).reshape(len(drawn), -1), k)
    shards = max(-(-total // SHARD), min(12, -(-total // 2048)))
    blocks = max(1, -(-asking // BLOCK))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    known = rows.withColumn("shard", place(shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = rows.filter(asked).withColumn("block", place(blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = known.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True)))
    found = both.groupBy("shard", "block").applyInArrow(_search(codes, k), RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
