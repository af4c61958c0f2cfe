"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.session import discard, staged


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) for each node ``a`` that is not the smallest of its component, with that smallest ``b``.

    Alternates hooking of larger and of smaller neighbours onto the least neighbour, which ends
    after a logarithmic number of rounds. Each round is two aggregates with partial minima and two
    joins, so a node with many edges is no single task's work; rounds are cut by stored tables.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = staged(edges, "edges"), None
    while (now := _digest(edges)) != before:
        before = now
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hooked = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = hooked.groupBy("a").agg(F.min("b").alias("m"))
        lower = hooked.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        done, edges = edges, staged(lower.union(least).distinct(), "edges")
        discard(done)
    return edges


def _digest(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0))).first())
