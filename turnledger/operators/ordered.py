"""Running values over an ordered group that may be far larger than one task.

A plain window over ``keys`` sorts the whole group in one task, which fails when one log file
holds a third of all lines. Here every group comes in bounded, ordered chunks (a file block, a
range of ids). The value is found in two steps: inside a chunk by a window, and across chunks by a
window over one summary row per chunk. The big side is shuffled once, by (keys, chunk).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def scan(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: str,
    *,
    sums: Mapping[str, Column] | None = None,
    latest: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns to ``df``.

    ``sums``       running total up to and including the row
    ``latest``     last non-null value up to and including the row
    ``previous``   last non-null value strictly before the row
    ``following``  first non-null value strictly after the row

    ``chunk`` orders the chunks of a group; ``order`` is unique and ordered within one chunk.
    """
    sums, latest = dict(sums or {}), dict(latest or {})
    previous, following = dict(previous or {}), dict(following or {})
    keys = list(keys)
    position = F.col(order)

    summary = [F.sum(e).alias(f"_s_{n}") for n, e in sums.items()]
    for name, expr in {**latest, **previous}.items():
        summary.append(F.max_by(expr, F.when(expr.isNotNull(), position)).alias(f"_c_{name}"))
    for name, expr in following.items():
        summary.append(F.min_by(expr, F.when(expr.isNotNull(), position)).alias(f"_c_{name}"))

    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(1, Window.unboundedFollowing)
    carried = [F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums]
    carried += [
        F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_c_{n}")
        for n in (*latest, *previous)
    ]
    carried += [F.first(f"_c_{n}", ignorenulls=True).over(after).alias(f"_c_{n}") for n in following]
    chunks = df.groupBy(*keys, chunk).agg(*summary).select(*keys, chunk, *carried)

    local = Window.partitionBy(*keys, chunk).orderBy(order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    strictly_before = local.rowsBetween(Window.unboundedPreceding, -1)
    strictly_after = local.rowsBetween(1, Window.unboundedFollowing)
    inner = [F.sum(e).over(upto).alias(f"_i_{n}") for n, e in sums.items()]
    inner += [F.last(e, ignorenulls=True).over(upto).alias(f"_i_{n}") for n, e in latest.items()]
    inner += [
        F.last(e, ignorenulls=True).over(strictly_before).alias(f"_i_{n}")
        for n, e in previous.items()
    ]
    inner += [
        F.first(e, ignorenulls=True).over(strictly_after).alias(f"_i_{n}")
        for n, e in following.items()
    ]
    joined = df.select("*", *inner).join(chunks, [*keys, chunk], "left")
    out = [
        (F.coalesce(F.col(f"_i_{n}"), F.lit(0)) + F.col(f"_s_{n}")).alias(n) for n in sums
    ]
    out += [
        F.coalesce(F.col(f"_i_{n}"), F.col(f"_c_{n}")).alias(n)
        for n in (*latest, *previous, *following)
    ]
    return joined.select(*[c for c in df.columns], *out)
