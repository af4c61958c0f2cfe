"""Filters of a usage query."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from turnledger.functions.columns import effort_of, local_day

VIEWS = ("dashboard", "series", "variants", "sessions", "tools", "heatmap", "comparison")


@dataclass(frozen=True)
class UsageQuery:
    """A view, an inclusive range of epoch milliseconds and optional filters (empty = all)."""

    from_utc: int
    to_utc: int
    view: str = "dashboard"
    sources: tuple[str, ...] = field(default=())
    models: tuple[str, ...] = field(default=())
    efforts: tuple[str, ...] = field(default=())
    workspaces: tuple[str, ...] = field(default=())
    rollup_to_base_model: bool = False


def in_days(df: DataFrame, q: UsageQuery) -> DataFrame:
    # The range is turned into local days the same way the days were written.
    return df.filter(
        F.col("day_local").between(local_day(F.lit(q.from_utc)), local_day(F.lit(q.to_utc)))
    )


def filter_daily(daily: DataFrame, q: UsageQuery) -> DataFrame:
    out = in_days(daily, q)
    if q.sources:
        out = out.filter(F.col("source").isin(*q.sources))
    if q.models:
        out = out.filter(F.col("base_model").isin(*q.models))
    if q.efforts:
        out = out.filter(effort_of(F.col("variant_id")).isin(*q.efforts))
    if q.workspaces:
        out = out.filter(F.col("workspace").isin(*q.workspaces))
    return out


def filter_records(records: DataFrame, q: UsageQuery) -> DataFrame:
    out = in_days(records, q)
    if q.sources:
        out = out.filter(F.col("source").isin(*q.sources))
    if q.models:
        out = out.filter(F.col("model").isin(*q.models))
    if q.efforts:
        out = out.filter(F.col("effort").isin(*q.efforts))
    if q.workspaces:
        out = out.filter(F.col("workspace").isin(*q.workspaces))
    return out


def filter_sessions(sessions: DataFrame, q: UsageQuery) -> DataFrame:
    """Sessions that overlap the range, by instant; they count whole. Models and efforts are ignored."""
    out = sessions.filter((F.col("first_ts_utc") <= q.to_utc) & (F.col("last_ts_utc") >= q.from_utc))
    if q.sources:
        out = out.filter(F.col("source").isin(*q.sources))
    if q.workspaces:
        out = out.filter(F.col("workspace").isin(*q.workspaces))
    return out
