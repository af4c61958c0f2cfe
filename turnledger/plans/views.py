"""The dashboard views, as queries over rollups and records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from turnledger.functions.columns import (
    NO_EFFORT,
    TOKEN_COLUMNS,
    effort_of,
    percent,
    ratio,
    usd,
)
from turnledger.operators.filters import (
    UsageQuery,
    filter_daily,
    filter_records,
    filter_sessions,
    in_days,
)
from turnledger.operators.pricing import long_context_keys, price_sums, unmapped_models
from turnledger.operators.rollups import (
    daily_rollup,
    hourly_rollup,
    session_rollup,
    session_sums,
    with_usd,
)

_MEASURES = (*TOKEN_COLUMNS, "total_tokens")
LEADERBOARD_ROWS = 20
HOURLY_MAX_RANGE_MS = 2 * 24 * 60 * 60 * 1000


def daily_series(daily: DataFrame, q: UsageQuery) -> DataFrame:
    kept = filter_daily(daily, q)
    if q.rollup_to_base_model:
        kept = kept.groupBy("day_local", "source", "base_model", "workspace").agg(
            *[F.sum(c).alias(c) for c in (*_MEASURES, "turns")],
            F.sum("cost_nano").cast("decimal(38,6)").alias("cost_nano"),
            F.sum("unknown_cost_turns").alias("unknown_cost_turns"),
        )
    return with_usd(kept).orderBy("day_local", "source", "base_model", "workspace")


def variant_breakdown(daily: DataFrame, q: UsageQuery) -> DataFrame:
    """Metrics per variant, or per base model; shares are of the filtered total."""
    group = "base_model" if q.rollup_to_base_model else "variant_id"
    rows = (
        filter_daily(daily, q)
        .groupBy(F.col(group).alias("_id"), "source")
        .agg(
            F.min("base_model").alias("base_model"),
            *[F.sum(c).alias(c) for c in (*_MEASURES, "turns")],
            F.sum("cost_nano").cast("decimal(38,6)").alias("cost_nano"),
            F.sum("unknown_cost_turns").alias("unknown_cost_turns"),
        )
        .withColumnRenamed("_id", "variant_id")
    )
    grand = rows.agg(F.sum("cost_nano").alias("_cost"), F.sum("total_tokens").alias("_tokens"))
    c = F.col
    cost = usd(c("cost_nano"))
    effort = F.lit(NO_EFFORT) if q.rollup_to_base_model else effort_of(c("variant_id"))
    all_input = c("cache_read_tokens") + c("input_tokens") + c("cache_creation_tokens")
    written = c("output_tokens") + c("reasoning_tokens")
    # One total row on the other side: a scalar, not a product of two tables.
    return rows.crossJoin(grand).select(
        "variant_id", "base_model", effort.alias("effort"), "source",
        *_MEASURES,
        cost.alias("cost_usd"),
        (c("unknown_cost_turns") > 0).alias("cost_unknown"),
        percent(cost, usd(c("_cost"))).alias("share_of_cost_pct"),
        percent(c("total_tokens"), c("_tokens")).alias("share_of_tokens_pct"),
        "turns",
        ratio(c("total_tokens"), c("turns")).alias("tokens_per_turn"),
        ratio(cost, c("turns")).alias("cost_per_turn"),
        ratio(c("output_tokens"), c("input_tokens")).alias("output_ratio"),
        ratio(c("reasoning_tokens"), written).alias("reasoning_intensity"),
        percent(c("cache_read_tokens"), all_input).alias("cache_efficiency_pct"),
        (ratio(cost, c("total_tokens")) * 1000).alias("blended_cost_per_1k"),
    ).orderBy(c("cost_usd").desc(), "variant_id", "source")


def session_leaderboard(sessions: DataFrame, q: UsageQuery, limit: int | None = None) -> DataFrame:
    """Sessions of the range by cost; ties by source and session id."""
    ranked = with_usd(filter_sessions(sessions, q)).orderBy(
        F.col("cost_usd").desc(), "source", "session_id"
    )
    return ranked.limit(limit) if limit else ranked


def _call_counts(tools: DataFrame, q: UsageQuery, *names: str) -> DataFrame:
    """Calls per record. A call has its record's day, so the range prunes days of the calls as well.

    Counted per record first: the join then meets one row per record and name.
    """
    in_range = in_days(tools, q)
    return in_range.groupBy(F.col("record_dedup_key").alias("dedup_key"), *names).agg(
        F.count("*").alias("_n")
    )


def tool_usage(tools: DataFrame, records: DataFrame, q: UsageQuery) -> DataFrame:
    kept = filter_records(records, q).select("dedup_key", "source")
    counts = (
        _call_counts(tools, q, "tool_name").join(kept, "dedup_key")
        .groupBy("tool_name", "source").agg(F.sum("_n").alias("count"))
    )
    # One row per tool and source: the total is taken over these few, not by counting again.
    grand = F.sum("count").over(Window.partitionBy())
    return (
        counts.withColumn("_all", grand)
        .select("tool_name", "source", "count", percent(F.col("count"), F.col("_all")).alias("share_pct"))
        .orderBy(F.col("count").desc(), "tool_name", "source")
    )


def tool_calls_by_day(tools: DataFrame, records: DataFrame, q: UsageQuery) -> DataFrame:
    kept = filter_records(records, q).select("dedup_key", "day_local")
    return (
        _call_counts(tools, q).join(kept, "dedup_key")
        .groupBy("day_local").agg(F.sum("_n").alias("count")).orderBy("day_local")
    )


def hourly_series(records: DataFrame, card: DataFrame, q: UsageQuery, long_keys: DataFrame | None = None) -> DataFrame:
    """Hours of the range. The long-context flag is one of all records: ``long_keys`` if they are known, else these are read."""
    hours = hourly_rollup(filter_records(records, q), card, long_context_keys(records) if long_keys is None else long_keys)
    return with_usd(hours).orderBy("day_local", "hour_local")


def heatmap(records: DataFrame, card: DataFrame, q: UsageQuery, long_keys: DataFrame | None = None) -> DataFrame:
    """Tokens per weekday and hour. ``cost_usd`` is always 0; ``cost_usd_priced`` is the cost."""
    priced = price_sums(
        session_sums(filter_records(records, q), ["dow_local", "hour_local"]),
        card,
        long_keys=long_context_keys(records) if long_keys is None else long_keys,
    )
    return (
        priced.groupBy(F.col("dow_local").alias("dow"), F.col("hour_local").alias("hour"))
        .agg(
            F.sum("total_tokens").alias("tokens"),
            F.lit(0.0).alias("cost_usd"),
            usd(F.sum("cost_nano")).alias("cost_usd_priced"),
        )
        .orderBy("dow", "hour")
    )


def source_comparison(daily: DataFrame, q: UsageQuery) -> DataFrame:
    """Totals per source. "Sessions" are distinct (day, workspace) pairs of the daily series."""
    return (
        filter_daily(daily, q)
        .groupBy("source")
        .agg(
            F.sum("total_tokens").alias("total_tokens"),
            usd(F.sum("cost_nano")).alias("cost_usd"),
            F.bool_or(F.col("unknown_cost_turns") > 0).alias("cost_unknown"),
            F.sum("turns").alias("turns"),
            F.countDistinct("day_local", "workspace").alias("sessions"),
        )
        .orderBy("source")
    )


def freshness(records: DataFrame, runs: DataFrame) -> DataFrame:
    """Time of the last ingest run and of the newest record."""
    newest = records.agg(F.max("ts_utc").alias("latest_record_utc"))
    last = runs.agg(F.max("run_utc").alias("last_ingest_run_utc"))
    return last.crossJoin(newest)


def warnings(file_state: DataFrame, unmapped: DataFrame) -> DataFrame:
    """Bad-line totals over all files as last read, and one row per unmapped model."""
    counts = (
        file_state.agg(
            F.coalesce(F.sum("malformed"), F.lit(0)).alias("malformed_lines"),
            F.coalesce(F.sum("oversized"), F.lit(0)).alias("oversized_lines"),
        )
        .unpivot([], ["malformed_lines", "oversized_lines"], "warning", "count")
        .select("warning", F.lit("").alias("model"), "count")
    )
    models = unmapped.select(
        F.lit("unmapped_model").alias("warning"), "model", F.lit(1).cast("bigint").alias("count")
    )
    return counts.unionByName(models)


def latest_rate_limit(rate_limits: DataFrame) -> DataFrame:
    """Newest rate-limit reading; no row where nothing was read."""
    place = F.struct("ts_utc", "dedup_key")
    return (
        rate_limits.filter(F.col("ts_utc") > 0)
        .agg(F.max_by(F.struct("ts_utc", "primary_pct", "secondary_pct"), place).alias("_r"))
        .filter(F.col("_r").isNotNull())
        .select("_r.*")
    )


def day_total(daily: DataFrame, day: str) -> DataFrame:
    """Totals of one local day."""
    return daily.filter(F.col("day_local") == day).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*_MEASURES, "turns")],
        F.coalesce(usd(F.sum("cost_nano")), F.lit(0.0)).alias("cost_usd"),
    )


@dataclass
class UsageTables:
    """Tables the views read. Rollups not given are derived from the records.

    ``long_keys`` are the billing keys that count as long context; with them a view of two days reads
    two days.
    """

    records: DataFrame
    tools: DataFrame
    card: DataFrame
    daily: DataFrame | None = None
    sessions: DataFrame | None = None
    long_keys: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.daily is None:
            self.daily = daily_rollup(self.records, self.card)
        if self.sessions is None:
            self.sessions = session_rollup(self.records, self.card)

    def unmapped(self) -> DataFrame:
        return unmapped_models(self.records, self.card)


def dashboard(t: UsageTables, q: UsageQuery) -> dict[str, DataFrame]:
    """All parts of the dashboard. The daily rollup is shared by the series and the breakdown."""
    parts = {
        "series": daily_series(t.daily, q),
        "variants": variant_breakdown(t.daily, q),
        "sessions": session_leaderboard(t.sessions, q, LEADERBOARD_ROWS),
        "tools": tool_usage(t.tools, t.records, q),
        "tool_calls_by_day": tool_calls_by_day(t.tools, t.records, q),
    }
    if q.to_utc - q.from_utc <= HOURLY_MAX_RANGE_MS:
        parts["hourly_series"] = hourly_series(t.records, t.card, q, t.long_keys)
    return parts


def run_query(t: UsageTables, q: UsageQuery) -> dict[str, DataFrame]:
    """Answer a query by its view name."""
    if q.view == "dashboard":
        return dashboard(t, q)
    answers = {
        "series": lambda: daily_series(t.daily, q),
        "variants": lambda: variant_breakdown(t.daily, q),
        "sessions": lambda: session_leaderboard(t.sessions, q),
        "tools": lambda: tool_usage(t.tools, t.records, q),
        "heatmap": lambda: heatmap(t.records, t.card, q, t.long_keys),
        "comparison": lambda: source_comparison(t.daily, q),
    }
    if q.view not in answers:
        raise ValueError(f"unknown view: {q.view}")
    return {q.view: answers[q.view]()}
