"""Daily and session rollups, and what one file adds to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from turnledger.functions.columns import TOKEN_COLUMNS, base_model, usd
from turnledger.functions.rates import LONG_CONTEXT_THRESHOLD
from turnledger.operators.pricing import BILLING_KEY, price_sums
from turnledger.schemas import DAILY_ROLLUP, SESSION_ROLLUP
from turnledger.sources.rates import MAX_BROADCAST_MODELS

DAILY_KEY = ["day_local", "source", "variant_id", "workspace"]
SESSION_KEY = ["source", "session_id"]
_MEASURES = (*TOKEN_COLUMNS, "total_tokens")


def session_sums(records: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Records added up per billing key and ``extra`` columns, before any other shuffle."""
    return records.groupBy(*BILLING_KEY, *extra).agg(
        *[F.sum(c).alias(c) for c in _MEASURES],
        F.count("*").alias("turns"),
        F.max("context_used_tokens").alias("max_context"),
    )


def _daily(priced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add priced sums up per ``keys``.

    The model stays a key of the first step, so that it sums numbers only and can hash; the text
    minimum is left to the second step, which sees no more than the rollup's own rows.
    """
    per_model = priced.groupBy(*keys, "model").agg(
        *[F.sum(c).alias(c) for c in (*_MEASURES, "turns")],
        F.sum("cost_nano").cast("decimal(38,6)").alias("cost_nano"),
        F.sum(F.when(F.col("cost_unknown"), F.col("turns")).otherwise(0)).alias("unknown_cost_turns"),
    )
    named = F.coalesce(F.nullif("model", F.lit("")), base_model(F.col("variant_id")))
    return per_model.groupBy(*keys).agg(
        F.min(named).alias("base_model"),
        *[F.sum(c).alias(c) for c in (*_MEASURES, "turns")],
        F.sum("cost_nano").cast("decimal(38,6)").alias("cost_nano"),
        F.sum("unknown_cost_turns").alias("unknown_cost_turns"),
    )


def daily_from_priced(priced: DataFrame) -> DataFrame:
    return _daily(priced, DAILY_KEY).select(*DAILY_ROLLUP.fieldNames())


def daily_rollup(records: DataFrame, card: DataFrame) -> DataFrame:
    """One row per (day, source, variant, workspace); cost is found per session first."""
    return daily_from_priced(
        price_sums(session_sums(records, ["day_local", "variant_id", "workspace"]), card)
    )


def daily_sums(records: DataFrame, card: DataFrame) -> DataFrame:
    """Records added up for the daily rollup, to be priced with the long-context keys of all records.

    A session is told apart only where its model has a long-context rate, as no other cost depends on
    it; the rest adds up to the rollup's own rows at once.
    """
    extra = ["day_local", "variant_id", "workspace"]
    rated = card.filter(F.col("long_rate").isNotNull()).select("model", F.lit(True).alias("_rated"))
    if rated.limit(MAX_BROADCAST_MODELS + 1).count() > MAX_BROADCAST_MODELS:
        return session_sums(records, extra)
    told = records.join(rated.hint("broadcast"), "model", "left")
    return session_sums(told.withColumn("session_id", F.when(F.col("_rated"), F.col("session_id"))), extra)


def hourly_rollup(records: DataFrame, card: DataFrame, long_keys: DataFrame) -> DataFrame:
    """One row per (day, hour). ``long_keys`` must come from all records, not the filtered ones."""
    priced = price_sums(
        session_sums(records, ["day_local", "hour_local"]), card, long_keys=long_keys
    )
    return priced.groupBy("day_local", "hour_local").agg(
        *[F.sum(c).alias(c) for c in _MEASURES],
        F.sum("turns").alias("turns"),
        F.sum("cost_nano").cast("decimal(38,6)").alias("cost_nano"),
        F.sum(F.when(F.col("cost_unknown"), F.col("turns")).otherwise(0)).alias("unknown_cost_turns"),
    )


def _session_parts(records: DataFrame, extra: Sequence[str] = (), only: DataFrame | None = None) -> DataFrame:
    """Sums per billing key, workspace and ``extra``, laid out by session.

    Records are summed by hash before anything else. What is left of a session is one row per model
    and workspace, so sessions can then be brought together whole.
    """
    fill = F.when(
        F.col("context_window") > 0,
        F.col("context_used_tokens").cast("double") / F.col("context_window").cast("double"),
    )
    parts = records.groupBy(*BILLING_KEY, *extra, "workspace").agg(
        *[F.sum(c).alias(c) for c in _MEASURES],
        F.count("*").alias("turns"),
        F.max("context_used_tokens").alias("max_context"),
        F.min("ts_utc").alias("first_ts_utc"),
        F.max("ts_utc").alias("last_ts_utc"),
        F.max(fill).alias("peak_context_fill"),
        F.sum(F.when(F.col("is_sidechain"), F.col("total_tokens")).otherwise(0)).alias("sidechain_tokens"),
    )
    if only is not None:
        parts = parts.join(only, SESSION_KEY, "left_semi")
    return parts.repartition(*[F.col(c) for c in (*extra, *SESSION_KEY)])


def _sessions(parts: DataFrame, card: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add parts up per model, price that, and add it up per ``keys``: a model of a session has one rate."""

    def totals() -> list[Column]:
        return [
            F.min("first_ts_utc").alias("first_ts_utc"),
            F.max("last_ts_utc").alias("last_ts_utc"),
            F.sum("turns").alias("turns"),
            *[F.sum(c).alias(c) for c in _MEASURES],
            F.max("peak_context_fill").alias("peak_context_fill"),
            F.sum("sidechain_tokens").alias("sidechain_tokens"),
        ]

    per_model = parts.groupBy(*keys, "model").agg(
        F.max("workspace").alias("workspace"), F.max("max_context").alias("max_context"), *totals()
    )
    named = F.when(F.col("workspace") != "", F.col("model"))
    return price_sums(per_model, card, keys=None).groupBy(*keys).agg(
        F.coalesce(F.min_by("workspace", named), F.lit("")).alias("workspace"),
        F.sum("cost_nano").cast("decimal(38,6)").alias("cost_nano"),
        *totals(),
    )


def session_rollup(records: DataFrame, card: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """One row per session; its workspace is that of the first model (by name) that has one.

    ``only`` restricts it to some sessions, after their records are added up.
    """
    sessions = _sessions(_session_parts(records, only=only), card, SESSION_KEY)
    return sessions.select(*SESSION_ROLLUP.fieldNames())


def file_daily(records: DataFrame, card: DataFrame) -> DataFrame:
    """What each file adds to the daily rollup. Long context is judged inside the file."""
    sums = session_sums(records, ["file_id", "day_local", "variant_id", "workspace"])
    priced = price_sums(sums, card, keys=["file_id", *BILLING_KEY])
    return _daily(priced, ["file_id", *DAILY_KEY])


def file_sessions(records: DataFrame, card: DataFrame) -> DataFrame:
    """What each file adds to the session rollup, token buckets included."""
    return _sessions(_session_parts(records, ["file_id"]), card, ["file_id", *SESSION_KEY])


def file_counts(records: DataFrame, tools: DataFrame) -> DataFrame:
    """Records and tool calls per file."""
    return (
        records.groupBy("file_id").agg(F.count("*").alias("turns"))
        .join(tools.groupBy("file_id").agg(F.count("*").alias("tools")), "file_id", "full_outer")
        .select("file_id", F.coalesce("turns", F.lit(0)).alias("turns"),
                F.coalesce("tools", F.lit(0)).alias("tools"))
    )


def _added(column: str, sign: Column) -> Column:
    return F.sum(F.col(column) * sign)


def merge_daily(*parts: DataFrame) -> DataFrame:
    """Add daily contributions together."""
    return combine_daily(parts, ())


def combine_daily(plus: Sequence[DataFrame], minus: Sequence[DataFrame]) -> DataFrame:
    """Daily rollup after adding some contributions and taking others away; empty rows leave."""
    names = [*DAILY_KEY, "base_model", *_MEASURES, "turns", "cost_nano", "unknown_cost_turns"]
    signed = [p.select(*names, F.lit(1).alias("_sign")) for p in plus]
    signed += [m.select(*names, F.lit(-1).alias("_sign")) for m in minus]
    everything = signed[0]
    for part in signed[1:]:
        everything = everything.unionByName(part)
    sign = F.col("_sign")
    return (
        everything.groupBy(*DAILY_KEY)
        .agg(
            F.min("base_model").alias("base_model"),
            *[_added(c, sign).alias(c) for c in (*_MEASURES, "turns")],
            F.sum(F.when(sign > 0, F.col("cost_nano")).otherwise(-F.col("cost_nano")))
            .cast("decimal(38,6)").alias("cost_nano"),
            _added("unknown_cost_turns", sign).alias("unknown_cost_turns"),
        )
        .filter(F.col("turns") > 0)
    )


def merge_sessions(*parts: DataFrame) -> DataFrame:
    """Add session contributions: sums add up, times widen, a later non-empty workspace wins."""
    names = [*SESSION_KEY, "workspace", "first_ts_utc", "last_ts_utc", "turns", "total_tokens",
             "cost_nano", "peak_context_fill", "sidechain_tokens"]
    everything = None
    for rank, part in enumerate(parts):
        ranked = part.select(*names, F.lit(rank).alias("_rank"))
        everything = ranked if everything is None else everything.unionByName(ranked)
    named = F.when(F.col("workspace") != "", F.struct("_rank", "workspace"))
    return everything.groupBy(*SESSION_KEY).agg(
        F.coalesce(F.max_by("workspace", named), F.lit("")).alias("workspace"),
        F.min("first_ts_utc").alias("first_ts_utc"),
        F.max("last_ts_utc").alias("last_ts_utc"),
        F.sum("turns").alias("turns"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("cost_nano").cast("decimal(38,6)").alias("cost_nano"),
        F.max("peak_context_fill").alias("peak_context_fill"),
        F.sum("sidechain_tokens").alias("sidechain_tokens"),
    )


def rollup_gaps(records: DataFrame, daily: DataFrame) -> DataFrame:
    """Consistency check: per day and source, records against the daily rollup (all zero = good)."""
    names = [*_MEASURES, "turns"]
    from_records = records.groupBy("day_local", "source").agg(
        *[F.sum(c).alias(c) for c in _MEASURES], F.count("*").alias("turns")
    )
    both = from_records.select("day_local", "source", *names).unionByName(
        daily.select("day_local", "source", *[(-F.col(c)).alias(c) for c in names])
    )
    return both.groupBy("day_local", "source").agg(*[F.sum(c).alias(f"{c}_gap") for c in names])


def above_threshold(records: DataFrame) -> DataFrame:
    """Per billing key: turns above the long-context threshold and the largest context."""
    return (
        records.filter(F.col("context_used_tokens") > LONG_CONTEXT_THRESHOLD)
        .groupBy(*BILLING_KEY)
        .agg(F.max("context_used_tokens").alias("max_context_used_tokens"), F.count("*").alias("turns"))
    )


def with_usd(df: DataFrame) -> DataFrame:
    """Replace the exact nano-USD sum by USD as a double."""
    return df.withColumn("cost_usd", usd(F.col("cost_nano"))).drop("cost_nano")
