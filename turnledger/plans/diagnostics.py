"""Diagnostics: long-context billing, midnight sessions, folder days, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnledger.functions.columns import local_day, usd
from turnledger.operators.rollups import above_threshold, with_usd
from turnledger.sources.rates import long_context_id

MAX_ROWS = 20


def _long_context(records: DataFrame, card: DataFrame) -> DataFrame:
    return above_threshold(records).join(card, "model", "left")


def _by_size(rows: DataFrame, limit: int | None, *ties: str) -> DataFrame:
    ranked = rows.orderBy(F.col("max_context_used_tokens").desc(), F.col("turns").desc(), *ties)
    return ranked.limit(limit) if limit else ranked


def _long_context_totals() -> list[Column]:
    return [
        F.count("*").alias("sessions"),
        F.sum("turns").alias("turns"),
        F.max("max_context_used_tokens").alias("max_context_used_tokens"),
    ]


def long_context_applied(records: DataFrame, card: DataFrame, limit: int | None = MAX_ROWS) -> DataFrame:
    """Models billed at a long-context rate: sessions, turns above the threshold, largest context."""
    hit = _long_context(records, card).filter(F.col("long_rate").isNotNull())
    rows = hit.groupBy("model", long_context_id(F.col("model")).alias("effective_model")).agg(*_long_context_totals())
    return _by_size(rows, limit, "model")


def long_context_missing(records: DataFrame, card: DataFrame, limit: int | None = MAX_ROWS) -> DataFrame:
    """Models above the threshold without a long-context rate."""
    missed = _long_context(records, card).filter(F.col("long_rate").isNull())
    return _by_size(missed.groupBy("model").agg(*_long_context_totals()), limit, "model")


def midnight_sessions(sessions: DataFrame, limit: int | None = MAX_ROWS) -> DataFrame:
    """Sessions whose first and last local day differ, by cost."""
    first, last = local_day(F.col("first_ts_utc")), local_day(F.col("last_ts_utc"))
    ranked = (
        with_usd(sessions.filter(first != last))
        .select("source", "session_id", "workspace", first.alias("first_day"), last.alias("last_day"),
                "total_tokens", "cost_usd")
        .orderBy(F.col("cost_usd").desc(), "source", "session_id")
    )
    return ranked.limit(limit) if limit else ranked


def folder_day(path: Column) -> Column:
    """First ``YYYY/MM/DD`` directory triple of a path, as a day; null without one."""
    part = r"(?:^|[\\/])(\d{4})[\\/]+(\d{2})[\\/]+(\d{2})(?=[\\/]|$)"
    pieces = [F.regexp_extract(path, part, i) for i in (1, 2, 3)]
    return F.when(pieces[0] != "", F.concat_ws("-", *pieces))


def _dated_files(file_daily: DataFrame) -> DataFrame:
    return (
        file_daily.filter(F.col("source") == "codex")
        .withColumn("folder_day", folder_day(F.col("file_id")))
        .filter(F.col("folder_day").isNotNull())
    )


def folder_day_costs(file_daily: DataFrame, limit: int | None = MAX_ROWS) -> DataFrame:
    """Cost by the day of the event against cost by the day of the folder."""
    dated = _dated_files(file_daily)
    by_event = dated.groupBy(F.col("day_local").alias("day")).agg(F.sum("cost_nano").alias("_event"))
    by_folder = dated.groupBy(F.col("folder_day").alias("day")).agg(F.sum("cost_nano").alias("_folder"))
    zero = F.lit(0)
    event, folder = F.coalesce("_event", zero), F.coalesce("_folder", zero)
    rows = by_event.join(by_folder, "day", "full_outer").select(
        "day", usd(event).alias("event_cost_usd"), usd(folder).alias("folder_cost_usd"),
        usd(event - folder).alias("delta_usd"),
    ).orderBy(F.col("day").desc())
    return rows.limit(limit) if limit else rows


def folder_day_mismatches(file_daily: DataFrame, limit: int | None = MAX_ROWS) -> DataFrame:
    """Files with an event on another day than their folder's; days of a file are bounded by the calendar."""
    rows = (
        _dated_files(file_daily)
        .groupBy(F.col("file_id").alias("file_path"), "folder_day")
        .agg(F.array_sort(F.collect_set("day_local")).alias("_days"), F.sum("cost_nano").alias("cost_nano"))
        .filter(F.exists("_days", lambda d: d != F.col("folder_day")))
        .withColumn("event_days", F.array_join("_days", ","))
    )
    ranked = with_usd(rows.drop("_days")).orderBy(F.col("cost_usd").desc(), "file_path")
    return ranked.limit(limit) if limit else ranked


def _reconciled(running_totals: DataFrame, file_sessions: DataFrame) -> DataFrame:
    final = running_totals.select(
        "file_path", "session_id", (F.col("input_total") + F.col("output_total")).alias("final_total_tokens")
    )
    ingested = file_sessions.filter(F.col("source") == "codex").select(
        F.col("file_id").alias("file_path"), "session_id",
        (F.col("input_tokens") + F.col("cache_read_tokens") + F.col("output_tokens") + F.col("reasoning_tokens"))
        .alias("ingested_total_tokens"),
    )
    return (
        final.join(ingested, ["file_path", "session_id"])
        .filter(F.col("ingested_total_tokens") != 0)
        .withColumn("delta_tokens", F.col("ingested_total_tokens") - F.col("final_total_tokens"))
    )


def reconciliation_mismatches(running_totals: DataFrame, file_sessions: DataFrame, limit: int | None = MAX_ROWS) -> DataFrame:
    """Sessions whose ingested tokens differ from the log's own final total."""
    rows = _reconciled(running_totals, file_sessions).filter(F.col("delta_tokens") != 0)
    ranked = rows.orderBy(F.abs("delta_tokens").desc(), "file_path", "session_id")
    return ranked.limit(limit) if limit else ranked


def reconciliation_checked(running_totals: DataFrame, file_sessions: DataFrame) -> DataFrame:
    return _reconciled(running_totals, file_sessions).agg(F.count("*").alias("checked_sessions"))


def full_report(
    audit: DataFrame, records: DataFrame, sessions: DataFrame, file_daily: DataFrame,
    file_sessions: DataFrame, running_totals: DataFrame, card: DataFrame,
) -> dict[str, DataFrame]:
    """All diagnostics by name."""
    return {
        "pricing": audit,
        "long_context_applied": long_context_applied(records, card),
        "long_context_missing": long_context_missing(records, card),
        "midnight_sessions": midnight_sessions(sessions),
        "folder_day_costs": folder_day_costs(file_daily),
        "folder_day_mismatches": folder_day_mismatches(file_daily),
        "reconciliation_checked": reconciliation_checked(running_totals, file_sessions),
        "reconciliation_mismatches": reconciliation_mismatches(running_totals, file_sessions),
    }
