"""Anomaly days, context fill, exact cache savings and the sidechain split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from turnledger.functions.columns import usd
from turnledger.functions.rates import LONG_CONTEXT_THRESHOLD
from turnledger.operators.pricing import price_sums, status_columns
from turnledger.operators.rollups import session_sums, with_usd

DEFAULT_MULTIPLIER = 2.0
MIN_MULTIPLIER = 1.0
DEFAULT_FILL_WARN_PCT = 80.0


def anomaly_days(daily: DataFrame, trailing: int = 7, multiplier: float = DEFAULT_MULTIPLIER) -> DataFrame:
    """Days whose cost is above ``multiplier`` times the median of the trailing active days.

    The window sees one row per day, whatever the size of the records.
    """
    k = max(MIN_MULTIPLIER, multiplier)
    days = daily.groupBy("day_local").agg(usd(F.sum("cost_nano")).alias("cost_usd"))
    before = Window.orderBy("day_local").rowsBetween(-trailing, -1)
    return days.withColumn(
        "trailing_median", F.percentile("cost_usd", F.lit(0.5)).over(before)
    ).withColumn(
        "is_anomaly", F.coalesce(F.col("cost_usd") > F.col("trailing_median") * k, F.lit(False))
    )


def peak_context_fill(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("peak_context_fill").isNotNull()).select(
        "source", "session_id", "peak_context_fill"
    )


def context_fill_warnings(sessions: DataFrame, warn_pct: float = DEFAULT_FILL_WARN_PCT) -> DataFrame:
    return peak_context_fill(sessions).filter(F.col("peak_context_fill") * 100 >= warn_pct)


def exact_cache_savings(records: DataFrame, card: DataFrame) -> DataFrame:
    """Per model: cached tokens times the gap between the input and the cached rate."""
    sums = session_sums(records)
    requested = F.col("max_context") > LONG_CONTEXT_THRESHOLD
    rated = sums.join(card, "model", "left").withColumns(
        status_columns(card, F.coalesce(requested, F.lit(False)))
    )
    gap = F.col("billed_rate.input_rate") - F.col("billed_rate.cached_rate")
    saved = F.sum(F.col("cache_read_tokens").cast("decimal(17,0)") * gap)
    return rated.groupBy("model").agg(
        F.sum("cache_read_tokens").alias("cache_read_tokens"), usd(saved).alias("saved_usd")
    )


def sidechain_split(records: DataFrame, card: DataFrame) -> DataFrame:
    """Main against sidechain turns."""
    priced = price_sums(session_sums(records, ["is_sidechain"]), card)
    return with_usd(
        priced.groupBy("source", "is_sidechain").agg(
            F.sum("total_tokens").alias("total_tokens"),
            F.sum("turns").alias("turns"),
            F.sum("cost_nano").cast("decimal(38,6)").alias("cost_nano"),
        )
    )
