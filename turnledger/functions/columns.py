"""Column expressions for turns: token totals, variants, local calendar, guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKEN_COLUMNS = (
    "input_tokens",
    "output_tokens",
    "cache_read_tokens",
    "cache_creation_tokens",
    "reasoning_tokens",
)

# Reasoning-effort levels that form a variant suffix.
EFFORT_LEVELS = ("minimal", "low", "medium", "high", "xhigh")
NO_EFFORT = "n/a"

_SUFFIX = "(" + "|".join(EFFORT_LEVELS) + ")"


def total_tokens() -> Column:
    """Sum of the five disjoint buckets."""
    first, *rest = (F.col(c) for c in TOKEN_COLUMNS)
    for bucket in rest:
        first = first + bucket
    return first


def variant_id(model: Column, effort: Column) -> Column:
    """``model (effort)``, or the bare model where there is no effort."""
    labelled = effort.isNotNull() & (effort != "") & (effort != NO_EFFORT)
    return F.when(labelled, F.concat(model, F.lit(" ("), effort, F.lit(")"))).otherwise(model)


def base_model(variant: Column) -> Column:
    """Inverse of :func:`variant_id`."""
    return F.when(
        variant.rlike(rf"^.* \({_SUFFIX}\)$"),
        F.regexp_extract(variant, rf"^(.*) \({_SUFFIX}\)$", 1),
    ).otherwise(variant)


def effort_of(variant: Column) -> Column:
    """Effort level encoded in a variant, or ``n/a``."""
    found = F.regexp_extract(variant, rf"\({_SUFFIX}\)$", 1)
    return F.when(found == "", F.lit(NO_EFFORT)).otherwise(found)


def instant(ts_ms: Column) -> Column:
    return F.timestamp_millis(ts_ms)


def local_day(ts_ms: Column) -> Column:
    """Calendar day ``YYYY-MM-DD`` in the session time zone."""
    return F.to_date(instant(ts_ms)).cast("string")


def local_weekday(ts_ms: Column) -> Column:
    """0 = Sunday ... 6 = Saturday, in the session time zone."""
    return (F.dayofweek(instant(ts_ms)) - 1).cast("bigint")


def local_hour(ts_ms: Column) -> Column:
    return F.hour(instant(ts_ms)).cast("bigint")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double; 0 where the denominator is not positive."""
    return F.when(
        denominator > 0, numerator.cast("double") / denominator.cast("double")
    ).otherwise(F.lit(0.0))


def percent(numerator: Column, denominator: Column) -> Column:
    return F.when(
        denominator > 0, numerator.cast("double") / denominator.cast("double") * 100
    ).otherwise(F.lit(0.0))


def percent_change(current: Column, previous: Column) -> Column:
    """Change against a previous value; 100 where something appeared from nothing."""
    return (
        F.when(previous > 0, (current - previous) / previous * 100)
        .when(current > 0, F.lit(100.0))
        .otherwise(F.lit(0.0))
    )


def usd(nano: Column) -> Column:
    """Nano-USD to USD, rounded to a double once."""
    return nano.cast("double") / F.lit(1e9)
