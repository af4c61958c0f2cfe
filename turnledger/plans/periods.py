"""Period analytics over the daily series: windows, comparisons, buckets and insight classes.

``as_of`` is always a date column. As a literal it folds into constants, so the day range still
reaches the scan as a pushed-down filter; taken from data it is a one-row aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from turnledger.functions.columns import local_day, percent, percent_change, ratio, usd

PERIODS = ("today", "day", "week", "month", "year")
# Visible buckets per period.
BUCKETS = {"today": 1, "day": 7, "week": 7, "month": 6, "year": 2}
TREND_BUCKETS = 12
TOP_MODELS = 5
TOP_TOOLS = 6

_MONDAY, _MONTH, _YEAR = "WEEK", "MONTH", "YEAR"


@dataclass(frozen=True)
class PeriodWindow:
    """Inclusive date bounds of a period's window, its previous window and the running period."""

    period: str
    start: Column
    end: Column
    prev_start: Column
    prev_end: Column
    current_start: Column
    buckets: int


def _truncated(as_of: Column, unit: str) -> Column:
    return F.date_trunc(unit, as_of).cast("date")


def period_window(period: str, as_of: Column) -> PeriodWindow:
    """Window of a period ending at ``as_of`` and the equally long one before it."""
    n = BUCKETS[period]
    if period in ("today", "day"):
        start, prev = F.date_sub(as_of, n - 1), F.date_sub(as_of, 2 * n - 1)
        current = as_of
    elif period == "week":
        current = _truncated(as_of, _MONDAY)
        start, prev = F.date_sub(current, 7 * (n - 1)), F.date_sub(current, 7 * (2 * n - 1))
    else:
        unit, months = (_MONTH, 1) if period == "month" else (_YEAR, 12)
        current = _truncated(as_of, unit)
        start = F.add_months(current, -months * (n - 1))
        prev = F.add_months(current, -months * (2 * n - 1))
    return PeriodWindow(period, start, as_of, prev, F.date_sub(start, 1), current, n)


def _day(value: Column) -> Column:
    return value.cast("string")


def period_table(as_of: DataFrame) -> DataFrame:
    """All periods of a one-row ``as_of`` frame: windows, running period and fetch range."""
    rows = []
    for name in PERIODS:
        w = period_window(name, F.col("as_of"))
        rows.append(F.struct(
            F.lit(name).alias("period"),
            _day(w.start).alias("window_from"), _day(w.end).alias("window_to"),
            _day(w.prev_start).alias("prev_from"), _day(w.prev_end).alias("prev_to"),
            _day(w.current_start).alias("current_from"), _day(w.end).alias("current_to"),
            _day(w.prev_start).alias("fetch_from"),
            F.lit(w.buckets).cast("bigint").alias("bucket_count"),
        ))
    return as_of.select(F.inline(F.array(*rows)))


def latest_day(daily: DataFrame) -> DataFrame:
    """One-row ``as_of``: the newest day of the series."""
    return daily.agg(F.to_date(F.max("day_local")).alias("as_of"))


def in_range(start: Column, end: Column) -> Column:
    return F.col("day_local").between(_day(start), _day(end))


def _tally(flag: Column) -> dict[str, Column]:
    """Totals over the rows of a flag. ``cache`` is cache reads only."""
    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(flag, F.col(name))), F.lit(0))

    return {
        "tokens": total("total_tokens"),
        "cost_usd": F.coalesce(usd(F.sum(F.when(flag, F.col("cost_nano")))), F.lit(0.0)),
        "turns": total("turns"),
        "input": total("input_tokens"),
        "output": total("output_tokens"),
        "cache": total("cache_read_tokens"),
        "reasoning": total("reasoning_tokens"),
        "caching_tokens": F.coalesce(
            F.sum(F.when(flag, F.col("cache_read_tokens") + F.col("cache_creation_tokens"))), F.lit(0)
        ),
        "models": F.countDistinct(F.when(flag, F.col("variant_id"))),
        "active_days": F.countDistinct(F.when(flag, F.col("day_local"))),
    }


def names_of(period: str | Sequence[str]) -> tuple[str, ...]:
    return (period,) if isinstance(period, str) else tuple(period)


def in_periods(daily: DataFrame, period: str | Sequence[str], as_of: Column) -> DataFrame:
    """Rows of the previous, present and running windows of each period, once per period they lie in.

    One scan serves all periods: ``current`` and ``running`` tell the windows apart, ``bucket`` is
    the period's bucket of the day.
    """
    windows = [period_window(name, as_of) for name in names_of(period)]
    cells = [
        F.struct(
            F.lit(w.period).alias("period"), in_range(w.prev_start, w.end).alias("_held"), in_range(w.start, w.end).alias("current"),
            in_range(w.current_start, w.end).alias("running"), _bucket_key(w.period, F.to_date("day_local")).alias("bucket"),
        )
        for w in windows
    ]
    starts = [w.prev_start for w in windows]
    kept = daily.filter(in_range(F.least(*starts) if len(starts) > 1 else starts[0], as_of))
    return kept.select("*", F.inline(F.array(*cells))).filter("_held").drop("_held")


def _per_period(rows: DataFrame, period: str | Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregates of each period, of those without rows too."""
    every = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(name) for name in names_of(period)])).alias("period"))
    return every.join(rows.groupBy("period").agg(*aggs), "period", "left")


def _filled(names: Sequence[str]) -> list[Column]:
    return [F.coalesce(name, F.lit(0.0 if "cost" in name else 0)).alias(name) for name in names]


def window_totals(daily: DataFrame, period: str | Sequence[str], as_of: Column) -> DataFrame:
    """Totals of the window, one row per period."""
    tally = _tally(F.col("current"))
    return _per_period(in_periods(daily, period, as_of), period, [e.alias(n) for n, e in tally.items()]).select("period", *_filled([*tally]))


def period_comparison(daily: DataFrame, period: str | Sequence[str], as_of: Column) -> DataFrame:
    """Window against previous window in one pass, with the change in per cent."""
    measures = ("tokens", "cost_usd", "turns")
    present, before = _tally(F.col("current")), _tally(~F.col("current"))
    aggs = [e[n].alias(f"{when}_{n}") for n in measures for when, e in (("cur", present), ("prev", before))]
    totals = _per_period(in_periods(daily, period, as_of), period, aggs).select("period", *_filled([f"{w}_{n}" for n in measures for w in ("cur", "prev")]))
    change = lambda n: percent_change(F.col(f"cur_{n}").cast("double"), F.col(f"prev_{n}").cast("double"))
    return totals.select("*", *[change(n).alias(f"{n}_delta_pct") for n in measures])


def peak_day(daily: DataFrame, period: str | Sequence[str], as_of: Column) -> DataFrame:
    """Day with the most tokens in the window; the first wins ties; none if nothing was used."""
    days = in_periods(daily, period, as_of).filter("current").groupBy("period", "day_local").agg(F.sum("total_tokens").alias("tokens"))
    best = F.min_by(F.struct("day_local", "tokens"), F.struct(-F.col("tokens"), F.col("day_local"))).alias("_d")
    return days.filter(F.col("tokens") > 0).groupBy("period").agg(best).select("period", "_d.day_local", "_d.tokens")


def _bucket_key(period: str, day: Column) -> Column:
    if period in ("today", "day"):
        return _day(day)
    if period == "week":
        return _day(_truncated(day, _MONDAY))
    return F.substring(_day(day), 1, 7 if period == "month" else 4)


_STEPS = {"today": "1 DAY", "day": "1 DAY", "week": "7 DAYS", "month": "1 MONTH", "year": "1 YEAR"}


def _calendar(name: str, as_of: Column, last: int | None) -> Column:
    """(period, bucket) of a period's window, newest first."""
    w = period_window(name, as_of)
    days = F.reverse(F.sequence(w.start, w.current_start, F.expr(f"INTERVAL {_STEPS[name]}")))
    return F.transform(F.slice(days, 1, last) if last else days, lambda at: F.struct(F.lit(name).alias("period"), _bucket_key(name, at).alias("bucket")))


def period_buckets(daily: DataFrame, period: str | Sequence[str], as_of: Column, last: int | None = None) -> DataFrame:
    """Zero-filled buckets of the window, newest first; of each period the ``last`` ones."""
    calendar = daily.sparkSession.range(1).select(F.inline(F.flatten(F.array(*[_calendar(name, as_of, last) for name in names_of(period)]))))
    names = {"tokens": "total_tokens", "turns": "turns", "input": "input_tokens",
             "output": "output_tokens", "cache": "cache_read_tokens", "reasoning": "reasoning_tokens"}
    used = (
        in_periods(daily, period, as_of).filter("current").groupBy("period", "bucket")
        .agg(*[F.sum(c).alias(n) for n, c in names.items()], F.sum("cost_nano").alias("cost_nano"))
    )
    return calendar.join(used, ["period", "bucket"], "left").select(
        "period", "bucket",
        *[F.coalesce(n, F.lit(0)).alias(n) for n in names],
        F.coalesce(usd(F.col("cost_nano")), F.lit(0.0)).alias("cost_usd"),
    ).orderBy("period", F.col("bucket").desc())


def today_hours(hourly: DataFrame, day: Column) -> DataFrame:
    """The 24 hours of a day, zero-filled. ``cache`` here is reads plus creation."""
    hours = hourly.sparkSession.range(24).select(F.col("id").alias("hour"))
    names = {"tokens": F.col("total_tokens"), "turns": F.col("turns"), "input": F.col("input_tokens"),
             "output": F.col("output_tokens"),
             "cache": F.col("cache_read_tokens") + F.col("cache_creation_tokens"),
             "reasoning": F.col("reasoning_tokens")}
    used = hourly.filter(F.col("day_local") == _day(day)).select(
        F.col("hour_local").alias("hour"), *[e.alias(n) for n, e in names.items()],
        F.col("cost_usd").alias("_cost"),
    )
    return hours.join(used, "hour", "left").select(
        "hour",
        *[F.coalesce(n, F.lit(0)).alias(n) for n in names],
        F.coalesce("_cost", F.lit(0.0)).alias("cost_usd"),
    ).orderBy("hour")


def today_hours_summary(hours: DataFrame) -> DataFrame:
    """Totals, peak hour per measure (first wins) and active hours."""
    def peak(name: str) -> Column:
        return F.max_by("hour", F.struct(F.col(name), -F.col("hour"))).alias(f"peak_hour_{name}")

    return hours.agg(
        F.sum("tokens").alias("tokens"),
        F.sum("turns").alias("turns"),
        peak("tokens"),
        peak("turns"),
        peak("cost_usd"),
        F.count_if(F.col("turns") > 0).alias("active_hours"),
    ).filter((F.col("tokens") > 0) | (F.col("turns") > 0))


def top_models(daily: DataFrame, period: str, as_of: Column, limit: int | None = TOP_MODELS) -> DataFrame:
    """Variants from the window's start on; the total leaves out cache creation."""
    w = period_window(period, as_of)
    parts = {"input": "input_tokens", "output": "output_tokens", "cache": "cache_read_tokens",
             "reasoning": "reasoning_tokens", "turns": "turns"}
    rows = (
        daily.filter(F.col("day_local") >= _day(w.start))
        .groupBy("variant_id")
        .agg(*[F.sum(c).alias(n) for n, c in parts.items()])
        .withColumn("total", F.col("input") + F.col("output") + F.col("cache") + F.col("reasoning"))
    )
    grand = rows.agg(F.sum("total").alias("_all"))
    ranked = (
        rows.crossJoin(grand)
        .select("variant_id", *parts, "total", percent(F.col("total"), F.col("_all")).alias("share_pct"))
        .orderBy(F.col("total").desc(), "variant_id")
    )
    return ranked.limit(limit) if limit else ranked


def composition(daily: DataFrame, period: str | Sequence[str], as_of: Column) -> DataFrame:
    """Shares of the four parts and the class they fall in; no row where nothing was used."""
    t = window_totals(daily, period, as_of)
    whole = F.col("input") + F.col("output") + F.col("cache") + F.col("reasoning")
    share = {n: ratio(F.col(n), whole) for n in ("input", "output", "cache", "reasoning")}
    label = (
        F.when(share["cache"] > 0.5, "high_cache")
        .when(share["cache"] < 0.1, "low_cache")
        .when(share["reasoning"] > 0.1, "high_reasoning")
        .otherwise("balanced")
    )
    return t.filter(whole > 0).select(
        "period", "input", "output", "cache", "reasoning",
        *[(e * 100).alias(f"{n}_pct") for n, e in share.items()],
        label.alias("composition_class"),
    )


def current_vs_average(daily: DataFrame, period: str | Sequence[str], as_of: Column) -> DataFrame:
    """Running period against the average bucket of the window."""
    running = _tally(F.col("running"))
    names = ("tokens", "turns", "input", "output", "caching_tokens", "models", "cost_usd")
    aggs = [*[running[n].alias(n) for n in names], _tally(F.col("current"))["cost_usd"].alias("_window_cost")]
    totals = _per_period(in_periods(daily, period, as_of), period, aggs).select("period", *_filled([*names, "_window_cost"]))
    buckets = F.element_at(F.create_map(*[F.lit(x) for name in names_of(period) for x in (name, BUCKETS[name])]), F.col("period"))
    average = F.col("_window_cost") / buckets
    return totals.select("period", *names, average.alias("average_cost_usd"), percent_change(F.col("cost_usd"), average).alias("delta_pct"))


def caching_and_tools(daily: DataFrame, tool_days: DataFrame, period: str | Sequence[str], as_of: Column) -> DataFrame:
    """Caching tokens (read plus creation) and tool calls of the window."""
    caching = _per_period(in_periods(daily, period, as_of), period, [_tally(F.col("current"))["caching_tokens"].alias("caching_tokens")])
    calls = _per_period(in_periods(tool_days, period, as_of), period, [F.sum(F.when(F.col("current"), F.col("count"))).alias("tool_calls")])
    return caching.join(calls, "period").select("period", *_filled(["caching_tokens", "tool_calls"]))


def today_ratios(daily: DataFrame, as_of: Column) -> DataFrame:
    t = window_totals(daily, "today", as_of)
    parts = F.col("input") + F.col("output") + F.col("cache") + F.col("reasoning")
    return t.select(
        percent(F.col("cache"), F.col("input") + F.col("cache")).alias("cache_hit_pct"),
        ratio(F.col("tokens"), F.col("turns")).alias("tokens_per_turn"),
        "turns",
        percent(F.col("reasoning"), parts).alias("reasoning_mix_pct"),
    )


def cache_savings_estimate(daily: DataFrame, period: str | Sequence[str], as_of: Column) -> DataFrame:
    """Rough savings: cached tokens at half the blended rate of everything fetched."""
    fetched = _per_period(in_periods(daily, period, as_of), period, [
        _tally(F.col("current"))["cache"].alias("cache"), usd(F.sum("cost_nano")).alias("_cost"),
        F.sum("total_tokens").alias("_tokens"), F.count("*").alias("_rows"),
    ])
    fetched = fetched.withColumns({"cache": F.coalesce("cache", F.lit(0)), "_rows": F.coalesce("_rows", F.lit(0))})
    blended = F.when(F.col("_tokens") > 0, F.col("_cost") / F.col("_tokens") * 1000).otherwise(F.lit(0.005))
    saved = F.when(F.col("_rows") > 0, F.col("cache") / 1000 * blended * 0.5).otherwise(
        F.col("cache") / 1000 * 0.0025
    )
    return fetched.select("period", "cache", saved.alias("cache_saved_usd"))


def today_insights(daily: DataFrame, as_of: Column) -> DataFrame:
    """Classes of today's numbers; no row on a day without use."""
    now = window_totals(daily, "today", as_of)
    before = window_totals(daily, "today", F.date_sub(as_of, 1)).select(
        F.col("cost_usd").alias("_yesterday")
    )
    c = F.col
    parts = c("input") + c("output") + c("cache") + c("reasoning")
    cost_delta = F.when(c("_yesterday") > 0, (c("cost_usd") - c("_yesterday")) / c("_yesterday") * 100)
    cache = percent(c("cache"), parts)
    reasoning = percent(c("reasoning"), parts)
    weight = ratio(c("tokens"), c("turns"))
    return (
        now.crossJoin(before)
        .filter((c("tokens") > 0) | (c("turns") > 0))
        .select(
            cost_delta.alias("cost_delta_pct"),
            F.when(cost_delta.isNull(), "neutral").when(cost_delta <= 0, "good").otherwise("warn").alias("cost_tone"),
            cache.alias("cache_pct"),
            F.when(cache >= 70, "good").when(cache >= 30, "neutral").otherwise("warn").alias("cache_tone"),
            weight.alias("tokens_per_turn"),
            ratio(c("cost_usd"), c("turns")).alias("cost_per_turn"),
            F.when(weight >= 100_000, "warn").otherwise("neutral").alias("weight_tone"),
            reasoning.alias("reasoning_pct"),
            F.when(reasoning > 15, "warn").when(reasoning > 5, "neutral").otherwise("good").alias("reasoning_tone"),
            F.when(c("input") > 0, c("output") / c("input") * 100).alias("output_shape_pct"),
        )
    )


def main_model(daily: DataFrame, as_of: Column) -> DataFrame:
    """The single largest daily row of the day (not summed by variant) and its share."""
    today = daily.filter(F.col("day_local") == _day(as_of))
    place = F.struct("total_tokens", F.col("turns"), "variant_id", "workspace", "source")
    best = today.agg(
        F.max_by(F.struct("variant_id", "total_tokens", "turns"), place).alias("_top"),
        F.sum("total_tokens").alias("_all"),
    ).filter(F.col("_all") > 0)
    share = percent(F.col("_top.total_tokens"), F.col("_all"))
    return best.select(
        "_top.variant_id", "_top.total_tokens", "_top.turns", share.alias("share_pct"),
        F.when(share >= 90, "warn").otherwise("neutral").alias("tone"),
    )


def live_status(records: DataFrame, as_of: Column) -> DataFrame:
    """Live where the newest record is of the day, stale where it is older, paused without any."""
    newest = records.agg(F.max("ts_utc").alias("latest_record_utc"))
    return newest.select(
        "latest_record_utc",
        F.when(F.col("latest_record_utc").isNull(), "paused")
        .when(local_day(F.col("latest_record_utc")) == _day(as_of), "live")
        .otherwise("stale").alias("status"),
    )


def with_secondary_currency(df: DataFrame, currency: str | None, rate: float | None) -> DataFrame:
    """Add the cost in a second currency where one is set and its rate is positive."""
    active = bool(currency) and rate is not None and rate > 0
    return df.withColumns({
        "secondary_currency": F.lit(currency if active else None).cast("string"),
        "cost_secondary": F.col("cost_usd") * F.lit(rate) if active else F.lit(None).cast("double"),
    })


def tool_summary(usage: DataFrame) -> DataFrame:
    """Total calls, distinct tools and the leading one; no row without calls."""
    leading = F.min_by("tool_name", F.struct(-F.col("count"), F.col("tool_name"), F.col("source")))
    return usage.agg(
        F.sum("count").alias("total_calls"),
        F.countDistinct("tool_name").alias("distinct_tools"),
        leading.alias("leading_tool"),
    ).filter(F.col("total_calls") > 0)


def top_tools(usage: DataFrame, limit: int = TOP_TOOLS) -> DataFrame:
    return usage.orderBy(F.col("count").desc(), "tool_name", "source").limit(limit)
