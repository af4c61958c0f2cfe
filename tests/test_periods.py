from pyspark.sql import functions as F

from turnledger.operators import rollups
from turnledger.plans import periods, views
from turnledger.operators.filters import UsageQuery
from helpers import ms, record, records


def as_of(spark, day):
    return spark.range(1).select(F.lit(day).cast("date").alias("as_of"))


def test_windows_have_the_exact_dates(spark):
    got = {r.period: r for r in periods.period_table(as_of(spark, "2026-06-03")).collect()}
    want = {
        "today": ("2026-06-03", "2026-06-03", "2026-06-02", "2026-06-02", 1, "2026-06-03"),
        "day": ("2026-05-28", "2026-06-03", "2026-05-21", "2026-05-27", 7, "2026-06-03"),
        "week": ("2026-04-20", "2026-06-03", "2026-03-02", "2026-04-19", 7, "2026-06-01"),
        "month": ("2026-01-01", "2026-06-03", "2025-07-01", "2025-12-31", 6, "2026-06-01"),
        "year": ("2025-01-01", "2026-06-03", "2023-01-01", "2024-12-31", 2, "2026-01-01"),
    }
    for name, (start, end, prev_start, prev_end, n, current) in want.items():
        r = got[name]
        assert (r.window_from, r.window_to, r.prev_from, r.prev_to, r.bucket_count, r.current_from) == (start, end, prev_start, prev_end, n, current)
        assert r.fetch_from == prev_start


def test_buckets_are_zero_filled_newest_first(spark, card):
    daily = rollups.daily_rollup(records(spark, record("a", "2026-06-01T00:00:00", input_tokens=5)), card)
    day = F.lit("2026-06-03").cast("date")
    for name, n in periods.BUCKETS.items():
        rows = periods.period_buckets(daily, name, day).collect()
        assert len(rows) == n and [r.bucket for r in rows] == sorted((r.bucket for r in rows), reverse=True)
        assert sum(r.tokens for r in rows) == (0 if name == "today" else 5)


def test_ties_and_empty_windows(spark, card):
    rows = records(spark, record("a", "2026-06-02T10:00:00", input_tokens=5), record("b", "2026-06-01T12:00:00", input_tokens=5))
    daily = rollups.daily_rollup(rows, card)
    day = F.lit("2026-06-03").cast("date")
    assert periods.peak_day(daily, "day", day).first().day_local == "2026-06-01"
    assert periods.peak_day(daily, "today", day).isEmpty()
    assert periods.composition(daily, "today", day).isEmpty()
    assert periods.today_insights(daily, day).isEmpty()
    compared = periods.period_comparison(daily, "day", day).first()
    assert (compared.cur_tokens, compared.prev_tokens, compared.tokens_delta_pct) == (10, 0, 100.0)
    hourly = views.hourly_series(rows, card, UsageQuery(0, ms("2027-01-01T00:00:00")))
    hours = periods.today_hours(hourly, F.lit("2026-06-02").cast("date"))
    assert hours.count() == 24
    assert periods.today_hours_summary(hours).first().peak_hour_tokens == 10
    assert periods.today_hours_summary(periods.today_hours(hourly, day)).isEmpty()


def test_status_currency_and_tools(spark, card):
    rows = records(spark, record("a", "2026-06-02T10:00:00"))
    statuses = [periods.live_status(r, F.lit(d).cast("date")).first().status for r, d in ((rows, "2026-06-02"), (rows, "2026-06-03"), (rows.limit(0), "2026-06-03"))]
    assert statuses == ["live", "stale", "paused"]
    priced = spark.createDataFrame([(2.0,)], "cost_usd double")
    assert periods.with_secondary_currency(priced, "EUR", 0.5).first().cost_secondary == 1.0
    assert periods.with_secondary_currency(priced, "EUR", 0.0).first().cost_secondary is None
    usage = spark.createDataFrame([("b", "codex", 2), ("a", "claude", 2), ("a", "codex", 1)], "tool_name string, source string, count long")
    row = periods.tool_summary(usage).first()
    assert (row.total_calls, row.distinct_tools, row.leading_tool) == (5, 2, "a")
