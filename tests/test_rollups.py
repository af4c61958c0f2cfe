import random

from pyspark.sql import functions as F

from turnledger.functions.columns import base_model, effort_of, variant_id
from turnledger.operators import rollups
from turnledger.operators.filters import UsageQuery, filter_daily, filter_records, filter_sessions
from turnledger.plans import diagnostics, extras, views
from helpers import TOKENS, calls, ms, record, records


def sample(spark, n=60):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        rows.append(record(
            f"k{i}", f"2024-01-{rng.randint(1, 5):02d}T{rng.randint(0, 23):02d}:10:00", session_id=f"s{rng.randint(0, 4)}",
            file_id=f"f{rng.randint(0, 2)}", source=rng.choice(["codex", "claude"]), model=rng.choice(["gpt-5", "gpt-5.5", "nobody"]),
            effort=rng.choice(["n/a", "low", "high"]), workspace=rng.choice(["", "/a", "/b"]), is_sidechain=rng.random() < 0.3,
            context_used_tokens=rng.choice([None, 100, 280_000]), context_window=400_000, **{t: rng.randint(0, 500) for t in TOKENS},
        ))
    return records(spark, *rows)


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_variant_round_trip(spark):
    df = spark.createDataFrame([("a", "high"), ("a b", "n/a"), ("x (y)", "minimal"), ("z", None), ("q", "")], "m string, e string")
    got = df.select("m", "e", variant_id(F.col("m"), F.col("e")).alias("v")).select("*", base_model(F.col("v")).alias("b"), effort_of(F.col("v")).alias("w"))
    for r in got.collect():
        assert r.b == r.m and r.w == (r.e or "n/a")


def test_daily_equals_records_and_session_cost(spark, card):
    rows = sample(spark)
    daily = rollups.daily_rollup(rows, card)
    gaps = rollups.rollup_gaps(rows, daily)
    assert gaps.filter(" OR ".join(f"{c} <> 0" for c in gaps.columns if c.endswith("_gap"))).isEmpty()
    cost = daily.agg(F.sum("cost_nano")).first()[0]
    assert cost == rollups.session_rollup(rows, card).agg(F.sum("cost_nano")).first()[0]


def test_subtract_is_the_inverse_of_adding(spark, card):
    rows = sample(spark)
    parts = [rollups.file_daily(rows.filter(F.col("file_id") == f), card).drop("file_id") for f in ("f0", "f1", "f2")]
    whole = rollups.merge_daily(*parts)
    assert same(rollups.combine_daily([whole], [parts[2]]), rollups.merge_daily(*parts[:2]))
    assert rollups.combine_daily([whole], parts).isEmpty()


def test_session_workspace_and_fill(spark, card):
    rows = records(
        spark,
        record("a", "2024-01-01T01:00:00", model="b-model", workspace="/late"),
        record("b", "2024-01-01T02:00:00", model="a-model", workspace="", context_used_tokens=90, context_window=100),
        record("c", "2024-01-01T03:00:00", model="c-model", workspace="/other", is_sidechain=True, input_tokens=7),
    )
    sessions = rollups.session_rollup(rows, card)
    row = sessions.first()
    assert (row.workspace, row.turns, row.sidechain_tokens, row.peak_context_fill) == ("/late", 3, 7, 0.9)
    assert (row.first_ts_utc, row.last_ts_utc) == (ms("2024-01-01T01:00:00"), ms("2024-01-01T03:00:00"))
    assert extras.context_fill_warnings(sessions, 90.0).count() == 1
    assert extras.context_fill_warnings(sessions, 91.0).count() == 0


def test_filters(spark, card):
    rows = sample(spark)
    whole = UsageQuery(ms("2024-01-01T00:00:00"), ms("2024-01-31T00:00:00"))
    assert filter_records(rows, whole).count() == 60
    narrow = UsageQuery(ms("2024-01-02T13:00:00"), ms("2024-01-03T01:00:00"), efforts=("n/a", "high"), sources=("codex",))
    kept = filter_records(rows, narrow)
    assert {r.day_local for r in kept.collect()} <= {"2024-01-02", "2024-01-03"}
    daily = filter_daily(rollups.daily_rollup(rows, card), narrow)
    assert daily.agg(F.sum("turns")).first()[0] == kept.count()
    sessions = rollups.session_rollup(records(spark, record("a", "2024-01-01T01:00:00"), record("b", "2024-01-09T01:00:00")), card)
    assert filter_sessions(sessions, UsageQuery(ms("2024-01-03T00:00:00"), ms("2024-01-04T00:00:00"), models=("x",))).count() == 1
    assert filter_sessions(sessions, UsageQuery(ms("2024-01-10T00:00:00"), ms("2024-01-11T00:00:00"))).isEmpty()


def test_views_read_no_logs_and_push_the_day_range_down(spark, card, tmp_path):
    path = str(tmp_path / "daily")
    rollups.daily_rollup(sample(spark), card).write.partitionBy("day_local").parquet(path)
    from turnledger.schemas import DAILY_ROLLUP

    q = UsageQuery(ms("2024-01-02T00:00:00"), ms("2024-01-03T00:00:00"), sources=("codex",))
    plan = views.daily_series(spark.read.schema(DAILY_ROLLUP).parquet(path), q)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day_local" in plan and "PushedFilters: [IsNotNull(source)" in plan
    assert "text" not in plan.lower().replace("context", "")


def test_hourly_series(spark, card):
    rows = records(
        spark,
        record("1", "2025-02-01T09:10:00", input_tokens=1000, output_tokens=500, cache_read_tokens=100, reasoning_tokens=50),
        record("2", "2025-02-01T09:45:00", input_tokens=2000, output_tokens=100),
        record("3", "2025-02-01T15:00:00", input_tokens=300, output_tokens=700),
    )
    got = views.hourly_series(rows, card, UsageQuery(ms("2025-02-01T00:00:00"), ms("2025-02-01T23:59:59"))).collect()
    assert [(r.hour_local, r.turns, r.total_tokens) for r in got] == [(9, 2, 3750), (15, 1, 1000)]


def test_tool_views_and_dashboard(spark, card):
    rows = records(spark, record("a", "2024-01-01T01:00:00"), record("b", "2024-01-02T01:00:00"))
    tools = calls(spark, ("a", "shell"), ("a", "shell"), ("b", "read"), ("gone", "x"))
    q = UsageQuery(ms("2024-01-01T00:00:00"), ms("2024-01-02T23:00:00"))
    usage = views.tool_usage(tools, rows, q).collect()
    assert [(r.tool_name, r["count"]) for r in usage] == [("shell", 2), ("read", 1)]
    tables = views.UsageTables(rows, tools, card)
    parts = views.run_query(tables, q)
    assert set(parts) == {"series", "variants", "sessions", "tools", "tool_calls_by_day", "hourly_series"}
    long_range = UsageQuery(q.from_utc, q.to_utc + 86_400_000 * 3)
    assert "hourly_series" not in views.run_query(tables, long_range)
    for name in ("series", "variants", "sessions", "tools", "heatmap", "comparison"):
        assert views.run_query(tables, UsageQuery(q.from_utc, q.to_utc, view=name))[name].count() > 0


def test_zero_denominators_and_empty_input(spark, card):
    rows = records(spark, record("a", "2024-01-01T01:00:00"))
    row = views.variant_breakdown(rollups.daily_rollup(rows, card), UsageQuery(0, ms("2030-01-01T00:00:00"))).first()
    assert (row.output_ratio, row.share_of_cost_pct, row.cache_efficiency_pct, row.blended_cost_per_1k) == (0, 0, 0, 0)
    none = rows.limit(0)
    assert views.day_total(rollups.daily_rollup(none, card), "2024-01-01").first().turns == 0


def test_local_days_follow_the_session_time_zone(spark):
    from turnledger.functions.columns import local_day, local_hour, local_weekday

    df = spark.createDataFrame([(ms("2024-06-01T02:30:00"),)], "ts long")
    got = []
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got.append(tuple(df.select(local_day(F.col("ts")), local_weekday(F.col("ts")), local_hour(F.col("ts"))).first()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [("2024-06-01", 6, 2), ("2024-05-31", 5, 22)]


def test_anomaly_days(spark, card):
    costs = [1, 1, 1, 5, 1]
    rows = records(spark, *[record(str(i), f"2024-01-0{i + 1}T00:00:00", input_tokens=c * 1000) for i, c in enumerate(costs)])
    got = extras.anomaly_days(rollups.daily_rollup(rows, card), trailing=3).orderBy("day_local").collect()
    assert [r.is_anomaly for r in got] == [False, False, False, True, False]


def test_diagnostics(spark, card):
    path = "/tmp/.codex/sessions/2026/06/07/rollout-diag.jsonl"
    rows = records(
        spark,
        record("a", "2026-06-08T00:10:00", file_id=path, session_id="diag", model="custom-large", input_tokens=90, output_tokens=50, context_used_tokens=300_000),
        record("b", "2026-06-08T00:20:00", file_id="/no/day.jsonl", session_id="x"),
        record("c", "2026-06-07T23:50:00", file_id="/no/day.jsonl", session_id="x"),
    )
    assert [r.model for r in diagnostics.long_context_missing(rows, card).collect()] == ["custom-large"]
    assert [r.session_id for r in diagnostics.midnight_sessions(rollups.session_rollup(rows, card)).collect()] == ["x"]
    daily = rollups.file_daily(rows, card)
    mismatch = diagnostics.folder_day_mismatches(daily).collect()
    assert [(r.folder_day, r.event_days) for r in mismatch] == [("2026-06-07", "2026-06-08")]
    deltas = {r.day: r.delta_usd for r in diagnostics.folder_day_costs(daily).collect()}
    assert deltas["2026-06-08"] == -deltas["2026-06-07"] > 0
    totals = spark.createDataFrame([(path, "diag", 100, 50), (path, "unseen", 1, 1)], "file_path string, session_id string, input_total long, output_total long")
    files = rollups.file_sessions(rows, card)
    assert diagnostics.reconciliation_checked(totals, files).first()[0] == 1
    assert [r.delta_tokens for r in diagnostics.reconciliation_mismatches(totals, files).collect()] == [-10]
