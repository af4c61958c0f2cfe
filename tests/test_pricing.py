from decimal import Decimal

from pyspark.sql import functions as F

from turnledger.functions.rates import DEFAULT_RATES
from turnledger.operators import pricing, rollups
from turnledger.plans import extras
from turnledger.sources import rates
from helpers import record, records

CUSTOM = {
    "m": (0.005, 0.0005, None, 0.03), "m-long-context": (0.01, 0.001, None, 0.045),
    "odd": (0.0000012345, None, None, None), "only-long-context": (0.02, None, None, 0.02),
}


def custom_card(spark):
    return rates.rate_card(rates.rate_rows(spark, CUSTOM))


def test_every_bundled_rate_is_whole_nano_usd():
    assert all(rates.nano(r) == rates.nano(r).to_integral_value() for rate in DEFAULT_RATES.values() for r in rate)


def test_inline_card_equals_computed_card(spark):
    inline = rates.default_card(spark)
    computed = rates.rate_card(rates.default_rates(spark))
    assert inline.exceptAll(computed).isEmpty() and computed.exceptAll(inline).isEmpty()


def test_cost_formula(spark, card):
    row = record("a", "2024-01-01T00:00:00", model="claude-sonnet-4", source="claude", input_tokens=1000, output_tokens=2000,
                 cache_read_tokens=3000, cache_creation_tokens=4000, reasoning_tokens=500)
    priced = rollups.with_usd(pricing.price_records(records(spark, row), card)).first()
    assert abs(priced.cost_usd - (0.003 + 2 * 0.015 + 3 * 0.0003 + 4 * 0.00375 + 0.5 * 0.015)) < 1e-12
    assert not priced.cost_unknown


def test_fallback_is_flagged_and_has_no_cache_write_rate(spark, card):
    row = record("a", "2024-01-01T00:00:00", model="nobody", input_tokens=1000, cache_creation_tokens=5000)
    priced = pricing.price_records(records(spark, row), card).first()
    assert priced.cost_unknown and priced.cost_nano == Decimal("1250000")


def test_long_context_covers_the_whole_session(spark):
    rows = records(
        spark,
        record("a", "2024-01-01T00:00:00", model="m", input_tokens=1000, output_tokens=1000, context_used_tokens=1_000),
        record("b", "2024-01-02T00:00:00", model="m", input_tokens=1000, output_tokens=1000, context_used_tokens=300_000),
        record("c", "2024-01-02T00:00:00", model="m", session_id="s2", input_tokens=1000, context_used_tokens=272_000),
        record("d", "2024-01-02T00:00:00", model="gpt-5", session_id="s3", context_used_tokens=272_001),
    )
    card = custom_card(spark)
    daily = rollups.with_usd(rollups.daily_rollup(rows, card)).filter(F.col("base_model") == "m")
    assert abs(daily.agg(F.sum("cost_usd")).first()[0] - 0.115) < 1e-12
    sessions = {r.session_id: r.cost_usd for r in rollups.with_usd(rollups.session_rollup(rows, card)).collect()}
    assert abs(sessions["s1"] - 0.11) < 1e-12 and abs(sessions["s2"] - 0.005) < 1e-12
    status = {r.dedup_key: r for r in pricing.price_records(rows, card).collect()}
    assert status["a"].long_context_applied and status["a"].effective_model == "m-long-context"
    assert not status["c"].long_context_requested
    assert status["d"].long_context_missing_rate and status["d"].effective_model == "gpt-5"


def test_rates_below_a_nano_stay_exact(spark):
    row = record("a", "2024-01-01T00:00:00", model="odd", input_tokens=1_000_000)
    assert pricing.price_records(records(spark, row), custom_card(spark)).first().cost_nano == Decimal("1234500.000000")


def test_a_long_rate_alone_gives_its_model_a_row(spark):
    row = {r.model: r for r in custom_card(spark).collect()}["only"]
    assert row.rate is None and row.long_rate.input_rate == 20000


def test_merge_keeps_bundled_rates(spark):
    over = rates.rate_rows(spark, {"gpt-5": (9, 9, 9, 9), "mine": (0.1, None, None, 0.2), "$fallback": (1, 1, 1, 1), "$note": (1, 1, 1, 1)})
    base = rates.default_rates(spark)
    merged = {r.model: r for r in rates.merge_rates(base, over).collect()}
    assert merged["gpt-5"].input_rate == 1250 and merged["mine"].output_rate == 200000
    assert not any(m.startswith("$") for m in merged)
    audit = {(r.outcome, r.model) for r in rates.merge_audit(base, over).collect()}
    assert audit == {("ignored_known_model", "gpt-5"), ("ignored_fallback", "$fallback"), ("custom_model", "mine")}


def test_rate_file_with_comments(spark, tmp_path):
    path = tmp_path / "rates.jsonc"
    path.write_text('{ // note\n "$schema": {"inputPer1K": 1}, "$fallback": {"inputPer1K": 0.5},\n /* x */ "mine": {"inputPer1K": 0.001, "outputPer1K": 0.002},\n "bad": 3, "text": "no", "list": [1] }')
    got = {r.model: (r.input_rate, r.cached_rate, r.output_rate) for r in rates.read_rate_file(spark, str(path)).collect()}
    assert got == {"$fallback": (500000, 0, 0), "mine": (1000, 0, 2000)}
    card = rates.card_with(spark, rates.read_rate_file(spark, str(path)))
    assert {r.model for r in card.collect()} >= {"mine", "gpt-5"}


def test_unmapped_models_keep_their_first_sight(spark, card):
    rows = records(spark, record("a", "2024-01-01T00:00:00", model="new"), record("b", "2024-01-01T00:00:00", model="old"), record("c", "2024-01-01T00:00:00"))
    stored = spark.createDataFrame([("old", 5), ("mapped", 6)], "model string, first_seen_utc long")
    table = pricing.refresh_unmapped(stored, pricing.unmapped_models(rows, card), F.lit(9).cast("bigint"))
    assert {tuple(r) for r in table.collect()} == {("old", 5), ("new", 9)}
    registry = pricing.register_fallback(rates.default_rates(spark), pricing.unmapped_models(rows, card))
    assert registry.filter("model = 'new'").first().input_rate == 1250


def test_exact_cache_savings(spark, card):
    row = record("a", "2024-01-01T00:00:00", model="gpt-5", cache_read_tokens=2000)
    saved = extras.exact_cache_savings(records(spark, row), card).first().saved_usd
    assert abs(saved - 2 * (0.00125 - 0.000125)) < 1e-12


def test_a_hot_session_is_dealt_in_parts(spark, card):
    """A session with a third of all records spreads over many parts, all others lie in one; costs are those without parts."""
    sizes = {"hot": 3000, **{f"s{i}": 3 for i in range(2000)}}
    names = spark.createDataFrame(list(sizes.items()), "name string, n int").selectExpr("name", "explode(sequence(1, n)) AS i")
    one = records(spark, record("a", "2024-01-01T00:00:00"))
    many = names.crossJoin(one.drop("session_id", "dedup_key", "context_used_tokens")).selectExpr(
        "*", "name AS session_id", "concat(name, '/', i) AS dedup_key",
        "CASE WHEN i = 1 AND (name = 'hot' OR hash(name) % 2 = 0) THEN 900000L ELSE 10L END AS context_used_tokens",
    ).select(*one.columns)
    hot = pricing.hot_keys(many)
    assert [r._parts for r in hot.collect()] == [-(-3000 * pricing.SHARES // 9000)]
    parts = pricing.spread(many, hot).groupBy("session_id", "_salt").count()
    assert parts.agg(F.max("count")).first()[0] < 40 and parts.filter("session_id <> 'hot' AND _salt > 0").isEmpty()
    priced = pricing.price_records(many, card)
    assert priced.count() == 9000 and priced.filter("session_id = 'hot' AND long_context_requested").count() == 3000
    asked = priced.groupBy("session_id").agg(F.sum(F.col("long_context_requested").cast("int")).alias("n"), F.max("context_used_tokens").alias("c"))
    assert asked.filter("n <> CASE WHEN session_id = 'hot' THEN 3000 WHEN c > 10 THEN 3 ELSE 0 END").isEmpty()
    assert pricing.hot_keys(many.limit(0)).isEmpty() and pricing.price_records(many.limit(0), card).isEmpty()
