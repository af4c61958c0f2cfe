"""The registered queries. Each takes (spark, folder of the tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnledger.functions.columns import base_model, effort_of, local_day, local_hour, local_weekday
from turnledger.operators import claude, codex, filters, incremental, logrows, normalize, pricing, rollups
from turnledger.operators.filters import UsageQuery
from turnledger.plans import diagnostics, extras, logfiles, periods, refresh, samples, views
from turnledger.session import staged, work_folder
from turnledger.sources import inventory, lines as line_source, ranges, rates, store
from turnledger.streaming import announced, rollups as stream_rollups, stateful_parse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Range and filters of the registered queries: the month the events cover.
MONTH = UsageQuery(from_utc=1_704_067_200_000, to_utc=1_706_659_199_999)
FORTNIGHT = UsageQuery(
    from_utc=1_704_844_800_000, to_utc=1_706_054_399_999,
    sources=("codex",), efforts=("high", "n/a"), workspaces=("/ws/0", "/ws/1"),
    models=("gpt-5-codex", "gpt-5.5", "unlisted-model"),
)
TWO_DAYS = UsageQuery(from_utc=1_706_400_000_000, to_utc=1_706_572_799_999)
BY_BASE_MODEL = UsageQuery(from_utc=MONTH.from_utc, to_utc=MONTH.to_utc, rollup_to_base_model=True)
AS_OF = "2024-01-30"


# A file of a stream is one task's work.
EVENTS_PER_FILE = 50_000


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.daily_rollup(samples.records(spark, sf), rates.default_card(spark))


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.session_rollup(samples.records(spark, sf), rates.default_card(spark))


def _tables(spark: SparkSession, sf: str) -> views.UsageTables:
    return views.UsageTables(samples.records(spark, sf), samples.tools(spark, sf), rates.default_card(spark))


def _logs(spark: SparkSession, sf: str, source: str | None = None) -> DataFrame:
    """Rendered log lines, written once as files of logs would be."""
    return staged(samples.unsized_log_lines(spark, sf, source=source), "lines")


def _codex_rows(spark: SparkSession, sf: str) -> DataFrame:
    return codex.rows(_logs(spark, sf, "codex"))


def _claude_turns(spark: SparkSession, sf: str) -> DataFrame:
    return claude.turns(claude.assistant_rows(claude.rows(_logs(spark, sf, "claude"))))


def _both_turns(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    logs = _logs(spark, sf)
    won = claude.turns(claude.assistant_rows(claude.rows(logs)))
    return codex.token_rows(codex.rows(logs)).filter("billed"), won


def _parsed(spark: SparkSession, sf: str) -> normalize.ParsedLogs:
    return normalize.parse_lines(_logs(spark, sf))


# --- sources and sinks ---------------------------------------------------------------------------


def _written(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """Rendered lines with their offsets, and the folder that their files are to lie in."""
    return staged(line_source.with_offsets(_logs(spark, sf)), "placed"), logfiles.local_folder(work_folder(spark, "files"))


def _small_store(spark: SparkSession) -> store.UsageStore:
    return store.UsageStore(spark, work_folder(spark, "store"), buckets=2)


def _roots(root: str) -> dict[str, str | None]:
    return {"codex": f"{root}/logs/codex", "claude": f"{root}/logs/claude"}


def _below(root: str) -> Column:
    return F.substring("file_path", len(root) + 1, 1 << 20).alias("file_path")


@query
def s01_file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """All log files written from the events, and a root that is off."""
    rows, root = _written(spark, sf)
    logfiles.write_files(rows, root)
    found = inventory.newest_first(inventory.scan_roots(spark, {**_roots(root), "other": None}))
    return found.select("source", _below(root), "size")


@query
def s02_changed_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Some folders and files of the same, some that are gone, and some outside the roots."""
    rows, root = _written(spark, sf)
    logfiles.write_files(rows, root)
    paths = rows.select("file_path").distinct()
    folders = paths.filter(F.endswith("file_path", F.lit("-4.jsonl"))).select(F.regexp_replace("file_path", "/[^/]*$", "").alias("path"))
    files = paths.filter(F.endswith("file_path", F.lit("-2.jsonl"))).select(F.col("file_path").alias("path"))
    gone = files.select(F.concat("path", F.lit("l")).alias("path"))
    named = folders.unionByName(files).unionByName(gone).select(F.concat(F.lit(root), "path").alias("path"))
    outside = named.select(F.concat(F.lit("/elsewhere"), "path").alias("path"))
    found = inventory.scan_changed(spark, named.unionByName(outside), {"codex": f"{root}/logs/codex"})
    return found.select("source", _below(root), "size")


@query
def s03_line_offsets(spark: SparkSession, sf: str) -> DataFrame:
    placed = line_source.emitted_lines(_logs(spark, sf))
    return placed.select("source", "file_path", "line_offset", "n_bytes")


@query
def s03_file_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same from real files, as Spark's reader gives them."""
    rows, root = _written(spark, sf)
    logfiles.write_files(rows, root)
    logs = ranges.whole_files(inventory.scan_roots(spark, _roots(root)))
    return line_source.emitted_lines(logs).select("source", _below(root), "line_offset", "n_bytes")


@query
def s03_block_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The same from blocks of two kilobytes, each read by itself."""
    rows, root = _written(spark, sf)
    logfiles.write_files(rows, root)
    found = inventory.scan_roots(spark, _roots(root))
    files = found.select("source", "file_path", F.lit(0).cast("bigint").alias("start"), F.col("size").alias("file_size"))
    lines = ranges.read_ranges(files, block_bytes=2_048, piece_bytes=300).filter("line_offset IS NOT NULL AND value IS NOT NULL")
    return lines.select("source", _below(root), "line_offset", "n_bytes")


@query
def s04_oversized_lines(spark: SparkSession, sf: str) -> DataFrame:
    return line_source.oversized_counts(
        _logs(spark, sf), line_source.MIN_MAX_LINE_BYTES
    )


@query
def s05_incomplete_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of every third user lack their last newline, as a file still being written does."""
    rows, root = _written(spark, sf)
    last = rows.groupBy("file_path").agg(F.max("line_offset").alias("last"))
    ended = (F.col("user_id") % 3 != 0) | (F.col("line_offset") != F.col("last"))
    logfiles.write_files(rows.join(last, "file_path"), root, ended)
    logs = staged(ranges.whole_files(inventory.scan_roots(spark, _roots(root))), "read")
    found = logrows.incomplete_files(codex.rows(logs)).unionByName(logrows.incomplete_files(claude.rows(logs)))
    return found.select("source", _below(root))


def _event_files(spark: SparkSession, sf: str, upto: int | None = None) -> DataFrame:
    """Inventory and held counts as the events seen so far would give (1 event = 100 bytes)."""
    rows = samples.records(spark, sf)
    if upto is not None:
        rows = rows.filter(F.col("ts_utc") <= upto)
    return rows.groupBy("source", F.col("file_id").alias("file_path")).agg(
        (F.count("*") * 100).alias("size"), F.max("ts_utc").alias("mtime_ms"), F.count("*").alias("turns")
    ).withColumn("file_id", F.col("file_path"))


@query
def s06_backfill_window(spark: SparkSession, sf: str) -> DataFrame:
    files = _event_files(spark, sf).select(*inventory.INVENTORY_COLUMNS)
    return inventory.within_backfill(files, 1, MONTH.to_utc + 27 * inventory.DAY_MS)


def _two_batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Stored records, and a later batch that rewrites some of them and adds others."""
    rows = samples.records(spark, sf)
    old = rows.filter(F.col("hour_local") < 16)
    new = rows.filter(F.col("hour_local") >= 12).withColumn("output_tokens", F.col("output_tokens") + 1)
    return old, new


@query
def s07_rate_file(spark: SparkSession, sf: str) -> DataFrame:
    """A rate file with comments, odd keys and odd values, written for the models seen and read back."""
    turns = samples.records(spark, sf).groupBy("model").agg(F.count("*").alias("n"), F.max("input_tokens").alias("most"))
    body = F.format_string('{"inputPer1K": %d.5, /* seen %d times */ "outputPer1K": 0.25}', "most", "n")
    rows = [
        F.format_string('  "%s": %s, // a model', "model", body), F.format_string('  "$%s": %s,', "model", body),
        F.format_string('  "%s-text": "none", "%s-list": [%d], "%s-cached": {"cachedInputPer1K": 0.00125},', "model", "model", "n", "model"),
    ]
    text = turns.select(F.concat_ws("\n", *rows).alias("line")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("all"))
    whole = text.select(F.concat(F.lit("{\n"), "all", F.lit('\n  "$fallback": {"outputPer1K": 2}\n}')).alias("value"))
    folder = work_folder(spark, "rates")
    whole.coalesce(1).write.text(folder)
    return rates.read_rate_file(spark, folder).select("model", *[F.col(c).cast("double").alias(c) for c in rates.RATE_COLUMNS])


@query
def s08_upsert_records(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _two_batches(spark, sf)
    return incremental.upsert_records(old, new).select("dedup_key", "day_local", "output_tokens")


@query
def s08_upsert_tool_events(spark: SparkSession, sf: str) -> DataFrame:
    _, new = _two_batches(spark, sf)
    calls = samples.tools(spark, sf)
    fresh = calls.filter(F.endswith("event_key", F.lit("#0"))).join(new.select(F.col("dedup_key").alias("record_dedup_key")), "record_dedup_key", "left_semi")
    return incremental.upsert_tools(calls, new, fresh.select(*calls.columns)).select("event_key", "tool_name")


@query
def s08_store_repeat(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches through a store; the second fails half-way, is recovered and comes again."""
    usage, card = _small_store(spark), rates.default_card(spark)
    old, new = (staged(rows, "batch") for rows in _two_batches(spark, sf))
    none, no_calls = old.select("file_id").limit(0), spark.createDataFrame([], store.TABLES["tool_event"])
    usage.apply(none, old, no_calls)
    incremental.refresh_rollups(usage, card)
    usage.apply(none, new, no_calls)  # and no rollups: the run ends here
    again = store.UsageStore(spark, usage.root)
    stream_rollups.into_store(again, card)(new, no_calls, new.select("dedup_key"), 1)
    return rollups.with_usd(again.read("daily_rollup"))


@query
def s09_delete_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples.records(spark, sf)
    files = rows.filter(F.col("workspace") == "/ws/0").filter(F.col("context_used_tokens") > 100_000).select("file_id").distinct()
    return incremental.delete_files(rows, files).select("dedup_key", "file_id")


@query
def s10_clear_and_refill(spark: SparkSession, sf: str) -> DataFrame:
    """A store that was filled, cleared and filled with other records; its run metrics stay until a reset."""
    usage, card = _small_store(spark), rates.default_card(spark)
    rows = staged(samples.records(spark, sf), "rows")
    no_calls = spark.createDataFrame([], store.TABLES["tool_event"])
    runs = rows.groupBy("day_local").agg(F.max("ts_utc").alias("run_utc")).select("run_utc", F.lit(False).alias("full_rescan"), F.lit(0).cast("bigint").alias("read_bytes"))
    usage.append("run_metrics", runs)
    for part in (rows, rows.filter(F.col("hour_local") < 6)):
        usage.clear()
        usage.apply(part.select("file_id").limit(0), part, no_calls)
    incremental.refresh_rollups(usage, card)
    kept = usage.read("usage_record").groupBy("source").agg(F.count("*").alias("turns"), F.sum("total_tokens").alias("total_tokens"))
    held = usage.read("daily_rollup").groupBy("source").agg(F.sum("total_tokens").alias("rollup_tokens"))
    metrics = usage.read("run_metrics").agg(F.count("*").alias("runs"))
    return kept.join(held, "source").crossJoin(metrics)


# --- parse ---------------------------------------------------------------------------------------


@query
def p01_keyword_filter(spark: SparkSession, sf: str) -> DataFrame:
    logs = _logs(spark, sf)
    hit = F.when(F.col("source") == "codex", codex.keyword(F.col("value"))).otherwise(claude.keyword(F.col("value")))
    return logs.groupBy("source", "file_path").agg(
        F.count("*").alias("line_count"), F.count_if(hit).alias("keyword_count")
    )


@query
def p02_malformed_lines(spark: SparkSession, sf: str) -> DataFrame:
    logs = _logs(spark, sf)
    return logrows.quality(codex.rows(logs)).unionByName(logrows.quality(claude.rows(logs)))


@query
def p03_context_carry(spark: SparkSession, sf: str) -> DataFrame:
    return _codex_rows(spark, sf).filter(F.col("kind") == "tokens").select(
        "session_id", "line_offset", "model", F.coalesce("effort", F.lit("-")).alias("effort"),
        "approval_policy", "sandbox_mode",
    )


@query
def p04_cumulative_delta(spark: SparkSession, sf: str) -> DataFrame:
    tokens = codex.token_rows(_codex_rows(spark, sf))
    return tokens.filter(F.col("billed") & F.col("from_total")).select(
        "session_id", "line_offset", "raw_input", "raw_cached", "raw_output", "raw_reasoning"
    )


@query
def p05_last_usage_fallback(spark: SparkSession, sf: str) -> DataFrame:
    tokens = codex.token_rows(_codex_rows(spark, sf))
    return tokens.filter(F.col("billed") & ~F.col("from_total")).select(
        "session_id", "line_offset", "raw_input", "raw_cached", "raw_output", "raw_reasoning"
    )


@query
def p06_turn_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return codex.token_rows(_codex_rows(spark, sf)).filter("billed").select(
        "session_id", "line_offset", "context_window", "context_used_tokens", "approval_policy",
        "sandbox_mode", "primary_pct", "secondary_pct",
    )


@query
def p07_codex_tools(spark: SparkSession, sf: str) -> DataFrame:
    rows = _codex_rows(spark, sf)
    calls = codex.tool_events(rows, staged(codex.token_rows(rows), "codex-tokens"))
    return calls.select("session_id", "record_dedup_key", "event_key", "tool_name")


@query
def p08_assistant_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = claude.assistant_rows(claude.rows(_logs(spark, sf, "claude")))
    return rows.select(
        "session_id", "line_offset", "request_id", "model", "workspace", "raw_input", "raw_output",
        "raw_cache_read", "raw_cache_creation",
    )


@query
def p09_request_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return _claude_turns(spark, sf).select(
        "session_id", "dedup_key", "line_offset", "model", "raw_input", "raw_output", "raw_cache_read", "raw_cache_creation"
    )


@query
def p10_claude_tools(spark: SparkSession, sf: str) -> DataFrame:
    return claude.tool_events(_claude_turns(spark, sf)).select("session_id", "event_key", "tool_name", "is_sidechain")


@query
def p11_turn_times(spark: SparkSession, sf: str) -> DataFrame:
    tokens, won = _both_turns(spark, sf)
    names = ["source", "session_id", "line_offset", "ts_utc"]
    both = tokens.select(*names).unionByName(won.select(*names))
    return both.filter(F.col("ts_utc") > 0)


@query
def p12_dedupe_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Each record once more with later values; the later copy must win, with its own calls only."""
    rows, calls = samples.records(spark, sf), samples.tools(spark, sf)
    again = rows.filter(F.col("is_sidechain")).withColumn("ts_utc", F.col("ts_utc") + 1)
    moved = calls.filter(F.col("is_sidechain") & F.endswith("event_key", F.lit("#0"))).withColumn("ts_utc", F.col("ts_utc") + 1)
    records, tools = normalize.dedupe(
        rows.withColumn("_at", F.lit(0)).unionByName(again.withColumn("_at", F.lit(1))),
        calls.withColumn("_at", F.lit(0)).unionByName(moved.withColumn("_at", F.lit(1))),
        "_at",
    )
    return records.select("dedup_key", "ts_utc").join(
        tools.groupBy(F.col("record_dedup_key").alias("dedup_key")).agg(F.count("*").alias("calls")), "dedup_key", "left"
    ).select("dedup_key", "ts_utc", F.coalesce("calls", F.lit(0)).alias("calls"))


@query
def p13_record_keys(spark: SparkSession, sf: str) -> DataFrame:
    tokens, won = _both_turns(spark, sf)
    return tokens.select("dedup_key").unionByName(won.select("dedup_key"))


@query
def p14_session_headers(spark: SparkSession, sf: str) -> DataFrame:
    logs = _logs(spark, sf)
    heads = codex.session_dimension(codex.rows(logs))
    others = claude.session_dimension(claude.assistant_rows(claude.rows(logs)))
    names = ["source", "file_path", "session_id", "cwd", "cli_version", "git_branch"]
    return heads.select(*names).unionByName(others.select(*names)).withColumn(
        "git_branch", F.coalesce("git_branch", F.lit("-"))
    )


# --- normalise -----------------------------------------------------------------------------------


@query
def n01_codex_buckets(spark: SparkSession, sf: str) -> DataFrame:
    buckets = normalize.codex_buckets(codex.token_rows(_codex_rows(spark, sf)))
    return buckets.select("dedup_key", "effort", "workspace", *rollups.TOKEN_COLUMNS)


@query
def n02_claude_buckets(spark: SparkSession, sf: str) -> DataFrame:
    buckets = normalize.claude_buckets(_claude_turns(spark, sf))
    return buckets.select("dedup_key", "effort", "workspace", "is_sidechain", "stop_reason", *rollups.TOKEN_COLUMNS)


@query
def n03_usage_records(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).records.select(
        "dedup_key", "source", "session_id", "ts_utc", "day_local", "dow_local", "hour_local", "model",
        "effort", "variant_id", "workspace", *rollups.TOKEN_COLUMNS, "total_tokens", "is_sidechain",
    )


@query
def n04_total_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return samples.records(spark, sf).select("dedup_key", "total_tokens")


@query
def n05_variants(spark: SparkSession, sf: str) -> DataFrame:
    seen = samples.records(spark, sf).groupBy("model", "effort", "variant_id").agg(F.count("*").alias("turns"))
    return seen.select(
        "model", "effort", "variant_id", base_model(F.col("variant_id")).alias("base_model"),
        effort_of(F.col("variant_id")).alias("variant_effort"), "turns",
    )


@query
def n06_local_calendar(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts_utc")
    return samples.records(spark, sf).select(
        "dedup_key", local_day(ts).alias("day"), local_weekday(ts).alias("weekday"), local_hour(ts).alias("hour")
    )


# --- pricing -------------------------------------------------------------------------------------


def _overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Rate overrides for every model seen, plus a fallback override."""
    seen = samples.records(spark, sf).select("model").distinct()
    flat = [F.lit(rates.nano(r)).cast(rates.RATE_TYPE).alias(c) for c, r in zip(rates.RATE_COLUMNS, (0.01, 0.002, 0.003, 0.04), strict=True)]
    fallback = spark.range(1).select(F.lit(rates.FALLBACK_KEY).alias("model"))
    return seen.unionByName(fallback).select("model", *flat)


@query
def r01_merged_rates(spark: SparkSession, sf: str) -> DataFrame:
    merged = rates.merge_rates(rates.default_rates(spark), _overrides(spark, sf))
    seen = samples.records(spark, sf).select("model").distinct()
    return merged.join(seen, "model", "left_semi").select(
        "model", *[F.col(c).cast("double").alias(c) for c in rates.RATE_COLUMNS]
    )


@query
def r02_merge_audit(spark: SparkSession, sf: str) -> DataFrame:
    return rates.merge_audit(rates.default_rates(spark), _overrides(spark, sf))


@query
def r03_long_context_keys(spark: SparkSession, sf: str) -> DataFrame:
    card = rates.default_card(spark)
    rated = card.filter(F.col("long_rate").isNotNull()).select("model")
    return pricing.long_context_keys(samples.records(spark, sf)).join(rated, "model", "left_semi").select(
        "source", "session_id", "model", "key_context"
    )


@query
def r04_effective_rate(spark: SparkSession, sf: str) -> DataFrame:
    priced = pricing.price_records(samples.records(spark, sf), rates.default_card(spark))
    return priced.select("dedup_key", "effective_model", "cost_unknown")


@query
def r05_record_cost(spark: SparkSession, sf: str) -> DataFrame:
    priced = pricing.price_records(samples.records(spark, sf), rates.default_card(spark))
    return rollups.with_usd(priced.select("dedup_key", "cost_nano"))


@query
def r06_long_context_status(spark: SparkSession, sf: str) -> DataFrame:
    priced = pricing.price_records(samples.records(spark, sf), rates.default_card(spark))
    return priced.select("dedup_key", "long_context_requested", "long_context_applied", "long_context_missing_rate")


@query
def r07_unmapped_models(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples.records(spark, sf)
    stored = rows.groupBy("model").agg(F.min("ts_utc").alias("first_seen_utc")).filter(F.col("model") != "gpt-5-mini")
    unmapped = pricing.unmapped_models(rows, rates.default_card(spark))
    return pricing.refresh_unmapped(stored, unmapped, F.lit(MONTH.to_utc).cast("bigint"))


@query
def r08_reprice(spark: SparkSession, sf: str) -> DataFrame:
    card = rates.card_with(spark, _overrides(spark, sf))
    daily, _ = incremental.reprice(samples.records(spark, sf), card)
    return rollups.with_usd(daily).select("day_local", "source", "variant_id", "workspace", "cost_usd", "unknown_cost_turns")


# --- rollups and filters -------------------------------------------------------------------------


@query
def a01_daily_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.with_usd(_daily(spark, sf))


@query
def a02_session_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.with_usd(_sessions(spark, sf))


@query
def a03_file_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.with_usd(rollups.file_daily(samples.records(spark, sf), rates.default_card(spark)))


@query
def a03_file_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.with_usd(rollups.file_sessions(samples.records(spark, sf), rates.default_card(spark)))


@query
def a03_file_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.file_counts(samples.records(spark, sf), samples.tools(spark, sf))


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = samples.records(spark, sf)
    return rows.filter(F.col("hour_local") < 12), rows.filter(F.col("hour_local") >= 12)


@query
def a04_merged_contributions(spark: SparkSession, sf: str) -> DataFrame:
    """Daily contributions of two halves, each priced by itself, added together."""
    card = rates.default_card(spark)
    first, second = (rollups.daily_rollup(part, card) for part in _halves(spark, sf))
    return rollups.with_usd(rollups.merge_daily(first, second))


@query
def a05_merged_sessions(spark: SparkSession, sf: str) -> DataFrame:
    card = rates.default_card(spark)
    first, second = (rollups.session_rollup(part, card) for part in _halves(spark, sf))
    return rollups.with_usd(rollups.merge_sessions(first, second))


@query
def a06_subtract_file(spark: SparkSession, sf: str) -> DataFrame:
    """Whole daily rollup minus the contributions of some files."""
    card, rows = rates.default_card(spark), samples.records(spark, sf)
    gone = rollups.file_daily(rows.filter(F.col("session_id").endswith("-3")), card)
    return rollups.with_usd(rollups.combine_daily([rollups.daily_rollup(rows, card)], [gone]))


@query
def a07_rollup_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.rollup_gaps(samples.records(spark, sf), _daily(spark, sf))


@query
def f01_daily_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.with_usd(filters.filter_daily(_daily(spark, sf), FORTNIGHT)).select(
        "day_local", "source", "variant_id", "workspace", "turns", "cost_usd"
    )


@query
def f02_record_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filter_records(samples.records(spark, sf), FORTNIGHT).select("dedup_key", "day_local", "variant_id")


@query
def f03_session_overlap(spark: SparkSession, sf: str) -> DataFrame:
    kept = filters.filter_sessions(_sessions(spark, sf), UsageQuery(TWO_DAYS.from_utc, TWO_DAYS.to_utc, sources=("claude",), workspaces=("/ws/2",)))
    return kept.select("source", "session_id", "first_ts_utc", "last_ts_utc", "turns")


# --- views ---------------------------------------------------------------------------------------


@query
def q01_daily_series(spark: SparkSession, sf: str) -> DataFrame:
    return views.daily_series(_daily(spark, sf), MONTH)


@query
def q02_daily_series_base_model(spark: SparkSession, sf: str) -> DataFrame:
    return views.daily_series(_daily(spark, sf), BY_BASE_MODEL)


@query
def q03_variant_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return views.variant_breakdown(staged(_daily(spark, sf), "daily"), MONTH)


@query
def q04_base_model_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return views.variant_breakdown(staged(_daily(spark, sf), "daily"), BY_BASE_MODEL)


@query
def q05_session_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return views.session_leaderboard(_sessions(spark, sf), MONTH, views.LEADERBOARD_ROWS)


@query
def q06_tool_usage(spark: SparkSession, sf: str) -> DataFrame:
    return views.tool_usage(samples.tools(spark, sf), samples.records(spark, sf), MONTH)


@query
def q07_tool_calls_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return views.tool_calls_by_day(samples.tools(spark, sf), samples.records(spark, sf), FORTNIGHT)


@query
def q08_hourly_series(spark: SparkSession, sf: str) -> DataFrame:
    return views.hourly_series(samples.records(spark, sf), rates.default_card(spark), TWO_DAYS)


@query
def q09_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return views.heatmap(samples.records(spark, sf), rates.default_card(spark), MONTH)


@query
def q10_source_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return views.source_comparison(_daily(spark, sf), MONTH)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Run metrics: one run per day of events; the run of the 10th was a full rescan."""
    return samples.events(spark, sf).groupBy("day_local").agg(F.max("ts_utc").alias("run_utc")).withColumn(
        "full_rescan", F.col("day_local") == "2024-01-10"
    )


@query
def q11_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return views.freshness(samples.records(spark, sf), _runs(spark, sf))


@query
def q12_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Two states of the growing logs are parsed and stored one after the other; each bad line counts once."""
    logs = _logs(spark, sf)
    usage = store.UsageStore(spark, work_folder(spark, "store"))
    for state in (logs.filter(F.col("chunk") < 8), logs):
        bad = logrows.quality(codex.rows(state, line_source.MIN_MAX_LINE_BYTES)).unionByName(
            logrows.quality(claude.rows(state, line_source.MIN_MAX_LINE_BYTES))
        )
        none = [F.lit(0).cast("bigint").alias(c) for c in ("size", "mtime_ms", "last_offset", "prefix_check", "turns", "tools")]
        rows = staged(bad.select(
            "file_path", F.col("file_path").alias("file_id"), "source", *none,
            F.col("malformed_count").alias("malformed"), F.col("oversized_count").alias("oversized"),
        ), "bad")
        usage.replace_rows("file_state", rows, ["file_path"], rows)
    unmapped = pricing.unmapped_models(samples.records(spark, sf), rates.default_card(spark))
    return views.warnings(usage.read("file_state"), unmapped)


@query
def q13_latest_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return views.latest_rate_limit(_parsed(spark, sf).rate_limits)


# Key columns and measures of the dashboard's parts.
DASHBOARD_CELLS = {
    "series": (("day_local", "source", "variant_id", "workspace"), ("total_tokens", "turns", "cost_usd")),
    "variants": (("variant_id", "source"), ("total_tokens", "cost_usd")),
    "sessions": (("source", "session_id", "workspace"), ("total_tokens", "turns", "cost_usd", "peak_context_fill")),
    "tools": (("tool_name", "source"), ("count", "share_pct")),
    "tool_calls_by_day": (("day_local",), ("count",)),
    "hourly_series": (("day_local", "hour_local"), ("total_tokens", "turns", "cost_usd")),
}


@query
def q14_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """All values of the dashboard, one row per part, key and measure."""
    tables = _tables(spark, sf)
    tables.daily, tables.sessions = staged(tables.daily, "daily"), staged(tables.sessions, "sessions")
    return _cells(views.dashboard(tables, TWO_DAYS), DASHBOARD_CELLS)


@query
def q15_day_total(spark: SparkSession, sf: str) -> DataFrame:
    return views.day_total(_daily(spark, sf), AS_OF)


# --- period analytics ----------------------------------------------------------------------------


@query
def w01_period_windows(spark: SparkSession, sf: str) -> DataFrame:
    table = periods.period_table(periods.latest_day(_daily(spark, sf)))
    return table.select("period", "window_from", "window_to", "prev_from", "prev_to", "bucket_count")


@query
def w02_current_ranges(spark: SparkSession, sf: str) -> DataFrame:
    table = periods.period_table(periods.latest_day(_daily(spark, sf)))
    return table.select("period", "current_from", "current_to")


@query
def w03_fetch_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Rows the fetch range of each period would read."""
    daily = staged(_daily(spark, sf), "daily")
    table = periods.period_table(periods.latest_day(daily)).select("period", "fetch_from", "current_to")
    days = daily.groupBy("day_local").agg(F.count("*").alias("n"))
    # Both sides are small by their nature: five ranges, one row per day.
    return days.join(table, days.day_local.between(table.fetch_from, table.current_to)).groupBy("period", "fetch_from").agg(
        F.sum("n").alias("row_count")
    )


@query
def w04_window_totals(spark: SparkSession, sf: str) -> DataFrame:
    return periods.window_totals(_daily(spark, sf), periods.PERIODS, _as_of())


@query
def w05_period_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return periods.period_comparison(_daily(spark, sf), periods.PERIODS, _as_of())


@query
def w06_peak_day(spark: SparkSession, sf: str) -> DataFrame:
    return periods.peak_day(_daily(spark, sf), periods.PERIODS, _as_of())


@query
def w07_period_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return periods.period_buckets(_daily(spark, sf), periods.PERIODS, _as_of(), periods.TREND_BUCKETS)


@query
def w08_today_hours(spark: SparkSession, sf: str) -> DataFrame:
    hourly = views.hourly_series(samples.records(spark, sf), rates.default_card(spark), MONTH)
    return periods.today_hours(hourly, _as_of())


@query
def w08_today_summary(spark: SparkSession, sf: str) -> DataFrame:
    return periods.today_hours_summary(w08_today_hours(spark, sf))


@query
def w09_top_models(spark: SparkSession, sf: str) -> DataFrame:
    return periods.top_models(staged(_daily(spark, sf), "daily"), "day", _as_of())


@query
def w10_composition(spark: SparkSession, sf: str) -> DataFrame:
    return periods.composition(_daily(spark, sf), periods.PERIODS, _as_of())


@query
def w11_current_vs_average(spark: SparkSession, sf: str) -> DataFrame:
    return periods.current_vs_average(_daily(spark, sf), periods.PERIODS[1:], _as_of())


@query
def w12_caching_and_tools(spark: SparkSession, sf: str) -> DataFrame:
    calls = views.tool_calls_by_day(samples.tools(spark, sf), samples.records(spark, sf), MONTH)
    return periods.caching_and_tools(_daily(spark, sf), calls, periods.PERIODS, _as_of())


@query
def w13_today_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return periods.today_ratios(_daily(spark, sf), _as_of())


@query
def w14_cache_savings(spark: SparkSession, sf: str) -> DataFrame:
    return periods.cache_savings_estimate(_daily(spark, sf), periods.PERIODS[1:], _as_of())


@query
def w15_today_insights(spark: SparkSession, sf: str) -> DataFrame:
    return periods.today_insights(staged(_daily(spark, sf), "daily"), _as_of())


@query
def w16_main_model(spark: SparkSession, sf: str) -> DataFrame:
    return periods.main_model(_daily(spark, sf), _as_of())


@query
def w17_live_status(spark: SparkSession, sf: str) -> DataFrame:
    return periods.live_status(samples.records(spark, sf), _as_of())


@query
def w18_secondary_currency(spark: SparkSession, sf: str) -> DataFrame:
    days = views.daily_series(_daily(spark, sf), MONTH).select("day_local", "source", "variant_id", "workspace", "cost_usd")
    return periods.with_secondary_currency(days, "EUR", 0.5)


@query
def w19_tool_summary(spark: SparkSession, sf: str) -> DataFrame:
    return periods.tool_summary(q06_tool_usage(spark, sf))


@query
def w19_top_tools(spark: SparkSession, sf: str) -> DataFrame:
    return periods.top_tools(q06_tool_usage(spark, sf))


# --- diagnostics ---------------------------------------------------------------------------------


@query
def d01_long_context_applied(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.long_context_applied(samples.records(spark, sf), rates.default_card(spark))


@query
def d02_long_context_missing(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.long_context_missing(samples.records(spark, sf), rates.default_card(spark))


@query
def d03_midnight_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.midnight_sessions(_sessions(spark, sf))


def _file_daily(spark: SparkSession, sf: str) -> DataFrame:
    return staged(rollups.file_daily(samples.records(spark, sf), rates.default_card(spark)), "file-daily")


@query
def d04_folder_day_costs(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.folder_day_costs(_file_daily(spark, sf))


@query
def d05_folder_day_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.folder_day_mismatches(_file_daily(spark, sf))


def _reconciliation(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    parsed = _parsed(spark, sf)
    return parsed.running_totals, rollups.file_sessions(parsed.records, rates.default_card(spark))


@query
def d06_reconciliation_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.reconciliation_mismatches(*_reconciliation(spark, sf))


@query
def d06_reconciliation_checked(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.reconciliation_checked(*_reconciliation(spark, sf))


# Key columns and measures of the report's parts.
REPORT_CELLS = {
    "pricing": (("outcome", "model"), ()),
    "long_context_applied": (("model", "effective_model"), ("sessions", "turns", "max_context_used_tokens")),
    "long_context_missing": (("model",), ("sessions", "turns", "max_context_used_tokens")),
    "midnight_sessions": (("source", "session_id", "workspace", "first_day", "last_day"), ("total_tokens", "cost_usd")),
    "folder_day_costs": (("day",), ("event_cost_usd", "folder_cost_usd", "delta_usd")),
    "folder_day_mismatches": (("file_path", "folder_day", "event_days"), ("cost_usd",)),
    "reconciliation_checked": ((), ("checked_sessions",)),
    "reconciliation_mismatches": (("file_path", "session_id"), ("final_total_tokens", "ingested_total_tokens", "delta_tokens")),
}


def _cells(parts: dict[str, DataFrame], layout: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """One row per part, key and measure; a part without measures gives the value 1 per key."""
    out = None
    for name, part in parts.items():
        keys, measures = layout[name]
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
        values = [F.col(m).cast("double").alias(m) for m in measures] or [F.lit(1.0).alias("present")]
        cells = part.select(F.lit(name).alias("part"), key.alias("key"), *values).unpivot(["part", "key"], list(measures) or ["present"], "measure", "value")
        out = cells if out is None else out.unionByName(cells)
    return out


@query
def d07_full_report(spark: SparkSession, sf: str) -> DataFrame:
    """All values of the diagnostics report, one row per part, key and measure."""
    card, rows = rates.default_card(spark), samples.records(spark, sf)
    parsed = _parsed(spark, sf)
    report = diagnostics.full_report(
        rates.merge_audit(rates.default_rates(spark), _overrides(spark, sf)), rows, rollups.session_rollup(rows, card),
        rollups.file_daily(rows, card), rollups.file_sessions(parsed.records, card), parsed.running_totals, card,
    )
    return _cells(report, REPORT_CELLS)


# --- extras --------------------------------------------------------------------------------------


@query
def x01_anomaly_days(spark: SparkSession, sf: str) -> DataFrame:
    return extras.anomaly_days(_daily(spark, sf), trailing=7, multiplier=1.05)


@query
def x02_peak_context_fill(spark: SparkSession, sf: str) -> DataFrame:
    return extras.peak_context_fill(_sessions(spark, sf))


@query
def x03_context_fill_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return extras.context_fill_warnings(_sessions(spark, sf), 25.0)


@query
def x04_exact_cache_savings(spark: SparkSession, sf: str) -> DataFrame:
    return extras.exact_cache_savings(samples.records(spark, sf), rates.default_card(spark))


@query
def x05_sidechain_split(spark: SparkSession, sf: str) -> DataFrame:
    return extras.sidechain_split(samples.records(spark, sf), rates.default_card(spark))


# --- incremental refresh -------------------------------------------------------------------------

CUT_OFF = 1_705_708_800_000  # 2024-01-20: what had been read by then


def _file_state(spark: SparkSession, sf: str) -> DataFrame:
    """State of the files as of the cut-off, with some odd ones: every kind of action occurs."""
    known = _event_files(spark, sf, CUT_OFF)
    user = F.regexp_extract("file_path", r"s(\d+)-\d\.jsonl$", 1).cast("bigint")
    return known.select(
        "source", "file_path",
        F.when(user % 11 == 3, F.concat("file_id", F.lit("~old"))).otherwise(F.col("file_id")).alias("file_id"),
        "size", "mtime_ms",
        F.when(user % 13 == 5, F.col("size") + 1_000_000).otherwise(F.col("size")).alias("last_offset"),
        F.lit(0).cast("bigint").alias("prefix_check"),
        F.when(user % 17 == 7, 0).otherwise(F.col("turns")).alias("turns"),
        F.lit(0).cast("bigint").alias("tools"),
    )


@query
def i01_classified_files(spark: SparkSession, sf: str) -> DataFrame:
    found = _event_files(spark, sf).select(*inventory.INVENTORY_COLUMNS)
    return incremental.classify(found, _file_state(spark, sf), 1, MONTH.to_utc + 27 * inventory.DAY_MS).select(
        "source", "file_path", "action"
    )


@query
def i02_rewritten_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files read once, then again after some had their first line changed and all had grown."""
    rows, root = _written(spark, sf)
    logfiles.write_files(rows, root)
    found = inventory.scan_roots(spark, _roots(root)).withColumn("last_offset", F.col("size"))
    state = staged(ranges.prefix_anchors(found).join(found.select("source", "file_path", "last_offset"), ["source", "file_path"]), "state")
    first = rows.filter((F.col("line_offset") == 0) & F.endswith("file_path", F.lit("-3.jsonl")))
    ends = rows.groupBy("source", "file_path").agg(F.max(F.col("line_offset") + F.col("n_bytes")).alias("line_offset"))
    logfiles.write_files(first.withColumn("value", F.reverse("value")), root)
    logfiles.write_files(ends.withColumn("value", F.lit("{}")), root)
    return incremental.rewritten_files(state).select("source", _below(root))


@query
def i03_overlapping_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples.records(spark, sf)
    stored = rows.filter(F.col("ts_utc") <= CUT_OFF)
    appended = rows.filter((F.col("ts_utc") > CUT_OFF) | (F.col("context_used_tokens") > 300_000))
    return incremental.overlapping_files(appended, stored)


def _running_input(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("file_id").alias("file_path"), "session_id").agg(
        (F.sum("input_tokens") * 4).alias("input_total"), F.sum("output_tokens").alias("output_total")
    )


@query
def i04_crossing_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples.records(spark, sf)
    appended = rows.filter(F.col("ts_utc") > CUT_OFF)
    return incremental.crossing_sessions(
        _running_input(rows.filter(F.col("ts_utc") <= CUT_OFF)), _running_input(rows), appended, rates.default_card(spark)
    )


@query
def i05_replaced_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples.records(spark, sf)
    files = rows.filter(F.endswith("session_id", F.lit("-2"))).select("file_id").distinct()
    fresh = rows.join(files, "file_id", "left_semi").filter(F.col("hour_local") < 12).select(*rows.columns)
    return incremental.replace_files(rows, files, fresh).select("dedup_key", "file_id")


def _no_scope(key: str) -> Column:
    """A key without the hash of its file's path, which depends on where the file lies."""
    return F.regexp_replace(key, ":[0-9a-f]{16}:", ":").alias(key)


@query
def i06_append_equals_full(spark: SparkSession, sf: str) -> DataFrame:
    """Records after two refreshes of files that grow in between, cut through sessions, turns and requests."""
    rows, root = _written(spark, sf)
    usage, options, card = _small_store(spark), refresh.RefreshOptions(_roots(root)), rates.default_card(spark)
    early = F.col("line_offset") < 6_000
    for turn, part in enumerate((early, ~early)):
        logfiles.write_files(rows.filter(part), root)
        refresh.refresh(usage, options, card, turn)
    return usage.read("usage_record").select(_no_scope("dedup_key"), "session_id", "ts_utc", "model", "variant_id", "total_tokens")


def _catalogs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The catalog after a listing up to the cut-off and one of all files but some; and the second listing."""
    files = inventory.INVENTORY_COLUMNS
    before = _event_files(spark, sf, CUT_OFF).select(*files)
    empty = before.limit(0).select(
        *files, *[F.lit(None).cast("bigint").alias(c) for c in ("first_seen_utc", "last_seen_utc", "last_changed_utc", "last_checked_utc", "last_ingested_utc")],
        *[F.lit(None).cast("string").alias(c) for c in ("min_day", "max_day", "state")],
    )
    first = staged(incremental.catalog_discovered(empty, before, CUT_OFF), "catalog")
    after = _event_files(spark, sf).filter(~F.endswith("file_path", F.lit("-6.jsonl"))).select(*files)
    return incremental.catalog_discovered(first, after, MONTH.to_utc), after


@query
def i07_file_catalog(spark: SparkSession, sf: str) -> DataFrame:
    catalog, _ = _catalogs(spark, sf)
    return catalog.select("file_path", "size", "first_seen_utc", "last_seen_utc", "last_changed_utc", "state")


@query
def i07_catalog_after_run(spark: SparkSession, sf: str) -> DataFrame:
    """The same after a run that read what is new or changed; some files gave nothing."""
    catalog, after = _catalogs(spark, sf)
    known = _event_files(spark, sf, CUT_OFF).select("file_path", F.col("size").alias("_size"))
    days = samples.records(spark, sf).groupBy(F.col("file_id").alias("file_path")).agg(F.min("day_local").alias("min_day"), F.max("day_local").alias("max_day"))
    same = F.coalesce(F.col("size") == F.col("_size"), F.lit(False))
    results = after.join(known, "file_path", "left").join(days, "file_path", "left").select(
        "file_path", F.when(same, incremental.SKIP).otherwise(incremental.REINGEST).alias("action"),
        (~F.endswith("file_path", F.lit("-5.jsonl"))).alias("has_state"), "min_day", "max_day",
    )
    return incremental.catalog_ingested(catalog, results, MONTH.to_utc + 1).select("file_path", "last_checked_utc", "last_ingested_utc", "min_day", "max_day", "state")


@query
def i08_missing_sources(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples.records(spark, sf)
    found = _event_files(spark, sf).filter(F.col("source") == "codex")
    return incremental.missing_sources(rows, found)


@query
def i08_missing_files(spark: SparkSession, sf: str) -> DataFrame:
    """Stored files of which some are gone from disk and some have another identity there."""
    found = _event_files(spark, sf).filter(~F.endswith("file_path", F.lit("-6.jsonl")))
    return incremental.missing_files(_file_state(spark, sf), found)


# --- streams -------------------------------------------------------------------------------------


def _in_pieces(spark: SparkSession, sf: str) -> tuple[stateful_parse.Outputs, str]:
    """A stream of log files that grow between its two runs, cut through the middle of sessions, turns and requests."""
    rows, root = _written(spark, sf)
    folder = work_folder(spark, "stateful")
    early = F.col("line_offset") < 6_000
    for part in (early, ~early):
        logfiles.write_files(rows.filter(part), root)
        announced.announce(spark, _roots(root), f"{folder}/in")
        stateful_parse.start(announced.lines(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return stateful_parse.Outputs(spark, f"{folder}/out"), root


@query
def t01_stateful_parse(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = _in_pieces(spark, sf)
    return out.latest("tool_events").select(_no_scope("event_key"), "tool_name", "session_id", "ts_utc")


@query
def t01_stateful_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Bad lines of the same stream: as many as one parse of the whole counts."""
    out, root = _in_pieces(spark, sf)
    return out.quality().filter("malformed_count + oversized_count > 0").select("source", _below(root), "malformed_count", "oversized_count")


def _turn_stream(spark: SparkSession, sf: str, folder: str, files: int = 5) -> DataFrame:
    """The events as a stream of some batches whose times overlap and go back, a batch of many events in several files."""
    raw = spark.read.parquet(f"{sf}/events.parquet")
    pieces = max(1, raw.count() // (files * EVENTS_PER_FILE))
    raw.repartition(files * pieces, F.xxhash64("event_id")).write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", pieces).parquet(f"{folder}/in")
    return samples.turns_of(arriving)


@query
def t02_stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every record arrives twice in the stream; one copy leaves it, however late the other is."""
    folder = work_folder(spark, "dedup")
    rows = samples.as_records(_turn_stream(spark, sf, folder))
    twice = rows.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    stream_rollups.into_folder(stream_rollups.deduplicated(twice), f"{folder}/out", f"{folder}/state", "append").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("dedup_key", "total_tokens")


@query
def t02_store_once(spark: SparkSession, sf: str) -> DataFrame:
    """The same into a store, batch after batch, and once more from a new stream that has no state of the first."""
    folder, usage = work_folder(spark, "once"), _small_store(spark)
    for run in range(2):
        rows = samples.as_records(_turn_stream(spark, sf, f"{folder}/{run}", 2))
        stream_rollups.into_store_once(rows, usage, f"{folder}/{run}/state").awaitTermination()
    return usage.read("usage_record").select("dedup_key", "total_tokens")


@query
def t03_stream_hourly(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_folder(spark, "hourly")
    rows = samples.as_records(_turn_stream(spark, sf, folder))
    stream_rollups.into_windows(rows, f"{folder}/out", f"{folder}/state").awaitTermination()
    return stream_rollups.stored_windows(spark, f"{folder}/out")


def _streamed_store(spark: SparkSession, sf: str) -> store.UsageStore:
    """Turns and their tool calls put into a store batch by batch."""
    folder = work_folder(spark, "store")
    usage, card = _small_store(spark), rates.default_card(spark)
    handle = stream_rollups.into_store(usage, card)

    def put(rows: DataFrame, batch: int) -> None:
        turns = staged(rows, "batch")
        kept = samples.as_records(turns)
        handle(kept, samples.tools_of(turns), kept.select("dedup_key", "file_id"), batch)

    (
        _turn_stream(spark, sf, folder).writeStream.foreachBatch(put)
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    )
    return usage


@query
def t04_stream_into_rollups(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.with_usd(_streamed_store(spark, sf).read("daily_rollup"))


@query
def t04_stream_tool_events(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed_store(spark, sf).read("tool_event").select("event_key", "record_dedup_key", "tool_name", "day_local")
