"""The refresh job: list, classify, read what is new, put its rows in place, bring rollups up to date."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from turnledger.operators import claude, codex, incremental, normalize, pricing, resume
from turnledger.operators.incremental import APPEND, REINGEST, SKIP
from turnledger.operators.logrows import FILE_KEYS
from turnledger.operators.rollups import file_counts, file_daily, file_sessions
from turnledger.plans import diagnostics, views
from turnledger.session import staged
from turnledger.sources import inventory, lines as line_source, ranges
from turnledger.sources.store import TABLES, UsageStore


@dataclass(frozen=True)
class RefreshOptions:
    roots: Mapping[str, str | None]
    max_line_bytes: int = line_source.DEFAULT_MAX_LINE_BYTES
    backfill_months: int = 0
    full_rescan: bool = False


def _guarded(actions: DataFrame, state: DataFrame) -> DataFrame:
    """Appends whose stored part no longer reads the same, or whose last line has grown, become reingests.

    ``start`` is the byte to read from.
    """
    stored = state.select(*FILE_KEYS, "last_offset", F.col("prefix_check").alias("_stored"))
    appends = staged(actions.filter(F.col("action") == APPEND).select(*FILE_KEYS).join(stored, FILE_KEYS), "appends")
    now = ranges.prefix_anchors(appends).select(*FILE_KEYS, "prefix_check", "line_ends")
    same = F.col("line_ends") & F.col("_stored").eqNullSafe(F.col("prefix_check"))
    held = appends.join(now, FILE_KEYS).filter(same).select(*FILE_KEYS, F.col("last_offset").alias("start"))
    action = F.when((F.col("action") == APPEND) & F.col("start").isNull(), REINGEST).otherwise(F.col("action"))
    return actions.join(held, FILE_KEYS, "left").withColumn("action", action).fillna(0, ["start"])


@dataclass(frozen=True)
class _Read:
    """What the files to read gave; ``resumed`` is None if all were read by Spark's reader."""

    parsed: normalize.ParsedLogs
    resumed: resume.Resumed | None
    read_bytes: int


def _read(store: UsageStore, options: RefreshOptions, actions: DataFrame, whole: bool) -> _Read | None:
    """Parse what is new.

    Each file is a byte range, from its start or from where the last read of it ended; no list of
    files comes to the driver. Of roots whose files tasks cannot open, Spark's reader reads all where nothing
    is skipped or appended (a first run, a full rescan).
    """
    todo = actions.filter(F.col("action") != SKIP)
    if todo.isEmpty():
        return None
    whole = whole and not all(ranges.reachable(root) for root in options.roots.values() if root)
    if whole and actions.filter(F.col("action").isin(SKIP, APPEND)).isEmpty():
        out = None
        for source, root in options.roots.items():
            if root and not todo.filter(F.col("source") == source).isEmpty():
                part = line_source.read_lines(store.spark, [root], source)
                out = part if out is None else out.unionByName(part)
        logs = out.withColumn("file_path", inventory.plain_path(F.col("file_path")))
        total = todo.agg(F.sum("size")).first()[0]
        return _Read(normalize.parse_lines(logs, options.max_line_bytes), None, total)
    files = todo.select(*FILE_KEYS, "start", F.col("size").alias("file_size"))
    both = staged(resume.typed_both(ranges.read_ranges(files, options.max_line_bytes), options.max_line_bytes), "typed")
    appends = staged(todo.filter(F.col("action") == APPEND).select(*FILE_KEYS), "appends")
    carry = store.read("carry", store.parts_of("carry", appends)).join(appends, FILE_KEYS, "left_semi")
    resumed = resume.finish(resume.typed_of(both, codex), resume.typed_of(both, claude), staged(carry, "carry"))
    return _Read(resumed.parsed, resumed, both.agg(F.coalesce(F.sum("read_bytes"), F.lit(0))).first()[0])


def refresh(store: UsageStore, options: RefreshOptions, card: DataFrame, now_ms: int, changed: list[str] | None = None) -> DataFrame:
    """Run one refresh; return the action taken per file.

    Of an appended file only the new bytes are read: the parse goes on from the rows carried in the
    store and gives what a full parse would. Other changed files are read whole and their rows
    replaced. A session that newly crosses the long-context threshold is priced afresh on all its days.
    """
    spark = store.spark
    store.recover()
    if options.full_rescan:
        store.clear()
    found = (
        inventory.scan_roots(spark, options.roots) if changed is None
        else inventory.scan_changed(spark, changed, options.roots)
    )
    months = 0 if options.full_rescan else options.backfill_months
    state = store.read("file_state")
    actions = staged(_guarded(staged(incremental.classify(found, state, months, now_ms), "classified"), state), "actions")
    catalog = incremental.catalog_discovered(store.read("file_catalog"), actions.select(*found.columns), now_ms)

    read = _read(store, options, actions, changed is None)
    if read is None:
        incremental.refresh_rollups(store, card)  # what a failed run left
        return _finish(store, catalog, actions, None, now_ms, options, card, 0)

    parsed, resumed = read.parsed, read.resumed
    records, tools = staged(parsed.records, "records"), staged(parsed.tool_events, "tools")
    unfinished = parsed.incomplete.withColumn("_incomplete", F.lit(True))
    action = F.when(F.col("_incomplete") & (F.col("action") != SKIP), SKIP).otherwise(F.col("action"))
    decided = staged(actions.join(unfinished, FILE_KEYS, "left").withColumn("action", action).drop("_incomplete"), "decided")
    applied = decided.filter(F.col("action") != SKIP)
    replaced = applied.filter(F.col("action") != APPEND).select("file_id")

    store.apply(replaced, records, tools, resumed.turn_keys if resumed else None)
    incremental.refresh_rollups(store, card)
    _remember_files(store, applied, records, tools, parsed, resumed)
    return _finish(store, catalog, decided, records, now_ms, options, card, read.read_bytes)


def _remember_files(
    store: UsageStore, applied: DataFrame, records: DataFrame, tools: DataFrame, parsed: normalize.ParsedLogs, resumed: resume.Resumed | None
) -> None:
    """Replace what is stored per file; of appended files the new rows join the old ones.

    The state comes last: until then a repeated run reads the same bytes again.
    """
    paths = staged(applied.select("file_path"), "paths")
    appends = staged(applied.filter(F.col("action") == APPEND).select("file_path"), "appended")
    held = {
        name: store.read(name, store.parts_of(name, appends)).join(appends, "file_path", "left_semi")
        for name in ("running_total", "rate_limit", "session", "file_state")
    }
    upto = applied.select(*FILE_KEYS, F.col("size").alias("last_offset"))
    figures = ("turns", "tools", "malformed", "oversized")
    parts = [
        file_counts(records, tools).withColumnRenamed("file_id", "file_path"),
        parsed.quality.select("file_path", F.col("malformed_count").alias("malformed"), F.col("oversized_count").alias("oversized")),
        held["file_state"].select("file_path", *figures),
    ]
    if resumed:
        parts.append(resumed.went_on.select("file_path", (-F.col("turns")).alias("turns"), (-F.col("tools")).alias("tools")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    counts = every.groupBy("file_path").agg(*[F.sum(c).alias(c) for c in figures])
    fresh = (
        applied.drop("last_offset").join(upto, FILE_KEYS).join(ranges.prefix_anchors(upto).drop("line_ends"), FILE_KEYS, "left")
        .join(counts, "file_path", "left").select(
            "file_path", "file_id", "source", "size", "mtime_ms", "last_offset", "prefix_check",
            *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in figures],
        )
    )
    names = {name: [f for f in TABLES[name].fieldNames()] for name in held}
    totals, limits, sessions = (
        frame.select(*names[name]) for name, frame in (("running_total", parsed.running_totals), ("rate_limit", parsed.rate_limits), ("session", parsed.sessions))
    )
    once = F.col("source") == claude.SOURCE  # its header is the first one; a later header of a Codex session counts
    old_totals = held["running_total"].join(totals, ["file_path", "session_id"], "left_anti")
    old_limits = held["rate_limit"].join(limits, ["file_path", "dedup_key"], "left_anti")
    first_heads = held["session"].filter(once)
    old_heads = held["session"].filter(~once).join(sessions, ["file_path", "session_id"], "left_anti").unionByName(first_heads)
    rows = {
        "running_total": totals.unionByName(old_totals), "rate_limit": limits.unionByName(old_limits),
        "session": sessions.join(first_heads, ["source", "file_path"], "left_anti").unionByName(old_heads),
        "carry": parsed.carry, "file_state": fresh,
    }
    for name, new in rows.items():
        store.replace_rows(name, paths, ["file_path"], new.join(paths, "file_path", "left_semi"))


def _finish(
    store: UsageStore, catalog: DataFrame, actions: DataFrame, records: DataFrame | None, now_ms: int, options: RefreshOptions, card: DataFrame,
    read_bytes: int,
) -> DataFrame:
    """Catalog, run metrics and unmapped models; no fact is read for them."""
    spark = store.spark
    fresh = store.read("usage_record").limit(0) if records is None else records
    spans = fresh.groupBy("file_id").agg(F.min("day_local").alias("min_day"), F.max("day_local").alias("max_day"))
    held = store.read("file_state").select("file_path", F.lit(True).alias("has_state"))
    results = (
        actions.join(held, "file_path", "left").join(spans, "file_id", "left")
        .select("file_path", "action", F.coalesce("has_state", F.lit(False)).alias("has_state"), "min_day", "max_day")
    )
    store.overwrite("file_catalog", incremental.catalog_ingested(catalog, results, now_ms))
    store.append("run_metrics", spark.range(1).select(
        F.lit(now_ms).cast("bigint").alias("run_utc"), F.lit(options.full_rescan).alias("full_rescan"),
        F.lit(read_bytes).cast("bigint").alias("read_bytes"),
    ))
    if records is not None:
        _unmapped(store, card, now_ms)
    return actions.select("source", "file_path", "action")


def _unmapped(store: UsageStore, card: DataFrame, now_ms: int) -> None:
    unmapped = pricing.unmapped_models(store.read("session_day"), card)
    store.overwrite("unmapped_model", pricing.refresh_unmapped(store.read("unmapped_model"), unmapped, F.lit(now_ms).cast("bigint")))


def reprice(store: UsageStore, card: DataFrame, now_ms: int) -> None:
    """Bring rollups and unmapped models to new rates without reading a log."""
    store.recover()
    daily, sessions = incremental.reprice(store.read("usage_record"), card)
    store.overwrite("daily_rollup", daily)
    store.overwrite("session_rollup", sessions)
    _unmapped(store, card, now_ms)


def tables(store: UsageStore, card: DataFrame) -> views.UsageTables:
    """What the views read, from the store."""
    names = ("usage_record", "tool_event")
    long_keys = incremental.long_keys_of_days(store.read("session_day"))
    return views.UsageTables(*[store.read(n) for n in names], card, store.read("daily_rollup"), store.read("session_rollup"), long_keys)


def report(store: UsageStore, card: DataFrame, audit: DataFrame) -> dict[str, DataFrame]:
    """All diagnostics from the store alone; ``audit`` tells where the rates come from."""
    records = store.read("usage_record")
    return diagnostics.full_report(
        audit, records, store.read("session_rollup"), file_daily(records, card), file_sessions(records, card),
        store.read("running_total"), card,
    )


def latest_rate_limit(store: UsageStore) -> DataFrame:
    return views.latest_rate_limit(store.read("rate_limit"))


def warnings(store: UsageStore) -> DataFrame:
    """Bad lines of all files as they are now, each counted once, and unmapped models."""
    return views.warnings(store.read("file_state"), store.read("unmapped_model"))


def rebuild(store: UsageStore, options: RefreshOptions, card: DataFrame, now_ms: int) -> bool:
    """Full rescan, only if every stored file can still be read; else nothing changes."""
    stored = store.read("file_state").filter((F.col("turns") > 0)).select("source", "file_path", "file_id")
    if not incremental.rebuild_is_safe(stored, inventory.scan_roots(store.spark, options.roots)):
        return False
    refresh(store, RefreshOptions(options.roots, options.max_line_bytes, 0, True), card, now_ms)
    return True
