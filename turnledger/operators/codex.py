"""Codex session logs: context carried forward, cumulative totals turned into per-turn counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnledger.operators.logrows import (
    FILE_KEYS,
    cut_rows,
    event_time,
    file_scope,
    mentions,
    nonblank,
    number,
    placed,
)
from turnledger.operators.ordered import scan
from turnledger.session import staged
from turnledger.sources.lines import DEFAULT_MAX_LINE_BYTES

SOURCE = "codex"

# Words of which a line must quote at least one to be parsed.
KEYWORDS = ("session_meta", "turn_context", "token_count", "function_call", "image_generation_call")
UNKNOWN_MODEL = "unknown"

_USAGE = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")
_COUNTS = ("input", "cached", "output", "reasoning")


def keyword(line: Column) -> Column:
    hit, *rest = mentions(line, *KEYWORDS)
    for other in rest:
        hit = hit | other
    return hit


_USAGE_TYPE = f"struct<{', '.join(f'{f}: string' for f in _USAGE)}>"
_INFO_TYPE = (
    f"struct<last_token_usage: {_USAGE_TYPE}, total_token_usage: {_USAGE_TYPE}, model_context_window: string>"
)
_LIMITS_TYPE = "struct<primary: struct<used_percent: string>, secondary: struct<used_percent: string>>"
SCHEMA = (
    "type string, timestamp variant, payload struct<id: string, cwd: string, cli_version: string, source: string, "
    "git: struct<branch: string, repository_url: string>, model: string, effort: string, approval_policy: string, "
    f"sandbox_policy: struct<mode: string>, type: string, name: string, info: {_INFO_TYPE}, rate_limits: {_LIMITS_TYPE}>, "
    f"info {_INFO_TYPE}, rate_limits {_LIMITS_TYPE}"
)


def extract(parsed: DataFrame) -> DataFrame:
    c = F.col
    kind, ptype = c("doc.type"), c("doc.payload.type")
    is_item = kind == "response_item"
    tool = F.when(is_item & (ptype == "function_call"), nonblank(c("doc.payload.name"))).when(
        is_item & (ptype == "image_generation_call"), F.lit("image_generation")
    )
    picked = parsed.select(
        "*",
        nonblank(c("doc.payload.id")).alias("_session"),
        tool.alias("_tool"),
        F.coalesce("doc.info", "doc.payload.info").alias("_info"),
        F.coalesce("doc.rate_limits", "doc.payload.rate_limits").alias("_limits"),
    )
    sorted_out = picked.withColumn(
        "kind",
        F.when((kind == "session_meta") & c("_session").isNotNull(), "session")
        .when((kind == "turn_context") & c("doc.payload").isNotNull(), "context")
        .when(c("_tool").isNotNull(), "tool")
        .when((kind == "event_msg") & (ptype == "token_count") & c("_info").isNotNull(), "tokens"),
    )

    def usage(path: str) -> Column:
        fields = [number(c(f"{path}.{f}")).alias(n) for f, n in zip(_USAGE, _COUNTS, strict=True)]
        return F.when((c("kind") == "tokens") & c(path).isNotNull(), F.struct(*fields))

    return sorted_out.select(
        *parsed.columns,
        "kind",
        F.when(c("kind") == "session", F.struct(
            c("_session").alias("id"),
            "doc.payload.cwd",
            "doc.payload.cli_version",
            c("doc.payload.source").alias("origin"),
            c("doc.payload.git.branch").alias("git_branch"),
            c("doc.payload.git.repository_url").alias("git_repo"),
        )).alias("session"),
        F.when(c("kind") == "context", F.struct(
            "doc.payload.model",
            "doc.payload.effort",
            "doc.payload.approval_policy",
            c("doc.payload.sandbox_policy.mode").alias("sandbox_mode"),
        )).alias("context"),
        F.when(c("kind") == "tool", c("_tool")).alias("tool_name"),
        usage("_info.total_token_usage").alias("total"),
        usage("_info.last_token_usage").alias("last"),
        F.when(c("kind") == "tokens", F.struct(
            event_time(c("doc.timestamp")).alias("ts_utc"),
            number(c("_info.model_context_window")).alias("context_window"),
            c("_limits.primary.used_percent").try_cast("double").alias("primary_pct"),
            c("_limits.secondary.used_percent").try_cast("double").alias("secondary_pct"),
        )).alias("turn"),
    )


def cut(lines: DataFrame, max_line_bytes: int = DEFAULT_MAX_LINE_BYTES) -> DataFrame:
    """Typed rows of the Codex lines in ``lines``."""
    return cut_rows(lines.filter(F.col("source") == SOURCE), keyword, SCHEMA, extract, max_line_bytes)


def context_scan(calls: Column | None = None) -> dict[str, dict[str, Column]]:
    """Running columns that carry the context; ``calls`` is what a row adds to the call count."""
    is_call = F.when(F.col("kind") == "tool", 1).otherwise(0)
    settings = F.struct("context.effort", "context.approval_policy", "context.sandbox_mode")
    return {
        "sums": {"calls_seen": is_call if calls is None else calls},
        "latest": {
            "_session": F.col("session.id"),
            "_model": F.col("context.model"),
            "_settings": F.when(F.col("context").isNotNull(), settings),
        },
    }


def resolved(scanned: DataFrame) -> DataFrame:
    """Name the carried values."""
    return scanned.select(
        *[c for c in scanned.columns if c not in ("_session", "_model", "_settings")],
        F.coalesce("_session", F.lit("")).alias("session_id"),
        F.coalesce("_model", F.lit(UNKNOWN_MODEL)).alias("model"),
        F.col("_settings.effort").alias("effort"),
        F.col("_settings.approval_policy").alias("approval_policy"),
        F.col("_settings.sandbox_mode").alias("sandbox_mode"),
    )


def with_context(cut: DataFrame) -> DataFrame:
    """Offsets, and session, model and the resettable settings carried forward through each file.

    The model keeps its last known value; effort, approval policy and sandbox mode are replaced by
    every context row, also by nothing. That is why they travel inside one non-null struct.
    ``calls_seen`` counts the tool calls up to each row.
    """
    return resolved(placed(cut, **context_scan()))


def rows(lines: DataFrame, max_line_bytes: int = DEFAULT_MAX_LINE_BYTES) -> DataFrame:
    """Typed rows with context. The raw text is read once, then two small tables are written."""
    return staged(with_context(staged(cut(lines, max_line_bytes), "codex-cut")), "codex-rows")


def token_rows(carried: DataFrame) -> DataFrame:
    """Token rows with a known model and usable totals, each with its per-turn counts.

    With a cumulative total the counts are its increase within (file, session). The baseline moves
    on every such row, so a row whose increase is negative or nil is kept here with
    ``billed = false``: it still ends the turn for pending tool calls.
    """
    usable = carried.filter(
        (F.col("kind") == "tokens")
        & (F.col("model") != UNKNOWN_MODEL)
        & (F.col("total").isNotNull() | F.col("last.input").isNotNull())
    )
    filled = F.when(
        F.col("total").isNotNull(),
        F.struct(*[F.coalesce(F.col(f"total.{c}"), F.lit(0)).alias(c) for c in _COUNTS]),
    )
    stepped = scan(
        usable.withColumn("total", filled),
        [*FILE_KEYS, "session_id"], "chunk", "pos",
        previous={"_before": F.col("total")},
    )
    cumulative = F.col("total").isNotNull()
    counts = {
        c: F.when(
            cumulative, F.col(f"total.{c}") - F.coalesce(F.col(f"_before.{c}"), F.lit(0))
        ).otherwise(F.coalesce(F.col(f"last.{c}"), F.lit(0)))
        for c in _COUNTS
    }
    counted = stepped.select(
        *FILE_KEYS, "chunk", "pos", "line_offset", "calls_seen", "session_id", "model", "effort",
        "approval_policy", "sandbox_mode", "turn.*",
        F.col("last.input").alias("context_used_tokens"),
        F.col("total.input").alias("total_input"),
        F.col("total.output").alias("total_output"),
        cumulative.alias("from_total"),
        *[expr.alias(f"raw_{name}") for name, expr in counts.items()],
    )
    raw = [F.col(f"raw_{c}") for c in _COUNTS]
    moved = (F.least(*raw) >= 0) & (F.greatest(*raw) > 0)
    return counted.withColumn("billed", ~F.col("from_total") | moved).withColumn(
        "dedup_key", record_key(F.col("session_id"), F.col("file_path"), F.col("line_offset"))
    )


def record_key(session: Column, file_path: Column, offset: Column) -> Column:
    return F.concat_ws(":", F.lit(SOURCE), session, file_scope(file_path), offset.cast("string"))


def placed_calls(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """Calls with the token row that follows them (``to_turn``, null = none yet) and their index.

    The index is the call's order within its turn: the running count of calls minus that count at
    the previous token row.
    """
    waiting = calls.select(*FILE_KEYS, "chunk", "pos", "tool_name", "calls_seen")
    ends = turns.select(
        *FILE_KEYS, "chunk", "pos", "calls_seen",
        F.struct("dedup_key", "session_id", "ts_utc", "billed").alias("own_turn"),
    )
    given = scan(
        waiting.unionByName(ends, allowMissingColumns=True), FILE_KEYS, "chunk", "pos",
        previous={"_before": F.when(F.col("own_turn").isNotNull(), F.col("calls_seen"))},
        following={"to_turn": F.col("own_turn")},
    )
    return given.filter(F.col("own_turn").isNull()).select(
        *waiting.columns,
        (F.col("calls_seen") - 1 - F.coalesce("_before", F.lit(0))).alias("call_index"),
        "to_turn",
    )


def given_calls(placed: DataFrame) -> DataFrame:
    """Tool events of calls whose token row bills something; the others are dropped."""
    return placed.filter("to_turn.billed").select(
        *FILE_KEYS,
        F.col("to_turn.session_id").alias("session_id"),
        F.col("to_turn.ts_utc").alias("ts_utc"),
        "tool_name",
        F.lit(False).alias("is_sidechain"),
        F.col("to_turn.dedup_key").alias("record_dedup_key"),
        F.concat_ws("#", "to_turn.dedup_key", F.col("call_index").cast("string")).alias("event_key"),
    )


def tool_events(carried: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tool calls given to the token row that follows them.

    Calls wait across rows that end early and across session changes; calls before a token row that
    bills nothing are dropped.
    """
    return given_calls(placed_calls(carried.filter(F.col("kind") == "tool"), tokens))


def running_totals(tokens: DataFrame) -> DataFrame:
    """Final cumulative totals per (file, session)."""
    seen = tokens.filter("from_total")
    place = F.struct("chunk", "pos")
    return seen.groupBy(*FILE_KEYS, "session_id").agg(
        F.max_by("total_input", place).alias("input_total"),
        F.max_by("total_output", place).alias("output_total"),
    )


def session_dimension(typed: DataFrame) -> DataFrame:
    """Last session header per (file, session id)."""
    heads = typed.filter(F.col("kind") == "session").select(
        *FILE_KEYS, F.struct("chunk", "pos").alias("_at"), "session.*"
    )
    return (
        heads.groupBy(*FILE_KEYS, F.col("id").alias("session_id"))
        .agg(F.max_by(F.struct("cwd", "cli_version", "origin", "git_branch", "git_repo"), "_at").alias("_h"))
        .select(*FILE_KEYS, "session_id", "_h.*")
    )
