"""Claude session logs: streamed copies of a request collapsed to its last row."""

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

SOURCE = "claude"

# Words a line must both quote to be parsed.
KEYWORDS = ("assistant", "usage")
UNKNOWN_MODEL = "unknown"
UNKNOWN_TOOL = "unknown"


def keyword(line: Column) -> Column:
    first, second = mentions(line, *KEYWORDS)
    return first & second


_USAGE = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
SCHEMA = (
    "type string, timestamp variant, sessionId string, requestId string, uuid string, cwd string, version string, "
    "gitBranch string, isSidechain string, entrypoint string, message struct<model: string, stop_reason: string, "
    f"usage: struct<{', '.join(f'{f}: string' for f in _USAGE)}>, content: array<string>>"
)


def extract(parsed: DataFrame) -> DataFrame:
    c = F.col
    model = c("doc.message.model")
    wanted = (
        (c("doc.type") == "assistant")
        & c("doc.message.usage").isNotNull()
        & nonblank(model).isNotNull()
        & ~F.startswith(model, F.lit("<"))
        & (model != UNKNOWN_MODEL)
    )
    counts = [F.coalesce(number(c(f"doc.message.usage.{f}")), F.lit(0)) for f in _USAGE]
    # Blocks stay text until here; only those that quote the word are looked into.
    quoted = F.filter("doc.message.content", lambda b: F.contains(b, F.lit('"tool_use"')))
    calls = F.filter(quoted, lambda b: F.get_json_object(b, "$.type") == "tool_use")
    names = F.transform(calls, lambda b: F.coalesce(F.get_json_object(b, "$.name"), F.lit(UNKNOWN_TOOL)))
    return parsed.withColumn("kind", F.when(wanted, F.lit("assistant"))).select(
        *parsed.columns,
        "kind",
        F.when(c("kind").isNotNull(), F.struct(
            F.coalesce("doc.sessionId", F.lit("")).alias("session_id"),
            F.coalesce(nonblank(c("doc.requestId")), nonblank(c("doc.uuid")), F.lit("")).alias("request_id"),
            event_time(c("doc.timestamp")).alias("ts_utc"),
            model.alias("model"),
            F.coalesce("doc.cwd", F.lit("")).alias("workspace"),
            nonblank(c("doc.message.stop_reason")).alias("stop_reason"),
            c("doc.isSidechain").try_cast("boolean").alias("is_sidechain"),
            nonblank(c("doc.entrypoint")).alias("entrypoint"),
            nonblank(c("doc.version")).alias("version"),
            c("doc.gitBranch").alias("git_branch"),
            counts[0].alias("raw_input"),
            counts[1].alias("raw_output"),
            counts[2].alias("raw_cache_read"),
            counts[3].alias("raw_cache_creation"),
            F.coalesce(names, F.array().cast("array<string>")).alias("tool_names"),
        )).alias("turn"),
    )


def cut(lines: DataFrame, max_line_bytes: int = DEFAULT_MAX_LINE_BYTES) -> DataFrame:
    """Typed rows of the Claude lines in ``lines``."""
    return cut_rows(lines.filter(F.col("source") == SOURCE), keyword, SCHEMA, extract, max_line_bytes)


def with_neighbours(cut: DataFrame) -> DataFrame:
    """Offsets, and the request ids of the assistant rows before and after."""
    request = F.col("turn.request_id")
    return placed(cut, previous={"prev_request": request}, following={"next_request": request})


def rows(lines: DataFrame, max_line_bytes: int = DEFAULT_MAX_LINE_BYTES) -> DataFrame:
    """Typed rows with neighbours. The raw text is read once, then two small tables are written."""
    return staged(with_neighbours(staged(cut(lines, max_line_bytes), "claude-cut")), "claude-rows")


def assistant_rows(typed: DataFrame) -> DataFrame:
    return typed.filter(F.col("kind") == "assistant").select(
        *FILE_KEYS, "chunk", "pos", "line_offset", "prev_request", "next_request", "turn.*"
    )


def turns(assistant: DataFrame) -> DataFrame:
    """One row per run of adjacent rows with the same request id; the last row gives the values.

    The key uses the session and the offset of the run's first row. The same id met again later,
    not adjacent, is another turn.
    """
    request = F.col("request_id")
    starts = F.col("prev_request").isNull() | (F.col("prev_request") != request)
    ends = F.col("next_request").isNull() | (F.col("next_request") != request)
    head = F.when(starts, F.struct("line_offset", "session_id"))
    key = F.concat_ws(
        ":", F.lit(SOURCE), "_head.session_id", file_scope(F.col("file_path")),
        "request_id", F.col("_head.line_offset").cast("string"),
    )
    return (
        scan(assistant, FILE_KEYS, "chunk", "pos", latest={"_head": head})
        .filter(ends)
        .withColumn("dedup_key", key)
        .withColumn("head_offset", F.col("_head.line_offset"))
        .withColumn("head_session", F.col("_head.session_id"))
        .drop("prev_request", "next_request", "_head")
    )


def tool_events(won: DataFrame) -> DataFrame:
    """Tool-use blocks of the winning rows."""
    return won.select(
        *FILE_KEYS, "session_id", "ts_utc", F.posexplode("tool_names").alias("_i", "tool_name"),
        F.coalesce("is_sidechain", F.lit(False)).alias("is_sidechain"),
        F.col("dedup_key").alias("record_dedup_key"),
    ).select(
        *FILE_KEYS, "session_id", "ts_utc", "tool_name", "is_sidechain", "record_dedup_key",
        F.concat_ws("#", "record_dedup_key", F.col("_i").cast("string")).alias("event_key"),
    )


def session_dimension(assistant: DataFrame) -> DataFrame:
    """Header of a file: its first assistant row with a session id."""
    place = F.struct("chunk", "pos")
    return (
        assistant.filter(F.col("session_id") != "")
        .groupBy(*FILE_KEYS)
        .agg(F.min_by(F.struct(
            "session_id", F.col("workspace").alias("cwd"), F.col("version").alias("cli_version"),
            "git_branch",
        ), place).alias("_h"))
        .select(*FILE_KEYS, "_h.*")
    )
