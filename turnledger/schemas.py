"""Table schemas: facts, rollups, file state, run metrics."""

from __future__ import annotations

from pyspark.sql import types as T

from turnledger.functions.columns import TOKEN_COLUMNS

_S, _L, _B, _D = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType()
COST = T.DecimalType(38, 6)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_TOKENS = tuple((name, _L) for name in TOKEN_COLUMNS)

USAGE_RECORD = _struct(
    ("dedup_key", _S), ("file_id", _S), ("source", _S), ("session_id", _S),
    ("ts_utc", _L), ("day_local", _S), ("dow_local", _L), ("hour_local", _L),
    ("model", _S), ("effort", _S), ("variant_id", _S), ("workspace", _S),
    *_TOKENS, ("total_tokens", _L),
    ("context_window", _L), ("context_used_tokens", _L), ("is_sidechain", _B), ("stop_reason", _S),
)

TOOL_EVENT = _struct(
    ("event_key", _S), ("record_dedup_key", _S), ("file_id", _S), ("source", _S),
    ("session_id", _S), ("ts_utc", _L), ("day_local", _S), ("tool_name", _S), ("is_sidechain", _B),
)

DAILY_ROLLUP = _struct(
    ("day_local", _S), ("source", _S), ("variant_id", _S), ("base_model", _S), ("workspace", _S),
    *_TOKENS, ("total_tokens", _L), ("turns", _L), ("cost_nano", COST), ("unknown_cost_turns", _L),
)

SESSION_ROLLUP = _struct(
    ("source", _S), ("session_id", _S), ("workspace", _S), ("first_ts_utc", _L), ("last_ts_utc", _L),
    ("turns", _L), ("total_tokens", _L), ("cost_nano", COST), ("peak_context_fill", _D),
    ("sidechain_tokens", _L),
)

FILE_STATE = _struct(
    ("file_path", _S), ("file_id", _S), ("source", _S), ("size", _L), ("mtime_ms", _L),
    ("last_offset", _L), ("prefix_check", _L), ("turns", _L), ("tools", _L),
    ("malformed", _L), ("oversized", _L),
)

RUNNING_TOTAL = _struct(
    ("file_path", _S), ("session_id", _S), ("input_total", _L), ("output_total", _L),
)

FILE_CATALOG = _struct(
    ("file_path", _S), ("file_id", _S), ("source", _S), ("size", _L), ("mtime_ms", _L),
    ("first_seen_utc", _L), ("last_seen_utc", _L), ("last_changed_utc", _L),
    ("last_checked_utc", _L), ("last_ingested_utc", _L), ("min_day", _S), ("max_day", _S), ("state", _S),
)

RUN_METRICS = _struct(
    ("run_utc", _L), ("full_rescan", _B), ("read_bytes", _L),
)

# Days of each billing key, with its largest context of the day.
SESSION_DAY = _struct(("source", _S), ("session_id", _S), ("model", _S), ("day_local", _S), ("max_context", _L))

# Sessions and days whose rollups are to be computed again; a row names one of them or both.
PENDING = _struct(("source", _S), ("session_id", _S), ("model", _S), ("day_local", _S))

SESSION = _struct(
    ("source", _S), ("file_path", _S), ("session_id", _S), ("cwd", _S), ("cli_version", _S), ("git_branch", _S),
)

RATE_LIMIT = _struct(
    ("file_path", _S), ("ts_utc", _L), ("dedup_key", _S), ("primary_pct", _D), ("secondary_pct", _D),
)

# Days on which a file has records, or had: where the old copy of a record can lie.
FILE_DAY = _struct(("file_id", _S), ("day_local", _S))

# What a parse must know to go on with a file; see operators/carry.py.
CARRY = _struct(
    ("source", _S), ("file_path", _S), ("part", _S), ("line_offset", _L), ("session_id", _S), ("model", _S), ("effort", _S),
    ("approval_policy", _S), ("sandbox_mode", _S), ("calls_seen", _L),
    ("total", _struct(("input", _L), ("cached", _L), ("output", _L), ("reasoning", _L))),
    ("tool_name", _S), ("request_id", _S), ("recorded", _B),
)

UNMAPPED_MODEL = _struct(("model", _S), ("first_seen_utc", _L))
