"""SQL for the registered queries, to be run by DuckDB on the same tables.

Written by itself, straight from ``events``: it shares no expression with the Spark code.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Turns, tool calls, prices and rollups derived from events.
_BASE = """
WITH ev AS (
  SELECT event_id, user_id, event_type, ts,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(ROUND(value * 100) AS BIGINT) AS v
  FROM events),
rec0 AS (
  SELECT event_id, user_id, ts, k, v, 'ev:' || event_id AS dedup_key,
    CASE WHEN user_id % 2 = 0 THEN 'codex' ELSE 'claude' END AS source,
    's' || user_id || '-' || (event_id % 7) AS session_id,
    epoch_us(ts) // 1000 AS ts_utc, strftime(ts, '%Y-%m-%d') AS day_local,
    CAST(dayofweek(ts) AS BIGINT) AS dow_local, CAST(hour(ts) AS BIGINT) AS hour_local,
    CASE event_type WHEN 'view' THEN 'gpt-5-codex' WHEN 'click' THEN 'gpt-5.5' WHEN 'purchase' THEN 'claude-sonnet-4'
      WHEN 'error' THEN 'gpt-5-mini' ELSE 'unlisted-model' END AS model,
    CASE WHEN user_id % 2 = 1 THEN 'n/a' WHEN k % 4 = 0 THEN 'low' WHEN k % 4 = 1 THEN 'medium'
      WHEN k % 4 = 2 THEN 'high' ELSE 'n/a' END AS effort,
    '/ws/' || (k % 3) AS workspace,
    v + 1 AS input_tokens, k * 11 AS output_tokens, k * 7 AS cache_read_tokens,
    CASE WHEN user_id % 2 = 1 THEN k ELSE 0 END AS cache_creation_tokens,
    CASE WHEN user_id % 2 = 0 THEN k * 3 ELSE 0 END AS reasoning_tokens,
    v * 20 AS context_used_tokens, (k % 5 = 0) AS is_sidechain
  FROM ev),
rec AS (
  SELECT *,
    CASE WHEN effort = 'n/a' THEN model ELSE model || ' (' || effort || ')' END AS variant_id,
    input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens + reasoning_tokens AS total_tokens,
    CASE WHEN source = 'codex'
      THEN '/logs/codex/' || strftime(DATE '2024-01-01' + CAST(user_id % 28 AS INTEGER), '%Y/%m/%d') || '/' || session_id || '.jsonl'
      ELSE '/logs/claude/u' || user_id || '/' || session_id || '.jsonl' END AS file_id
  FROM rec0),
tool AS (
  SELECT dedup_key || '#' || i AS event_key, dedup_key AS record_dedup_key, file_id, source, session_id, ts_utc, day_local,
    CASE i % 3 WHEN 0 THEN 'shell' WHEN 1 THEN 'apply_patch' ELSE 'read_file' END AS tool_name, is_sidechain, k
  FROM (SELECT *, unnest(range(k % 4)) AS i FROM rec)),
rates(model, r_in, r_cached, r_write, r_out) AS (VALUES
  ('gpt-5-codex', 1250, 125, 0, 10000), ('gpt-5.5', 5000, 500, 0, 30000), ('claude-sonnet-4', 3000, 300, 3750, 15000),
  ('gpt-5-mini', 250, 25, 0, 2000), ('gpt-5.5-long-context', 10000, 1000, 0, 45000)),
ctx AS (SELECT source, session_id, model, MAX(context_used_tokens) AS key_context FROM rec GROUP BY ALL),
priced AS (
  SELECT r.*, c.key_context > 272000 AS requested,
    c.key_context > 272000 AND r.model = 'gpt-5.5' AS applied,
    CASE WHEN c.key_context > 272000 AND r.model = 'gpt-5.5' THEN 'gpt-5.5-long-context' ELSE r.model END AS effective_model,
    t.model IS NULL AS cost_unknown,
    r.input_tokens * COALESCE(t.r_in, 1250) + r.cache_read_tokens * COALESCE(t.r_cached, 125)
      + r.cache_creation_tokens * COALESCE(t.r_write, 0)
      + (r.output_tokens + r.reasoning_tokens) * COALESCE(t.r_out, 10000) AS nano
  FROM rec r JOIN ctx c USING (source, session_id, model)
  LEFT JOIN rates t ON t.model = CASE WHEN c.key_context > 272000 AND r.model = 'gpt-5.5' THEN 'gpt-5.5-long-context' ELSE r.model END),
daily AS (
  SELECT day_local, source, variant_id, MIN(model) AS base_model, workspace, {sums}, CAST(COUNT(*) AS BIGINT) AS turns,
    SUM(nano) AS nano, CAST(SUM(CASE WHEN cost_unknown THEN 1 ELSE 0 END) AS BIGINT) AS unknown_cost_turns
  FROM priced GROUP BY day_local, source, variant_id, workspace),
sess_model AS (
  SELECT source, session_id, model, MAX(workspace) AS workspace, MIN(ts_utc) AS first_ts, MAX(ts_utc) AS last_ts, COUNT(*) AS turns,
    SUM(total_tokens) AS total_tokens, SUM(nano) AS nano, MAX(context_used_tokens) AS max_ctx,
    SUM(CASE WHEN is_sidechain THEN total_tokens ELSE 0 END) AS side
  FROM priced GROUP BY ALL),
sess AS (
  SELECT source, session_id, MIN_BY(workspace, model) AS workspace, MIN(first_ts) AS first_ts_utc, MAX(last_ts) AS last_ts_utc,
    CAST(SUM(turns) AS BIGINT) AS turns, CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, SUM(nano) AS nano,
    MAX(max_ctx) / 1000000 AS peak_context_fill, CAST(SUM(side) AS BIGINT) AS sidechain_tokens
  FROM sess_model GROUP BY source, session_id)
"""

_TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens")
_MEASURES = (*_TOKENS, "total_tokens")
_SUMS = ", ".join(f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in _MEASURES)
_COLS = ", ".join(_MEASURES)
_BASE = _BASE.replace("{sums}", _SUMS)

# Log lines rendered from events, and what parsing them must give.
_LOGS = (
    _BASE
    + """,
stamped AS (
  SELECT *, CASE WHEN k % 23 = 7 AND k % 2 = 1 THEN '' WHEN k % 23 = 7 THEN '"timestamp":"' || ts_utc || '",' WHEN k % 8 = 0 THEN '"timestamp":' || ts_utc || ','
    ELSE '"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z",' END AS stamp,
    k % 9 <> 0 AS cumulative, input_tokens + cache_read_tokens AS raw_in, output_tokens + reasoning_tokens AS raw_out
  FROM rec),
cx AS (
  SELECT *, row_number() OVER w AS nth,
    SUM(CASE WHEN cumulative THEN raw_in ELSE 0 END) OVER w AS cum_in,
    SUM(CASE WHEN cumulative THEN cache_read_tokens ELSE 0 END) OVER w AS cum_cached,
    SUM(CASE WHEN cumulative THEN raw_out ELSE 0 END) OVER w AS cum_out,
    SUM(CASE WHEN cumulative THEN reasoning_tokens ELSE 0 END) OVER w AS cum_reason
  FROM stamped WHERE source = 'codex' WINDOW w AS (PARTITION BY session_id ORDER BY event_id)),
cx_info AS (
  SELECT *, '{"last_token_usage":' || CASE WHEN cumulative THEN '{"input_tokens":' || context_used_tokens || '}'
      ELSE '{"input_tokens":' || raw_in || ',"cached_input_tokens":' || cache_read_tokens || ',"output_tokens":' || raw_out
        || ',"reasoning_output_tokens":' || reasoning_tokens || '}' END
    || CASE WHEN cumulative THEN ',"total_token_usage":{"input_tokens":' || cum_in || ',"cached_input_tokens":' || cum_cached
        || ',"output_tokens":' || cum_out || ',"reasoning_output_tokens":' || cum_reason || '}' ELSE '' END
    || ',"model_context_window":1000000}' AS info,
    '"rate_limits":{"primary":{"used_percent":' || k || '},"secondary":{"used_percent":' || (k % 7) || '}}' AS limits
  FROM cx),
cx_tokens AS (
  SELECT *, CASE WHEN k % 2 = 0 THEN '{"type":"event_msg",' || stamp || '"payload":{"type":"token_count","info":' || info || ',' || limits || '}}'
    ELSE '{"type":"event_msg",' || stamp || '"payload":{"type":"token_count"},"info":' || info || ',' || limits || '}' END AS tokens
  FROM cx_info),
cx_lines AS (
  SELECT source, file_id, user_id, event_id, [
    CASE WHEN nth = 1 THEN '{"type":"session_meta","payload":{"id":"' || session_id || '","cwd":"/home/dev","cli_version":"1.2.3","source":"cli","git":{"branch":"main","repository_url":"https://example.org/r.git"}}}' END,
    CASE WHEN nth = 1 OR k % 3 = 0 THEN '{"type":"turn_context","payload":{"model":"' || model || '"' || CASE WHEN effort = 'n/a' THEN '' ELSE ',"effort":"' || effort || '"' END
      || ',"approval_policy":"p' || (k % 2) || '","sandbox_policy":{"mode":"m' || (k % 5) || '"}}}' END,
    '{"type":"response_item","payload":{"type":"message","text":"größe ' || CASE WHEN k % 29 = 0 THEN repeat('x', 5000) ELSE '' END || '"}}',
    CASE WHEN k % 4 > 0 THEN '{"type":"response_item","payload":{"type":"function_call","name":"shell","arguments":"{}"}}' END,
    CASE WHEN k % 4 > 1 THEN '{"type":"response_item","payload":{"type":"function_call","name":"apply_patch","arguments":"{}"}}' END,
    CASE WHEN k % 4 > 2 THEN '{"type":"response_item","payload":{"type":"function_call","name":"read_file","arguments":"{}"}}' END,
    CASE WHEN k % 11 = 0 THEN '{"type":"response_item","payload":{"type":"image_generation_call"}}' END,
    tokens,
    CASE WHEN cumulative AND k % 5 = 1 THEN tokens END,
    CASE WHEN k % 17 = 3 THEN '{"type":"event_msg","payload":{"type":"token_count",' END,
    CASE WHEN k % 13 = 5 THEN tokens || '{"x":1}' END] AS texts
  FROM cx_tokens),
cl AS (
  SELECT *, CASE WHEN k % 6 = 1 THEN 'u' || event_id ELSE 'r' || (k % 4) END AS request_id,
    '{"type":"assistant",' || stamp || '"sessionId":"' || session_id || '",' || CASE WHEN k % 6 = 1 THEN '' ELSE '"requestId":"r' || (k % 4) || '",' END
      || '"uuid":"u' || event_id || '","cwd":"' || workspace || '",'
      || CASE WHEN k % 5 = 0 THEN '"isSidechain":true,' WHEN k % 5 = 1 THEN '"isSidechain":false,' ELSE '' END
      || '"version":"2.0","message":{"model":"' || CASE WHEN k % 19 = 0 THEN '<synthetic>' ELSE model END
      || '","stop_reason":"end_turn","usage":{"input_tokens":' || input_tokens || ',"output_tokens":' AS before_out,
    ',"cache_read_input_tokens":' || cache_read_tokens || ',"cache_creation_input_tokens":' || cache_creation_tokens || '},"content":[' AS after_out
  FROM stamped WHERE source = 'claude'),
cl_lines AS (
  SELECT source, file_id, user_id, event_id, [
    '{"type":"user","message":{"role":"user","content":"größe ' || CASE WHEN k % 29 = 0 THEN repeat('x', 5000) ELSE '' END || '"}}',
    CASE WHEN k % 3 = 0 THEN before_out || '1' || after_out || ']}}' END,
    before_out || output_tokens || after_out || array_to_string(list_transform(range(k % 4), lambda i:
      CASE WHEN k % 10 = 5 THEN '{"type":"tool_use"}' ELSE '{"type":"tool_use","name":"'
        || CASE i WHEN 0 THEN 'shell' WHEN 1 THEN 'apply_patch' ELSE 'read_file' END || '"}' END), ',') || ']}}',
    CASE WHEN k % 17 = 3 THEN '{"type":"assistant","message":{"usage":{' END,
    CASE WHEN k % 13 = 5 THEN before_out || '7' || after_out || ']}}{"x":1}' END] AS texts
  FROM cl),
log0 AS (
  SELECT source, file_id, user_id, event_id, unnest(texts) AS value, generate_subscripts(texts, 1) AS i
  FROM (SELECT * FROM cx_lines UNION ALL SELECT * FROM cl_lines)),
log AS (
  SELECT source, file_id AS file_path, user_id, event_id, i, value, CAST(strlen(value) + 1 AS BIGINT) AS n_bytes,
    CAST(SUM(strlen(value) + 1) OVER (PARTITION BY file_id ORDER BY event_id, i) - strlen(value) - 1 AS BIGINT) AS line_offset
  FROM log0 WHERE value IS NOT NULL),
cx_context AS (
  SELECT *, MAX(CASE WHEN nth = 1 OR k % 3 = 0 THEN event_id END) OVER (PARTITION BY session_id ORDER BY event_id) AS context_event FROM cx),
cx_turn AS (
  SELECT t.event_id, t.session_id, t.file_id, t.k, t.cumulative, l.line_offset, c.model, c.effort, 'p' || (c.k % 2) AS approval_policy,
    'm' || (c.k % 5) AS sandbox_mode, t.ts_utc, t.k % 23 <> 7 AS timed, t.raw_in, t.cache_read_tokens, t.raw_out, t.reasoning_tokens,
    t.input_tokens, t.output_tokens, CASE WHEN t.cumulative THEN t.context_used_tokens ELSE t.raw_in END AS context_used_tokens,
    t.day_local, t.dow_local, t.hour_local, t.cum_in, t.cum_out,
    'codex:' || t.session_id || ':' || sha256(t.file_id)[1:16] || ':' || l.line_offset AS dedup_key
  FROM cx_context t JOIN cx c ON c.event_id = t.context_event
  JOIN log l ON l.event_id = t.event_id AND l.i = 8 AND l.source = 'codex'),
cl_row AS (
  SELECT c.*, f.line_offset AS final_offset, COALESCE(p.line_offset, f.line_offset) AS first_offset
  FROM cl c JOIN log f ON f.event_id = c.event_id AND f.i = 3 AND f.source = 'claude'
  LEFT JOIN log p ON p.event_id = c.event_id AND p.i = 2 AND p.source = 'claude'
  WHERE c.k % 19 <> 0),
cl_edge AS (
  SELECT *, lag(request_id) OVER w IS DISTINCT FROM request_id AS starts, lead(request_id) OVER w IS DISTINCT FROM request_id AS ends
  FROM cl_row WINDOW w AS (PARTITION BY session_id ORDER BY event_id)),
cl_turn AS (
  SELECT * EXCLUDE (dedup_key), k % 23 <> 7 AS timed,
    'claude:' || session_id || ':' || sha256(file_id)[1:16] || ':' || request_id || ':' || head_offset AS dedup_key
  FROM (SELECT *, MAX(CASE WHEN starts THEN first_offset END) OVER (PARTITION BY session_id ORDER BY event_id) AS head_offset FROM cl_edge)
  WHERE ends)
"""
)


def _add(name: str, body: str, prefix: str = _BASE) -> None:
    ORACLES[name] = f"{prefix}\n{body.strip()}"


def _log(name: str, body: str) -> None:
    _add(name, body, _LOGS)


# --- sources and sinks ---------------------------------------------------------------------------

_log("s01_file_inventory", "SELECT source, file_path, CAST(SUM(n_bytes) AS BIGINT) AS size FROM log GROUP BY ALL")
_log("s02_changed_inventory", """
SELECT source, file_path, CAST(SUM(n_bytes) AS BIGINT) AS size FROM log
WHERE source = 'codex' AND (file_path LIKE '%-2.jsonl' OR regexp_replace(file_path, '/[^/]*$', '') IN (
  SELECT regexp_replace(file_path, '/[^/]*$', '') FROM log WHERE source = 'codex' AND file_path LIKE '%-4.jsonl'))
GROUP BY ALL""")
for _name in ("s03_file_lines", "s03_block_ranges"):
    _log(_name, "SELECT source, file_path, line_offset, n_bytes FROM log WHERE n_bytes - 1 <= 1048576")
_log("s03_line_offsets", "SELECT source, file_path, line_offset, n_bytes FROM log WHERE n_bytes - 1 <= 1048576")
_log("s04_oversized_lines", """
SELECT source, file_path, CAST(COUNT(*) AS BIGINT) AS line_count, CAST(COUNT(*) FILTER (n_bytes - 1 > 4096) AS BIGINT) AS oversized_count
FROM log GROUP BY ALL""")
_log("s05_incomplete_files", """
SELECT source, file_path FROM log WHERE user_id % 3 = 0
GROUP BY ALL HAVING arg_max(i, line_offset) IN (10, 11) OR (source = 'claude' AND arg_max(i, line_offset) IN (4, 5))""")
_FILES = """
SELECT source, file_id AS file_path, file_id, CAST(COUNT(*) * 100 AS BIGINT) AS size, MAX(ts_utc) AS mtime_ms FROM rec GROUP BY source, file_id"""
_add("s06_backfill_window", f"""
SELECT * FROM ({_FILES}) WHERE mtime_ms >= 1706659199999 - 3 * 86400000""")
_add("s07_rate_file", """
, m AS (SELECT model, MAX(input_tokens) AS most FROM rec GROUP BY model)
SELECT model, (most + 0.5) * 1e6::DOUBLE AS input_rate, 0.0::DOUBLE AS cached_rate, 0.0::DOUBLE AS write_rate, 250000.0::DOUBLE AS output_rate FROM m
UNION ALL SELECT model || '-cached', 0.0, 1250.0, 0.0, 0.0 FROM m
UNION ALL SELECT '$fallback', 0.0, 0.0, 0.0, 2000000.0""")
_add("s10_clear_and_refill", """
SELECT source, CAST(COUNT(*) AS BIGINT) AS turns, CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, CAST(SUM(total_tokens) AS BIGINT) AS rollup_tokens,
  (SELECT CAST(COUNT(DISTINCT day_local) AS BIGINT) FROM rec) AS runs
FROM rec WHERE hour_local < 6 GROUP BY source""")
_add("s08_upsert_records", """
SELECT dedup_key, day_local, output_tokens FROM rec WHERE hour_local < 12
UNION ALL SELECT dedup_key, day_local, output_tokens + 1 FROM rec WHERE hour_local >= 12""")
_add("s08_store_repeat", "SELECT {daily} FROM daily", _BASE.replace(
    "  SELECT *,\n    CASE WHEN effort = 'n/a' THEN model",
    "  SELECT * REPLACE (output_tokens + CASE WHEN hour_local >= 12 THEN 1 ELSE 0 END AS output_tokens),\n    CASE WHEN effort = 'n/a' THEN model",
))
_add("s08_upsert_tool_events", """
SELECT t.event_key, t.tool_name FROM tool t JOIN rec r ON r.dedup_key = t.record_dedup_key
WHERE r.hour_local < 12 OR t.event_key LIKE '%#0'""")
_add("s09_delete_files", """
SELECT dedup_key, file_id FROM rec
WHERE file_id NOT IN (SELECT file_id FROM rec WHERE workspace = '/ws/0' AND context_used_tokens > 100000)""")

# --- parse ---------------------------------------------------------------------------------------

_log("p01_keyword_filter", """
SELECT source, file_path, CAST(COUNT(*) AS BIGINT) AS line_count,
  CAST(COUNT(*) FILTER ((source = 'codex' AND i <> 3) OR (source = 'claude' AND i > 1)) AS BIGINT) AS keyword_count
FROM log GROUP BY ALL""")
_log("p02_malformed_lines", """
SELECT source, file_path, CAST(COUNT(*) FILTER ((source = 'codex' AND i IN (10, 11)) OR (source = 'claude' AND i IN (4, 5))) AS BIGINT) AS malformed_count,
  CAST(0 AS BIGINT) AS oversized_count FROM log GROUP BY ALL""")
_log("p03_context_carry", """
SELECT t.session_id, l.line_offset, t.model, CASE WHEN t.effort = 'n/a' THEN '-' ELSE t.effort END AS effort, t.approval_policy, t.sandbox_mode
FROM cx_turn t JOIN log l ON l.event_id = t.event_id AND l.source = 'codex' AND l.i IN (8, 9)""")
_RAW = "session_id, line_offset, raw_in AS raw_input, cache_read_tokens AS raw_cached, raw_out AS raw_output, reasoning_tokens AS raw_reasoning"
_log("p04_cumulative_delta", f"SELECT {_RAW} FROM cx_turn WHERE cumulative")
_log("p05_last_usage_fallback", f"SELECT {_RAW} FROM cx_turn WHERE NOT cumulative")
_log("p06_turn_metadata", """
SELECT session_id, line_offset, CAST(1000000 AS BIGINT) AS context_window, context_used_tokens, approval_policy, sandbox_mode,
  CAST(k AS DOUBLE) AS primary_pct, CAST(k % 7 AS DOUBLE) AS secondary_pct FROM cx_turn""")
_CX_TOOLS = """
SELECT session_id, dedup_key AS record_dedup_key, dedup_key || '#' || n AS event_key, name AS tool_name, timed FROM (
  SELECT session_id, dedup_key, timed, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS n FROM (
    SELECT *, list_concat(['shell', 'apply_patch', 'read_file'][1:k % 4], CASE WHEN k % 11 = 0 THEN ['image_generation'] ELSE [] END) AS names FROM cx_turn))"""
_log("p07_codex_tools", f"SELECT session_id, record_dedup_key, event_key, tool_name FROM ({_CX_TOOLS})")
_log("p08_assistant_rows", """
SELECT session_id, line_offset, request_id, model, workspace, input_tokens AS raw_input, raw_output,
  cache_read_tokens AS raw_cache_read, cache_creation_tokens AS raw_cache_creation FROM (
  SELECT *, final_offset AS line_offset, output_tokens AS raw_output FROM cl_row
  UNION ALL SELECT *, first_offset, 1 FROM cl_row WHERE k % 3 = 0)""")
_log("p09_request_collapse", """
SELECT session_id, dedup_key, final_offset AS line_offset, model, input_tokens AS raw_input, output_tokens AS raw_output,
  cache_read_tokens AS raw_cache_read, cache_creation_tokens AS raw_cache_creation FROM cl_turn""")
_log("p10_claude_tools", """
SELECT session_id, dedup_key || '#' || n AS event_key, CASE WHEN k % 10 = 5 THEN 'unknown' WHEN n = 0 THEN 'shell' WHEN n = 1 THEN 'apply_patch' ELSE 'read_file' END AS tool_name,
  is_sidechain FROM (SELECT *, unnest(range(k % 4)) AS n FROM cl_turn)""")
_log("p11_turn_times", """
SELECT 'codex' AS source, session_id, line_offset, ts_utc FROM cx_turn WHERE timed
UNION ALL SELECT 'claude', session_id, final_offset, ts_utc FROM cl_turn WHERE timed""")
_add("p12_dedupe_by_key", """
SELECT dedup_key, ts_utc + CASE WHEN is_sidechain THEN 1 ELSE 0 END AS ts_utc,
  CASE WHEN is_sidechain THEN LEAST(k % 4, 1) ELSE k % 4 END AS calls FROM rec""")
_log("p13_record_keys", "SELECT dedup_key FROM cx_turn UNION ALL SELECT dedup_key FROM cl_turn")
_log("p14_session_headers", """
SELECT source, file_id AS file_path, session_id, '/home/dev' AS cwd, '1.2.3' AS cli_version, 'main' AS git_branch FROM cx WHERE nth = 1
UNION ALL SELECT 'claude', file_id, session_id, arg_min(workspace, event_id), '2.0', '-' FROM cl_row GROUP BY file_id, session_id""")

# --- normalise -----------------------------------------------------------------------------------

_log("n01_codex_buckets", """
SELECT dedup_key, effort, '' AS workspace, input_tokens, output_tokens, cache_read_tokens, CAST(0 AS BIGINT) AS cache_creation_tokens, reasoning_tokens FROM cx_turn""")
_log("n02_claude_buckets", """
SELECT dedup_key, 'n/a' AS effort, workspace, is_sidechain, 'end_turn' AS stop_reason, input_tokens, output_tokens, cache_read_tokens,
  cache_creation_tokens, CAST(0 AS BIGINT) AS reasoning_tokens FROM cl_turn""")
_PARSED = """
SELECT dedup_key, 'codex' AS source, session_id, ts_utc, day_local, dow_local, hour_local, model, effort,
  CASE WHEN effort = 'n/a' THEN model ELSE model || ' (' || effort || ')' END AS variant_id, '' AS workspace,
  input_tokens, output_tokens, cache_read_tokens, CAST(0 AS BIGINT) AS cache_creation_tokens, reasoning_tokens,
  input_tokens + output_tokens + cache_read_tokens + reasoning_tokens AS total_tokens, false AS is_sidechain
FROM cx_turn WHERE timed
UNION ALL SELECT dedup_key, 'claude', session_id, ts_utc, day_local, dow_local, hour_local, model, 'n/a', model, workspace,
  input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, CAST(0 AS BIGINT),
  input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens, is_sidechain
FROM cl_turn WHERE timed"""
_log("n03_usage_records", _PARSED)
_add("n04_total_tokens", "SELECT dedup_key, total_tokens FROM rec")
_add("n05_variants", """
SELECT model, effort, variant_id, model AS base_model, effort AS variant_effort, CAST(COUNT(*) AS BIGINT) AS turns FROM rec GROUP BY ALL""")
_add("n06_local_calendar", "SELECT dedup_key, day_local AS day, dow_local AS weekday, hour_local AS hour FROM rec")

# --- pricing -------------------------------------------------------------------------------------

_add("r01_merged_rates", """
SELECT model, CAST(r_in AS DOUBLE) AS input_rate, CAST(r_cached AS DOUBLE) AS cached_rate, CAST(r_write AS DOUBLE) AS write_rate, CAST(r_out AS DOUBLE) AS output_rate
FROM rates WHERE model IN (SELECT model FROM rec)
UNION ALL SELECT DISTINCT model, 10000.0::DOUBLE, 2000.0::DOUBLE, 3000.0::DOUBLE, 40000.0::DOUBLE FROM rec WHERE model = 'unlisted-model'""")
_add("r02_merge_audit", """
SELECT DISTINCT CASE WHEN model = 'unlisted-model' THEN 'custom_model' ELSE 'ignored_known_model' END AS outcome, model FROM rec
UNION ALL SELECT 'ignored_fallback', '$fallback'""")
_add("r03_long_context_keys", "SELECT * FROM ctx WHERE key_context > 272000 AND model = 'gpt-5.5'")
_add("r04_effective_rate", "SELECT dedup_key, effective_model, cost_unknown FROM priced")
_add("r05_record_cost", "SELECT dedup_key, nano / 1e9 AS cost_usd FROM priced")
_add("r06_long_context_status", """
SELECT dedup_key, requested AS long_context_requested, applied AS long_context_applied, requested AND NOT applied AS long_context_missing_rate FROM priced""")
_add("r07_unmapped_models", "SELECT model, MIN(ts_utc) AS first_seen_utc FROM rec WHERE model = 'unlisted-model' GROUP BY model")
_add("r08_reprice", """
SELECT day_local, source, variant_id, workspace, CAST(SUM(CASE WHEN cost_unknown
  THEN input_tokens * 10000 + cache_read_tokens * 2000 + cache_creation_tokens * 3000 + (output_tokens + reasoning_tokens) * 40000
  ELSE nano END) AS DOUBLE) / 1e9 AS cost_usd, CAST(0 AS BIGINT) AS unknown_cost_turns
FROM priced GROUP BY day_local, source, variant_id, workspace""")

# --- rollups and filters -------------------------------------------------------------------------

_USD = "CAST(nano AS DOUBLE) / 1e9"
_DAILY = f"day_local, source, variant_id, base_model, workspace, {_COLS}, turns, {_USD} AS cost_usd, unknown_cost_turns"
_add("a01_daily_rollup", f"SELECT {_DAILY} FROM daily")
ORACLES["s08_store_repeat"] = ORACLES["s08_store_repeat"].replace("{daily}", _DAILY)
_SESS = "source, session_id, workspace, first_ts_utc, last_ts_utc, turns, total_tokens, CAST(nano AS DOUBLE) / 1e9 AS cost_usd, peak_context_fill, sidechain_tokens"
_add("a02_session_rollup", f"SELECT {_SESS} FROM sess")
_FILE_DAILY = f"""
SELECT file_id, day_local, source, variant_id, MIN(model) AS base_model, workspace, {_SUMS}, CAST(COUNT(*) AS BIGINT) AS turns,
  CAST(SUM(nano) AS DOUBLE) / 1e9 AS cost_usd, SUM(nano) AS nano, CAST(SUM(CASE WHEN cost_unknown THEN 1 ELSE 0 END) AS BIGINT) AS unknown_cost_turns
FROM priced GROUP BY file_id, day_local, source, variant_id, workspace"""
_add("a03_file_daily", f"SELECT * EXCLUDE (nano) FROM ({_FILE_DAILY})")
_TOKEN_SUMS = ", ".join(f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in _TOKENS)
_add("a03_file_sessions", f"""
SELECT s.*, t.* EXCLUDE (source, session_id) FROM (SELECT {_SESS} FROM sess) s
JOIN (SELECT source, session_id, MIN(file_id) AS file_id, {_TOKEN_SUMS} FROM rec GROUP BY source, session_id) t USING (source, session_id)""")
_add("a03_file_counts", """
SELECT file_id, CAST(COUNT(*) AS BIGINT) AS turns, CAST(SUM(k % 4) AS BIGINT) AS tools FROM rec GROUP BY file_id""")
_HALF = """
, half_ctx AS (SELECT source, session_id, model, hour_local < 12 AS early, MAX(context_used_tokens) AS c FROM rec GROUP BY ALL),
half AS (
  SELECT p.*, h.c > 272000 AND p.model = 'gpt-5.5' AS half_applied,
    CASE WHEN p.model <> 'gpt-5.5' THEN p.nano WHEN h.c > 272000
      THEN p.input_tokens * 10000 + p.cache_read_tokens * 1000 + (p.output_tokens + p.reasoning_tokens) * 45000
      ELSE p.input_tokens * 5000 + p.cache_read_tokens * 500 + (p.output_tokens + p.reasoning_tokens) * 30000 END AS half_nano
  FROM priced p JOIN half_ctx h ON h.source = p.source AND h.session_id = p.session_id AND h.model = p.model AND h.early = (p.hour_local < 12))
"""
_add("a04_merged_contributions", f"""{_HALF}
SELECT day_local, source, variant_id, MIN(model) AS base_model, workspace, {_SUMS}, CAST(COUNT(*) AS BIGINT) AS turns,
  CAST(SUM(half_nano) AS DOUBLE) / 1e9 AS cost_usd, CAST(SUM(CASE WHEN cost_unknown THEN 1 ELSE 0 END) AS BIGINT) AS unknown_cost_turns
FROM half GROUP BY day_local, source, variant_id, workspace""")
_add("a05_merged_sessions", f"""{_HALF},
half_model AS (SELECT source, session_id, hour_local < 12 AS early, model, MAX(workspace) AS w FROM half GROUP BY ALL),
half_named AS (SELECT source, session_id, early, arg_min(w, model) AS w FROM half_model GROUP BY ALL),
named AS (SELECT source, session_id, arg_max(w, CASE WHEN early THEN 0 ELSE 1 END) AS workspace FROM half_named GROUP BY ALL)
SELECT source, session_id, any_value(workspace_later) AS workspace, MIN(ts_utc) AS first_ts_utc, MAX(ts_utc) AS last_ts_utc, CAST(COUNT(*) AS BIGINT) AS turns,
  CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, CAST(SUM(half_nano) AS DOUBLE) / 1e9 AS cost_usd, MAX(context_used_tokens) / 1000000 AS peak_context_fill,
  CAST(SUM(CASE WHEN is_sidechain THEN total_tokens ELSE 0 END) AS BIGINT) AS sidechain_tokens
FROM half JOIN (SELECT source, session_id, workspace AS workspace_later FROM named) USING (source, session_id) GROUP BY source, session_id""")
_add("a06_subtract_file", f"""
SELECT day_local, source, variant_id, MIN(model) AS base_model, workspace, {_SUMS}, CAST(COUNT(*) AS BIGINT) AS turns,
  CAST(SUM(nano) AS DOUBLE) / 1e9 AS cost_usd, CAST(SUM(CASE WHEN cost_unknown THEN 1 ELSE 0 END) AS BIGINT) AS unknown_cost_turns
FROM priced WHERE event_id % 7 <> 3 GROUP BY day_local, source, variant_id, workspace""")
_add("a07_rollup_gaps", "SELECT DISTINCT day_local, source, " + ", ".join(
    f"CAST(0 AS BIGINT) AS {c}_gap" for c in (*_MEASURES, "turns")) + " FROM rec")
_F_DAYS = "day_local BETWEEN '2024-01-10' AND '2024-01-23'"
_F_REST = "source IN ('codex') AND workspace IN ('/ws/0', '/ws/1')"
_F_MODELS = "('gpt-5-codex', 'gpt-5.5', 'unlisted-model')"
_add("f01_daily_filter", f"""
SELECT day_local, source, variant_id, workspace, turns, {_USD} AS cost_usd FROM daily WHERE {_F_DAYS} AND {_F_REST}
  AND base_model IN {_F_MODELS} AND (variant_id NOT LIKE '% (%)' OR variant_id LIKE '%(high)')""")
_add("f02_record_filter", f"""
SELECT dedup_key, day_local, variant_id FROM rec WHERE {_F_DAYS} AND {_F_REST} AND model IN {_F_MODELS} AND effort IN ('high', 'n/a')""")
_add("f03_session_overlap", """
SELECT source, session_id, first_ts_utc, last_ts_utc, turns FROM sess
WHERE first_ts_utc <= 1706572799999 AND last_ts_utc >= 1706400000000 AND source = 'claude' AND workspace = '/ws/2'""")

# --- views ---------------------------------------------------------------------------------------

_MONTH = "day_local BETWEEN '2024-01-01' AND '2024-01-30'"
_TWO_DAYS = "day_local BETWEEN '2024-01-28' AND '2024-01-29'"
_add("q01_daily_series", f"SELECT {_DAILY} FROM daily WHERE {_MONTH}")
_add("q02_daily_series_base_model", f"""
SELECT day_local, source, base_model, workspace, {_SUMS}, CAST(SUM(turns) AS BIGINT) AS turns, CAST(SUM(nano) AS DOUBLE) / 1e9 AS cost_usd,
  CAST(SUM(unknown_cost_turns) AS BIGINT) AS unknown_cost_turns
FROM daily WHERE {_MONTH} GROUP BY day_local, source, base_model, workspace""")


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0 END"


def _pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) * 100 ELSE 0 END"


def _breakdown(group: str, effort: str) -> str:
    return f"""
, grp AS (
  SELECT {group} AS variant_id, MIN(base_model) AS base_model, {effort} AS effort, source, {_SUMS}, CAST(SUM(turns) AS BIGINT) AS turns,
    CAST(SUM(nano) AS DOUBLE) / 1e9 AS cost_usd, SUM(unknown_cost_turns) > 0 AS cost_unknown, SUM(nano) AS nano
  FROM daily WHERE {_MONTH} GROUP BY {group}, source),
tot AS (SELECT CAST(SUM(nano) AS DOUBLE) / 1e9 AS c, SUM(total_tokens) AS t FROM grp)
SELECT variant_id, base_model, effort, source, {_COLS}, cost_usd, cost_unknown, {_pct('cost_usd', 'c')} AS share_of_cost_pct,
  {_pct('total_tokens', 't')} AS share_of_tokens_pct, turns, {_ratio('total_tokens', 'turns')} AS tokens_per_turn,
  {_ratio('cost_usd', 'turns')} AS cost_per_turn, {_ratio('output_tokens', 'input_tokens')} AS output_ratio,
  {_ratio('reasoning_tokens', '(output_tokens + reasoning_tokens)')} AS reasoning_intensity,
  {_pct('cache_read_tokens', '(cache_read_tokens + input_tokens + cache_creation_tokens)')} AS cache_efficiency_pct,
  ({_ratio('cost_usd', 'total_tokens')}) * 1000 AS blended_cost_per_1k
FROM grp, tot"""


_EFFORT = "CASE WHEN regexp_matches(ANY_VALUE(variant_id), '\\((low|medium|high)\\)$') THEN regexp_extract(ANY_VALUE(variant_id), '\\((low|medium|high)\\)$', 1) ELSE 'n/a' END"
_add("q03_variant_breakdown", _breakdown("daily.variant_id", _EFFORT.replace("(variant_id)", "(daily.variant_id)")))
_add("q04_base_model_breakdown", _breakdown("daily.base_model", "'n/a'"))
_add("q05_session_leaderboard", f"""
SELECT {_SESS} FROM sess WHERE first_ts_utc <= 1706659199999 AND last_ts_utc >= 1704067200000
ORDER BY cost_usd DESC, source, session_id LIMIT 20""")
_USAGE = f"""
SELECT tool_name, source, n AS count, CAST(n AS DOUBLE) / CAST(SUM(n) OVER () AS DOUBLE) * 100 AS share_pct
FROM (SELECT tool_name, source, CAST(COUNT(*) AS BIGINT) AS n FROM tool WHERE {_MONTH} GROUP BY ALL)"""
_add("q06_tool_usage", _USAGE)
_add("q07_tool_calls_by_day", f"""
SELECT r.day_local, CAST(COUNT(*) AS BIGINT) AS count FROM tool t JOIN rec r ON r.dedup_key = t.record_dedup_key
WHERE r.{_F_DAYS} AND r.source = 'codex' AND r.workspace IN ('/ws/0', '/ws/1') AND r.model IN {_F_MODELS} AND r.effort IN ('high', 'n/a') GROUP BY r.day_local""")
_HOURLY = f"""
SELECT day_local, hour_local, {_SUMS}, CAST(COUNT(*) AS BIGINT) AS turns, CAST(SUM(nano) AS DOUBLE) / 1e9 AS cost_usd,
  CAST(SUM(CASE WHEN cost_unknown THEN 1 ELSE 0 END) AS BIGINT) AS unknown_cost_turns FROM priced"""
_add("q08_hourly_series", f"{_HOURLY} WHERE {_TWO_DAYS} GROUP BY day_local, hour_local")
_add("q09_heatmap", f"""
SELECT dow_local AS dow, hour_local AS hour, CAST(SUM(total_tokens) AS BIGINT) AS tokens, CAST(0 AS DOUBLE) AS cost_usd,
  CAST(SUM(nano) AS DOUBLE) / 1e9 AS cost_usd_priced FROM priced WHERE {_MONTH} GROUP BY ALL""")
_add("q10_source_comparison", f"""
SELECT source, CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, CAST(SUM(nano) AS DOUBLE) / 1e9 AS cost_usd, bool_or(unknown_cost_turns > 0) AS cost_unknown,
  CAST(SUM(turns) AS BIGINT) AS turns, CAST(COUNT(DISTINCT day_local || workspace) AS BIGINT) AS sessions FROM daily WHERE {_MONTH} GROUP BY source""")
_add("q11_freshness", "SELECT MAX(ts_utc) AS last_ingest_run_utc, MAX(ts_utc) AS latest_record_utc FROM rec")
_log("q12_warnings", """
SELECT 'malformed_lines' AS warning, '' AS model,
  CAST(COUNT(*) FILTER ((source = 'codex' AND i IN (10, 11)) OR (source = 'claude' AND i IN (4, 5))) AS BIGINT) AS count FROM log
UNION ALL SELECT 'oversized_lines', '', COUNT(*) FROM log WHERE n_bytes - 1 > 4096
UNION ALL SELECT DISTINCT 'unmapped_model', model, 1 FROM rec WHERE model = 'unlisted-model'""")
_log("q13_latest_rate_limit", """
SELECT ts_utc, CAST(k AS DOUBLE) AS primary_pct, CAST(k % 7 AS DOUBLE) AS secondary_pct FROM cx_turn WHERE timed ORDER BY ts_utc DESC, dedup_key DESC LIMIT 1""")


def _cells(part: str, rows: str, keys: str, *measures: str) -> str:
    """One row per key and measure of a part of the dashboard."""
    return " UNION ALL ".join(
        f"SELECT '{part}' AS part, concat_ws('|', {keys}) AS key, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM ({rows})" for m in measures
    )


_add("q14_dashboard", "\nUNION ALL ".join((
    _cells("series", f"SELECT {_DAILY} FROM daily WHERE {_TWO_DAYS}", "day_local, source, variant_id, workspace", "total_tokens", "turns", "cost_usd"),
    _cells("variants", f"SELECT variant_id, source, SUM(total_tokens) AS total_tokens, CAST(SUM(nano) AS DOUBLE) / 1e9 AS cost_usd FROM daily WHERE {_TWO_DAYS} GROUP BY ALL",
           "variant_id, source", "total_tokens", "cost_usd"),
    _cells("sessions", f"SELECT {_SESS} FROM sess WHERE first_ts_utc <= 1706572799999 AND last_ts_utc >= 1706400000000 ORDER BY cost_usd DESC, source, session_id LIMIT 20",
           "source, session_id, workspace", "total_tokens", "turns", "cost_usd", "peak_context_fill"),
    _cells("tools", _USAGE.replace(_MONTH, _TWO_DAYS), "tool_name, source", "count", "share_pct"),
    _cells("tool_calls_by_day", f"SELECT day_local, COUNT(*) AS count FROM tool WHERE {_TWO_DAYS} GROUP BY ALL", "day_local", "count"),
    _cells("hourly_series", f"{_HOURLY} WHERE {_TWO_DAYS} GROUP BY day_local, hour_local", "day_local, hour_local", "total_tokens", "turns", "cost_usd"),
)))
_add("q15_day_total", f"SELECT {_SUMS}, CAST(SUM(turns) AS BIGINT) AS turns, CAST(SUM(nano) AS DOUBLE) / 1e9 AS cost_usd FROM daily WHERE day_local = '2024-01-30'")

# --- period analytics ----------------------------------------------------------------------------

# Dates of the windows for 2024-01-30, the newest day of the events.
_WINDOWS = """
, win(period, window_from, window_to, prev_from, prev_to, bucket_count, current_from) AS (VALUES
  ('today', '2024-01-30', '2024-01-30', '2024-01-29', '2024-01-29', 1, '2024-01-30'),
  ('day', '2024-01-24', '2024-01-30', '2024-01-17', '2024-01-23', 7, '2024-01-30'),
  ('week', '2023-12-18', '2024-01-30', '2023-10-30', '2023-12-17', 7, '2024-01-29'),
  ('month', '2023-08-01', '2024-01-30', '2023-02-01', '2023-07-31', 6, '2024-01-01'),
  ('year', '2023-01-01', '2024-01-30', '2021-01-01', '2022-12-31', 2, '2024-01-01')),
cur AS (SELECT w.*, d.* FROM win w LEFT JOIN daily d ON d.day_local BETWEEN w.window_from AND w.window_to),
old AS (SELECT w.*, d.* FROM win w LEFT JOIN daily d ON d.day_local BETWEEN w.prev_from AND w.prev_to)
"""
_add("w01_period_windows", f"{_WINDOWS} SELECT period, window_from, window_to, prev_from, prev_to, CAST(bucket_count AS BIGINT) AS bucket_count FROM win")
_add("w02_current_ranges", f"{_WINDOWS} SELECT period, current_from, '2024-01-30' AS current_to FROM win")
_add("w03_fetch_ranges", f"""{_WINDOWS}
SELECT period, prev_from AS fetch_from, CAST(COUNT(*) AS BIGINT) AS row_count FROM win JOIN daily ON day_local BETWEEN prev_from AND '2024-01-30' GROUP BY ALL""")


def _sum(column: str, name: str) -> str:
    return f"CAST(COALESCE(SUM({column}), 0) AS BIGINT) AS {name}"


_W_TOTALS = ", ".join([
    _sum("total_tokens", "tokens"), "COALESCE(CAST(SUM(nano) AS DOUBLE) / 1e9, 0) AS cost_usd", _sum("turns", "turns"),
    _sum("input_tokens", "input"), _sum("output_tokens", "output"), _sum("cache_read_tokens", "cache"),
    _sum("reasoning_tokens", "reasoning"), _sum("cache_read_tokens + cache_creation_tokens", "caching_tokens"),
    "CAST(COUNT(DISTINCT variant_id) AS BIGINT) AS models", "CAST(COUNT(DISTINCT day_local) AS BIGINT) AS active_days",
])
_W_CTE = f"{_WINDOWS}, wt AS (SELECT period, bucket_count, {_W_TOTALS} FROM cur GROUP BY period, bucket_count), wo AS (SELECT period, {_W_TOTALS} FROM old GROUP BY period)"
_add("w04_window_totals", f"{_W_CTE} SELECT * EXCLUDE (bucket_count) FROM wt")


def _change(cur: str, prev: str) -> str:
    return f"CASE WHEN {prev} > 0 THEN (CAST({cur} AS DOUBLE) - {prev}) / {prev} * 100 WHEN {cur} > 0 THEN 100 ELSE 0 END"


_add("w05_period_comparison", f"""{_W_CTE}
SELECT period, """ + ", ".join(
    f"wt.{n} AS cur_{n}, wo.{n} AS prev_{n}, {_change(f'wt.{n}', f'wo.{n}')} AS {n}_delta_pct" for n in ("tokens", "cost_usd", "turns")
) + " FROM wt JOIN wo USING (period)")
_add("w06_peak_day", f"""{_WINDOWS}
SELECT period, day_local, tokens FROM (
  SELECT period, day_local, CAST(SUM(total_tokens) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY period ORDER BY SUM(total_tokens) DESC, day_local) AS rn
  FROM cur WHERE day_local IS NOT NULL GROUP BY period, day_local) WHERE rn = 1 AND tokens > 0""")
_add("w07_period_buckets", f"""{_WINDOWS},
buckets AS (
  SELECT 'today' AS period, '2024-01-30' AS bucket
  UNION ALL SELECT 'day', strftime(DATE '2024-01-30' - CAST(i AS INTEGER), '%Y-%m-%d') FROM range(7) t(i)
  UNION ALL SELECT 'week', strftime(DATE '2024-01-29' - CAST(7 * i AS INTEGER), '%Y-%m-%d') FROM range(7) t(i)
  UNION ALL SELECT 'month', unnest(['2023-08', '2023-09', '2023-10', '2023-11', '2023-12', '2024-01'])
  UNION ALL SELECT 'year', unnest(['2023', '2024'])),
keyed AS (
  SELECT *, CASE period WHEN 'week' THEN strftime(date_trunc('week', CAST(day_local AS DATE)), '%Y-%m-%d') WHEN 'month' THEN day_local[1:7]
    WHEN 'year' THEN day_local[1:4] ELSE day_local END AS bucket FROM cur)
SELECT b.period, b.bucket, {_sum('total_tokens', 'tokens')}, {_sum('turns', 'turns')}, {_sum('input_tokens', 'input')}, {_sum('output_tokens', 'output')},
  {_sum('cache_read_tokens', 'cache')}, {_sum('reasoning_tokens', 'reasoning')}, COALESCE(CAST(SUM(nano) AS DOUBLE) / 1e9, 0) AS cost_usd
FROM buckets b LEFT JOIN keyed k ON k.period = b.period AND k.bucket = b.bucket GROUP BY b.period, b.bucket""")
_HOURS = f"""
, hrs AS ({_HOURLY} WHERE day_local = '2024-01-30' GROUP BY day_local, hour_local),
hours AS (
  SELECT h.i AS hour, COALESCE(total_tokens, 0) AS tokens, COALESCE(turns, 0) AS turns, COALESCE(input_tokens, 0) AS input, COALESCE(output_tokens, 0) AS output,
    COALESCE(cache_read_tokens + cache_creation_tokens, 0) AS cache, COALESCE(reasoning_tokens, 0) AS reasoning, COALESCE(cost_usd, 0) AS cost_usd
  FROM range(24) h(i) LEFT JOIN hrs ON hour_local = h.i)"""
_add("w08_today_hours", f"{_HOURS} SELECT * FROM hours")
_add("w08_today_summary", f"""{_HOURS}
SELECT CAST(SUM(tokens) AS BIGINT) AS tokens, CAST(SUM(turns) AS BIGINT) AS turns,
  (SELECT hour FROM hours ORDER BY tokens DESC, hour LIMIT 1) AS peak_hour_tokens, (SELECT hour FROM hours ORDER BY turns DESC, hour LIMIT 1) AS peak_hour_turns,
  (SELECT hour FROM hours ORDER BY cost_usd DESC, hour LIMIT 1) AS peak_hour_cost_usd, CAST(COUNT(*) FILTER (turns > 0) AS BIGINT) AS active_hours FROM hours""")
_add("w09_top_models", f"""
, m AS (
  SELECT variant_id, {_sum('input_tokens', 'input')}, {_sum('output_tokens', 'output')}, {_sum('cache_read_tokens', 'cache')}, {_sum('reasoning_tokens', 'reasoning')},
    {_sum('turns', 'turns')}, {_sum('input_tokens + output_tokens + cache_read_tokens + reasoning_tokens', 'total')}
  FROM daily WHERE day_local >= '2024-01-24' GROUP BY variant_id)
SELECT *, CAST(total AS DOUBLE) / CAST((SELECT SUM(total) FROM m) AS DOUBLE) * 100 AS share_pct FROM m ORDER BY total DESC, variant_id LIMIT 5""")
_PARTS = "(input + output + cache + reasoning)"
_add("w10_composition", f"""{_W_CTE}
SELECT period, input, output, cache, reasoning, CAST(input AS DOUBLE) / {_PARTS} * 100 AS input_pct, CAST(output AS DOUBLE) / {_PARTS} * 100 AS output_pct,
  CAST(cache AS DOUBLE) / {_PARTS} * 100 AS cache_pct, CAST(reasoning AS DOUBLE) / {_PARTS} * 100 AS reasoning_pct,
  CASE WHEN CAST(cache AS DOUBLE) / {_PARTS} > 0.5 THEN 'high_cache' WHEN CAST(cache AS DOUBLE) / {_PARTS} < 0.1 THEN 'low_cache'
    WHEN CAST(reasoning AS DOUBLE) / {_PARTS} > 0.1 THEN 'high_reasoning' ELSE 'balanced' END AS composition_class
FROM wt WHERE {_PARTS} > 0""")
_add("w11_current_vs_average", f"""{_W_CTE},
now AS (SELECT w.period, {_W_TOTALS} FROM win w LEFT JOIN daily d ON d.day_local BETWEEN w.current_from AND '2024-01-30' GROUP BY w.period)
SELECT n.period, n.tokens, n.turns, n.input, n.output, n.caching_tokens, n.models, n.cost_usd, w.cost_usd / w.bucket_count AS average_cost_usd,
  {_change('n.cost_usd', '(w.cost_usd / w.bucket_count)')} AS delta_pct
FROM now n JOIN wt w USING (period) WHERE n.period <> 'today'""")
_add("w12_caching_and_tools", f"""{_W_CTE}
SELECT t.period, t.caching_tokens, CAST((SELECT COUNT(*) FROM tool x WHERE x.day_local BETWEEN w.window_from AND w.window_to) AS BIGINT) AS tool_calls
FROM wt t JOIN win w USING (period)""")
_add("w13_today_ratios", f"""{_W_CTE}
SELECT {_pct('cache', '(input + cache)')} AS cache_hit_pct, {_ratio('tokens', 'turns')} AS tokens_per_turn, turns, {_pct('reasoning', _PARTS)} AS reasoning_mix_pct
FROM wt WHERE period = 'today'""")
_add("w14_cache_savings", f"""{_W_CTE},
f AS (SELECT w.period, CAST(SUM(nano) AS DOUBLE) / 1e9 AS c, CAST(SUM(total_tokens) AS DOUBLE) AS t FROM win w JOIN daily d ON d.day_local BETWEEN w.prev_from AND w.window_to GROUP BY w.period)
SELECT t.period, t.cache, CAST(t.cache AS DOUBLE) / 1000 * (f.c / f.t * 1000) * 0.5 AS cache_saved_usd FROM wt t JOIN f USING (period) WHERE t.period <> 'today'""")
_add("w15_today_insights", f"""{_W_CTE},
x AS (SELECT wt.*, wo.cost_usd AS y FROM wt JOIN wo USING (period) WHERE period = 'today'),
z AS (SELECT *, CASE WHEN y > 0 THEN (cost_usd - y) / y * 100 END AS d, {_pct('cache', _PARTS)} AS cp, {_pct('reasoning', _PARTS)} AS rp, {_ratio('tokens', 'turns')} AS tt FROM x)
SELECT d AS cost_delta_pct, CASE WHEN d IS NULL THEN 'neutral' WHEN d <= 0 THEN 'good' ELSE 'warn' END AS cost_tone,
  cp AS cache_pct, CASE WHEN cp >= 70 THEN 'good' WHEN cp >= 30 THEN 'neutral' ELSE 'warn' END AS cache_tone,
  tt AS tokens_per_turn, {_ratio('cost_usd', 'turns')} AS cost_per_turn, CASE WHEN tt >= 100000 THEN 'warn' ELSE 'neutral' END AS weight_tone,
  rp AS reasoning_pct, CASE WHEN rp > 15 THEN 'warn' WHEN rp > 5 THEN 'neutral' ELSE 'good' END AS reasoning_tone,
  CASE WHEN input > 0 THEN CAST(output AS DOUBLE) / input * 100 END AS output_shape_pct
FROM z WHERE tokens > 0 OR turns > 0""")
_add("w16_main_model", """
, t AS (SELECT * FROM daily WHERE day_local = '2024-01-30')
SELECT variant_id, total_tokens, turns, share_pct, CASE WHEN share_pct >= 90 THEN 'warn' ELSE 'neutral' END AS tone FROM (
  SELECT *, CAST(total_tokens AS DOUBLE) / CAST((SELECT SUM(total_tokens) FROM t) AS DOUBLE) * 100 AS share_pct FROM t
  ORDER BY total_tokens DESC, turns DESC, variant_id DESC, workspace DESC, source DESC LIMIT 1)""")
_add("w17_live_status", "SELECT MAX(ts_utc) AS latest_record_utc, CASE WHEN MAX(day_local) = '2024-01-30' THEN 'live' ELSE 'stale' END AS status FROM rec")
_add("w18_secondary_currency", f"""
SELECT day_local, source, variant_id, workspace, {_USD} AS cost_usd, 'EUR' AS secondary_currency, {_USD} * 0.5 AS cost_secondary FROM daily WHERE {_MONTH}""")
_add("w19_tool_summary", f"""
SELECT CAST(SUM(count) AS BIGINT) AS total_calls, CAST(COUNT(DISTINCT tool_name) AS BIGINT) AS distinct_tools,
  (SELECT tool_name FROM ({_USAGE}) ORDER BY count DESC, tool_name, source LIMIT 1) AS leading_tool FROM ({_USAGE})""")
_add("w19_top_tools", f"SELECT * FROM ({_USAGE}) ORDER BY count DESC, tool_name, source LIMIT 6")

# --- diagnostics ---------------------------------------------------------------------------------

_LONG = "CAST(COUNT(*) AS BIGINT) AS sessions, CAST(SUM(n) AS BIGINT) AS turns, MAX(m) AS max_context_used_tokens"
_ABOVE = "(SELECT source, session_id, model, COUNT(*) AS n, MAX(context_used_tokens) AS m FROM rec WHERE context_used_tokens > 272000 GROUP BY ALL)"
_add("d01_long_context_applied", f"SELECT model, model || '-long-context' AS effective_model, {_LONG} FROM {_ABOVE} WHERE model = 'gpt-5.5' GROUP BY model")
_add("d02_long_context_missing", f"""
SELECT model, {_LONG} FROM {_ABOVE} WHERE model <> 'gpt-5.5' GROUP BY model ORDER BY max_context_used_tokens DESC, turns DESC, model LIMIT 20""")
_add("d03_midnight_sessions", f"""
SELECT source, session_id, workspace, strftime(make_timestamp(first_ts_utc * 1000), '%Y-%m-%d') AS first_day,
  strftime(make_timestamp(last_ts_utc * 1000), '%Y-%m-%d') AS last_day, total_tokens, {_USD} AS cost_usd
FROM sess WHERE strftime(make_timestamp(first_ts_utc * 1000), '%Y-%m-%d') <> strftime(make_timestamp(last_ts_utc * 1000), '%Y-%m-%d')
ORDER BY cost_usd DESC, source, session_id LIMIT 20""")
_DATED = f"SELECT *, replace(file_id[13:22], '/', '-') AS folder_day FROM ({_FILE_DAILY}) WHERE source = 'codex'"
_add("d04_folder_day_costs", f"""
, f AS ({_DATED}), a AS (SELECT day_local AS day, SUM(nano) AS e FROM f GROUP BY day_local), b AS (SELECT folder_day AS day, SUM(nano) AS g FROM f GROUP BY folder_day)
SELECT day, CAST(COALESCE(e, 0) AS DOUBLE) / 1e9 AS event_cost_usd, CAST(COALESCE(g, 0) AS DOUBLE) / 1e9 AS folder_cost_usd,
  CAST(COALESCE(e, 0) - COALESCE(g, 0) AS DOUBLE) / 1e9 AS delta_usd FROM a FULL JOIN b USING (day) ORDER BY day DESC LIMIT 20""")
_add("d05_folder_day_mismatches", f"""
, f AS ({_DATED})
SELECT file_id AS file_path, folder_day, string_agg(DISTINCT day_local, ',' ORDER BY day_local) AS event_days, CAST(SUM(nano) AS DOUBLE) / 1e9 AS cost_usd
FROM f GROUP BY file_id, folder_day HAVING bool_or(day_local <> folder_day) ORDER BY cost_usd DESC, file_path LIMIT 20""")
_RECON = """
, ing AS (SELECT file_id, session_id, SUM(CASE WHEN timed THEN raw_in + raw_out ELSE 0 END) AS g, MAX(CASE WHEN cumulative THEN cum_in + cum_out END) AS f FROM cx_turn GROUP BY ALL),
rc AS (SELECT file_id AS file_path, session_id, CAST(f AS BIGINT) AS final_total_tokens, CAST(g AS BIGINT) AS ingested_total_tokens, CAST(g - f AS BIGINT) AS delta_tokens
  FROM ing WHERE f IS NOT NULL AND g <> 0)"""
_log("d06_reconciliation_mismatches", f"{_RECON} SELECT * FROM rc WHERE delta_tokens <> 0 ORDER BY ABS(delta_tokens) DESC, file_path, session_id LIMIT 20")
_log("d06_reconciliation_checked", f"{_RECON} SELECT CAST(COUNT(*) AS BIGINT) AS checked_sessions FROM rc")


def _body(name: str) -> str:
    """What comes after the shared tables in the SQL of another query."""
    sql = ORACLES[name]
    return sql.removeprefix(_LOGS if sql.startswith(_LOGS) else _BASE).strip()


def _report_cells(part: str, keys: tuple[str, ...], measures: tuple[str, ...], rows: str) -> str:
    key = " || '|' || ".join(keys) or "''"
    cells = [f"SELECT '{part}' AS part, {key} AS key, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM {rows}" for m in measures]
    return "\nUNION ALL ".join(cells or [f"SELECT '{part}' AS part, {key} AS key, 'present' AS measure, 1.0::DOUBLE AS value FROM {rows}"])


def _report_sql() -> str:
    long_context = ("sessions", "turns", "max_context_used_tokens")
    parts = {
        "pricing": ("r02_merge_audit", ("outcome", "model"), ()),
        "long_context_applied": ("d01_long_context_applied", ("model", "effective_model"), long_context),
        "long_context_missing": ("d02_long_context_missing", ("model",), long_context),
        "midnight_sessions": ("d03_midnight_sessions", ("source", "session_id", "workspace", "first_day", "last_day"), ("total_tokens", "cost_usd")),
        "reconciliation_checked": ("d06_reconciliation_checked", (), ("checked_sessions",)),
        "reconciliation_mismatches": ("d06_reconciliation_mismatches", ("file_path", "session_id"), ("final_total_tokens", "ingested_total_tokens", "delta_tokens")),
        "folder_day_costs": ("d04_folder_day_costs", ("day",), ("event_cost_usd", "folder_cost_usd", "delta_usd")),
        "folder_day_mismatches": ("d05_folder_day_mismatches", ("file_path", "folder_day", "event_days"), ("cost_usd",)),
    }
    own, cells = "", []
    for part, (name, keys, measures) in parts.items():
        body = _body(name)
        # Tables that the query adds to the shared ones are its own subquery's here.
        inner = f"WITH {body[1:].strip()}" if body.startswith(",") else body
        own += f",\npart_{part} AS ({inner})"
        cells.append(_report_cells(part, keys, measures, f"part_{part}"))
    return own + "\n" + "\nUNION ALL ".join(cells)


_log("d07_full_report", _report_sql())

# --- extras --------------------------------------------------------------------------------------

_add("x01_anomaly_days", """
, d AS (SELECT day_local, CAST(SUM(nano) AS DOUBLE) / 1e9 AS cost_usd FROM daily GROUP BY day_local),
m AS (SELECT *, median(cost_usd) OVER (ORDER BY day_local ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS trailing_median FROM d)
SELECT day_local, cost_usd, trailing_median, COALESCE(cost_usd > trailing_median * 1.05, false) AS is_anomaly FROM m""")
_add("x02_peak_context_fill", "SELECT source, session_id, peak_context_fill FROM sess")
_add("x03_context_fill_warnings", "SELECT source, session_id, peak_context_fill FROM sess WHERE peak_context_fill * 100 >= 25")
_add("x04_exact_cache_savings", """
SELECT p.model, CAST(SUM(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
  CAST(SUM(cache_read_tokens * (COALESCE(r_in, 1250) - COALESCE(r_cached, 125))) AS DOUBLE) / 1e9 AS saved_usd
FROM priced p LEFT JOIN rates t ON t.model = p.effective_model GROUP BY p.model""")
_add("x05_sidechain_split", """
SELECT source, is_sidechain, CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, CAST(COUNT(*) AS BIGINT) AS turns, CAST(SUM(nano) AS DOUBLE) / 1e9 AS cost_usd
FROM priced GROUP BY ALL""")

# --- incremental refresh -------------------------------------------------------------------------

_KNOWN = "(SELECT source, file_id, MIN(user_id) AS u, COUNT(*) * 100 AS size, MAX(ts_utc) AS mtime FROM rec WHERE ts_utc <= 1705708800000 GROUP BY source, file_id)"
_add("i01_classified_files", f"""
SELECT f.source, f.file_path, CASE WHEN s.file_id IS NULL THEN CASE WHEN f.mtime_ms < 1706659199999 - 3 * 86400000 THEN 'skip' ELSE 'firstRead' END
  WHEN s.u % 11 = 3 THEN 'reingest' WHEN s.u % 17 = 7 THEN 'reingest' WHEN f.size = s.size AND f.mtime_ms = s.mtime THEN 'skip'
  WHEN f.size < s.size + CASE WHEN s.u % 13 = 5 THEN 1000000 ELSE 0 END THEN 'reingest' ELSE 'append' END AS action
FROM ({_FILES}) f LEFT JOIN {_KNOWN} s ON s.file_id = f.file_id AND s.source = f.source""")
_add("i02_rewritten_files", "SELECT DISTINCT source, file_id AS file_path FROM rec WHERE event_id % 7 = 3")
_add("i03_overlapping_files", "SELECT DISTINCT source, file_id FROM rec WHERE ts_utc <= 1705708800000 AND context_used_tokens > 300000")
_add("i04_crossing_sessions", """
SELECT file_id AS file_path, session_id FROM rec GROUP BY ALL
HAVING SUM(input_tokens) FILTER (ts_utc <= 1705708800000) * 4 <= 272000 AND SUM(input_tokens) * 4 > 272000
  AND bool_or(ts_utc > 1705708800000 AND model = 'gpt-5.5')""")
_add("i05_replaced_files", "SELECT dedup_key, file_id FROM rec WHERE event_id % 7 <> 2 OR hour_local < 12")
_log("i06_append_equals_full", f"SELECT regexp_replace(dedup_key, ':[0-9a-f]{{16}}:', ':') AS dedup_key, session_id, ts_utc, model, variant_id, total_tokens FROM ({_PARSED})")
_add("i07_file_catalog", f"""
SELECT f.file_path, CASE WHEN f.file_path LIKE '%-6.jsonl' THEN k.size ELSE f.size END AS size,
  CASE WHEN k.file_id IS NULL THEN 1706659199999 ELSE 1705708800000 END AS first_seen_utc,
  CASE WHEN f.file_path LIKE '%-6.jsonl' THEN 1705708800000 ELSE 1706659199999 END AS last_seen_utc,
  CASE WHEN k.file_id IS NULL OR (f.file_path NOT LIKE '%-6.jsonl' AND k.size <> f.size) THEN 1706659199999 ELSE 1705708800000 END AS last_changed_utc,
  CASE WHEN k.file_id IS NULL THEN 'discovered' WHEN f.file_path NOT LIKE '%-6.jsonl' AND k.size <> f.size THEN 'changed' ELSE 'discovered' END AS state
FROM ({_FILES}) f LEFT JOIN {_KNOWN} k ON k.file_id = f.file_id WHERE k.file_id IS NOT NULL OR f.file_path NOT LIKE '%-6.jsonl'""")
_add("i07_catalog_after_run", f"""
SELECT f.file_path, CASE WHEN f.file_path LIKE '%-6.jsonl' THEN NULL ELSE 1706659200000 END AS last_checked_utc,
  CASE WHEN f.file_path NOT LIKE '%-6.jsonl' AND f.size IS DISTINCT FROM k.size THEN 1706659200000 END AS last_ingested_utc,
  CASE WHEN f.file_path NOT LIKE '%-6.jsonl' AND f.size IS DISTINCT FROM k.size THEN d.min_day END AS min_day,
  CASE WHEN f.file_path NOT LIKE '%-6.jsonl' AND f.size IS DISTINCT FROM k.size THEN d.max_day END AS max_day,
  CASE WHEN f.file_path LIKE '%-6.jsonl' THEN 'discovered' WHEN f.file_path LIKE '%-5.jsonl' THEN 'ignored' ELSE 'complete' END AS state
FROM ({_FILES}) f LEFT JOIN {_KNOWN} k ON k.file_id = f.file_id
JOIN (SELECT file_id, MIN(day_local) AS min_day, MAX(day_local) AS max_day FROM rec GROUP BY file_id) d ON d.file_id = f.file_id
WHERE k.file_id IS NOT NULL OR f.file_path NOT LIKE '%-6.jsonl'""")
_add("i08_missing_files", f"""
SELECT source, file_id AS file_path, CASE WHEN u % 11 = 3 THEN file_id || '~old' ELSE file_id END AS file_id
FROM {_KNOWN} WHERE u % 11 = 3 OR file_id LIKE '%-6.jsonl'""")
_add("i08_missing_sources", "SELECT DISTINCT source FROM rec WHERE source = 'claude'")

# --- streams -------------------------------------------------------------------------------------

_log("t01_stateful_parse", f"""
SELECT regexp_replace(event_key, ':[0-9a-f]{{16}}:', ':') AS event_key, * EXCLUDE (event_key) FROM (SELECT x.event_key, x.tool_name, x.session_id, t.ts_utc FROM ({_CX_TOOLS}) x JOIN cx_turn t ON t.dedup_key = x.record_dedup_key WHERE x.timed
UNION ALL SELECT dedup_key || '#' || n, CASE WHEN k % 10 = 5 THEN 'unknown' WHEN n = 0 THEN 'shell' WHEN n = 1 THEN 'apply_patch' ELSE 'read_file' END,
  session_id, ts_utc FROM (SELECT *, unnest(range(k % 4)) AS n FROM cl_turn WHERE timed))""")
_BAD = "(source = 'codex' AND i IN (10, 11)) OR (source = 'claude' AND i IN (4, 5))"
_log("t01_stateful_quality", f"""
SELECT source, file_path, CAST(COUNT(*) FILTER ({_BAD}) AS BIGINT) AS malformed_count, CAST(0 AS BIGINT) AS oversized_count
FROM log GROUP BY ALL HAVING malformed_count > 0""")
for _name in ("t02_stream_dedup", "t02_store_once"):
    _add(_name, "SELECT dedup_key, total_tokens FROM rec")
_add("t03_stream_hourly", f"""
SELECT ts_utc // 3600000 * 3600000 AS window_start_utc, source, {_SUMS}, CAST(COUNT(*) AS BIGINT) AS turns FROM rec GROUP BY ts_utc // 3600000, source""")
_add("t04_stream_tool_events", "SELECT event_key, record_dedup_key, tool_name, day_local FROM tool")
_add("t04_stream_into_rollups", f"SELECT {_DAILY} FROM daily")
