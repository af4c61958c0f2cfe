"""Maps the ``events`` table to usage records, tool events and log lines.

The driver's tables hold no session logs, so turns are derived from events: one event is one turn.
Log lines are rendered from the same events, so that parsing them can be checked against SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnledger.functions.columns import total_tokens, variant_id
from turnledger.operators.ordered import scan
from turnledger.schemas import TOOL_EVENT, USAGE_RECORD
from turnledger.session import staged

# Events per chunk of a rendered file, as a power of two.
CHUNK_BITS = 9
# Room for the lines of one event.
LINES_PER_EVENT = 16

# Model per event type.
MODEL_OF_EVENT = {
    "view": "gpt-5-codex",
    "click": "gpt-5.5",
    "purchase": "claude-sonnet-4",
    "error": "gpt-5-mini",
    "signup": "unlisted-model",
}
TOOL_NAMES = ("shell", "apply_patch", "read_file")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the derived turn columns."""
    return turns_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


_SESSION = "concat('s', user_id, '-', event_id % 7) AS session_id"
_KEYED = (
    "event_id", "user_id", "event_type", "ts",
    "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
    "CAST(round(value * 100) AS BIGINT) AS v",
)
_TURN = (
    "*",
    "concat('ev:', event_id) AS dedup_key",
    "if(user_id % 2 = 0, 'codex', 'claude') AS source",
    # The zone-less event time is read as UTC, whatever the session time zone is.
    "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000 AS ts_utc",
    "CAST(CAST(ts AS DATE) AS STRING) AS day_local",
    "CAST(dayofweek(ts) - 1 AS BIGINT) AS dow_local",
    "CAST(hour(ts) AS BIGINT) AS hour_local",
    "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in MODEL_OF_EVENT.items()) + " END AS model",
    "CASE WHEN user_id % 2 = 1 THEN 'n/a' WHEN k % 4 = 0 THEN 'low' WHEN k % 4 = 1 THEN 'medium' WHEN k % 4 = 2 THEN 'high' ELSE 'n/a' END AS effort",
    "concat('/ws/', k % 3) AS workspace",
    "v + 1 AS input_tokens",
    "k * 11 AS output_tokens",
    "k * 7 AS cache_read_tokens",
    "if(user_id % 2 = 1, k, 0) AS cache_creation_tokens",
    "if(user_id % 2 = 0, k * 3, 0) AS reasoning_tokens",
    "CAST(1000000 AS BIGINT) AS context_window",
    "v * 20 AS context_used_tokens",
    "k % 5 = 0 AS is_sidechain",
    "if(user_id % 2 = 0, concat('/logs/codex/', replace(CAST(date_add(DATE'2024-01-01', CAST(user_id % 28 AS INT)) AS STRING), '-', '/'), '/s',"
    " user_id, '-', event_id % 7, '.jsonl'), concat('/logs/claude/u', user_id, '/s', user_id, '-', event_id % 7, '.jsonl')) AS file_path",
)


def turns_of(raw: DataFrame) -> DataFrame:
    """Derived columns of raw events; ``session_id`` and ``chunk`` stay if they are there."""
    held = [c for c in ("session_id", "chunk") if c in raw.columns]
    return raw.selectExpr(*_KEYED, *(held or [_SESSION])).selectExpr(*_TURN)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage records, one per event."""
    return as_records(events(spark, sf_dir))


def as_records(turns: DataFrame) -> DataFrame:
    return (
        turns.withColumnRenamed("file_path", "file_id")
        .withColumn("total_tokens", total_tokens())
        .withColumn("variant_id", variant_id(F.col("model"), F.col("effort")))
        .withColumn("stop_reason", F.lit(None).cast("string"))
        .select(*USAGE_RECORD.fieldNames())
    )


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool events: ``k % 4`` calls per turn."""
    return tools_of(events(spark, sf_dir))


def tools_of(turns: DataFrame) -> DataFrame:
    named = F.element_at(F.array(*[F.lit(n) for n in TOOL_NAMES]), (F.col("_i") % 3 + 1).cast("int"))
    return (
        turns.withColumnRenamed("file_path", "file_id")
        .filter(F.col("k") % 4 > 0)
        .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") % 4 - 1)))
        .select(
            F.concat_ws("#", "dedup_key", F.col("_i").cast("string")).alias("event_key"),
            F.col("dedup_key").alias("record_dedup_key"),
            "file_id", "source", "session_id", "ts_utc", "day_local",
            named.alias("tool_name"),
            "is_sidechain",
        )
        .select(*TOOL_EVENT.fieldNames())
    )


# --- log lines ---------------------------------------------------------------------------------


def _fill(template: str, when: str | None = None) -> Column:
    """Text with ``<sql>`` marks replaced by column values; null unless ``when`` holds."""
    parts = re.split(r"<([^<>]+)>", template)
    quoted = [f"'{p}'" if i % 2 == 0 else f"CAST({p} AS STRING)" for i, p in enumerate(parts) if p]
    text = f"concat({', '.join(quoted)})"
    return F.expr(f"CASE WHEN {when} THEN {text} END" if when else text)


# Timestamp field: usually ISO, sometimes epoch milliseconds, sometimes absent.
_STAMP = (
    "CASE WHEN k % 23 = 7 AND k % 2 = 1 THEN '' WHEN k % 23 = 7 THEN concat('\"timestamp\":\"', ts_utc, '\",') WHEN k % 8 = 0 THEN concat('\"timestamp\":', ts_utc, ',') ELSE "
    """concat('"timestamp":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), '",') END"""
)
_FILLER = "CASE WHEN k % 29 = 0 THEN repeat('x', 5000) ELSE '' END"


def _codex_lines(turns: DataFrame) -> DataFrame:
    """Lines of Codex turns with cumulative totals per session.

    Kept odd on purpose: context rows are sparse, some rows have no cumulative total, some repeat
    the last one, some lack a time.
    """
    def step(value: str) -> Column:
        return F.expr(f"CASE WHEN k % 9 <> 0 THEN {value} ELSE 0 END")

    sums = {
        "cum_in": step("input_tokens + cache_read_tokens"), "cum_cached": step("cache_read_tokens"),
        "cum_out": step("output_tokens + reasoning_tokens"), "cum_reason": step("reasoning_tokens"), "nth": F.lit(1),
    }
    totals = scan(turns, ["session_id"], "chunk", "event_id", sums=sums)
    usage = '{"input_tokens":<%s>,"cached_input_tokens":<%s>,"output_tokens":<%s>,"reasoning_output_tokens":<%s>}'
    whole = usage % ("cum_in", "cum_cached", "cum_out", "cum_reason")
    single = usage % ("input_tokens + cache_read_tokens", "cache_read_tokens", "output_tokens + reasoning_tokens", "reasoning_tokens")
    info = F.coalesce(
        _fill(f'{{"last_token_usage":{{"input_tokens":<context_used_tokens>}},"total_token_usage":{whole},"model_context_window":1000000}}', "k % 9 <> 0"),
        _fill(f'{{"last_token_usage":{single},"model_context_window":1000000}}'),
    )
    limits = '"rate_limits":{"primary":{"used_percent":<k>},"secondary":{"used_percent":<k % 7>}}'
    tokens = F.coalesce(
        _fill('{"type":"event_msg",<stamp>"payload":{"type":"token_count","info":<info>,' + limits + "}}", "k % 2 = 0"),
        _fill('{"type":"event_msg",<stamp>"payload":{"type":"token_count"},"info":<info>,' + limits + "}"),
    )
    call = '{"type":"response_item","payload":{"type":"function_call","name":"%s","arguments":"{}"}}'
    effort = """CASE WHEN effort = 'n/a' THEN '' ELSE concat(',"effort":"', effort, '"') END"""
    return (
        totals.withColumn("stamp", F.expr(_STAMP)).withColumn("filler", F.expr(_FILLER)).withColumn("info", info)
        .withColumn("tokens", tokens).withColumn("effort_field", F.expr(effort))
        .withColumn("lines", F.array(
            _fill('{"type":"session_meta","payload":{"id":"<session_id>","cwd":"/home/dev","cli_version":"1.2.3",'
                  '"source":"cli","git":{"branch":"main","repository_url":"https://example.org/r.git"}}}', "nth = 1"),
            _fill('{"type":"turn_context","payload":{"model":"<model>"<effort_field>,"approval_policy":"p<k % 2>",'
                  '"sandbox_policy":{"mode":"m<k % 5>"}}}', "nth = 1 OR k % 3 = 0"),
            _fill('{"type":"response_item","payload":{"type":"message","text":"größe <filler>"}}'),
            *[_fill(call % name, f"k % 4 > {i}") for i, name in enumerate(TOOL_NAMES)],
            _fill('{"type":"response_item","payload":{"type":"image_generation_call"}}', "k % 11 = 0"),
            F.col("tokens"),
            _fill("<tokens>", "k % 9 <> 0 AND k % 5 = 1"),
            _fill('{"type":"event_msg","payload":{"type":"token_count",', "k % 17 = 3"),
            _fill('<tokens>{"x":1}', "k % 13 = 5"),
        ))
    )


def _claude_lines(turns: DataFrame) -> DataFrame:
    """Lines of Claude turns; request ids repeat, so some turns merge into their neighbour."""
    request = """CASE WHEN k % 6 = 1 THEN '' ELSE concat('"requestId":"r', k % 4, '",') END"""
    side = """CASE WHEN k % 5 = 0 THEN '"isSidechain":true,' WHEN k % 5 = 1 THEN '"isSidechain":false,' ELSE '' END"""
    blocks = [
        F.coalesce(_fill('{"type":"tool_use"}', f"k % 4 > {i} AND k % 10 = 5"), _fill(f'{{"type":"tool_use","name":"{name}"}}', f"k % 4 > {i}"))
        for i, name in enumerate(TOOL_NAMES)
    ]

    def assistant(output: str, content: str, when: str | None = None, tail: str = "") -> Column:
        return _fill(
            '{"type":"assistant",<stamp>"sessionId":"<session_id>",<request>"uuid":"u<event_id>","cwd":"<workspace>",<side>'
            '"version":"2.0","message":{"model":"<logged_model>","stop_reason":"end_turn","usage":{"input_tokens":<input_tokens>,'
            f'"output_tokens":{output},"cache_read_input_tokens":<cache_read_tokens>,'
            f'"cache_creation_input_tokens":<cache_creation_tokens>}},"content":[{content}]}}}}{tail}', when,
        )

    return (
        turns.withColumn("stamp", F.expr(_STAMP)).withColumn("filler", F.expr(_FILLER))
        .withColumn("request", F.expr(request)).withColumn("side", F.expr(side))
        .withColumn("logged_model", F.expr("CASE WHEN k % 19 = 0 THEN '<synthetic>' ELSE model END"))
        .withColumn("content", F.concat_ws(",", *blocks))
        .withColumn("lines", F.array(
            _fill('{"type":"user","message":{"role":"user","content":"größe <filler>"}}'),
            assistant("1", "", "k % 3 = 0"),
            assistant("<output_tokens>", "<content>"),
            _fill('{"type":"assistant","message":{"usage":{', "k % 17 = 3"),
            assistant("7", "", "k % 13 = 5", '{"x":1}'),
        ))
    )


def log_lines(spark: SparkSession, sf_dir: str, chunk_bits: int = CHUNK_BITS, source: str | None = None) -> DataFrame:
    """A lines frame rendered from all events, in event order within each session's file.

    Files of every third user lack the final newline, as a file still being written does.
    """
    # Laid out as the running totals need it. The table is compact, so a few tasks read it: they
    # pass its own columns on, and all else is derived behind the exchange.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("*", _SESSION, f"shiftright(event_id, {chunk_bits}) AS chunk")
    is_codex = F.col("user_id") % 2 == 0
    mine = {"codex": is_codex, "claude": ~is_codex}
    keep = ["source", "file_path", "user_id", "event_id", "chunk", "lines"]
    render = {"codex": _codex_lines, "claude": _claude_lines}
    parts = [
        render[s](turns_of(raw.filter(mine[s]).repartition(width, "session_id", "chunk"))).select(*keep)
        for s in ([source] if source else render)
    ]
    rendered = parts[0] if source else parts[0].unionByName(parts[1])
    # Outer, or Spark adds a filter on the array, moves it below the exchange and renders every line there as well.
    exploded = rendered.select(
        "source", "file_path", "user_id", "event_id", "chunk", F.posexplode_outer("lines").alias("_i", "value")
    ).filter(F.col("value").isNotNull())
    return exploded.select(
        "source", "file_path", "user_id", "chunk",
        (F.col("event_id") * LINES_PER_EVENT + F.col("_i")).alias("pos"),
        "value",
    )


def sized_log_lines(spark: SparkSession, sf_dir: str, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Rendered lines with the file size a directory listing would give.

    The size is found from one row per chunk and joined by chunk, so a large file is not one key.
    """
    lines = staged(log_lines(spark, sf_dir, chunk_bits), "lines")
    open_file = F.when(F.col("user_id") % 3 == 0, 1).otherwise(0)
    keys = ["source", "file_path"]
    chunks = lines.groupBy(*keys, "chunk").agg(
        F.sum(F.octet_length("value").cast("bigint") + 1).alias("_n"), F.max(open_file).alias("_open")
    )
    whole = Window.partitionBy(*keys)
    sizes = chunks.select(*keys, "chunk", (F.sum("_n").over(whole) - F.max("_open").over(whole)).alias("file_size"))
    return lines.join(sizes, [*keys, "chunk"])


def unsized_log_lines(spark: SparkSession, sf_dir: str, chunk_bits: int = CHUNK_BITS, source: str | None = None) -> DataFrame:
    """Rendered lines of files taken as complete."""
    return log_lines(spark, sf_dir, chunk_bits, source).withColumn("file_size", F.lit(None).cast("bigint"))
