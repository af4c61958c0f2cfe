"""Small builders shared by the tests."""

from datetime import UTC, datetime

from turnledger.schemas import TOOL_EVENT, USAGE_RECORD

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens")


def ms(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp() * 1000)


def record(key, when, **over):
    ts = ms(when)
    at = datetime.fromtimestamp(ts / 1000, UTC)
    row = {
        "dedup_key": key, "file_id": "f1", "source": "codex", "session_id": "s1", "ts_utc": ts,
        "day_local": at.strftime("%Y-%m-%d"), "dow_local": (at.weekday() + 1) % 7, "hour_local": at.hour,
        "model": "gpt-5", "effort": "n/a", "workspace": "", "is_sidechain": False,
        "context_window": None, "context_used_tokens": None, "stop_reason": None, **dict.fromkeys(TOKENS, 0),
    }
    row.update(over)
    row.setdefault("variant_id", row["model"] if row["effort"] == "n/a" else f"{row['model']} ({row['effort']})")
    row["total_tokens"] = sum(row[t] for t in TOKENS)
    return tuple(row[name] for name in USAGE_RECORD.fieldNames())


def records(spark, *rows):
    return spark.createDataFrame(list(rows), USAGE_RECORD)


def calls(spark, *pairs):
    rows = [(f"{key}#{i}", key, "f1", "codex", "s1", 1, "2024-01-01", name, False) for i, (key, name) in enumerate(pairs)]
    return spark.createDataFrame(rows, TOOL_EVENT)


def lines(spark, source, path, texts, chunk_lines=3, size=None):
    """A lines frame of one file, cut into chunks of a few lines."""
    rows = [(source, path, i // chunk_lines, i % chunk_lines, text, size) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "source string, file_path string, chunk long, pos long, value string, file_size long")


def offsets(texts):
    out, at = [], 0
    for text in texts:
        out.append(at)
        at += len(text.encode()) + 1
    return out
