import json
import random

from turnledger.operators import claude, codex, logrows, normalize
from helpers import lines, offsets


def usage(i, c, o, r):
    return {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": r}


def meta(session):
    return {"type": "session_meta", "payload": {"id": session, "cwd": "/p"}}


def context(model=None, effort=None):
    payload = {k: v for k, v in {"model": model, "effort": effort}.items() if v}
    return {"type": "turn_context", "payload": payload}


def call(name):
    return {"type": "response_item", "payload": {"type": "function_call", "name": name}}


def tokens(total=None, last=None, ts="2024-01-05T10:00:00.000Z", nested=False):
    info = {k: v for k, v in {"total_token_usage": total, "last_token_usage": last}.items() if v}
    info["model_context_window"] = 200000
    line = {"type": "event_msg", "payload": {"type": "token_count"}}
    (line["payload"] if nested else line)["info"] = info
    return {**line, "timestamp": ts} if ts is not None else line


def codex_model(items):
    """What a reader going line by line would give: turns and tool calls."""
    session, model, effort, pending, base = "", "unknown", None, [], {}
    turns, tools = [], []
    for i, item in enumerate(items):
        payload = item.get("payload") or {}
        if item["type"] == "session_meta":
            session = payload.get("id") or session
        elif item["type"] == "turn_context":
            model, effort = payload.get("model") or model, payload.get("effort")
        elif item["type"] == "response_item":
            pending.append(payload["name"])
        else:
            info = item.get("info") or payload.get("info")
            if not info or model == "unknown":
                continue
            total, last = info.get("total_token_usage"), info.get("last_token_usage")
            names = list(usage(0, 0, 0, 0))
            if total:
                old = base.get(session, dict.fromkeys(names, 0))
                counts = [total[n] - old[n] for n in names]
                base[session] = total
                if min(counts) < 0 or max(counts) == 0:
                    pending = []
                    continue
            elif last and last.get("input_tokens") is not None:
                counts = [last.get(n, 0) for n in names]
            else:
                continue
            turns.append((session, model, effort, i, *counts))
            tools += [(i, n, name) for n, name in enumerate(pending)]
            pending = []
    return turns, tools


def random_codex(rng, n):
    totals, items, session = {}, [], ""
    for _ in range(n):
        kind = rng.random()
        if kind < 0.1:
            session = rng.choice(["A", "B"])
            items.append(meta(session))
        elif kind < 0.25:
            items.append(context(rng.choice([None, "m1", "m2"]), rng.choice([None, "high"])))
        elif kind < 0.5:
            items.append(call(rng.choice(["x", "y"])))
        else:
            step = rng.choice([0, 0, 3, 10, -5])
            now = [max(0, t + step + i) if step else t for i, t in enumerate(totals.get(session, [0, 0, 0, 0]))]
            form = rng.random()
            if form < 0.7:
                totals[session] = now
                items.append(tokens(usage(*now), {"input_tokens": 5}, nested=rng.random() < 0.5))
            elif form < 0.9:
                items.append(tokens(None, usage(4, 1, 2, 1)))
            else:
                items.append(tokens())
    return items


def test_codex_equals_sequential_model(spark):
    rng = random.Random(11)
    frame, want_turns, want_tools = None, [], []
    for log in range(4):
        items = random_codex(rng, 120)
        texts = [json.dumps(i) for i in items]
        part = lines(spark, "codex", f"/log{log}", texts, chunk_lines=rng.choice([1, 7, 50]))
        frame = part if frame is None else frame.unionByName(part)
        turns, tools = codex_model(items)
        at = offsets(texts)
        want_turns += [(f"/log{log}", s, m, e, at[i], *c) for s, m, e, i, *c in turns]
        want_tools += [(f"/log{log}", at[i], n, name) for i, n, name in tools]
    rows = codex.rows(frame)
    found = codex.token_rows(rows)
    got = found.filter("billed").select(
        "file_path", "session_id", "model", "effort", "line_offset", "raw_input", "raw_cached", "raw_output", "raw_reasoning"
    ).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want_turns))
    events = codex.tool_events(rows, found).select("file_path", "event_key", "tool_name").collect()
    seen = [(r.file_path, int(r.event_key.split(":")[-1].split("#")[0]), int(r.event_key.split("#")[1]), r.tool_name) for r in events]
    assert sorted(seen) == sorted(want_tools)


def test_disjoint_buckets_and_repeated_snapshots(spark):
    items = [meta("s"), context("gpt-5-codex", "high"), tokens(usage(1000, 400, 600, 200)), tokens(usage(1000, 400, 600, 200)),
             context("gpt-5-codex", "xhigh"), tokens(usage(1060, 400, 610, 200))]
    parsed = normalize.parse_lines(lines(spark, "codex", "/f", [json.dumps(i) for i in items]))
    got = parsed.records.orderBy("dedup_key").collect()
    by_variant = {r.variant_id: r for r in got}
    first = by_variant["gpt-5-codex (high)"]
    assert (first.input_tokens, first.cache_read_tokens, first.output_tokens, first.reasoning_tokens) == (600, 400, 400, 200)
    assert (first.cache_creation_tokens, first.total_tokens) == (0, 1600)
    second = by_variant["gpt-5-codex (xhigh)"]
    assert (second.input_tokens, second.output_tokens) == (60, 10)
    assert len(got) == 2


def assistant(rid, i=1, o=1, **over):
    line = {"type": "assistant", "timestamp": "2025-01-15T09:00:10.000Z", "sessionId": "s", "requestId": rid, "cwd": "/w",
            "message": {"model": "claude-sonnet-4-20250514", "usage": {"input_tokens": i, "output_tokens": o}, "content": []}}
    line.update(over)
    return line


def test_requests_collapse_only_when_adjacent(spark):
    items = [assistant("r1", 1), assistant("r1", 2), {"type": "user", "message": {}}, assistant("r1", 3), assistant("r2", 10), assistant("r1", 100)]
    for chunk_lines in (1, 2, 10):
        frame = lines(spark, "claude", "/f", [json.dumps(i) for i in items], chunk_lines)
        won = claude.turns(claude.assistant_rows(claude.rows(frame)))
        assert sorted((r.request_id, r.raw_input) for r in won.collect()) == [("r1", 3), ("r1", 100), ("r2", 10)]


def test_claude_tools_and_odd_content(spark):
    use = {"type": "tool_use", "name": "Read", "input": {"type": "x"}}
    items = [
        assistant("a", message={"model": "m", "usage": {}, "content": ["text", {"type": "text", "text": '"tool_use"'}, use, {"type": "tool_use"}]}, isSidechain=True),
        assistant("b", message={"model": "m", "usage": {"input_tokens": 5.0}, "content": 'plain "usage" text'}),
        assistant("c", message={"model": "<synthetic>", "usage": {"input_tokens": 1}}),
        assistant("d", message={"model": "unknown", "usage": {"input_tokens": 1}}),
        assistant("e", message={"model": "m"}),
    ]
    won = claude.turns(claude.assistant_rows(claude.rows(lines(spark, "claude", "/f", [json.dumps(i) for i in items]))))
    assert {r.request_id: r.raw_input for r in won.collect()} == {"a": 0, "b": 5}
    got = sorted((r.event_key[-2:], r.tool_name, r.is_sidechain) for r in claude.tool_events(won).collect())
    assert got == [("#0", "Read", True), ("#1", "unknown", True)]


def test_malformed_lines_count_only_behind_the_keywords(spark):
    texts = ["{not json", '{"token_count" broken', '{"type":"event_msg","payload":"token_count"}', json.dumps(context("m")), '["token_count"]']
    counts = logrows.quality(codex.rows(lines(spark, "codex", "/f", texts))).first()
    assert counts.malformed_count == 1


def test_turns_without_a_time_still_move_the_baseline(spark):
    items = [context("m"), tokens(usage(100, 0, 0, 0), ts=None), tokens(usage(150, 0, 0, 0), ts=1704448800000), tokens(usage(160, 0, 0, 0), ts="nonsense")]
    parsed = normalize.parse_lines(lines(spark, "codex", "/f", [json.dumps(i) for i in items]))
    got = parsed.records.collect()
    assert [(r.input_tokens, r.ts_utc, r.day_local) for r in got] == [(50, 1704448800000, "2024-01-05")]


def test_nothing_of_the_conversation_leaves_the_parser(spark):
    secret = "SENTINEL-9f3"
    codex_items = [meta("s"), context("m"), {**call("shell"), "arguments": secret}, {"type": "response_item", "payload": {"type": "message", "text": secret}},
                   {**tokens(usage(5, 0, 5, 0)), "note": secret}]
    codex_items[2]["payload"]["arguments"] = secret
    claude_items = [assistant("r", message={"model": "m", "usage": {"input_tokens": 1}, "content": [
        {"type": "text", "text": secret}, {"type": "tool_use", "name": "Read", "input": secret}]})]
    frame = lines(spark, "codex", "/a", [json.dumps(i) for i in codex_items]).unionByName(
        lines(spark, "claude", "/b", [json.dumps(i) for i in claude_items])
    )
    parsed = normalize.parse_lines(frame)
    assert parsed.records.count() == 2 and parsed.tool_events.count() == 2
    for table in (parsed.records, parsed.tool_events, parsed.quality, parsed.running_totals, parsed.rate_limits):
        assert not any(secret in row for row in table.toJSON().collect())
    for rows in (codex.rows(frame), claude.rows(frame)):
        assert not any(secret in row for row in rows.toJSON().collect())


def test_dedupe_keeps_the_last_and_its_calls(spark):
    from helpers import calls, record, records

    old = records(spark, record("k", "2024-01-01T00:00:01"))
    new = records(spark, record("k", "2024-01-01T00:00:02", input_tokens=9))
    from pyspark.sql import functions as F

    rows = old.withColumn("_at", F.lit(0)).unionByName(new.withColumn("_at", F.lit(1)))
    stale = calls(spark, ("k", "a")).withColumn("_at", F.lit(0))
    fresh = calls(spark, ("k", "b")).withColumn("ts_utc", F.lit(1704067202000)).withColumn("_at", F.lit(1))
    kept, tools = normalize.dedupe(rows, stale.unionByName(fresh), "_at")
    assert [r.input_tokens for r in kept.collect()] == [9]
    assert [r.tool_name for r in tools.collect()] == ["b"]
