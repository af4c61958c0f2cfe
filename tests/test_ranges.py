import io
import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnledger.operators import normalize, resume, rollups
from turnledger.plans import refresh
from turnledger.plans.refresh import RefreshOptions
from turnledger.sources import inventory, ranges, rates
from turnledger.sources.store import UsageStore
from test_parse import assistant, random_codex
from test_refresh import consistent, write


def plain_lines(data, limit):
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\n", at)
        stop = len(data) if end < 0 else end
        out.append((at, stop - at + (end >= 0), data[at:stop] if stop - at <= limit else None, end >= 0))
        at = stop + 1
    return out


def test_blocks_together_give_each_line_once():
    rng = random.Random(3)
    for _ in range(300):
        data = b"".join(rng.choice([b"a", b"bc", b"\n", b"\n\n", "ü".encode(), b"x" * rng.randint(0, 40)]) for _ in range(rng.randint(0, 40)))
        limit, block, piece = rng.randint(1, 30), rng.randint(1, 25), rng.randint(1, 20)
        got, read = [], 0
        for start in range(0, len(data), block):
            for part in ranges.lines_in(io.BytesIO(data + b"later"), start, min(start + block, len(data)), len(data), limit, piece):
                if isinstance(part, int):
                    read += part
                else:
                    got += part
        assert got == plain_lines(data, limit)


def test_a_block_reads_little_beyond_itself():
    data = b"".join(b"%06d\n" % i for i in range(10_000))
    *_, read = ranges.lines_in(io.BytesIO(data), 35_001, 42_000, len(data), 100, 512)
    assert 6_999 <= read < 8_100


def test_read_ranges_of_files(spark, tmp_path):
    one, two = tmp_path / "a.jsonl", tmp_path / "b ü%20.jsonl"
    one.write_bytes(b"first\nsecond\r\nth\xc3\xbcrd\n" + b"y" * 5_000 + b"\n\nlast")
    two.write_bytes(b"alone\n")
    rows = [("codex", str(one), 6, one.stat().st_size), ("claude", str(two), 0, 6), ("claude", str(two), 6, 6)]
    files = spark.createDataFrame(rows, "source string, file_path string, start long, file_size long")
    found = ranges.read_ranges(files, 4_096, block_bytes=7).collect()
    lines = sorted((r.file_path, r.line_offset, r.n_bytes, r.value, r.ended) for r in found if r.line_offset is not None)
    assert lines == sorted([
        (str(one), 6, 8, "second\r", True), (str(one), 14, 7, "thürd", True), (str(one), 21, 5_001, None, True), (str(one), 5_022, 1, "", True),
        (str(one), 5_023, 4, "last", False), (str(two), 0, 6, "alone", True),
    ])
    assert all((r.read_bytes is None) == (r.line_offset is not None) for r in found)


def test_anchors_tell_appended_from_rewritten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK_BYTES", 20_000)
    text = b"".join(b"line %06d\n" % i for i in range(5_000))
    path = tmp_path / "a.jsonl"

    def checks(upto):
        files = spark.createDataFrame([("codex", str(path), upto)], "source string, file_path string, last_offset long")
        (row,) = ranges.prefix_anchors(files).collect()
        return row.prefix_check, row.line_ends

    path.write_bytes(text)
    before, ends = checks(len(text))
    assert ends
    path.write_bytes(text + b"more\n")
    assert checks(len(text)) == (before, True)
    for at in (0, 4_095, 19_990, 39_000, len(text) - 2):  # head, block limits, tail
        path.write_bytes(text[:at] + b"X" + text[at + 1 :] + b"more\n")
        assert checks(len(text))[0] != before, at
    path.write_bytes(text[:-3])
    assert checks(len(text))[0] != before
    path.write_bytes(text[:-1] + b"grown\n")
    assert checks(len(text) - 1)[1] is False
    path.write_bytes(b"")
    assert checks(0)[1] is True


def test_listing_of_named_paths(spark, tmp_path):
    for name in ("x/a.jsonl", "x/y/b.jsonl", "x/y/c.txt", "z/d.jsonl"):
        write(tmp_path / "root" / name, ["{}"])
    root = str(tmp_path / "root")
    named = [f"{root}/x/y/", f"file://{root}/x/a.jsonl", f"{root}/gone.jsonl", f"{root}/gone/", str(tmp_path), f"{root}/x/y/b.jsonl", f"{root}x/a.jsonl"]
    found = inventory.scan_changed(spark, named, {"codex": root, "claude": None}).collect()
    assert sorted(os.path.relpath(r.file_path, root) for r in found) == ["x/a.jsonl", "x/y/b.jsonl"]
    assert {(r.size, r.source, r.file_id == r.file_path) for r in found} == {(3, "codex", True)}
    assert inventory.scan_changed(spark, [root], {"codex": root}).count() == 3
    frame = spark.createDataFrame([(f"{root}/z",)], "path string")
    assert [os.path.basename(r.file_path) for r in inventory.scan_changed(spark, frame, {"codex": root}).collect()] == ["d.jsonl"]
    assert inventory.scan_changed(spark, [], {"codex": root}).isEmpty()


@pytest.fixture(scope="module")
def card(spark):
    return rates.rate_card(rates.rate_rows(spark, {"m": (0.005, 0, None, 0.03), "m-long-context": (0.01, 0, None, 0.045)}))


def test_an_append_reads_its_own_bytes_and_equals_a_full_parse(spark, card, tmp_path):
    """Files grow line by line group; whatever the cut, the store holds what a first read of the whole gives."""
    rng = random.Random(11)
    roots = {"codex": str(tmp_path / "logs" / "codex"), "claude": str(tmp_path / "logs" / "claude")}
    texts = {tmp_path / "logs" / "codex" / f"{n}.jsonl": [json.dumps(i) for i in random_codex(rng, 60)] for n in "xy"}
    message = lambda i: {"model": "m", "usage": {"input_tokens": i + 1}, "content": [{"type": "tool_use", "name": "n"}] * rng.randint(0, 2)}
    texts[tmp_path / "logs" / "claude" / "z.jsonl"] = [
        json.dumps(assistant(rng.choice("pqr"), i, message=message(i), timestamp=rng.choice(["2024-01-05T10:00:00Z"] * 3 + [None]))) for i in range(40)
    ]
    store, options = UsageStore(spark, str(tmp_path / "tables")), RefreshOptions(roots)
    cuts = {path: sorted(rng.sample(range(20, len(lines)), 2)) for path, lines in texts.items()}
    for turn in range(3):
        added = 0
        for path, lines in texts.items():
            first, last = [0, *cuts[path], len(lines)][turn : turn + 2]
            write(path, lines[first:last], mode="a")
            added += sum(len(t.encode()) + 1 for t in lines[first:last])
        actions = {r.action for r in refresh.refresh(store, options, card, turn).collect()}
        assert actions == ({"firstRead"} if turn == 0 else {"append"})
        read = store.read("run_metrics").filter(F.col("run_utc") == turn).first().read_bytes
        assert added <= read <= added + 3  # the byte before each append tells that a line begins
    whole = UsageStore(spark, str(tmp_path / "whole"))
    refresh.refresh(whole, options, card, 9)
    for name in ("usage_record", "tool_event", "running_total", "rate_limit", "session", "carry", "file_state", "daily_rollup", "session_rollup"):
        got, want = (s.read(name) for s in (store, whole))
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), name
    assert store.read("usage_record").count() > 30 and consistent(store, card)


def test_one_hundredth_added_costs_one_hundredth(spark, card, tmp_path):
    path = tmp_path / "logs" / "a.jsonl"
    write(path, [assistant(f"r{i}", i, filler="x" * 800) for i in range(2_000)])
    store, options = UsageStore(spark, str(tmp_path / "tables")), RefreshOptions({"claude": str(path.parent)})
    refresh.refresh(store, options, card, 1)
    before = path.stat().st_size
    write(path, [assistant(f"s{i}", i, filler="x" * 800) for i in range(20)], mode="a")
    refresh.refresh(store, options, card, 2)
    read = {r.run_utc: r.read_bytes for r in store.read("run_metrics").collect()}
    assert read[1] == before and read[2] <= 0.0101 * before and store.read("usage_record").count() == 2_020


def test_a_grown_last_line_is_read_again(spark, card, tmp_path):
    path = tmp_path / "logs" / "a.jsonl"
    write(path, [assistant("r1", 1), '{"open'], end="")
    store, options = UsageStore(spark, str(tmp_path / "tables")), RefreshOptions({"claude": str(path.parent)})
    run = lambda now: refresh.refresh(store, options, card, now).first().action
    assert run(1) == "firstRead"
    with open(path, "a") as out:
        out.write('": 1}\n' + json.dumps(assistant("r3", 5)) + "\n")
    assert run(2) == "reingest" and store.read("usage_record").count() == 2 and consistent(store, card)


def test_a_file_is_opened_once_for_all_its_blocks(tmp_path, monkeypatch):
    """Tiny blocks of some files: one opening per file, few batches, every line with its offset."""
    rows, want, seen = [], [], []
    for n in range(3):
        path, at = str(tmp_path / f"{n}.jsonl"), 0
        texts = [f"{n}-{i} größe" for i in range(50)]
        (tmp_path / f"{n}.jsonl").write_text("".join(t + "\n" for t in texts))
        for text in texts:
            want.append((path, at, text))
            at += len(text.encode()) + 1
        rows += [{"source": "codex", "file_path": path, "start": s, "end": min(s + 16, at), "file_size": at} for s in range(0, at, 16)]
    real = ranges.opened
    monkeypatch.setattr(ranges, "opened", lambda path: seen.append(path) or real(path))
    batches = list(ranges._read(4_096, 7)(iter([pa.RecordBatch.from_pylist(rows)])))
    got = [(r["file_path"], r["line_offset"], r["value"]) for b in batches for r in b.to_pylist() if r["line_offset"] is not None]
    assert sorted(got) == sorted(want) and len(seen) == 3 and len(batches) == 1
    assert sum(r["read_bytes"] is not None for b in batches for r in b.to_pylist()) == len(rows)


def test_appended_lines_are_parsed_once(spark):
    """The filter on what a parse gives stays above it: below, it would hold the parse once for each field it names."""
    files = spark.createDataFrame([], "source string, file_path string, start long, file_size long")
    plan = resume.typed_both(ranges.read_ranges(files))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("from_json(") <= 2
