import json

from pyspark.sql import functions as F

from turnledger.operators import codex, logrows
from turnledger.plans import samples
from turnledger.sources import inventory, lines as line_source, ranges
from helpers import lines, offsets


def test_offsets_on_split_files(spark, tmp_path):
    """Multi-byte text, CR LF, empty lines and a missing final newline, read in many splits."""
    texts = [f"zeile {i} größe ✓ " + "x" * (i % 17) for i in range(80)]
    (tmp_path / "a+b c.jsonl").write_bytes("\n".join(texts).encode())
    crlf = [f"w{i}" for i in range(30)] + ["", "end"]
    (tmp_path / "crlf.jsonl").write_bytes(("\r\n".join(crlf) + "\r\n").encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        raw = line_source.read_lines(spark, [str(tmp_path)], "codex")
        assert raw.select("file_path", "chunk").distinct().count() > 10
        got = line_source.emitted_lines(raw).select(
            inventory.plain_path(F.col("file_path")).alias("p"), "line_offset", "line"
        ).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    plain = {(r.line_offset, r.line) for r in got if r.p == str(tmp_path / "a+b c.jsonl")}
    assert plain == set(zip(offsets(texts), texts, strict=True))
    windows = {(r.line_offset, r.line) for r in got if r.p.endswith("crlf.jsonl")}
    want = zip(offsets([t + "\r" for t in crlf]), crlf, strict=True)
    assert windows == {(o, t) for o, t in want if t}


def test_oversized_lines_are_counted_and_offsets_kept(spark):
    texts = ["a" * 10, "b" * 5000, "c"]
    frame = lines(spark, "codex", "/f", texts)
    counts = line_source.oversized_counts(frame, 1).first()  # raised to the minimum of 4096
    assert (counts.line_count, counts.oversized_count) == (3, 1)
    got = line_source.emitted_lines(frame, 4096).select("line_offset", "line").collect()
    assert sorted((r.line_offset, r.line[0]) for r in got) == [(0, "a"), (5012, "c")]


def test_incomplete_last_line_holds_the_file_back(spark):
    head = json.dumps({"type": "turn_context", "payload": {"model": "m"}})
    broken = '{"type":"event_msg","payload":{"type":"token_count"'
    size = len((head + "\n" + broken).encode())
    open_file = lines(spark, "codex", "/open", [head, broken], 1, size)
    closed = lines(spark, "codex", "/closed", [head, broken], 1, size + 1)
    tail_ok = lines(spark, "codex", "/ok", [broken, head], 1, size)
    rows = codex.rows(open_file.unionByName(closed).unionByName(tail_ok))
    assert [r.file_path for r in logrows.incomplete_files(rows).collect()] == ["/open"]
    kept = {r.file_path for r in logrows.without_incomplete(rows).select("file_path").distinct().collect()}
    assert kept == {"/closed", "/ok"}


def test_inventory(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "one.jsonl").write_text("{}\n")
    (tmp_path / "x" / "two.jsonl").write_text("{}\n{}\n")
    (tmp_path / "x" / "note.txt").write_text("no")
    root = str(tmp_path / "x")
    found = inventory.scan_roots(spark, {"codex": root, "claude": str(tmp_path / "missing")})
    assert sorted((r.file_path, r.size, r.source) for r in found.collect()) == [
        (f"{root}/two.jsonl", 6, "codex"), (f"{root}/y/one.jsonl", 3, "codex"),
    ]
    assert inventory.scan_roots(spark, {"codex": None}).count() == 0
    changed = inventory.scan_changed(spark, [f"{root}/y", "/elsewhere/a.jsonl", f"{root}/gone.jsonl"], {"codex": root})
    assert [r.file_path for r in changed.collect()] == [f"{root}/y/one.jsonl"]
    newest = found.agg(F.max("mtime_ms")).first()[0]
    later = newest + 31 * inventory.DAY_MS
    assert inventory.within_backfill(found, 1, later).count() == 0
    assert inventory.within_backfill(found, 0, later).count() == 2


def test_rendered_lines_are_made_once_behind_the_exchange(spark, tmp_path):
    """No filter on the rendered array is moved below the exchange, where few tasks read the compact table."""
    spark.range(40).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts", "id % 5 AS user_id", "'view' AS event_type", "1.5D AS value", "concat('{\"k\": ', id, '}') AS props"
    ).write.parquet(f"{tmp_path}/events.parquet")
    for source in ("codex", "claude"):
        lines = samples.unsized_log_lines(spark, str(tmp_path), source=source)
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert not any("Filter" in line and "get_json_object" in line for line in plan.splitlines()), source
        assert lines.count() > 40


def test_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Small bounds, so that several jobs go down the tree; the names are those that Spark's reader lists, and empty files."""
    monkeypatch.setattr(ranges, "ENTRIES", 5)
    for n in range(40):
        folder = tmp_path / f"a{n % 4}" / f"b{n % 3}" / "c"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{n} +%20.jsonl").write_text("x" * (n + 1))
    for name in ("_no.jsonl", ".no.jsonl", "_k=v.jsonl", "no.txt"):
        (tmp_path / "a0" / name).write_text("x")
    (tmp_path / "a1" / ".hidden").mkdir()
    (tmp_path / "a1" / ".hidden" / "no.jsonl").write_text("x")
    (tmp_path / "a1" / "gone.jsonl").symlink_to(tmp_path / "nowhere")
    root = str(tmp_path)
    names = ["file_path", "size", "mtime_ms"]
    want = {tuple(r[c] for c in names) for r in inventory._listing(spark, [root], "codex", inventory.LOG_GLOB).collect()}
    monkeypatch.setattr(inventory, "_listing", None)
    (tmp_path / "empty.jsonl").touch()
    got = inventory.scan_roots(spark, {"codex": f"file:{root}/", "claude": f"{root}/none"}).collect()
    assert len(want) == 41 and len(got) == 42
    assert {tuple(r[c] for c in names) for r in got if r.size} == want


def test_whole_files_are_as_sparks_reader_gives_them(spark, tmp_path):
    """Bytes that are no UTF-8, CR, empty lines, a long line and a missing last newline, in blocks that cut through them."""
    (tmp_path / "a b.jsonl").write_bytes(b"\xff\xfe1\r\n\n" + "größe\n".encode() * 9 + b"y" * 300 + b"\nlast")
    (tmp_path / "none.jsonl").write_bytes(b"")
    found = inventory.scan_roots(spark, {"codex": str(tmp_path)})
    mine = ranges.whole_files(found, block_bytes=7)
    spark_s = line_source.read_lines(spark, [str(tmp_path)], "codex").withColumn("file_path", inventory.plain_path(F.col("file_path")))
    shown = [
        sorted((r.file_path, r.line_offset, bytes(r.v), r.file_size) for r in line_source.with_offsets(lines).select("*", F.col("value").cast("binary").alias("v")).collect())
        for lines in (mine, spark_s)
    ]
    assert len(shown[0]) == 13 and shown[0] == shown[1]
